"""Web archives: Zstandard WARC files, one frame a record, dictionary in front.

An archive is a Zstandard stream. Its first frame is a skippable one (magic
0x184D2A5D) with the dictionary; then each record is a frame of its own,
compressed with that dictionary. A task trains the dictionary on the first
records of each archive (at most ``SAMPLES``) and closes an archive at
``archive_bytes`` of payload, so no archive grows with the corpus.

Archives are files in the shared folder: each is a row of Spark's text sink
with a file of its own, whose line end is an empty skippable frame. The reader
takes files with the binaryFile source, loads the dictionary, decodes one frame
per record and checks the version line, the mandatory headers, the block's
length, the closing line ends and the block's and payload's digests. Archives of
others may leave out optional fields, use any record ids and hold chunked bodies. A record
that fails raises ``ValueError`` and with it the job.

Of pages with equal payloads of ``revisit_bytes`` bytes or more, that with the
smallest page_id is a response, others are revisits whose block keeps the HTTP
header, with the payload's length, and refers to it.

Defined results: a null html is an empty payload; a null url is
``urn:x-unknown``; a null page_id ranks after all others and is written as
``none``, so it is a response only where no page with its payload has an id; rows
that repeat page_id and payload are alike; an empty table writes no archive and
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, new_folder

DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # skippable frame 0x184D2A50 of size 0
FULL_DICTIONARY = 0xEC30A437
SAMPLES = 200
DICTIONARY_BYTES = 16_384
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None) -> bytes:
    """A response, or a revisit of ``first_id`` if that is given."""
    head = HTTP % len(payload)
    block = head + (b"" if first_id is not None else payload)
    uri = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "urn:x-unknown"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>",
        "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{sha1_32(block)}",
        f"WARC-Payload-Digest: sha1:{sha1_32(payload)}",
    ]
    if first_id is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{first_id}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def make_archive(records: list[bytes]) -> bytes:
    samples = records[:SAMPLES]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        raw = dictionary.as_bytes()
        if zstandard.ZstdCompressionDict(raw).dict_id() == 0:
            raise zstandard.ZstdError("no trained dictionary")
    except (zstandard.ZstdError, MemoryError):  # too few or too small records to train on: their own bytes serve
        raw = samples[0][:DICTIONARY_BYTES]
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frames = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(map(frames.compress, records))


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends."""
    params = zstandard.get_frame_parameters(data[at : at + 18])
    end = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if end + 3 > len(data):
            raise ValueError("archive ends within a frame")
        head = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
        if head & 1:
            break
    end += 4 * params.has_checksum
    if end > len(data):
        raise ValueError("archive ends within a frame")
    return end


def read_frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, each decoded from its own frame."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise ValueError("archive without a dictionary in front")
    size = struct.unpack_from("<I", data, 4)[0]
    raw = data[8 : 8 + size]
    if len(raw) != size:
        raise ValueError("dictionary is cut off")
    if raw[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
        try:
            raw = zstandard.ZstdDecompressor().decompress(raw)  # a dictionary may be compressed itself
        except zstandard.ZstdError as e:
            raise ValueError("the dictionary can't be decoded") from e
    full = raw[:4] == struct.pack("<I", FULL_DICTIONARY)
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)
    frames, at = zstandard.ZstdDecompressor(dict_data=dictionary), 8 + size
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("archive ends within a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic >> 4 == 0x184D2A5:
            at += 8 + size
            continue
        try:
            end = frame_end(data, at)
            record = frames.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise ValueError("a frame can't be decoded") from e
        yield record
        at = end


def header_fields(lines: list[str]) -> dict[str, str]:
    """Named fields by lower-case name; a line that begins with white space goes on the one before, and of repeated names the first counts."""
    whole: list[str] = []
    for line in lines:
        if line[:1] in (" ", "\t") and whole:
            whole[-1] += " " + line.strip()
        else:
            whole.append(line)
    fields: dict[str, str] = {}
    for line in whole:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"malformed header {line!r}")
        fields.setdefault(name.strip().lower(), value.strip())
    return fields


def unchunked(body: bytes) -> bytes:
    """The bytes of a body in HTTP's chunked coding."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("malformed chunk")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
        if body[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk's length differs")


def check_digest(stated: str | None, what: str, *ways: bytes) -> None:
    """Whether a stated SHA-1, in base 32 or hexadecimal, is that of any of the ``ways`` to take the bytes; other algorithms are not checked."""
    name, _, value = (stated or "").partition(":")
    if name.lower() != "sha1":
        return
    known = [f(hashlib.sha1(w).digest()).decode() for w in ways for f in (base64.b32encode, base64.b16encode)]
    if value.upper() not in known:
        raise ValueError(f"the {what}'s digest differs")


def number(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise ValueError(f"not a length: {text!r}")
    return int(text)


def parse_record(record: bytes) -> dict:
    """Headers and payload of a record, validated; whatever is wrong is a ValueError.

    Of a response or revisit: payload (bytes, without HTTP's header and chunks),
    payload_bytes (of a revisit what its header states, null if it does not) and
    digest (as stated, else computed; of a revisit null if it is not stated).
    Records marked as truncated may be shorter than they state.
    """
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line")
    headers = header_fields(lines[1:])
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing:
        raise ValueError(f"headers are missing: {sorted(missing)}")
    length = number(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    block = rest[:length]
    check_digest(headers.get("warc-block-digest"), "block", block)
    out = {"headers": headers, "type": headers["warc-type"]}
    if out["type"] not in ("response", "revisit"):
        return out
    revisit, whole = out["type"] == "revisit", "warc-truncated" not in headers
    size, coding, payload = None, "", block
    if block.startswith(b"HTTP/"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep and whole and not revisit:
            raise ValueError("no end of the HTTP header")
        fields = header_fields(http.decode("latin-1").split("\r\n")[1:])
        coding = fields.get("transfer-encoding", "").lower()
        size = number(fields["content-length"]) if "content-length" in fields and "chunked" not in coding else None
    elif not revisit and "application/http" in headers.get("content-type", "").lower():
        raise ValueError("no HTTP header")
    if revisit and payload.strip():
        raise ValueError("a revisit with a payload")
    raw = payload
    if not revisit and "chunked" in coding and whole:
        payload = unchunked(raw)
    if not revisit and whole:
        if size is not None and size != len(payload):
            raise ValueError("the payload's length differs")
        check_digest(headers.get("warc-payload-digest"), "payload", payload, raw)  # archives differ in which they take
    stated = headers.get("warc-payload-digest", "")
    out["digest"] = stated.removeprefix("sha1:") or (None if revisit else sha1_32(payload))
    out["payload_bytes"] = size if revisit else len(payload)
    out["payload"] = payload
    return out


def page_of(urn: str | None) -> int | None:
    """The page_id in a record id of :func:`make_record`; null for other ids."""
    name, _, value = (urn or "").strip("<>").rpartition(":")
    return int(value) if name == "urn:x-page" and value.lstrip("-").isdigit() else None


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 0, archive_bytes: int = 16 << 20) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives under ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    bounded_batches(pages.sparkSession)
    # Groups are combined before they are shuffled, and only their digests are. The join splits a hot digest.
    firsts = cut(rows.filter(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    with_first = rows.join(firsts, ["digest", "size"], "left")
    # A revisit's payload is needed for its length and digest only, which the record takes from the row.
    records = with_first.select("page_id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, first = (batch.column(j)[i].as_py() for j in range(4))
                records.append(make_record(page_id, url, payload, first))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([make_archive(records)], pa.binary())], names=["value"])
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([make_archive(records)], pa.binary())], names=["value"])

    archives = records.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, refers_to_id string"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The responses and revisits of all archives under ``path``, validated; a revisit's payload is null.

    page_id and refers_to are null in archives that :func:`write_archives` did not
    write; record_id and refers_to_id are the ids as they stand. An archive is read
    by one task and has 2 GB at most, as Spark's binary files have.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns: list[list] = [[] for _ in range(9)]
                for record in read_frames(batch.column(0)[i].as_py() or b"") if batch.column(0)[i].as_py() else ():
                    got = parse_record(record)
                    if got["type"] not in ("response", "revisit"):
                        continue
                    h = got["headers"]
                    revisit = got["type"] == "revisit"
                    row = (page_of(h["warc-record-id"]), h.get("warc-target-uri"), got["type"], page_of(h.get("warc-refers-to")), got["payload_bytes"], got["digest"], None if revisit or not payloads else got["payload"], h["warc-record-id"], h.get("warc-refers-to"))
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path, revisit_bytes)
    return read_archives(spark, path, payloads=False)
