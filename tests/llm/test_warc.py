"""Records that others write: optional fields, chunked bodies, any ids; and what is wrong with a record."""

import base64
import hashlib
import uuid

import pytest

from shopsift.llm import warc


def record(block, kind="response", own=None, **fields):
    named = {"WARC-Type": kind, "WARC-Record-ID": own or f"<urn:uuid:{uuid.UUID(int=7)}>", "WARC-Date": "2024-01-01T00:00:00Z"} | fields
    lines = ["WARC/1.0", *[f"{k}: {v}" for k, v in named.items() if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(payload, *fields):
    return b"\r\n".join([b"HTTP/1.1 200 OK", *fields]) + b"\r\n\r\n" + payload


def sha1(data, code=base64.b32encode):
    return "sha1:" + code(hashlib.sha1(data).digest()).decode()


CHUNKED = b"4;x=1\r\nabcd\r\n3\r\nefg\r\n0\r\n\r\n"


@pytest.mark.parametrize(
    "data,size,payload",
    [
        (record(http(b"hello")), 5, b"hello"),
        (record(http(b"hello", b"Content-Length: 5"), **{"WARC-Payload-Digest": sha1(b"hello", base64.b16encode)}), 5, b"hello"),
        (record(http(CHUNKED, b"Transfer-Encoding: chunked")), 7, b"abcdefg"),
        (record(http(CHUNKED, b"Transfer-Encoding: chunked", b"Content-Length: 99"), **{"WARC-Payload-Digest": sha1(CHUNKED)}), 7, b"abcdefg"),
        (record(http(CHUNKED, b"transfer-encoding: Chunked"), **{"WARC-Payload-Digest": sha1(b"abcdefg")}), 7, b"abcdefg"),
        (record(http(b"x", b"A: 1", b" folded", b"Content-Length: 1"), **{"WARC-Payload-Digest": "sha256:abc"}), 1, b"x"),
        (record(b"20240101 dns", **{"Content-Type": "text/dns"}), 12, b"20240101 dns"),
        (record(http(b"cut", b"Content-Length: 300"), **{"WARC-Truncated": "length", "WARC-Payload-Digest": sha1(b"whole")}), 3, b"cut"),
        (record(http(b"", b"Content-Length: 44"), "revisit", **{"WARC-Payload-Digest": sha1(b"other")}), 44, b""),
        (record(b"", "revisit"), None, b""),
    ],
)
def test_foreign_records(data, size, payload):
    got = warc.parse_record(data)
    assert (got["payload_bytes"], got["payload"]) == (size, payload)
    assert warc.page_of(got["headers"]["warc-record-id"]) is None
    if got["type"] == "response" and "warc-payload-digest" not in got["headers"]:
        assert got["digest"] == warc.sha1_32(payload)


@pytest.mark.parametrize(
    "data",
    [
        b"", b"WARC/1.0", b"HTTP/1.1 200 OK\r\n\r\n", record(http(b"x", b"Content-Length: 2")), record(http(b"x", b"Content-Length: -1")), record(http(b"x", b"Content-Length: 1x")),
        record(http(b"x"), **{"WARC-Payload-Digest": sha1(b"y")}), record(http(b"x"), **{"WARC-Block-Digest": sha1(b"y")}), record(http(b"zz\r\nabc", b"Transfer-Encoding: chunked")), record(http(b"9\r\nabc\r\n0\r\n\r\n", b"Transfer-Encoding: chunked")),
        record(b"no header", **{"Content-Type": "application/http"}), record(http(b"body"), "revisit"), record(http(b"x"), own="x", **{"WARC-Date": None}), record(http(b"x"))[:-1], record(http(b"x")).replace(b"WARC-Date:", b"WARC-Date"),
        record(http(b"x")).replace(b"Content-Length: ", b"Content-Length: \xb2"), record(http(b"x")).replace(b"WARC-Type", b"\xff\xfe"),
    ],
)
def test_bad_records_are_value_errors(data):
    with pytest.raises(ValueError):
        warc.parse_record(data)


def test_foreign_archive(spark, tmp_path):
    records = [record(http(f"page {k} ".encode() * 30), own=f"<urn:uuid:{uuid.UUID(int=k)}>") for k in range(20)]
    records += [record(b"", "warcinfo"), record(http(b"", b"Content-Length: 9"), "revisit", **{"WARC-Refers-To": f"<urn:uuid:{uuid.UUID(int=3)}>"})]
    (tmp_path / "a.warc.zst").write_bytes(warc.make_archive(records))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert len(got) == 21 and {r.page_id for r in got} == {None} and {r.payload for r in got} == {f"page {k} ".encode() * 30 for k in range(20)} | {None}
    assert [(r.refers_to, r.refers_to_id, r.payload_bytes) for r in got if r.record_type == "revisit"] == [(None, f"<urn:uuid:{uuid.UUID(int=3)}>", 9)]
    assert [r.record_id for r in got][:2] == [f"<urn:uuid:{uuid.UUID(int=k)}>" for k in range(2)]
