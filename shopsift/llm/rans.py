"""Token ids in files of interleaved range asymmetric numeral systems.

A file holds the ids of consecutive documents, at most ``FILE_TOKENS`` (a
longer document has a file of its own). Its blocks of ``BLOCK`` ids share one static frequency
table over the ids that occur, quantised to ``2**SCALE``. A block deals its ids
to ``LANES`` interleaved coders, which renormalise by 32-bit words into one
stream a block; blocks are independent, and within a block the coders' states
and the place in the stream are stored every ``EVERY`` steps, so decoding may
start at any block or checkpoint. Checksums cover each block's ids and bytes.

Coders of all blocks advance in lockstep as numpy vectors. Documents are dealt
to range partitions by doc_id and the text's beginning; files are rows of Spark's text sink with a
file each; the number of partitions follows the texts' total length.

Defined results: a null text is empty and has the end id alone; an added token
that a text spells out has its own id, as in the library's plain call; rows that
repeat a doc_id stand one after another, ordered by text; a null doc_id comes
first; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import worker_encoder
from .common import bounded_batches, cut, give_back, new_folder

MAGIC = b"RANSID01"
SCALE = 18
LOW = np.uint64(1 << 31)
LANES, STEPS, EVERY = 256, 1024, 256
BLOCK = LANES * STEPS
FILE_TOKENS = 16 * BLOCK
#: Bytes of texts that are encoded together, and of a partition at most; a file is written as soon as it is full.
PARTITION_BYTES, MOST_BYTES = 16_000_000, 256_000_000
LEAD = 16


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur, ascending, and frequencies of 1 or more that sum to ``2**SCALE``."""
    counts = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    symbols = np.flatnonzero(counts)
    if len(symbols) > 1 << SCALE:
        raise ValueError("more symbols than the table has slots")
    counts = counts[symbols].astype(np.float64)
    freqs = np.maximum(1, np.floor(counts / counts.sum() * (1 << SCALE))).astype(np.int64)
    off = (1 << SCALE) - int(freqs.sum())
    if off > 0:
        freqs[np.argmax(freqs)] += off
    while off < 0:  # rare symbols were lifted to 1: take from the largest, in proportion
        room = freqs - 1
        take = np.minimum(room, np.ceil(room * (-off / room.sum())).astype(np.int64))
        over = np.cumsum(take)
        take = np.where(over <= -off, take, np.maximum(0, take - (over + off)))
        freqs -= take
        off = (1 << SCALE) - int(freqs.sum())
    return symbols.astype(np.uint32), freqs.astype(np.uint32)


def _encode(dealt: np.ndarray, start: np.ndarray, freq: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``dealt``: blocks x steps x lanes of symbol indexes. For each block: stream, checkpoints' places, their states."""
    blocks, steps, lanes = dealt.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    top = freq << np.uint64(63 - SCALE)  # the state may not reach this before a symbol is put
    words, masks, states = [], [], []
    bits, down = np.uint64(SCALE), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        s = dealt[:, t, :]
        f = freq[s]
        full = x >= top[s]
        words.append(x[full].astype(np.uint32))
        masks.append(full)
        x = np.where(full, x >> down, x)
        q = x // f
        x = (q << bits) + (x - q * f) + start[s]
        if t % EVERY == 0:
            states.append(x.copy())
    words.reverse(), masks.reverse(), states.reverse()
    per_step = np.stack([m.sum(1) for m in masks])  # steps x blocks
    block_of = np.concatenate([np.repeat(np.arange(blocks), n) for n in per_step])
    flat = np.concatenate(words)[np.argsort(block_of, kind="stable")]
    ends = np.cumsum(per_step.sum(0))
    places = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(per_step, 0)])[0:steps:EVERY]
    state = np.stack(states, 1)  # blocks x checkpoints x lanes
    return [(flat[ends[b] - per_step[:, b].sum() : ends[b]], places[:, b].astype(np.uint32), state[b]) for b in range(blocks)]


def _decode(x: np.ndarray, stream: np.ndarray, at: np.ndarray, steps: int, slot: np.ndarray, start: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """``x``: blocks x lanes of states; ``at``: each block's place in ``stream``."""
    blocks, lanes = x.shape
    out = np.empty((blocks, steps, lanes), np.int32)
    mask, bits, up = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    x, at = x.copy(), at.astype(np.int64).copy()
    for t in range(steps):
        low = x & mask
        s = slot[low]
        out[:, t, :] = s
        x = freq[s] * (x >> bits) + low - start[s]
        need = x < LOW
        rank = need.cumsum(1)
        took = (at[:, None] + rank - 1)[need]
        if len(took):
            x[need] = (x[need] << up) | stream[took].astype(np.uint64)
        at += rank[:, -1]
    return out


def _pack(parts: list[bytes]) -> bytes:
    return b"".join(struct.pack("<Q", len(p)) + p for p in parts)


def _unpack(data: bytes, at: int, n: int) -> tuple[list[bytes], int]:
    parts = []
    for _ in range(n):
        (size,) = struct.unpack_from("<Q", data, at)
        parts.append(data[at + 8 : at + 8 + size])
        if len(parts[-1]) != size:
            raise ValueError("the file is cut off")
        at += 8 + size
    return parts, at


def _deal(ids: np.ndarray) -> list[np.ndarray]:
    """Blocks x steps x lanes: the full blocks, then the last one, filled up with its first id."""
    full = len(ids) // BLOCK
    out = [ids[: full * BLOCK].reshape(full, STEPS, LANES)] if full else []
    rest = ids[full * BLOCK :]
    if len(rest):
        steps = -(-len(rest) // LANES)
        out.append(np.concatenate([rest, np.full(steps * LANES - len(rest), rest[0], rest.dtype)]).reshape(1, steps, LANES))
    return out


def make_file(partition: int, number: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, freqs = frequency_table(ids)
    index = np.zeros(int(symbols[-1]) + 1, np.int32) if len(symbols) else np.zeros(1, np.int32)
    index[symbols] = np.arange(len(symbols))
    freq = freqs.astype(np.uint64)
    start = np.cumsum(freq) - freq
    blocks = [b for dealt in _deal(index[ids]) for b in _encode(dealt, start, freq)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        struct.pack("<qqqq", partition, number, len(ids), len(blocks)),
        zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes(), 1),
        zlib.compress(lengths.astype("<i8").tobytes(), 1),
        zlib.compress(symbols.astype("<u4").tobytes() + freqs.astype("<u4").tobytes(), 1),
    ]
    for b, (stream, places, state) in enumerate(blocks):
        own = ids[b * BLOCK : (b + 1) * BLOCK]
        body = [stream.astype("<u4").tobytes(), places.astype("<u4").tobytes(), state.astype("<u8").tobytes()]
        parts += [struct.pack("<qII", len(own), zlib.crc32(own.astype("<u4").tobytes()), zlib.crc32(b"".join(body))), *body]
    return MAGIC + _pack(parts)


class IdFile:
    """A file's documents and blocks; blocks decode on their own."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        (head, docs, lengths, table), at = _unpack(data, 8, 4)
        self.partition, self.number, self.n_tokens, n_blocks = struct.unpack("<qqqq", head)
        raw = zlib.decompress(docs)
        n = len(raw) // 9
        known = np.frombuffer(raw, np.uint8, offset=8 * n)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(raw, "<i8", n), known, strict=True)]
        self.lengths = np.frombuffer(zlib.decompress(lengths), "<i8")
        table = np.frombuffer(zlib.decompress(table), "<u4")
        self.symbols, freqs = table[: len(table) // 2].astype(np.int64), table[len(table) // 2 :]
        self.freq = freqs.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(freqs), dtype=np.int32), freqs.astype(np.int64))
        self.blocks = []
        for _ in range(n_blocks):
            (info, *body), at = _unpack(data, at, 4)
            size, ids_crc, crc = struct.unpack("<qII", info)
            if zlib.crc32(b"".join(body)) != crc:
                raise ValueError("a block's bytes differ from their checksum")
            self.blocks.append((size, ids_crc, np.frombuffer(body[0], "<u4"), np.frombuffer(body[1], "<u4"), np.frombuffer(body[2], "<u8").reshape(-1, LANES)))

    def block(self, b: int, checkpoint: int = 0) -> np.ndarray:
        """Ids of block ``b`` from one of its checkpoints on; they stand every EVERY * LANES ids."""
        return self._some([b], checkpoint)[0]

    def _some(self, which: list[int], checkpoint: int = 0) -> list[np.ndarray]:
        sizes = [self.blocks[b][0] for b in which]
        steps = -(-sizes[0] // LANES) - checkpoint * EVERY
        streams = [self.blocks[b][2] for b in which]
        base = np.cumsum([0] + [len(s) for s in streams])[:-1]
        at = base + np.array([self.blocks[b][3][checkpoint] for b in which], np.int64)
        x = np.stack([self.blocks[b][4][checkpoint] for b in which])
        got = _decode(x, np.concatenate(streams), at, steps, self.slot, self.start, self.freq)
        out = [self.symbols[g.reshape(-1)[: n - checkpoint * EVERY * LANES]].astype("<u4") for g, n in zip(got, sizes, strict=True)]
        if checkpoint == 0:
            for b, ids in zip(which, out, strict=True):
                if zlib.crc32(ids.tobytes()) != self.blocks[b][1]:
                    raise ValueError("a block's ids differ from their checksum")
        return out

    def ids(self) -> np.ndarray:
        full = [b for b, block in enumerate(self.blocks) if block[0] == BLOCK]
        rest = [b for b, block in enumerate(self.blocks) if block[0] != BLOCK]
        out = self._some(full) if full else []
        for b in rest:
            out += self._some([b])
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def gathered(batches: Iterator[pa.RecordBatch], most: int = PARTITION_BYTES) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of batches of (id, text), several at a time, of about ``most`` bytes."""
    names, texts, size = [], [], 0
    for batch in batches:
        names += batch.column(0).to_pylist()
        texts.append(batch.column(1))
        size += batch.column(1).nbytes
        if size >= most:
            yield names, pa.concat_arrays(texts)
            names, texts, size = [], [], 0
    if names:
        yield names, pa.concat_arrays(texts)


def partitions(size: int, cores: int) -> int:
    """Of how many partitions texts of ``size`` bytes are: a task encodes its distinct pieces once, so no more than eight a core until they have ``MOST_BYTES``."""
    return max(cores, min(-(-size // PARTITION_BYTES), 8 * cores), -(-size // MOST_BYTES))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write files under ``path`` in ascending order of doc_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = partitions(chars, rows.sparkSession.sparkContext.defaultParallelism)
    # Where many rows share an id, or have none, the texts' beginnings part them; Spark samples 1,000,000 of either at most.
    lead = F.substring("text", 1, LEAD).alias("lead")
    ordered = rows.select("*", lead).repartitionByRange(parts, "doc_id", "lead").drop("lead").sortWithinPartitions("doc_id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        partition, number, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4")
        docs, runs, size = [], [], 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(r) + 1 for r in runs], np.int64)
            data = make_file(partition, number, docs, lengths, np.concatenate([x for r in runs for x in (r, end)]))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for names, texts in gathered(batches):
            many, ids = encoder.encode(texts)
            stops = np.cumsum(many).tolist()
            for doc, lo, hi in zip(names, [0, *stops], stops, strict=False):
                if size and size + hi - lo + 1 > FILE_TOKENS:
                    yield close()
                    docs, runs, size, number = [], [], 0, number + 1
                docs.append(doc)
                runs.append(ids[lo:hi])
                size += hi - lo + 1
        if docs:
            yield close()
        give_back()

    bounded_batches(rows.sparkSession)
    files = ordered.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(partition, number, place, doc_id, local_start, n_tokens, ids_crc32, ids) of each document in the files."""
    schema = "partition long, number long, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = IdFile(batch.column(0)[i].as_py())
                ids, n = file.ids(), len(file.doc_ids)
                if len(ids) != file.n_tokens or int(file.lengths.sum()) != file.n_tokens:
                    raise ValueError("the file's lengths differ")
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(n, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, file.partition)), pa.array(np.full(n, file.number)), pa.array(np.arange(n)), pa.array(file.doc_ids, pa.int64()), pa.array(starts), pa.array(file.lengths), pa.array(crcs, pa.int64()), own],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def id_round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: write the ids in order, then read the files back."""
    spark = docs.sparkSession
    path = new_folder(spark, "ids")
    write_ids(docs, path, tokenizer, end_id)
    found = cut(read_ids(spark, path, with_ids=False).drop("ids"))
    # Files are put in order within their partition, and one row a partition, each of up to MOST_BYTES, in one place.
    files = found.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = files.groupBy("partition").agg(F.sum("n").alias("n"))
    first = totals.select("partition", before(Window.orderBy("partition")).alias("first"))
    within = files.select("partition", "number", before(Window.partitionBy("partition").orderBy("number")).alias("within"))
    bases = within.join(first, "partition").select("partition", "number", (F.col("first") + F.col("within")).alias("base"))
    return found.join(bases, ["partition", "number"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
