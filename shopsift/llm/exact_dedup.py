"""Exact duplicates by a minimal perfect hash over historical digests.

Texts are equal when identical after deleting ASCII white space; the digest is
the SHA-256 of that normal form. Distinct digests of the historical rows are
split by a hash into shards of bounded size. For each shard a minimal perfect
hash (levels of collision-free bits, ranked by population counts) maps every
digest to its own slot, which holds the full digest, the winner's locator
(doc_id and length) and the group's size. Other rows are first grouped by
digest; each distinct digest probes its shard's slot and the 32 bytes there are
compared, so a digest that is no member is never taken for one. Members join
the historical group, nonmembers are groups of their own.

All shuffles carry (digest, doc_id, length) and never texts; grouping combines
before it shuffles, so a text that a third of all rows share costs one row a
task. A shard holds about ``shard_keys`` digests whatever the corpus.

Defined results: null counts as the empty text; of equal texts the row with
most code points, then the smallest doc_id, stays, and null ids rank last; rows
that repeat a doc_id, or have none, are all returned with that doc_id's fate; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

GAMMA = 2.0
LEVELS = 48


def normal_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text without ASCII white space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", ""), 256))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digests).view("<u8").reshape(len(digests), 4)
    return words[:, 0] ^ words[:, 2], words[:, 1] ^ words[:, 3]


class PerfectHash:
    """A minimal perfect hash for distinct 32-byte digests."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = np.frombuffer(np.packbits(bits, bitorder="little").tobytes().ljust(-(-len(bits) // 64) * 8, b"\0"), "<u8")
        self.words = words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.n_bits = int(self.ranks[-1])

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        a, b = _halves(digests)
        left = np.arange(len(digests))
        sizes, levels = [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = (_mix(a[left], 2 * level + 1) + b[left] * np.uint64(2 * level + 1)) % np.uint64(size)
            hits = np.bincount(at.astype(np.int64), minlength=size)
            levels.append(hits == 1)
            sizes.append(size)
            left = left[hits[at.astype(np.int64)] != 1]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        rest = digests[left]  # keys that every level left over: found by comparing, after the ranked slots
        return cls(np.array(sizes, np.int64), bits, rest)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for each digest; -1 where no level claims it. A nonmember may get a member's slot."""
        out = np.full(len(digests), -1, np.int64)
        a, b = _halves(digests)
        left = np.arange(len(digests))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = ((_mix(a[left], 2 * level + 1) + b[left] * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.ranks[word] + below)[hit]
            left = left[~hit]
        if len(self.rest):
            place = {d.tobytes(): self.n_bits + i for i, d in enumerate(self.rest)}
            for i in left:
                out[i] = place.get(digests[i].tobytes(), -1)
        return out


def _digests(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 32)


INDEX = "shard long, n long, sizes binary, bits binary, rest binary, digests binary, winners binary, missing binary, points binary, counts binary"


def _build(key: tuple, table: pa.Table) -> pa.Table:
    digests = _digests(table.column("digest"))
    mph = PerfectHash.build(digests)
    order = np.empty(len(digests), np.int64)
    order[mph.slots(digests)] = np.arange(len(digests))
    column = lambda n: table.column(n).fill_null(0).to_numpy()[order].astype("<i8").tobytes()
    missing = table.column("winner").is_null().to_numpy()[order].tobytes()
    values = [key[0].as_py(), len(digests), mph.sizes.astype("<i8").tobytes(), np.packbits(mph.bits, bitorder="little").tobytes(), mph.rest.tobytes(), digests[order].tobytes(), column("winner"), missing, column("points"), column("n")]
    types = [pa.int64(), pa.int64()] + [pa.binary()] * 8
    return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, winner, points, n) of each distinct digest; a null id wins only where no other row has as many points."""
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n")).select("digest", F.col("best.doc_id").alias("winner"), (-F.col("best.p")).alias("points"), "n")


def with_shard(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard with the perfect hash and its slots; may be written and used again.

    ``history``: rows of (digest, doc_id, points).
    """
    return with_shard(grouped(history), shards).groupBy("shard").applyInArrow(_build, INDEX)


def _probe(key: tuple, new: pa.Table, index: pa.Table) -> pa.Table:
    shard = index.to_pylist()
    new_digests = _digests(new.column("digest")) if new.num_rows else np.zeros((0, 32), np.uint8)
    ints = {c: new.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("winner", "points", "n")}
    none = new.column("winner").is_null().to_numpy().astype(bool)
    if shard:
        row = shard[0]
        sizes = np.frombuffer(row["sizes"], "<i8")
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")[: int(sizes.sum())].astype(bool)
        mph = PerfectHash(sizes, bits, np.frombuffer(row["rest"], np.uint8).reshape(-1, 32))
        digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winner, points, counts = (np.frombuffer(row[c], "<i8").copy() for c in ("winners", "points", "counts"))
        missing = np.frombuffer(row["missing"], bool).copy()
        slot = mph.slots(new_digests)
        member = slot >= 0
        member[member] = (digests[slot[member]] == new_digests[member]).all(1)
        at = slot[member]  # probes are distinct digests, so no slot comes twice
        before = (none[member] < missing[at]) | ((none[member] == missing[at]) & (ints["winner"][member] < winner[at]))
        better = (ints["points"][member] > points[at]) | ((ints["points"][member] == points[at]) & before)
        winner[at] = np.where(better, ints["winner"][member], winner[at])
        missing[at] = np.where(better, none[member], missing[at])
        points[at] = np.where(better, ints["points"][member], points[at])
        counts[at] += ints["n"][member]
        fresh = ~member
    else:
        digests, winner, missing, counts = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        fresh = np.ones(len(new_digests), bool)
    all_digests = np.concatenate([digests, new_digests[fresh]])
    known = np.concatenate([np.ones(len(digests), bool), np.zeros(int(fresh.sum()), bool)])
    return pa.table({
        "digest": pa.array([d.tobytes() for d in all_digests], pa.binary()),
        "keep_id": pa.array(np.concatenate([winner, ints["winner"][fresh]]), pa.int64(), mask=np.concatenate([missing, none[fresh]])),
        "group_size": pa.array(np.concatenate([counts, ints["n"][fresh]]), pa.int64()),
        "historical": pa.array(known, pa.bool_()),
    })


def look_up(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size, historical) over the index and the new rows (digest, doc_id, points)."""
    probes = with_shard(grouped(new), shards)
    return probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "digest binary, keep_id long, group_size long, historical boolean")


def exact_duplicates(docs: DataFrame, historical: Column | None = None, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = 100_000) -> DataFrame:
    """One row an input row: doc_id, keep_id, group_size, kept, text_sha256, historical.

    ``historical`` tells the rows that the index is built over; by default the
    half with even ``crc32(doc_id)``. The result does not depend on it.
    """
    spark = docs.sparkSession
    if historical is None:
        historical = F.crc32(F.col(id_col).cast("string")) % 2 == 0
    rows = cut(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
        normal_digest(F.col(text_col)).alias("digest"),
        F.coalesce(historical, F.lit(False)).alias("old"),
    ))
    most = rows.count()  # at least the number of distinct digests
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // shard_keys))
    index = build_index(rows.filter("old"), shards)
    winners = look_up(rows.filter(~F.col("old")), index, shards)
    # A digest that many rows share is one key of this join; adaptive execution splits it.
    return rows.join(winners, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "historical"
    )


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of equal texts one row.

    It is the one with most code points, then the smallest doc_id, a null id last;
    of rows that repeat that id with an equal text, the longest and then smallest
    text. Rows are known by id and digest together, so those that share an id but
    not the text stay or go each for itself.
    """
    kept = cut(exact_duplicates(docs).filter("kept").groupBy("text_sha256", "doc_id").count())
    mark = "__" + "_" * max(map(len, docs.columns))
    digest, own = f"{mark}digest", f"{mark}own"
    winners = kept.select(F.unhex("text_sha256").alias(digest), F.col("doc_id").alias(own), "count")
    rows = docs.withColumn(digest, normal_digest(F.col("text")))
    same = lambda some: (rows[digest] == some[digest]) & rows["doc_id"].cast("long").eqNullSafe(some[own])
    once = winners.filter("count = 1")
    stay = rows.join(once, same(once), "left_semi").select(*docs.columns)
    several = winners.filter("count > 1")
    if several.isEmpty():
        return stay
    row = F.struct(*docs.columns).alias(f"{mark}row")
    order = F.struct((-F.char_length(F.coalesce("text", F.lit("")))).alias("p"), F.coalesce("text", F.lit("")).alias("t"), F.to_json(F.struct(*docs.columns)).alias("j"))
    best = rows.join(several, same(several), "left_semi").groupBy(digest).agg(F.min_by(row, order).alias(f"{mark}row"))
    return stay.unionByName(best.select(*[F.col(f"{mark}row")[c].alias(c) for c in docs.columns]))
