"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles of ``SHINGLE`` words, as 64-bit
hashes. Its sketch has ``BINS`` coordinates: in round i every element goes to a
random bin with the value i + hash, and a bin keeps its smallest; after
``BINS`` rounds, round ``BINS + j`` puts every element into bin j, so every
coordinate fills. Two sets agree in a coordinate with a probability of their
Jaccard similarity, as concentrated as with independent hashing. Bands of
``ROWS`` coordinates are bucket keys: of pairs at the threshold 0.8, one in 2e7
shares no bucket.

Documents with equal sets are one class, and only one row a class goes on. In a
bucket of few classes all pairs are candidates, in a larger one the pairs with
its smallest class. Candidates are confirmed on full sets. Then pairs of
different components that share a larger bucket remain; pairs within a component
could add nothing. They come from an exact prefix join over the sets of all
classes in buckets of several components (:func:`residual_pairs`) and are
confirmed likewise; nothing is capped.

Defined results: null or blank texts have an empty set, size 0, and are linked
with nothing; a text of fewer words than a shingle has one shingle; rows that
repeat a doc_id count as one document; a null doc_id takes its class's
component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, per_batch, texts_of

SHINGLE = 5
SIMILARITY = 80  # in hundredths
BINS, ROWS = 128, 4
FEW = 4
SMALL_ITEMS = 2_000_000  # shingles of the sets that may be broadcast
MEMO = 200_000
SEEDS = (np.arange(1, 2 * 1024 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
NONE = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, of which a task remembers a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, size: int, memo: WordHashes) -> np.ndarray:
    """The distinct shingles of a text, sorted; words are split at ASCII white space, A-Z lower-cased."""
    words = text.encode().lower().split()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a set that is not empty; ``bins`` is a power of two."""
    out = np.full(bins, NONE)
    step = max(1, 2 * bins // len(items))
    for lo in range(0, bins, step):
        rounds = np.arange(lo, min(bins, lo + step), dtype=np.uint64)
        x = mix(items[None, :] ^ SEEDS[rounds.astype(np.int64), None])
        np.minimum.at(out, (x & np.uint64(bins - 1)).reshape(-1).astype(np.int64), ((rounds[:, None] << np.uint64(53)) | (x >> np.uint64(11))).reshape(-1))
        if out.max() != NONE:
            return out
    for b in np.flatnonzero(out == NONE):
        out[b] = (np.uint64(bins + b) << np.uint64(53)) | (mix(items ^ SEEDS[bins + b]) >> np.uint64(11)).min()
    return out


def bands(items: np.ndarray) -> np.ndarray:
    rows = sketch(items).reshape(-1, ROWS)
    keys = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return keys.view(np.int64)


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, sig (a 128-bit digest of the set), bands."""
    source = texts_of(docs)

    def make():
        memo = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, sigs, keys = [], [], []
            for text in batch.column(1):
                items = shingles(text.as_py(), size, memo)
                n.append(len(items))
                sigs.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                keys.append(bands(items) if len(items) else None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "sig", "bands"])

        return step

    return per_batch(source, make, "doc_id long, n_shingles long, sig binary, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(node, items) of the rows of ``docs`` whose doc_id is among ``ids`` (node), in small pieces."""
    source = texts_of(docs.join(ids, docs["doc_id"] == ids["node"], "left_semi"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                items = [shingles(t.as_py(), size, memo).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.list_(pa.int64()))], names=["node", "items"])

    return source.mapInArrow(read, "node long, items array<long>").filter(F.size("items") > 0)


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked.

    Sets are broadcast only if those needed have ``SMALL_ITEMS`` shingles at
    most; beyond that pairs and sets meet by two shuffles.
    """
    pairs = cut(pairs)
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = cut(sets.join(needed, "node", "left_semi"))
    small = (sets.agg(F.sum(F.size("items"))).first()[0] or 0) <= SMALL_ITEMS
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    if small:
        left, right = F.broadcast(left), F.broadcast(right)
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("common") >= similarity * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b): the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; each is a
    combined minimum by node and a join, which splits a hub's neighbours.
    """
    edges = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def residual_pairs(sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of different components that may be as similar as asked; ``sets``: (node, items, component).

    A prefix join, exact for the similarity. The items of a set are put in one
    order: first those of its component alone, which no pair can share, then the
    others from the rarest on. Two sets meet at the first item that they share,
    and what stands from there on bounds their intersection. So an item is a key
    only where enough of its set remains, an entry goes on only if it could reach
    the smallest set that its item lists, and a pair only if both remainders allow
    the similarity. An item's entries of its largest component meet the other
    entries alone.
    """
    sized = sets.withColumn("n", F.size("items").cast("long"))
    items = sized.select("node", "n", "component", F.explode("items").alias("item"))
    shared = items.groupBy("item").agg(F.count("*").alias("df"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("item", "df")
    own = Window.partitionBy("node")
    # A set has as many rows as it has items, so these windows are as large as a text.
    ranked = items.join(shared, "item").withColumns({"left": F.count("*").over(own) - F.row_number().over(own.orderBy("df", "item")) + 1})
    entries = cut(ranked.filter(100 * F.col("left") >= similarity * F.col("n")).select("item", "node", "n", "component", "left"))
    lists = entries.groupBy("item", "component").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    lists = lists.groupBy("item").agg(F.max(F.struct("size", "component"))["component"].alias("major"), F.min("least").alias("least"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    reach = f"(100 + {similarity}) * left >= {similarity} * (n + least)"
    entries = cut(entries.join(lists, "item").filter(reach).drop("least"))
    x = entries.filter("component != major").select(F.col("item").alias("ix"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("left").alias("la"))
    y = entries.select(F.col("item").alias("iy"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("left").alias("lb"), (F.col("component") == F.col("major")).alias("is_major"))
    near = f"ix = iy AND ca != cb AND (is_major OR a < b) AND (100 + {similarity}) * least(la, lb) >= {similarity} * (na + nb)"
    return x.join(y, F.expr(near)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fits(similarity: int) -> str:
    """Sizes that allow the similarity."""
    return f"100 * least(na, nb) >= {similarity} * greatest(na, nb)"


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """One row an input row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(sketched(docs, shingle))
    classes = cut(rows.filter("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    keys = classes.filter("node IS NOT NULL").select("node", "n", F.explode("bands").alias("key"))
    buckets = cut(keys.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct("node", "n")).alias("first")).filter("many > 1"))
    members = cut(keys.join(buckets, "key").select("key", "node", "n", "many", "first"))
    sets = cut(sets_of(docs, members.select("node").distinct(), shingle))

    few = members.filter(f"many <= {FEW}")
    pairs = few.select("key", F.col("node").alias("a"), F.col("n").alias("na")).join(few.select("key", F.col("node").alias("b"), F.col("n").alias("nb")), "key").filter("a < b")
    star = members.filter(f"many > {FEW} AND node != first.node").select(F.col("first.node").alias("a"), F.col("first.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = pairs.select("a", "na", "b", "nb").unionByName(star).filter(fits(similarity)).select("a", "b").distinct()
    links = cut(confirm(pairs, sets, similarity))
    found = cut(components(links))

    labelled = cut(members.filter(f"many > {FEW}").select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key")
    open_nodes = labelled.join(mixed, "key", "left_semi").select("node", "component").distinct()
    more = cut(confirm(residual_pairs(sets.join(open_nodes, "node"), similarity), sets, similarity))
    if not more.isEmpty():
        found = cut(components(links.unionByName(more)))

    of_class = classes.select("sig", "node").join(found, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    # A set that many rows share is one key of this join; adaptive execution splits it.
    full = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sig")).alias("sig")).join(cut(of_class), "sig", "left")
    component = F.coalesce("component", "doc_id")
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: one document of each group.

    A row without an id, or with one that other texts have too, goes by id and
    text together and ranks after all other ids. Rows that repeat both count as
    one document.
    """
    text = F.coalesce("text", F.lit(""))
    number = F.lit(1 << 62).bitwiseOR(F.xxhash64(text, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)))
    name = "__id" + "_" * max(map(len, docs.columns))
    # Hashes alone are shuffled to find ids of several texts.
    each = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(name)).agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b"))
    shared = cut(each.filter("a <> b").select(name))
    own = F.col("doc_id").cast("long")
    if shared.isEmpty():
        numbered = docs.withColumn(name, F.coalesce(own, number))
    else:
        both = docs.join(shared.withColumn(f"{name}s", F.lit(True)), docs["doc_id"] == shared[name], "left")
        numbered = both.select(*[docs[c] for c in docs.columns], F.when(F.col(f"{name}s"), number).otherwise(F.coalesce(own, number)).alias(name))
    kept = near_duplicates(numbered.select(F.col(name).alias("doc_id"), "text"), shingle, similarity).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return numbered.join(kept, name, "left_semi").select(*docs.columns)
