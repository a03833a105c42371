"""Benchmark passages in documents by a positional inverted index, in DataFrame functions only.

Postings (document, position, term) of the terms that the test items use are
counted; the index that is stored holds the lists of each phrase's two rarest
terms, and each document's number of words. A phrase is found from those lists:
positions, less the terms' offsets in the phrase, are intersected. Where they agree the phrase may begin;
where they differ by ``slack`` at most, its words may stand near. What remains is
compared with the words of those documents alone: word for word for an exact
match; for a proximity match all words of the phrase stand, in any order, in its
length and ``slack`` words on either side.

Tables of test terms, anchors, phrases and candidates are broadcast only if they
are measured to have ``SMALL_BYTES`` at most; beyond that they are joined by a
shuffle. A document's candidates are at most its words times the phrases that
share its rare terms.

A document is known by doc_id and a hash of its text. Defined results: null
texts have no words; rows that repeat doc_id and text give alike rows; a null
doc_id is kept as such; an item without an id counts for hits, but is in no list
of items; empty documents or an empty benchmark give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, stored

SMALL_BYTES = 16 << 20
SLACK = 5
WINDOW = 13
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words after lower-casing A-Z."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    # Splitting is several times as fast as extracting; a separator at either end leaves an empty part.
    return F.filter(F.split(low, SEPARATOR), lambda w: w != "")


def broadcast_if_small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows, as JSON, have ``most`` bytes at most."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the key (k, h) that joins use, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, k, h, pos, term) of the ``terms`` in ``docs``, as :func:`keyed` gives them.

    Each row of ``docs`` also has a posting without a term whose position is its number of words.
    """
    ended = F.concat(words(F.col("text")), F.array(F.lit(None).cast("string")))
    all_ = docs.select("doc_id", "k", "h", F.posexplode(ended).alias("pos", "term"))
    known = broadcast_if_small(terms.select("term", F.lit(True).alias("__known")))
    return all_.join(known, "term", "left").filter("__known OR term IS NULL").select("doc_id", "k", "h", "pos", "term")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(wid, item_id, terms): the runs of ``size`` words of each item, or all of a shorter one."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    runs = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, size))).alias("terms"))
    return runs.select(F.md5(F.array_join("terms", " ")).alias("wid"), "item_id", "terms")


def anchors(phrases: DataFrame, counts: DataFrame, many: int = 2) -> DataFrame:
    """(wid, n, off, term, need): the ``many`` rarest places of each phrase, all of whose terms occur."""
    places = phrases.select("wid", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term")).join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    by = Window.partitionBy("wid")
    places = places.withColumns({"rank": F.row_number().over(by.orderBy("count", "off")), "least": F.min("count").over(by)})
    return places.filter((F.col("least") > 0) & (F.col("rank") <= many)).select("wid", "n", "off", "term", F.least("n", F.lit(many)).alias("need"))


def phrase_hits(docs: DataFrame, phrases: DataFrame, slack: int = SLACK) -> DataFrame:
    """Rows of ``docs`` (doc_id, k, h) with n_words, ``hits`` and ``near``: arrays of (start, n, wid) of the phrases (wid, terms) there.

    ``near`` gives each phrase once, also the exact ones, with the first start of
    its rarest terms, less their offset, around which all its words stand.
    """
    phrases = cut(phrases.select("wid", "terms").distinct())
    terms = cut(phrases.select(F.explode("terms").alias("term")).distinct())
    counts = cut(postings(docs, terms).filter("term IS NOT NULL").groupBy("term").count())
    anchored = cut(anchors(phrases, counts))
    index = stored(postings(docs, anchored.select("term").distinct()), "postings")
    starts = index.join(broadcast_if_small(anchored), "term").select("k", "h", (F.col("pos") - F.col("off")).alias("start"), "off", "n", "wid", "need")
    by = Window.partitionBy("k", "h", "wid").orderBy("start", "off")
    close = lambda f: (f("off", 1).over(by) != F.col("off")) & (F.abs(f("start", 1).over(by) - F.col("start")) <= slack)
    meets = (F.col("need") == 1) | F.coalesce(close(F.lag), F.lit(False)) | F.coalesce(close(F.lead), F.lit(False))
    some = cut(starts.withColumn("meets", meets).filter("meets").select("k", "h", "start", "wid").distinct())
    found = some.join(broadcast_if_small(phrases), "wid").groupBy("k", "h").agg(F.collect_list(F.struct("start", "wid", "terms")).alias("found"))
    hit = lambda c: F.struct(c["start"].alias("start"), F.size(c["terms"]).alias("n"), c["wid"].alias("wid"))
    at = lambda w, c: (c["start"] >= 0) & (F.slice(w, F.greatest(c["start"], F.lit(0)) + 1, F.size(c["terms"])) == c["terms"])
    around = lambda w, c: F.slice(w, F.greatest(c["start"] - slack, F.lit(0)) + 1, F.size(c["terms"]) + slack + F.least(c["start"], F.lit(slack)))
    by_words = lambda w: F.struct(
        F.transform(F.filter("found", lambda c: at(w, c)), hit).alias("hits"),
        F.transform(F.filter("found", lambda c: F.size(F.array_except(c["terms"], around(w, c))) == 0), hit).alias("near"),
    )
    # One-element arrays bind a value that is used more than once, so it is computed once.
    result = F.transform(F.array(words(F.col("text"))), by_words)[0]
    # Only the texts of documents with candidates go on.
    texts = docs.join(broadcast_if_small(some.select("k", "h").distinct()), ["k", "h"], "left_semi")
    checked = texts.join(found, ["k", "h"]).select("k", "h", F.explode(F.array(result)).alias("r")).select("k", "h", "r.hits", "r.near")
    checked = cut(checked.filter((F.size("hits") > 0) | (F.size("near") > 0)).dropDuplicates(["k", "h"]))
    none = F.array().cast("array<struct<start:int,n:int,wid:string>>")
    rows = index.filter("term IS NULL").select("doc_id", "k", "h", F.col("pos").cast("long").alias("n_words"))
    return rows.join(broadcast_if_small(checked), ["k", "h"], "left").withColumns({c: F.coalesce(c, none) for c in ("hits", "near")})


def covered(hits: Column) -> Column:
    """How many positions the spans (start, n) of an array cover."""
    spans = F.array_sort(F.array_distinct(F.transform(hits, lambda c: F.struct(c["start"].cast("long").alias("s"), (c["start"] + c["n"]).cast("long").alias("e")))))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end"))
    add = lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["end"]))).alias("sum"), F.greatest(a["end"], x["e"]).alias("end"))
    return F.aggregate(spans, start, add, lambda a: a["sum"])


def _set_of(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(hits, lambda c: c["wid"])))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20, slack: int = SLACK) -> DataFrame:
    """One row an input row: doc_id, k, h, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    ``n_near`` counts the items with a window whose words stand near one another.
    """
    source = keyed(docs)
    found = cut(windows(benchmark, size))
    keyed_sets = {f"{c}_set": F.when(F.size(c) > 0, F.md5(F.array_join(_set_of(F.col(c)), ","))) for c in ("hits", "near")}
    hits = cut(phrase_hits(source, found, slack).withColumns(keyed_sets))
    # A common passage stands in many documents: windows are joined to items once for each distinct set of windows.
    sets = hits.filter("near_set IS NOT NULL OR hits_set IS NOT NULL").select(F.inline(F.array(*[F.struct(F.col(f"{c}_set").alias("set"), _set_of(F.col(c)).alias("wids")) for c in ("hits", "near")])))
    sets = sets.filter("set IS NOT NULL").dropDuplicates(["set"])
    items = sets.select("set", F.explode("wids").alias("wid")).join(found.select("wid", F.col("item_id").cast("string").alias("item")).distinct(), "wid")
    items = cut(items.groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items")))
    rows = hits.select("doc_id", "k", "h", "n_words", covered(F.col("hits")).alias("n_hit"), "hits_set", "near_set")
    rows = rows.join(items.withColumnRenamed("set", "hits_set"), "hits_set", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    rows = rows.join(items.select(F.col("set").alias("near_set"), F.size("items").cast("long").alias("near_items")), "near_set", "left")
    return rows.select(
        "doc_id", "k", "h", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.coalesce("near_items", F.lit(0)).alias("n_near"),
    )


def proximity(docs: DataFrame, phrases: DataFrame, slack: int = 5) -> DataFrame:
    """(doc_id, wid, start, end): spans that hold all distinct terms of a phrase within its length plus ``slack`` words.

    ``phrases``: (wid, terms). Of overlapping spans each start is given with its shortest span.
    """
    source = keyed(docs)
    wanted = phrases.select("wid", F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("need"), F.size("terms").alias("n")).distinct()
    index = postings(source.dropDuplicates(["k", "h"]), wanted.select("term").distinct()).filter("term IS NOT NULL").drop("doc_id")
    lists = index.join(wanted, "term")
    complete = lists.groupBy("k", "h", "wid").agg(F.count_distinct("term").alias("have"), F.first("need").alias("need")).filter("have = need").select("k", "h", "wid")
    lists = lists.join(complete, ["k", "h", "wid"], "left_semi")
    # A span's places are no more than its words, so the longest phrase and ``slack`` bound the rows of the frame.
    widest = (phrases.agg(F.max(F.size("terms"))).first()[0] or 0) + slack
    after = Window.partitionBy("k", "h", "wid").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    ends = lists.withColumn("next", F.collect_list(F.struct("pos", "term")).over(after.rowsBetween(0, widest)))
    near = ends.withColumn("near", F.filter("next", lambda c: c["pos"] < F.col("pos") + F.col("n") + slack))
    firsts = F.transform(F.array_distinct(F.transform("near", lambda c: c["term"])), lambda t: F.array_min(F.transform(F.filter("near", lambda c: c["term"] == t), lambda c: c["pos"])))
    spans = near.filter(F.size(F.array_distinct(F.transform("near", lambda c: c["term"]))) == F.col("need"))
    return spans.withColumn("end", F.array_max(firsts) + 1).join(source.select("doc_id", "k", "h"), ["k", "h"]).select("doc_id", "wid", F.col("pos").alias("start"), "end").distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that are not contaminated."""
    bad = cut(contamination(docs, benchmark).filter("contaminated").select("k", "h").distinct())
    flagged = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__h": F.xxhash64(F.coalesce("text", F.lit("")))})
    return flagged.join(bad, (flagged["__k"] == bad["k"]) & (flagged["__h"] == bad["h"]), "left_anti").select(*docs.columns)
