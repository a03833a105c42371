"""Searching a site map: an index of the words in URL paths, and URLs ranked by how many words of a query they match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.listing import clean_url
from ..shared import cut

#: The URLs with the same common words are ranked in so many parts first, so that no task gets all of them.
PARTS = 16
#: The best URLs by common words are sent to every task up to so many rows, 16 MB by estimate.
FEW = 75_000


def path_words(url: Column) -> Column:
    """The distinct words of a URL's path, in lower case: runs of letters and digits."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.array_distinct(F.regexp_extract_all(F.lower(path), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def path_index(pages: DataFrame, id_col: str, url_col: str = "url") -> DataFrame:
    """(word, id, url): the index, one row for each word of each distinct cleaned URL, by its smallest id; may be written in buckets of ``word``."""
    urls = pages.select(clean_url(F.col(url_col)).alias("url"), F.col(id_col).alias("id")).filter("url IS NOT NULL").groupBy("url").agg(F.min("id").alias("id"))
    return urls.select(F.explode(path_words(F.col("url"))).alias("word"), "id", "url")


def _words(text: Column) -> Column:
    """The distinct words of a query, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _best(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The first ``most`` rows of each ``by`` with their place: most words matched, then the smallest id."""
    order = [F.desc("matched"), F.asc_nulls_last("id"), "url"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= most)


def _shared_best(urls: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """(asked, best): of each set of common words the ``most`` best URLs (id, url, matched as base) by these words alone.

    URLs that hold the same common words differ in id only, so the first of each
    such kind stand for all, and of the kinds those with the ``most`` best first
    URLs are enough.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("id"), "url"))
    parts = urls.filter(F.size("held") > 0).select("held", "id", "url", F.pmod(F.hash("id", "url"), F.lit(PARTS)).alias("part"))
    parts = parts.withColumn("n", place("held", "part")).filter(F.col("n") <= most)
    firsts = parts.select("held", "id", "url").withColumn("n", place("held")).filter(F.col("n") <= most)
    kinds = firsts.filter("n = 1").select("held", "id", "url", F.explode("held").alias("word"))
    met = sets.select("asked", F.inline("asked")).join(kinds, "word").groupBy("asked", "held", "id", "url").agg(F.sum("weight").alias("matched"))
    met = _best(met, "asked", most).select("asked", "held", "matched")
    best = _best(met.join(firsts.drop("n"), "held"), "asked", most)
    return best.groupBy("asked").agg(F.collect_list(F.struct("id", "url", F.col("matched").alias("base"))).alias("best"))


def search_paths(index: DataFrame, queries: DataFrame, most: int = 150) -> DataFrame:
    """(query, place, url, matched): of each query the ``most`` URLs with most of its words, then the smallest id.

    ``queries``: query, words (separated by anything that is no letter or digit);
    a word in several rows of one query counts as often.
    A word is common if more than ``most`` URLs hold it. A URL without a rare word
    of a query is among its best only if it is among the best by the common words
    alone, and these are found once for all queries with the same common words. So
    postings of rare words alone are joined to queries, ``most`` a word at most.
    """
    words = queries.select("query", F.explode(_words(F.col("words"))).alias("word")).groupBy("query", "word").agg(F.count("*").alias("weight"))
    spread = index.groupBy("word").agg((F.count("*") > most).alias("common"))
    known = spread.join(words.select("word").distinct(), "word", "left_semi")
    common, rare = (lambda v: F.collect_list(F.when(F.col("common"), v))), (lambda v: F.collect_list(F.when(~F.col("common"), v)))
    word, weighed = F.col("word"), F.struct("word", "weight")
    urls = cut(index.join(known, "word").groupBy("id", "url").agg(F.array_sort(common(word)).alias("held"), rare(word).alias("rare")))
    wanted = cut(words.join(known, "word").groupBy("query").agg(F.array_sort(common(weighed)).alias("asked"), rare(weighed).alias("rare")))

    sets = wanted.filter(F.size("asked") > 0).select("asked").distinct()
    best = _shared_best(urls, sets, most)
    best = F.broadcast(best) if sets.count() * most <= FEW else best  # else a set that most queries ask for would be one task's
    by_common = wanted.select("query", "asked").join(best, "asked").select("query", F.inline("best"), F.lit(0).cast("long").alias("weight"))
    base = F.aggregate(F.filter("asked", lambda a: F.array_contains("held", a["word"])), F.lit(0).cast("long"), lambda n, a: n + a["weight"])
    asking = wanted.select("query", "asked", F.inline("rare"))
    by_rare = urls.select("id", "url", "held", F.explode("rare").alias("word")).join(asking, "word").select("query", "id", "url", base.alias("base"), "weight")
    matched = (F.sum("weight") + F.max("base")).alias("matched")
    found = by_common.unionByName(by_rare).repartition("query").groupBy("query", "id", "url").agg(matched)
    return _best(found, "query", most).select("query", "place", "url", "matched")
