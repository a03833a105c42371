"""Pages that name their next page: every chain read to its end by doubling, not page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.listing import link_next
from ..shared import cut
from .tables import first_wins


def recorded(responses: DataFrame, seq: list[str]) -> DataFrame:
    """(url, next, products) of the responses that a reader goes on from: status 200, a JSON body, products in it.

    ``responses``: url, status, body, link (the header). Of responses to one URL the first by ``seq`` counts.
    """
    one = first_wins(responses.filter(F.col("url").isNotNull()), ["url"], seq)
    products = F.try_variant_get(F.try_parse_json("body"), "$.products", "array<variant>")
    read = one.filter("status = 200").select("url", link_next(F.col("link")).alias("next"), products.alias("products"))
    return read.filter(F.size(F.coalesce("products", F.array().cast("array<variant>"))) > 0)


def follow_links(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """(site, url, place): the pages that a reader of each site meets, numbered from 1.

    ``pages``: (url, next), of those alone that can be read; ``starts``: (site,
    url). A chain ends before a page that cannot be read, and before one that it
    has had, so a cycle is read once.

    Round k knows of each site the first 2^k pages and of each page the one 2^k
    further on; joining the two doubles both, so a chain of n pages takes log n
    rounds of joins, whatever the number of chains. Rows are spread by URL, a long
    chain like many short ones.
    """
    known = pages.select("url")
    jumps = cut(pages.filter("next IS NOT NULL").select("url", F.col("next").alias("to")).join(known.withColumnRenamed("url", "to"), "to", "left_semi").select("url", "to"))
    reach = cut(starts.select("site", "url").distinct().join(known, "url", "left_semi").withColumn("place", F.lit(1).cast("long")))
    step, had = 1, reach.count()
    while True:
        ahead = reach.join(jumps, "url").select("site", F.col("to").alias("url"), (F.col("place") + step).alias("place"))
        reach = cut(reach.unionByName(ahead).groupBy("site", "url").agg(F.min("place").alias("place")))
        have = reach.count()
        if have == had:
            return reach
        had, step = have, 2 * step
        further = jumps.select(F.col("url").alias("to"), F.col("to").alias("__to"))
        jumps = cut(jumps.join(further, "to").select("url", F.col("__to").alias("to")))


def store_products(responses: DataFrame, starts: DataFrame, seq: list[str]) -> DataFrame:
    """(site, page, seq, product): the products of each site's chain in order, as JSON."""
    pages = recorded(responses, seq)
    found = follow_links(pages, starts).join(pages.select("url", "products"), "url")
    items = found.select("site", F.col("place").alias("page"), F.posexplode("products").alias("seq", "item"))
    return items.select("site", "page", "seq", F.to_json("item").alias("product"))
