"""Finalize: kept products become items, prices, a collection with its children, and are marked, all from one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import listing
from . import records, tables


def outputs(products: DataFrame, stored_items: DataFrame, prices: DataFrame, requests: DataFrame, named: DataFrame, today: str) -> dict[str, DataFrame]:
    """items, prices, collections, children and products after the requests.

    ``products``: id, review_status, sku, product_name, source_site,
    source_product_url, source_price; ``stored_items``: item_code; ``prices``:
    item_code, rate. Requests are taken in the order of their names, products of
    one by id. Of products with one item code the first makes the item, the last
    with a price sets it.
    """
    taken = records.taken_products(products, requests, named).join(products, "id")
    code = listing.item_code(F.col("sku"), F.col("product_name"))
    rows = taken.withColumn("item_code", code).withColumn("rate", listing.parse_price(F.col("source_price")))
    new = tables.first_wins(tables.new_only(rows, stored_items, "item_code"), ["item_code"], ["collection", "id"])
    last = tables.last_value(rows.filter("rate <> 0").withColumn("seq", F.struct("collection", "id")), ["item_code"], "rate", "seq")
    children = tables.numbered(rows.select("collection", "id", "item_code", listing.or_else(F.col("product_name"), F.col("item_code")).alias("item_name"), listing.or_else(F.col("source_site"), "").alias("source_site"), listing.or_else(F.col("source_product_url"), "").alias("product_url")), ["collection"], ["id"])
    done = taken.select("id").distinct().withColumn("review_status", F.lit("Finalized"))
    return {
        "items": new.select("item_code", listing.or_else(F.col("product_name"), F.col("item_code")).alias("item_name"), listing.or_else(F.col("source_site"), "").alias("brand"), listing.or_else(F.col("source_product_url"), "").alias("customer_code")),
        "prices": tables.merge(prices, last, ["item_code"]),
        "collections": records.collection_headers(products.select("id", "review_status"), requests, named, today),
        "children": children.drop("id"),
        "products": tables.merge(products, done, ["id"], insert=False),
    }
