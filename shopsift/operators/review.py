"""The review queue: filters, pages, summaries and status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("Pending", "Kept", "Skipped")


def conditions(site: str | None = None, status: str | None = "Pending", category: str | None = None, search: str | None = None) -> Column:
    """All filters that are given; empty ones do not filter. ``%`` and ``_`` in category and search are wildcards."""
    out = F.lit(True)
    if site:
        out &= F.col("source_site") == site
    if status:
        out &= F.col("review_status") == status
    if category:
        out &= F.col("categories").ilike(f"%{category}%")
    if search:
        out &= F.col("product_name").ilike(f"%{search}%") | F.col("sku").ilike(f"%{search}%")
    return out


def queue_page(products: DataFrame, page: int = 1, page_size: int = 24, **filters) -> DataFrame:
    """A page, newest first, ties by id."""
    rows = products.filter(conditions(**filters)).orderBy(F.desc("scraped_at"), "id")
    return rows.offset((page - 1) * page_size).limit(page_size)


def summary(products: DataFrame) -> DataFrame:
    """One row with the number of products of each status, in one pass."""
    return products.agg(*[F.count_if(F.col("review_status") == s).alias(s.lower()) for s in STATUSES])


def page_count(products: DataFrame, status: str = "", page_size: int = 24) -> DataFrame:
    counts = summary(products).select(F.col((status or "Pending").lower()).alias("total"))
    return counts.select("total", F.ceil(F.col("total") / page_size).cast("long").alias("pages"))


def status_error(status: Column) -> Column:
    """What is wrong with a status that a row is to be set to, null if nothing is."""
    return F.when(F.coalesce(status.isin(*STATUSES), F.lit(False)), F.lit(None)).otherwise(F.concat(F.lit("Invalid status: "), F.coalesce(status, F.lit("none"))))


def set_status(products: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """A new snapshot with the status of the ``ids`` set."""
    if status not in STATUSES:
        raise ValueError(f"status is one of {STATUSES}")
    marked = products.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return marked.withColumn("review_status", F.when(F.col("__hit"), status).otherwise(F.col("review_status"))).drop("__hit")
