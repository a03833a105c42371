"""A stored table in buckets of its key, sorted, so that joins with new rows shuffle the new rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def write_store(rows: DataFrame, table: str, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Write ``rows`` as a table at ``path``, a file for each bucket of ``keys``; and read it."""
    spread = rows.repartition(buckets, *keys)  # else each task would write a file for each bucket
    spread.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def buckets_of(spark: SparkSession, table: str) -> int:
    """How many buckets a stored table has."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Num Buckets'").select("data_type").first()
    if described is None:
        raise ValueError(f"{table} is not in buckets")
    return int(described[0])


def new_to_store(rows: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """``rows`` whose keys are filled and not stored, as :func:`~shopsift.operators.tables.new_only` gives them.

    New rows are dealt out as the store's buckets are, so the store is read in
    place, without a shuffle or a distinct of its keys. A key that many new rows
    share is reduced to one row first.
    """
    spark = rows.sparkSession
    filled = rows
    for k in keys:
        filled = filled.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    fresh = filled.select(*keys).distinct().repartition(buckets_of(spark, table), *keys)
    # The hint keeps the store from being sent to every task, whatever its size is said to be.
    left = fresh.join(spark.table(table).select(*keys).hint("merge"), keys, "left_anti")
    return filled.join(left, keys, "left_semi").select(*rows.columns)
