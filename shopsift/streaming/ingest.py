"""Incremental ingest: each micro-batch adds the products whose URL is not stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import first_wins, new_only

BUCKETS = 64


def ingest_stream(rows: DataFrame, store: str, checkpoint: str, key: str | list[str] = "source_product_url", seq: list[str] | None = None) -> StreamingQuery:
    """Append new products of the stream ``rows`` to the Parquet table at ``store``, then stop when no input is left.

    A product is known by ``key``, such as its URL, or its site and URL where each
    site skips what it has itself. A batch writes a folder named by its id, so one
    that is run again after a lost driver replaces what it had written. Folders
    are split by a hash of the key, and a batch reads only the buckets it touches.
    For streams of very many batches :func:`shopsift.streaming.seen.decide_stream`
    keeps what is stored as state, and reads no stored table.
    """
    order, keys = seq or ["page", "seq"], [key] if isinstance(key, str) else key

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(store)
        fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        own = f"{store}/batch={batch_id}"
        fs.delete(jvm.org.apache.hadoop.fs.Path(own), True)
        batch.persist()  # it is read for its buckets and to be written
        try:
            fresh = first_wins(batch, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
            if fs.exists(base) and fs.listStatus(base):
                touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS rows
                stored = spark.read.schema(fresh.schema).parquet(store).filter(F.col("bucket").isin(touched))
                fresh = new_only(fresh, stored, keys)
            fresh.write.partitionBy("bucket").parquet(own)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
