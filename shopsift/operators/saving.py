"""Saving in one pass: each row goes to the saved or the rejected rows, and counters are taken as they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def rejected_for(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row breaks, null if it keeps them all; a rule that is null is broken."""
    out = F.lit(None).cast("string")
    for name, keeps in reversed(rules.items()):
        out = F.when(F.coalesce(keeps, F.lit(False)), out).otherwise(F.lit(name))
    return out


def product_rules(raw: DataFrame) -> dict[str, Column]:
    """What a product needs, of the columns that ``raw`` has: a URL, a price and a time that parse, JSON that parses."""
    rules: dict[str, Column] = {}
    if "source_product_url" in raw.columns:
        rules["no url"] = F.col("source_product_url") != ""
    if "price" in raw.columns:
        rules["price"] = (F.coalesce("price", F.lit("")) == "") | F.col("price").try_cast("decimal(12,2)").isNotNull()
    if "scraped_at" in raw.columns:
        rules["time"] = F.col("scraped_at").isNull() | F.try_to_timestamp(F.col("scraped_at").cast("string")).isNotNull()
    if "body" in raw.columns:
        rules["body"] = F.try_parse_json("body").isNotNull()
    return rules


def outcomes(raw: DataFrame, stored: DataFrame, keys: list[str], seq: list[str], rules: dict[str, Column], skip: list[str] | None = None) -> DataFrame:
    """(the columns of ``raw``, outcome, reason, copies): what becomes of each row, in one shuffle.

    ``known`` for the reason ``skipped`` are rows whose ``skip`` columns (such as
    site and URL) are stored, whatever rule they break; then ``rejected`` those
    that break a rule, one row for each that differs; then ``known`` for the
    reason ``stored`` those whose ``keys`` are stored; and of the rest the first
    of each key by ``seq`` is ``saved``. ``copies`` counts the rows that one
    stands for, so it sums to the rows of ``raw``. Copies combine before the shuffle.
    """
    rows = raw.withColumn("reason", rejected_for(rules))
    for columns, reason, over in ((keys, "stored", False), (skip, "skipped", True)):
        if columns:
            have = stored.select(*columns).distinct().withColumn("__have", F.lit(reason))
            rows = rows.join(have, columns, "left")
            first, second = ("__have", "reason") if over else ("reason", "__have")
            rows = rows.withColumn("reason", F.coalesce(first, second)).drop("__have")
    known = F.col("reason").isin("stored", "skipped")
    rest = [c for c in raw.columns if c not in keys]
    row = F.struct(*seq, *[c for c in rest if c not in seq])
    own = F.when(F.col("reason").isNotNull() & ~known, row)
    found = rows.groupBy(*keys, "reason", own.alias("__own")).agg(F.min(row).alias("__row"), F.count("*").alias("copies"))
    outcome = F.when(F.col("reason").isNull(), "saved").when(known, "known").otherwise("rejected")
    return found.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in raw.columns], outcome.alias("outcome"), "reason", "copies")


def counters() -> list[Column]:
    """found, skipped, saved, rejected of :func:`outcomes`: rows that a site had count each time that an endpoint shows them, products once."""
    skipped = F.sum(F.when(F.col("reason") == "skipped", F.col("copies")).otherwise(0))
    new = F.count_if((F.col("outcome") == "saved") | F.coalesce(F.col("reason") == "stored", F.lit(False)))
    rejected = F.sum(F.when(F.col("outcome") == "rejected", F.col("copies")).otherwise(0))
    return [(new + skipped).alias("found"), skipped.alias("skipped"), F.count_if(F.col("outcome") == "saved").alias("saved"), rejected.alias("rejected")]


def save(found: DataFrame, path: str) -> dict[str, int]:
    """Write the rows of :func:`outcomes` to a folder for each outcome, and return the counters, taken in the pass that writes."""
    seen = Observation("saving")
    found.observe(seen, *counters()).write.partitionBy("outcome").parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}
