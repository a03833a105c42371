"""What each site has and what any site has, as one keyed state: incremental ingest that reads no stored table again.

Rows are listings (source_product_url, site, run, page, seq, fit), where ``fit``
says whether the classifier takes them. Of each URL the owner is the first fit
row by run, page, seq and site. A row is

* ``skipped`` if an earlier run of its own site has saved its URL, fit or not,
  since the site's skip set is asked before the classifier;
* ``unfit`` if it is not skipped and the classifier does not take it;
* ``saved`` if it is the owner;
* ``known`` else: repeated in its run, or another site has it.

Rows that say the same are one row of the result with their number, ``copies``,
which sums to the rows read. :func:`decide` does this to a whole table,
:func:`decide_stream` to a stream, whose state is one owner a URL; a stream that
is stopped goes on from its checkpoint. Both agree if runs are named in the order
in which they come, and the pages of a run come in order. Rows without a URL are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OWNER = "run string, page long, seq long, site string"
DECISIONS = "source_product_url string, site string, run string, decision string, copies long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(rows: DataFrame) -> DataFrame:
    kinds = {"source_product_url": "string", "site": "string", "run": "string", "page": "long", "seq": "long", "fit": "boolean"}
    out = rows.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    return out.filter("source_product_url <> ''").withColumn("fit", F.coalesce("fit", F.lit(False)))


def decide(rows: DataFrame) -> DataFrame:
    """(source_product_url, site, run, decision, copies) of a whole table."""
    # What says the same combines before the shuffle, so a URL that a third of all rows show is a row for each site and run.
    each = _rows(rows).groupBy("source_product_url", "site", "run", "fit").agg(F.min(F.struct("page", "seq")).alias("first"), F.count("*").alias("copies"))
    place = F.struct("run", "first.page", "first.seq", "site")
    owner = each.filter("fit").groupBy("source_product_url").agg(F.min(place).alias("owner"))
    both = each.join(owner, "source_product_url", "left")
    had = (F.col("owner.site") == F.col("site")) & (F.col("owner.run") < F.col("run"))
    own = F.col("fit") & (F.col("owner") == place)
    kind = lambda name, n: F.struct(F.lit(name).alias("decision"), n.cast("long").alias("copies"))
    found = F.when(F.coalesce(had, F.lit(False)), F.array(kind("skipped", F.col("copies")))).when(~F.col("fit"), F.array(kind("unfit", F.col("copies")))).when(own, F.array(kind("saved", F.lit(1)), kind("known", F.col("copies") - 1)))
    found = F.explode(found.otherwise(F.array(kind("known", F.col("copies")))))
    return both.select("source_product_url", "site", "run", found.alias("d")).select("source_product_url", "site", "run", "d.*").filter("copies > 0")


class Owners(StatefulProcessor):
    """Keeps the owner of each URL."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", OWNER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802  the name is given
        each: dict[tuple, list] = {}  # of a URL's rows in a batch: one entry for each site and run, however many rows
        for frame in rows:
            for own, part in frame.groupby(["run", "site", "fit"], dropna=False):
                first = min(zip(part["page"], part["seq"], strict=True))
                before = each.get(own)
                each[own] = [min(first, before[0]), before[1] + len(part)] if before else [first, len(part)]
        owner = tuple(self.owner.get()) if self.owner.exists() else None
        out = []
        if owner is None:
            fit = [(run, int(first[0]), int(first[1]), site) for (run, site, fit), (first, _) in each.items() if fit]
            owner = min(fit, default=None)
            if owner:
                self.owner.update(owner)
                out.append((key[0], owner[3], owner[0], "saved", 1))
                each[owner[0], owner[3], True][1] -= 1
        for (run, site, fit), (_, copies) in each.items():
            if copies:
                had = owner is not None and owner[3] == site and owner[0] < run
                out.append((key[0], site, run, "skipped" if had else "known" if fit else "unfit", copies))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    def close(self) -> None:
        pass


def decide_stream(rows: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append what :func:`decide` says of the stream ``rows`` to the Parquet table at ``out``; with ``once`` until no input is left.

    Input, state and output of a batch are committed together in ``checkpoint``
    and the table's log, so each row counts once however often a batch is run.
    """
    spark = rows.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)  # a query keeps the settings that it was started with
    try:
        found = _rows(rows).groupBy("source_product_url").transformWithStateInPandas(Owners(), DECISIONS, "append", "none")
        writer = found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
