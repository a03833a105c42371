"""Keyed-table operators: deduplication by arrival, upserts by snapshot, existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row by ``order``; the minimum of a struct combines before the shuffle, a window would not."""
    names = [f"__o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(names, order, strict=True))).select(*keys, F.struct(*names, *[c for c in df.columns if c not in keys]).alias("__row"))
    best = rows.groupBy(*keys).agg(F.min("__row").alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def first_wins(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The earliest row of each key; rows with a null key all stay."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return _one(df.filter(~null), keys, [F.col(c) for c in seq]).unionByName(df.filter(null))


def last_value(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The latest ``value`` of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def new_only(rows: DataFrame, stored: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key is filled and not stored; the stored side is reduced to its keys first."""
    keys = [key] if isinstance(key, str) else key
    filled = rows
    for k in keys:
        filled = filled.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return filled.join(stored.select(*keys).distinct(), keys, "left_anti")


def merge(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str] | None = None, insert: bool = True, seq: str | None = None) -> DataFrame:
    """A new snapshot of ``target``: rows of ``changes`` update ``columns`` (all but the keys by default) or are added.

    Without ``insert`` changes of other keys are ignored, and a small ``changes``
    may be broadcast. Of changes that repeat a key the last by the column ``seq``
    counts, or the largest where there is no such column.
    """
    update = [c for c in target.columns if c not in keys] if columns is None else columns
    rest = [c for c in changes.columns if c not in keys and c != seq]
    best = F.max(F.struct(*([seq] if seq else []), *rest)) if seq or rest else F.lit(None)
    one = changes.groupBy(*keys).agg(best.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
    a, b = target.withColumn("__a", F.lit(True)), one.withColumn("__b", F.lit(True))
    both = a.alias("a").join(b.alias("b"), keys, "full_outer" if insert else "left")
    pick = [
        F.col(c) if c in keys else (F.when(F.col("__b") & (F.col("__a").isNull() | F.lit(c in update)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in rest else F.col(f"a.{c}")).alias(c)
        for c in target.columns
    ]
    return both.select(*pick)


def fold_updates(updates: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """(keys, columns): of each key and column the last value that is not null by ``seq``; a column never set is null.

    ``updates`` is a log to which sparse updates are only appended; folding it
    gives what applying them one after the other would. The maximum of a struct
    combines before the shuffle, so a key with a third of all updates costs a row
    a task, and folds of parts may be folded again if they keep ``seq``.
    """
    values = [c for c in updates.columns if c not in keys and c not in seq]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(*seq, c))).alias(c) for c in values]
    return updates.groupBy(*keys).agg(*last).select(*keys, *[F.col(c)[c].alias(c) for c in values])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Rows numbered from 1 within each parent."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def _first_pages(rows: DataFrame, page: str, key: str, by: list[str], start: int) -> tuple[DataFrame, DataFrame]:
    """(by, key, __first): the first page of each key; and (by, page): the pages that have something new."""
    filled = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    read = rows.filter(F.col(page) >= start)
    first = read.filter(filled).groupBy(*by, key).agg(F.min(page).alias("__first"))
    return first, first.select(*by, F.col("__first").alias(page)).unionByName(read.filter(~filled).select(*by, page)).distinct()


def stop_page(rows: DataFrame, page: str, key: str, by: list[str] | None = None, start: int = 0) -> DataFrame:
    """(by, __stop): the first page from ``start`` on without a row whose key no earlier page had; rows without a key are always new.

    With ``by``, groups without rows from ``start`` on have no row here.
    """
    by = by or []
    _, fresh = _first_pages(rows, page, key, by, start)
    # The first page without a new key is the first of all or follows one that has new keys.
    begin = fresh.select(*by).distinct().withColumn(page, F.lit(start)) if by else rows.sparkSession.range(1).select(F.lit(start).alias(page))
    after = fresh.select(*by, (F.col(page) + 1).alias(page)).unionByName(begin)
    return after.join(fresh, [*by, page], "left_anti").groupBy(*by).agg(F.min(page).alias("__stop"))


def until_nothing_new(rows: DataFrame, page: str, key: str, last_page: int | None = None, by: list[str] | None = None, start: int = 0) -> DataFrame:
    """What a reader keeps that goes on from page to page until one has nothing new: rows whose key no earlier page had, and rows without a key.

    Reading begins at page ``start`` and stops at :func:`stop_page`, which a
    missing page may be; a key repeated within its first page stays repeated.
    With ``by``, each of its groups (such as a site) is read on its own. Pages
    beyond ``last_page``, if it is given, are not kept.
    """
    by = by or []
    first, _ = _first_pages(rows, page, key, by, start)
    stop = stop_page(rows, page, key, by, start)
    if last_page is not None:
        stop = stop.withColumn("__stop", F.least("__stop", F.lit(last_page + 1)))
    read = rows.join(stop, by) if by else rows.join(F.broadcast(stop))  # one row
    read = read.filter((F.col(page) >= start) & (F.col(page) < F.col("__stop"))).drop("__stop")
    filled = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    new = read.filter(filled).join(first, [*by, key]).filter(F.col(page) == F.col("__first"))
    return new.select(*rows.columns).unionByName(read.filter(~filled).select(*rows.columns))


def topup(left: DataFrame, right: DataFrame, key: str, seq: list[str], fewer_than: int = 20) -> DataFrame:
    """``left`` and, where it has fewer rows, the first rows of ``right`` with keys that it lacks.

    Which of the two it is decides the plan, so ``left`` is counted, up to ``fewer_than`` rows, as the plan is made.
    """
    few = left.limit(fewer_than).count() < fewer_than
    if not few:
        return left
    return left.unionByName(first_wins(new_only(right, left, key), [key], seq))


def count_children(parents: DataFrame, children: DataFrame, key: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Each parent with its number of children, 0 for none; children are aggregated before the join."""
    counts = children.groupBy(key).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in (extra or {}).items()])
    return parents.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
