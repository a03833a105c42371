"""Record-keeping operators: sites, run logs, collections, prices, settings, listing pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.listing import friendly_message, or_else, page_url, retry_class
from .tables import merge, new_only, numbered, stop_page

#: Fixed value: categories of a site that is added without any.
DEFAULT_CATEGORIES = "Jewellery, Accessories"
#: The keys of a normalised listing item besides its image.
ITEM_KEYS = ("product_name", "product_source_url", "price", "sku", "description", "category")


def site_arguments(sites: str | list[str] | None, configured: list[str]) -> list[str]:
    """The sites that a caller asks for: None, a name, a list, or JSON of either; nothing means all, inactive ones too."""
    if isinstance(sites, str):
        try:
            sites = json.loads(sites)
        except ValueError:
            pass
    if isinstance(sites, str):
        sites = [sites] if sites else []
    return list(sites or []) or list(configured)


def site_argument_column(sites: Column, configured: Column) -> Column:
    """:func:`site_arguments` over a column of strings."""
    text = F.coalesce(sites, F.lit(""))
    quoted = F.regexp_extract(text, r'^\s*"(.*)"\s*$', 1)
    names = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>")).when(quoted != "", F.array(quoted)).when(text.isin("", "null", '""'), F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, names).otherwise(configured)


def config_value(*sources: Column, missing: str = "the key is not set") -> Column:
    """The first source that is filled; an error where none is."""
    filled = [F.nullif(s, F.lit("")) for s in sources]
    return F.coalesce(*filled, F.raise_error(F.lit(missing)).cast("string"))


def with_run(rows: DataFrame, run_id: str, now: str) -> DataFrame:
    """Rows stamped with the run's id and time, which are given so that a run may be repeated, and an id of their own."""
    own = F.sha2(F.concat_ws("|", F.lit(run_id), F.to_json(F.struct(*rows.columns))), 256)
    return rows.withColumns({"scrape_id": F.lit(run_id), "scraped_at": F.lit(now).cast("timestamp_ntz"), "id": F.substring(own, 1, 32)})


def queued_logs(sites: DataFrame, run_id: str) -> DataFrame:
    """One log row a site, made before any work begins."""
    return sites.select("site_name", "site_url", F.lit(run_id).alias("scrape_id"), F.lit("Queued").alias("status"))


def add_sites(stored: DataFrame, added: DataFrame) -> DataFrame:
    """``stored`` (site_name, site_url, categories, is_active) with new sites; their categories default, and they are active."""
    new = new_only(added, stored, "site_name").select("site_name", "site_url", or_else(F.col("categories"), DEFAULT_CATEGORIES).alias("categories"), F.lit(True).alias("is_active"))
    return stored.unionByName(new)


def delete_with_children(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """New snapshots of both tables without the keys in ``gone``."""
    keys = gone.select(key).distinct()
    return parents.join(keys, key, "left_anti"), children.join(keys, key, "left_anti")


def reinject(rows: DataFrame, labels: list[str], added: DataFrame, section: str | None = None) -> DataFrame:
    """Rows without the ``labels``, then ``added``; nothing changes where ``section`` is among the labels already."""
    changed = rows.filter(~F.col("label").isin(*labels)).unionByName(added)
    if section is None:
        return changed
    has = rows.agg(F.coalesce(F.bool_or(F.col("label") == section), F.lit(False)).alias("__has"))  # one row
    old = rows.join(F.broadcast(has), F.col("__has"))
    return old.drop("__has").unionByName(changed.join(F.broadcast(has), ~F.col("__has")).drop("__has"))


def taken_products(products: DataFrame, requests: DataFrame, named: DataFrame) -> DataFrame:
    """(collection, id): which request takes each kept product; a request takes those that it names, or all kept where it names none.

    ``products``: id, review_status; ``requests``: collection; ``named``:
    (collection, id). Requests come in the order of their names, and what one has
    taken is kept no longer; so a product goes to the first that asks for it.
    """
    by_name = named.join(requests.select("collection").distinct(), "collection", "left_semi").groupBy("id").agg(F.min("collection").alias("collection"))
    first = requests.join(named, "collection", "left_anti").agg(F.min("collection").alias("__first"))  # one row
    kept = products.filter("review_status = 'Kept'").select("id").join(by_name, "id", "left").join(F.broadcast(first))
    return kept.select(F.least("collection", "__first").alias("collection"), "id").filter("collection IS NOT NULL")


def collection_headers(products: DataFrame, requests: DataFrame, named: DataFrame, today: str) -> DataFrame:
    """(collection, finalized_on, created) of each request, by :func:`taken_products`.

    A request with names makes a collection even if none of them is kept; one
    without names makes none if no product is left, its date is null then.
    """
    counts = taken_products(products, requests, named).groupBy("collection").agg(F.count("*").alias("created"))
    names = named.select("collection").distinct().withColumn("__named", F.lit(True))
    made = requests.select("collection").distinct().join(counts, "collection", "left").join(names, "collection", "left")
    has = F.col("created").isNotNull() | F.col("__named").isNotNull()
    return made.select("collection", F.when(has, F.lit(today).cast("date")).alias("finalized_on"), F.coalesce("created", F.lit(0)).alias("created"))


def with_price(items: DataFrame, prices: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Items with their price by a composite key, null where there is none; of several prices of a key the largest."""
    return items.join(prices.groupBy(*keys).agg(F.max(value).alias(value)), keys, "left")


def ensure_groups(stored: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """Rows (name, parent, is_group) to insert: the root first where it is missing, then each missing group under it; empty names are skipped."""
    spark = stored.sparkSession
    top = spark.range(1).select(F.lit(root).alias("name"), F.lit("").alias("parent"), F.lit(True).alias("is_group"))
    child = wanted.select("name").distinct().filter(F.col("name") != root).select("name", F.lit(root).alias("parent"), F.lit(False).alias("is_group"))
    missing = new_only(child, stored, "name")
    # The root is asked for only where a group is inserted.
    used = F.broadcast(missing.limit(1).select(F.lit(True).alias("__any")))  # one row
    return new_only(top, stored, "name").join(used).drop("__any").unionByName(missing)


def set_flag(rows: DataFrame, name: Column, flag: str) -> DataFrame:
    """The flag set to 1 for the rows ``name`` picks where it is 0."""
    return rows.withColumn(flag, F.when(name & (F.col(flag) == 0), F.lit(1)).otherwise(F.col(flag)))


def split_known(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``known``: whether the key, such as (site, URL), is stored; so a site skips what it has itself."""
    return rows.join(stored.select(*keys).distinct().withColumn("known", F.lit(True)), keys, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def method_used(method: Column, found: Column, known: Column) -> Column:
    """Store or Listing as asked; Auto takes the store unless nothing is found there and nothing known."""
    return F.when(method.isin("Store", "Listing"), method).when((found > 0) | (known > 0), "Store").otherwise("Listing")


def page_table(sites: DataFrame, url: str, most: int = 30) -> DataFrame:
    """A row for each site and page number from 1 to ``most``, the listing reader's limit."""
    pages = sites.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return pages.withColumn("page_url", page_url(F.col(url), F.col("page")))


def listing_pages(responses: DataFrame) -> DataFrame:
    """(site, page, error, products) of recorded responses (site, page, status, body), products as an array of variants.

    A status of 400 or more, a body that is no JSON or one without success is an
    error with no products, so failures are rows of the result; a page without
    products has an empty list.
    """
    body = F.try_parse_json("body")
    success = F.coalesce(F.try_variant_get(body, "$.success", "boolean"), F.lit(False))
    failed = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(": "), F.substring("body", 1, 300))).when(~success, F.concat(F.lit("Scrape failed: "), F.coalesce("body", F.lit(""))))
    none = F.array().cast("array<variant>")
    found = F.coalesce(F.try_variant_get(body, "$.data.json.products", "array<variant>"), none)
    return responses.select("site", "page", failed.alias("error"), F.when(failed.isNull(), found).otherwise(none).alias("products"))


def normalised_items(pages: DataFrame) -> DataFrame:
    """Each item of ``pages`` (site, page, products) with its seven keys filled by defaults.

    Items are read one by one as variants, so one of an odd shape costs no other:
    an object or list in place of a text stays as its JSON. Items that are null,
    empty or no objects are left out.
    """
    items = pages.select("site", "page", F.posexplode("products").alias("seq", "item"))
    items = items.filter(F.to_json("item").startswith("{") & (F.to_json("item") != "{}"))
    value = lambda path: F.try_variant_get("item", path, "string")
    many = F.size(F.coalesce(F.try_variant_get("item", "$.images", "array<variant>"), F.array().cast("array<variant>"))) > 0
    image = F.when(many, value("$.images[0]")).otherwise(value("$.product_image_url"))
    return items.select("site", "page", "seq", or_else(image, "").alias("product_image_url"), *[or_else(value(f"$.{k}"), "").alias(k) for k in ITEM_KEYS])


def listing_runs(pages: DataFrame, sites: DataFrame, most: int = 30) -> DataFrame:
    """(site, status, log, last_page): how the run over each site ends, of ``pages`` (site, page, error, products).

    Pages are read from 1 to ``most``, up to the first with nothing new; a page
    that fails has no products and so ends the reading, and the run is Done. If
    that page's error is of credits the run has Failed, with nothing saved.
    ``last_page`` is the last page whose products count, 0 if there is none.
    """
    stop = stop_page(normalised_items(pages).filter(F.col("page") <= most), "page", "product_source_url", ["site"], 1)
    ended = sites.select("site").distinct().join(stop, "site", "left").select("site", F.coalesce("__stop", F.lit(1)).cast("long").alias("page"))
    found = ended.join(pages.filter(F.col("error").isNotNull() & (F.col("page") <= most)).groupBy("site", F.col("page").cast("long").alias("page")).agg(F.min("error").alias("error")), ["site", "page"], "left")
    failed = F.coalesce(retry_class(F.col("error")) == "abort", F.lit(False))
    return found.select("site", F.when(failed, "Failed").otherwise("Done").alias("status"), F.when(failed, friendly_message(F.col("error"))).alias("log"), F.when(failed, 0).otherwise(F.col("page") - 1).cast("long").alias("last_page"))


def dump_json(rows: DataFrame, path: str) -> None:
    """A file of JSON lines for each task, values that are null as null."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def list_view(rows: DataFrame, sort_field: str = "creation", descending: bool = True, page_length: int = 20) -> DataFrame:
    """The first page of a list as its view shows it, ties by name."""
    return rows.orderBy(F.desc(sort_field) if descending else F.asc(sort_field), "name").limit(page_length)


def retry_waits(failures: DataFrame, message: str, step: int = 10, attempts: int = 3) -> DataFrame:
    """``failures`` with a row for each attempt and the seconds waited after it: ``step`` more each time where the error is one to wait for, else one attempt and no wait."""
    waits = retry_class(F.col(message)) == "wait"
    rows = failures.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.when(waits, attempts).otherwise(1))))
    return rows.withColumn("seconds", F.when(waits, F.col("attempt") * step).otherwise(0))


def after_retries(attempts: DataFrame, by: list[str], step: int = 10, most: int = 3) -> DataFrame:
    """(by, attempts, waited, error): how each call ends, of the recorded ``attempts`` (by, attempt from 1 up, error).

    A call ends with its first attempt that succeeds (a null error) or fails for
    another reason than one to wait for, else with its last, the ``most``th at the
    latest; later ones are as if they had not been. After each that is waited for
    ``step`` seconds more pass, after the last too. Attempts combine before the
    shuffle.
    """
    wait = F.coalesce(retry_class(F.col("error")) == "wait", F.lit(False))
    end = F.struct("attempt", "error")
    found = attempts.filter(F.col("attempt") <= most).groupBy(*by).agg(F.min(F.when(~wait, end)).alias("end"), F.max(end).alias("last"))
    n = F.coalesce("end.attempt", "last.attempt")
    waits = F.when(F.col("end").isNotNull(), n - 1).otherwise(n)
    error = F.when(F.col("end").isNotNull(), F.col("end.error")).otherwise(F.col("last.error"))
    return found.select(*by, n.alias("attempts"), (step * waits * (waits + 1) / 2).cast("long").alias("waited"), error.alias("error"))


def lookup(parameters: DataFrame, logs: DataFrame, argument: str, by: list[str]) -> DataFrame:
    """A row for each entry of a JSON map (site to log's name) in column ``argument``, with that log's columns; (by, site, log_name, status, ...).

    ``logs``: name, status and what else a log has. A name that has no log is a
    row with the status Failed. Text that is no JSON map has no entries. Entries
    are spread and joined, so a map may be as large as a row can be.
    """
    entries = parameters.select(*by, F.explode(F.from_json(argument, "map<string,string>")).alias("site", "log_name"))
    had = entries.join(logs.withColumnRenamed("name", "log_name"), "log_name", "left")
    return had.withColumn("status", F.coalesce("status", F.lit("Failed"))).select(*by, "site", "log_name", *[c for c in logs.columns if c != "name"])


def sync_registry(registry: DataFrame, row: DataFrame, key: str, runtime: list[str], legacy: DataFrame) -> DataFrame:
    """The registry without the ``legacy`` keys and with ``row`` inserted, or updated in all columns but the ``runtime`` ones."""
    left = registry.join(legacy.select(key).distinct(), key, "left_anti").select(*registry.columns)
    return merge(left, row, [key], [c for c in row.columns if c != key and c not in runtime])


def factory_sheet(children: DataFrame, items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The six columns of a collection's sheet after ``by``: row, style_number, product_name, description, image, product_url.

    ``children``: ``by``, item, item_name, product_url and the ``order`` columns;
    ``items``: item, image, description. The image's cell holds its URL, as it
    does where an image cannot be put in; values that are missing are empty.
    """
    rows = numbered(children.join(items, "item", "left"), by, order, "row")
    cells = {"style_number": "item", "product_name": "item_name", "description": "description", "image": "image", "product_url": "product_url"}
    return rows.select(*by, "row", *[or_else(F.col(c).cast("string"), "").alias(k) for k, c in cells.items()])
