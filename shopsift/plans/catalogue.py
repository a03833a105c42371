"""The catalogue of queries: each over the star-schema tables, with its SQL beside it in ``catalogue_sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import listing
from ..operators import records, review, tables
from . import catalogue_flows, catalogue_records
from .catalogue_sql import SQL as CATALOGUE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    """Register ``f(t)``, which gets a function from a table's name to its DataFrame."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return f


def _stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last_scraped"))


@query
def site_stats(t):
    stats = _stats(t("lineitem"))
    return t("supplier").join(stats, "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("total_products"), "last_scraped")


@query
def site_stats_with_zero(t):
    # Customers stand for sites here; most of them have no products.
    sites = t("customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return sites.join(_stats(t("lineitem")), "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("total_products"), "last_scraped")


@query
def collections_counts(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.count_children(t("orders").select("o_orderkey", "o_orderdate"), lines, "o_orderkey").withColumnRenamed("n", "item_count")


@query
def collection_items_priced(t):
    items = t("part").select("p_partkey", "p_name")
    prices = t("part").filter("p_type = 'PROMO'").select("p_partkey", F.col("p_retailprice").alias("price_list_rate"), F.lit("USD").alias("currency"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", F.col("l_partkey").alias("p_partkey"))
    return lines.join(items, "p_partkey", "left").join(prices, "p_partkey", "left")


@query
def run_log_report(t):
    return t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("products"), F.min("l_shipdate").alias("scraped_at"))


def _products(t) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "Pending").when(F.col("o_orderstatus") == "F", "Kept").otherwise("Skipped")
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("source_site"), status.alias("review_status"), F.col("o_orderpriority").alias("categories"), F.col("o_orderdate").alias("scraped_at"), F.lit("").alias("product_name"), F.lit("").alias("sku"))


@query
def review_queue_page(t):
    return review.queue_page(_products(t), page=2, status="Kept", category="urgent").select("id", "review_status", "categories", "scraped_at")


@query
def review_queue_search(t):
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("sku"), F.col("p_retailprice").alias("scraped_at"))
    return review.queue_page(rows, status="", search="RING").select("id", "product_name", "sku")


@query
def review_summary(t):
    return review.summary(_products(t))


@query
def review_page_count(t):
    return review.page_count(_products(t))


@query
def status_update(t):
    rows = _products(t).select("id", "review_status")
    return review.set_status(rows, rows.filter("id % 7 = 0").select("id"), "Kept")


@query
def notes_update(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("notes"))
    notes = rows.filter("id % 11 = 0").select("id", F.concat(F.lit("note "), F.col("id").cast("string")).alias("notes"))
    return tables.merge(rows, notes, ["id"], insert=False)


@query
def toggle_active(t):
    rows = t("supplier").select("s_suppkey", F.lit(True).alias("is_active"))
    return tables.merge(rows, rows.filter("s_suppkey % 3 = 0").select("s_suppkey", (~F.col("is_active")).alias("is_active")), ["s_suppkey"], insert=False)


def _kept(t) -> DataFrame:
    lines = t("lineitem").join(t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return lines.select(F.col("l_partkey").cast("string").alias("item_code"), "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("rate"), "l_shipdate")


SEQ = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "rate"]


@query
def finalize_items_first_wins(t):
    stored = t("part").filter("p_type = 'PROMO'").select(F.col("p_partkey").cast("string").alias("item_code"))
    return tables.first_wins(tables.new_only(_kept(t), stored, "item_code"), ["item_code"], SEQ).select("item_code", "l_orderkey", "l_suppkey")


@query
def finalize_price_last_wins(t):
    rows = _kept(t).filter("rate > 0").withColumn("seq", F.struct(*SEQ))
    stored = t("part").select(F.col("p_partkey").cast("string").alias("item_code"), F.col("p_retailprice").alias("rate"))
    return tables.merge(stored, tables.last_value(rows, ["item_code"], "rate", "seq"), ["item_code"])


@query
def finalize_children(t):
    return tables.numbered(_kept(t).select("l_orderkey", "item_code", "l_linenumber", "l_shipdate", "l_suppkey", "rate"), ["l_orderkey"], ["l_linenumber", "item_code", "l_suppkey", "l_shipdate", "rate"]).select("l_orderkey", "idx", "item_code")


@query
def finalize_status(t):
    rows = _products(t).select("id", "review_status")
    done = rows.filter("review_status = 'Kept'").select("id", F.lit("Finalized").alias("review_status"))
    return tables.merge(rows, done, ["id"], insert=False)


@query
def ensure_dimensions(t):
    stored = t("part").filter("p_size <= 1").select("p_brand").distinct()
    return tables.new_only(t("part").select("p_brand").distinct(), stored, "p_brand")


@query
def factory_sheet(t):
    url = F.concat(F.lit("http://s"), F.col("l_suppkey"), F.lit("/p/"), F.col("l_partkey"))
    items = t("part").select(F.col("p_partkey").alias("item"), F.concat(F.lit("http://i/"), F.col("p_partkey"), F.lit(".png")).alias("image"), F.col("p_type").alias("description"), "p_name")
    order = ["l_linenumber", "item", "l_suppkey", "l_shipdate", "l_extendedprice"]
    children = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", url.alias("product_url"))
    return records.factory_sheet(children, items.withColumnRenamed("p_name", "item_name"), ["l_orderkey"], order)


@query
def factory_filename(t):
    return t("part").select("p_partkey", listing.file_name(F.concat("p_name", F.lit("/"), "p_brand")).alias("file_name"))


def _hosts(t) -> DataFrame:
    return t("pages").select("page_id", "url", listing.base_url(F.col("url")).alias("host"))


@query
def already_saved_semi(t):
    rows = _hosts(t)
    return rows.join(rows.filter("page_id % 5 = 0").select("host").distinct(), "host", "left_semi").select("page_id", "host")


@query
def new_only_anti(t):
    rows = _hosts(t)
    return tables.new_only(rows, rows.filter("page_id % 5 = 0"), "host").select("page_id", "host")


@query
def ingest_counters(t):
    rows = _hosts(t)
    stored = rows.filter("page_id % 5 = 0").select("host").distinct().withColumn("known", F.lit(True))
    both = rows.join(stored, "host", "left")
    return both.agg(F.count("*").alias("urls_found"), F.count_distinct(F.when(F.col("known"), F.col("host"))).alias("already_in_db"), F.count_distinct(F.when(F.col("known").isNull(), F.col("host"))).alias("products_saved"))


@query
def dedupe_first_wins(t):
    return tables.first_wins(_hosts(t), ["host"], ["page_id"]).select("host", "page_id")


@query
def dedupe_documents(t):
    # Digests are shuffled, not texts.
    rows = t("documents").select("doc_id", F.sha2(F.trim("text"), 256).alias("body"))
    return rows.groupBy("body").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query
def pagination_stop(t):
    rows = t("events").select("event_id", F.expr("event_id div 20").alias("page"), F.col("user_id").alias("url"))
    return tables.until_nothing_new(rows, "page", "url").select("event_id", "page", "url")


@query
def topup_merge(t):
    first = t("region").select(F.col("r_regionkey").cast("long").alias("key"), F.concat(F.lit("Brand#"), F.col("r_regionkey").cast("string")).alias("brand"))
    return tables.topup(first, t("part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand")), "brand", ["key"])


@query
def classify_keyword(t):
    return t("part").select("p_partkey", listing.is_jewelry(F.col("p_type"), F.col("p_brand"), F.col("p_name")).alias("is_jewelry"))


@query
def normalize_tags(t):
    return t("part").select("p_partkey", F.array_join(listing.normalize_tags(F.concat("p_type", F.lit("_x, ,"), "p_brand", F.lit(" - y"))), "|").alias("tags"))


@query
def strip_html(t):
    return t("pages").select("page_id", F.md5(listing.strip_html(F.col("html"))).alias("description_md5"))


@query
def url_functions(t):
    u = F.col("url")
    return t("pages").select(
        "page_id", listing.base_url(u).alias("base"), listing.clean_url(u).alias("clean"), listing.collection_handle(F.concat(F.lit("http://a.b/collections/x"), F.col("page_id").cast("string"), F.lit("/y?z"))).alias("handle"),
        listing.page_url(u, F.col("page_id") + 1).alias("page_url"), listing.link_next(F.concat(F.lit("<a>; rel=\"previous\", <"), F.regexp_replace("url", ",", ""), F.lit(">; rel=\"next\""))).alias("next"),
        listing.product_url(F.lit("http://a.b/collections/all/products.json"), F.col("page_id").cast("string")).alias("product_url"), listing.is_product_url(u).alias("is_product"),
    )


@query
def parse_price(t):
    text = F.concat(F.lit("$ "), F.col("p_size").cast("string"), F.lit(","), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".50 - $9"))
    return t("part").select("p_partkey", listing.parse_price(text).alias("price"), listing.format_price(listing.parse_price(text)).alias("shown"))


@query
def item_code(t):
    sku = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), "p_brand", F.lit(" ")))
    return t("part").select("p_partkey", listing.item_code(sku, F.col("p_name")).alias("item_code"))


@query
def normalise_product(t):
    raw = F.to_json(F.struct(F.col("p_name").alias("product_name"), F.when(F.col("p_size") > 25, F.array(F.concat(F.lit("i"), "p_size"), F.lit("j"))).otherwise(F.array().cast("array<string>")).alias("images"), F.when(F.col("p_size") > 10, F.lit("alt")).alias("product_image_url")))
    p = F.from_json(raw, "product_name string, images array<string>, product_image_url string")
    return t("part").select("p_partkey", p.alias("p")).select("p_partkey", "p.product_name", listing.or_else(F.coalesce(F.get("p.images", 0), F.col("p.product_image_url")), "").alias("image"))


@query
def images_topup(t):
    # The page's links stand for its images, the first of them as one that is known already.
    markdown = F.regexp_replace("html", '<a href="/([^"]*)">', "![](https://a.b/$1.JPG?w=1) ")
    first = F.concat(F.lit("https://a.b/"), F.regexp_extract("html", '<a href="/([^"]*)">', 1), F.lit(".JPG?w=1"))
    return t("pages").select("page_id", F.array_join(listing.images_topup(F.array(first), markdown), " ").alias("images"))


@query
def url_candidates_limit(t):
    rows = t("pages").select("page_id", listing.clean_url(F.col("url")).alias("url"))
    return tables.first_wins(rows, ["url"], ["page_id"]).orderBy("page_id").limit(50)


@query
def error_taxonomy(t):
    text = F.concat(F.col("event_type"), F.lit(" HTTP "), (F.lit(400) + F.col("user_id") % 30).cast("string"), F.when(F.col("user_id") % 4 == 0, " Read timed out").when(F.col("user_id") % 4 == 1, " Connection refused").otherwise(""))
    return t("events").select("event_id", listing.error_kind(text).alias("kind"), listing.retry_class(text).alias("retry"), listing.connection_message(text).alias("message"))


@query
def progress_elapsed(t):
    spans = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end"))
    rows = t("orders").select("o_orderkey", "o_orderdate").join(spans, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    seconds = F.coalesce(F.timestamp_diff("SECOND", F.col("o_orderdate"), F.col("end")), F.lit(0))
    return rows.select("o_orderkey", seconds.alias("elapsed"), listing.duration_text(F.abs(seconds) % 4000).alias("shown"))


@query
def progress_rollup(t):
    failed = F.col("event_type") == "error"
    return t("events").groupBy("user_id").agg(F.count("*").alias("logs"), F.count_if(~failed).alias("saved"), F.bool_or(failed).alias("any_failed"), F.bool_and(F.col("event_type").isin("error", "purchase")).alias("all_over"))


@query
def progress_missing_log(t):
    wanted = t("supplier").select((F.col("s_suppkey") * 2).alias("user_id"), "s_name")
    logs = t("events").groupBy("user_id").agg(F.count("*").alias("urls_found"))
    return wanted.join(logs, "user_id", "left").select("s_name", F.coalesce("urls_found", F.lit(0)).alias("urls_found"), F.when(F.col("urls_found").isNull(), "Failed").otherwise("Done").alias("status"))


@query
def badge_text(t):
    user = F.col("user_id")
    status = F.when(F.col("event_type") == "error", "Failed").when(user % 3 == 0, "Done").when(F.col("event_type") == "signup", "Queued").otherwise("Running")
    text = F.when(user % 2 == 0, "Rate limit hit").when(user % 5 == 0, "out of CREDITS").when(user % 7 == 0, "").otherwise("timed out")
    n = user % 3
    line = listing.progress_line(status, n, user % 2, user % 4, F.floor("value"), text)
    return t("events").select("event_id", listing.badge_text(status, text).alias("badge"), listing.done_text(n, user % 2, n + 1).alias("done"), line.alias("line"))


@query
def categories_tags(t):
    return t("part").select("p_partkey", F.array_join(listing.comma_list(F.concat("p_brand", F.lit(", , "), "p_type", F.lit(" "))), " · ").alias("tags"))


@query
def html_escape(t):
    return t("pages").select("page_id", F.md5(listing.html_escape(F.col("html"))).alias("escaped_md5"))


@query
def site_filter(t):
    return t("supplier").filter(F.contains(F.lower("s_name"), F.lit("r#00000001"))).select("s_suppkey", "s_name")


@query
def active_sites(t):
    return t("supplier").withColumn("is_active", F.col("s_suppkey") % 4 != 0).filter("is_active").select("s_suppkey", "s_name")


@query
def method_dispatch(t):
    asked = F.when(F.col("s_suppkey") % 3 == 0, "Store").when(F.col("s_suppkey") % 3 == 1, "Listing").otherwise("Auto")
    return t("supplier").select("s_suppkey", records.method_used(asked, F.col("s_suppkey") % 5, F.col("s_suppkey") % 2).alias("method"))


@query
def cascade_delete(t):
    gone = t("supplier").filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    parents, left = records.delete_with_children(t("supplier").withColumnRenamed("s_suppkey", "l_suppkey"), t("lineitem"), gone, "l_suppkey")
    counts = left.groupBy("l_suppkey").agg(F.count("*").alias("products"))
    return parents.select("l_suppkey", "s_name").join(counts, "l_suppkey", "full_outer")


@query
def registry_upsert(t):
    registry = t("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("status"))
    rows = t("nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey") + 10, F.upper("n_name"), F.lit(-1)).toDF("n_nationkey", "n_name", "status")
    legacy = t("region").select((F.col("r_regionkey") * 3).alias("n_nationkey"))
    return records.sync_registry(registry, rows, "n_nationkey", ["status"], legacy)


@query
def sidebar_reinject(t):
    rows = t("region").select(F.col("r_name").alias("label"))
    labels = t("nation").filter("n_nationkey < 3").select(F.concat(F.lit("A"), "n_name").alias("label"))
    return records.reinject(rows, ["ASIA", "EUROPE"], labels, "Section")


@query
def image_fields(t):
    kind = F.when(F.col("p_size") % 4 == 0, "image/PNG").when(F.col("p_size") % 4 == 1, "image/gif").when(F.col("p_size") % 4 == 2, "image/webp").otherwise("image/x")
    return t("part").select("p_partkey", listing.image_extension(kind).alias("ext"), listing.scaled_width(F.col("p_size") * 7, F.col("p_size") % 5).alias("width"), F.base64(F.encode("p_name", "utf-8")).alias("encoded"))


QUERIES |= catalogue_records.QUERIES | catalogue_flows.QUERIES
SQL = CATALOGUE_SQL | catalogue_records.SQL | catalogue_flows.SQL
