"""Queries of the record-keeping operators over the star-schema tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import listing
from ..operators import records, review, tables
from ..shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register ``f(t)``, which gets a function from a table's name to its DataFrame, and its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        SQL[f.__name__] = sql
        return f

    return add


def text(c: str):
    return F.col(c).cast("string")


def _listing_responses(t):
    """A response a page: its links as items, each fourth one empty, null, or of an odd shape; pages of some lengths are failures."""
    item = lambda h, i: (
        F.when(i % 4 == 1, "{}").when(i % 4 == 2, "null")
        .when(i % 4 == 3, F.concat(F.lit('{"product_name":{"odd":"'), h, F.lit('"},"product_image_url":"alt","images":[],"price":7,"category":null}')))
        .otherwise(F.concat(F.lit('{"product_name":"'), h, F.lit('","images":["i1","i2"],"product_image_url":"alt","product_source_url":"/'), h, F.lit('","price":"5.50"}')))
    )
    items = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(r'<a href="/([^"\\]*)"'), F.lit(1)), item), ",")
    size = F.char_length("html")
    body = F.when(size % 11 == 3, '{"success":false}').when(size % 11 == 4, "no JSON").when(size % 11 == 5, '{"success":true}').otherwise(F.concat(F.lit('{"success":true,"data":{"json":{"products":['), items, F.lit("]}}}")))
    status = F.when(size % 13 == 1, 503).when(size % 13 == 2, 402).when(size % 13 == 3, 302).otherwise(200)
    return t("pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("site"), F.col("page_id").alias("page"), status.alias("status"), body.alias("body"))


@query(r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS site, page_id AS page, regexp_extract_all(html, '<a href="/([^"\\]*)"', 1) AS h FROM pages WHERE length(html) % 11 NOT IN (3, 4, 5) AND length(html) % 13 NOT IN (1, 2)),
i AS (SELECT site, page, h, unnest(range(len(h))) AS seq FROM p)
SELECT site, page, CAST(seq AS INTEGER) AS seq, CASE WHEN seq % 4 = 0 THEN h[seq + 1] ELSE '{"odd":"' || h[seq + 1] || '"}' END AS product_name, CASE WHEN seq % 4 = 0 THEN 'i1' ELSE 'alt' END AS product_image_url,
CASE WHEN seq % 4 = 0 THEN '/' || h[seq + 1] ELSE '' END AS product_source_url, CASE WHEN seq % 4 = 0 THEN '5.50' ELSE '7' END AS price, '' AS sku, '' AS description, '' AS category FROM i WHERE seq % 4 IN (0, 3)""")
def listing_page_products(t):
    return records.normalised_items(records.listing_pages(_listing_responses(t)))


@query("""WITH p AS (SELECT page_id, length(html) % 11 AS a, length(html) % 13 AS b, html FROM pages)
SELECT page_id AS page, CASE WHEN b = 1 OR b = 2 THEN CASE b WHEN 1 THEN 'HTTP 503: ' ELSE 'HTTP 402: ' END || CASE a WHEN 3 THEN '{"success":false}' WHEN 4 THEN 'no JSON' WHEN 5 THEN '{"success":true}' ELSE '{"success":true,"' END
WHEN a = 3 THEN 'Scrape failed: {"success":false}' WHEN a = 4 THEN 'Scrape failed: no JSON' END AS error FROM p""")
def listing_page_errors(t):
    # Long bodies differ beyond their first words.
    return records.listing_pages(_listing_responses(t)).select("page", F.regexp_replace("error", r'^(HTTP \d+: \{"success":true,").*$', "$1").alias("error"))


@query(r"""WITH RECURSIVE p AS (SELECT page_id % 32 AS site, page_id // 32 + 1 AS page, length(html) AS z, regexp_extract_all(html, '<a href="/([^"\\]*)"', 1) AS h FROM pages),
i AS (SELECT site, page, z, CASE WHEN z % 13 = 2 THEN 'credits' ELSE '' END AS bad, h, unnest(range(CASE WHEN z % 11 IN (3, 4, 5) OR z % 13 IN (1, 2) THEN 0 ELSE len(h) END + 1)) - 1 AS k FROM p),
b AS (SELECT site, page, bad, list(CASE WHEN k % 4 = 0 THEN '/' || h[k + 1] ELSE '' END) FILTER (k % 4 = 0 OR k % 4 = 3) AS urls FROM i GROUP BY site, page, bad),
r AS (SELECT site, page, bad, urls IS NOT NULL AS fresh, coalesce(urls, list_value('')) AS seen FROM b WHERE page = 1
UNION ALL SELECT b.site, b.page, b.bad, coalesce(len(list_filter(b.urls, lambda u: u = '' OR NOT list_contains(r.seen, u))), 0) > 0, list_concat(r.seen, coalesce(b.urls, list_value(''))) FROM r JOIN b ON b.site = r.site AND b.page = r.page + 1 WHERE r.fresh AND b.page <= 30)
SELECT site, CASE WHEN bool_or(NOT fresh AND bad = 'credits') THEN 'Failed' ELSE 'Done' END AS status, CASE WHEN bool_or(NOT fresh AND bad = 'credits') THEN 'Out of credits at the scraping service' END AS log,
CASE WHEN bool_or(NOT fresh AND bad = 'credits') THEN 0 ELSE count(*) FILTER (fresh) END AS last_page FROM r GROUP BY site""")
def listing_runs(t):
    pages = records.listing_pages(_listing_responses(t)).select((F.col("page") % 32).alias("site"), (F.floor(F.col("page") / 32) + 1).alias("page"), "error", "products")
    return records.listing_runs(pages, pages)


@query("""WITH r AS (SELECT l_suppkey AS site, l_partkey AS url, l_shipdate FROM lineitem), k AS (SELECT DISTINCT l_suppkey AS site, l_partkey AS url FROM lineitem WHERE l_linestatus = 'F')
SELECT r.site, count(*) AS found, count(k.url) AS skipped, count(*) - count(k.url) AS fresh FROM r LEFT JOIN k ON r.site = k.site AND r.url = k.url GROUP BY r.site""")
def skip_set_per_site(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("url"), "l_linestatus")
    known = records.split_known(rows, rows.filter("l_linestatus = 'F'"), ["site", "url"])
    return known.groupBy("site").agg(F.count("*").alias("found"), F.count_if("known").alias("skipped"), F.count_if(~F.col("known")).alias("fresh"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name ELSE 'S' || n_nationkey END AS value FROM nation")
def config_read(t):
    conf = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, "")
    return t("nation").select("n_nationkey", records.config_value(conf, F.concat(F.lit("S"), text("n_nationkey"))).alias("value"))


@query("SELECT s_name AS site_name, 'http://' || s_suppkey AS site_url, 'run-1' AS scrape_id, 'Queued' AS status FROM supplier")
def log_rows(t):
    return records.queued_logs(t("supplier").select(F.col("s_name").alias("site_name"), F.concat(F.lit("http://"), text("s_suppkey")).alias("site_url")), "run-1")


@query("""SELECT s_name AS site_name, 'u' AS site_url, 'old' AS categories, s_suppkey % 2 = 0 AS is_active FROM supplier
UNION ALL SELECT c_name, 'v', CASE c_custkey % 3 WHEN 0 THEN c_mktsegment ELSE 'Jewellery, Accessories' END, true FROM customer WHERE c_name NOT IN (SELECT s_name FROM supplier)""")
def add_sites(t):
    stored = t("supplier").select(F.col("s_name").alias("site_name"), F.lit("u").alias("site_url"), F.lit("old").alias("categories"), (F.col("s_suppkey") % 2 == 0).alias("is_active"))
    categories = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "")
    return records.add_sites(stored, t("customer").select(F.col("c_name").alias("site_name"), F.lit("v").alias("site_url"), categories.alias("categories")))


@query("SELECT to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_brand': p_brand}) AS line FROM part")
def json_lines(t):
    """The lines of the dump as they were written."""
    part = t("part")
    path = new_folder(part.sparkSession, "dump")
    records.dump_json(part.select("p_partkey", "p_name", "p_brand"), path)
    return part.sparkSession.read.text(path).select(F.col("value").alias("line"))


@query("""WITH u AS (SELECT min(c_custkey) AS first FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)),
k AS (SELECT least(o_custkey, coalesce(first, o_custkey)) AS collection FROM orders, u WHERE o_orderstatus = 'F')
SELECT c_custkey AS collection, CASE WHEN count(k.collection) > 0 OR c_custkey IN (SELECT o_custkey FROM orders) THEN DATE '2024-05-01' END AS finalized_on, count(k.collection) AS created
FROM customer LEFT JOIN k ON k.collection = c_custkey GROUP BY c_custkey""")
def collection_headers(t):
    # Each customer asks for a collection of its own orders; one without orders names nothing, and so asks for all that are kept still.
    products = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "Kept").otherwise("Pending").alias("review_status"))
    named = t("orders").select(F.col("o_custkey").alias("collection"), F.col("o_orderkey").alias("id"))
    return records.collection_headers(products, t("customer").select(F.col("c_custkey").alias("collection")), named, "2024-05-01")


@query("SELECT n_name, CASE WHEN n_regionkey = 1 AND n_nationkey % 2 = 0 THEN 1 ELSE CAST(n_nationkey % 2 AS BIGINT) END AS issingle FROM nation")
def flag_update(t):
    rows = t("nation").select("n_name", "n_regionkey", (F.col("n_nationkey") % 2).cast("long").alias("issingle"))
    return records.set_flag(rows, F.col("n_regionkey") == 1, "issingle").select("n_name", F.col("issingle").cast("long").alias("issingle"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, max(p_retailprice) AS price FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND l_returnflag = CASE p_type WHEN 'PROMO' THEN 'A' ELSE 'N' END
GROUP BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_linestatus""")
def price_by_item_and_list(t):
    prices = t("part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_type") == "PROMO", "A").otherwise("N").alias("l_returnflag"), F.col("p_retailprice").alias("price"))
    return records.with_price(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"), prices, ["l_partkey", "l_returnflag"], "price")


@query("""SELECT row_number() OVER (ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS idx, l_partkey, p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 7 ORDER BY 1""")
def items_of_collection(t):
    own = t("lineitem").filter("l_orderkey = 7")
    rows = tables.numbered(own, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    return rows.join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left").select("idx", "l_partkey", "p_name").orderBy("idx")


@query("SELECT o_orderkey, o_orderdate, count(l_orderkey) AS product_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 ORDER BY o_orderdate DESC, o_orderkey DESC")
def collections_newest_first(t):
    counted = tables.count_children(t("orders").select("o_orderkey", "o_orderdate"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return counted.withColumnRenamed("n", "product_count").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("SELECT l_orderkey, l_suppkey, count(*) AS product_count, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2 ORDER BY 4 DESC")
def run_log_sorted(t):
    # The alias hides the column, so rows are in order of the aggregate.
    return t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("product_count"), F.min("l_shipdate").alias("l_shipdate")).orderBy(F.desc("l_shipdate"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal, s_suppkey")
def sites_by_creation(t):
    return t("supplier").orderBy("s_acctbal", "s_suppkey").select("s_suppkey", "s_name")


@query("SELECT o_orderkey AS name, o_orderdate AS creation FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20")
def list_view_page(t):
    return records.list_view(t("orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("creation")))


@query("SELECT l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_orderkey = 11")
def drill_through(t):
    return t("lineitem").filter("l_orderkey = 11").select("l_partkey", "l_suppkey", "l_shipdate")


@query(r"""WITH p AS (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, list_distinct(list_transform(regexp_extract_all(html, '<a href="/([a-z]+)">', 1), lambda h: 'https://a.b/' || h || '.png')) AS d,
list_transform(regexp_extract_all(html, '<a href="/([a-z]+)">', 1), lambda h: 'https://a.b/' || h || '.png') AS l FROM pages WHERE page_id % 4 <> 0)
SELECT page_id, title, coalesce((SELECT string_agg(url, ' ' ORDER BY i) FROM (SELECT url, min(i) AS i FROM (SELECT unnest(l) AS url, unnest(range(len(l))) AS i) GROUP BY url ORDER BY i LIMIT 5)), '') AS images FROM p WHERE title <> ''""")
def page_extraction(t):
    title = F.when(F.col("page_id") % 4 != 0, F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    markdown = F.array_join(F.transform(F.regexp_extract_all("html", F.lit('<a href="/([a-z]+)">'), F.lit(1)), lambda h: F.concat(F.lit("![x](https://a.b/"), h, F.lit(".png)"))), " ")
    rows = t("pages").select("page_id", title.alias("title"), F.array_join(listing.images_topup(F.array().cast("array<string>"), markdown), " ").alias("images"))
    return rows.filter(F.coalesce("title", F.lit("")) != "")


@query("SELECT p_partkey, '$' || p_retailprice AS shown FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) || '.5' AS p_retailprice FROM part)")
def price_modal(t):
    return t("part").select("p_partkey", listing.raw_price(F.concat(text("p_size"), F.lit(".5"))).alias("shown"))


@query("""SELECT p_partkey, 'run-1' AS scrape_id, TIMESTAMP '2024-05-01 10:00:00' AS scraped_at, substr(sha256('run-1|{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}'), 1, 32) AS id FROM part""")
def run_stamps(t):
    return records.with_run(t("part").select("p_partkey", "p_name"), "run-1", "2024-05-01 10:00:00").select("p_partkey", "scrape_id", "scraped_at", "id")


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 1 THEN s_name WHEN 2 THEN 'a|b' WHEN 3 THEN 'one' ELSE 'x|y|z' END AS names FROM supplier""")
def site_arguments(t):
    kind = F.col("s_suppkey") % 6
    given = F.when(kind == 0, "").when(kind == 1, F.col("s_name")).when(kind == 2, '["a","b"]').when(kind == 3, '"one"').when(kind == 4, "[]")
    names = records.site_argument_column(given, F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    return t("supplier").select("s_suppkey", F.array_join(names, "|").alias("names"))


@query("""WITH r AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS saved, count(*) FILTER (event_type = 'click') AS known, count(DISTINCT event_type) AS sites, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1)
SELECT user_id, CASE WHEN failed THEN '⚠️ ' ELSE '✅ ' END || saved || ' new product' || CASE WHEN saved <> 1 THEN 's' ELSE '' END || ' found across ' || sites || ' site' || CASE WHEN sites <> 1 THEN 's' ELSE '' END
|| CASE WHEN saved = 0 AND known > 0 THEN ' Everything was already up to date — ' || known || ' product' || CASE WHEN known <> 1 THEN 's' ELSE '' END || ' matched existing entries.' ELSE '' END
|| CASE WHEN failed THEN ' One or more sites had issues — see the cards below for details.' ELSE '' END AS summary FROM r""")
def run_summary(t):
    kind = F.col("event_type")
    runs = t("events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("saved"), F.count_if(kind == "click").alias("known"), F.count_distinct(kind).alias("sites"), F.bool_or(kind == "error").alias("failed"))
    return runs.select("user_id", listing.run_summary(F.col("saved"), F.col("known"), F.col("sites"), F.col("failed")).alias("summary"))


@query("""SELECT event_id, n AS attempt, CASE WHEN user_id % 30 <> 2 AND (user_id % 30 = 29 OR user_id % 4 = 0) THEN step * n ELSE 0 END AS seconds
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 10 ELSE 60 END AS step, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 4 END AS most FROM events WHERE event_type = 'error'), range(1, 5) r(n)
WHERE n <= CASE WHEN user_id % 30 <> 2 AND (user_id % 30 = 29 OR user_id % 4 = 0) THEN most ELSE 1 END""")
def retry_waits(t):
    message = F.concat(F.lit("HTTP "), (F.lit(400) + F.col("user_id") % 30).cast("string"), F.when(F.col("user_id") % 4 == 0, " Read timed out").otherwise(""))
    failures = t("events").filter("event_type = 'error'").withColumn("message", message)
    page, discovery = (failures.filter(F.col("event_id") % 2 == k) for k in (0, 1))
    return records.retry_waits(page, "message", 10, 3).unionByName(records.retry_waits(discovery, "message", 60, 4)).select("event_id", "attempt", "seconds")


@query("""WITH t AS (SELECT event_id, event_type || ' HTTP ' || (400 + user_id % 30) || CASE user_id % 4 WHEN 0 THEN ' Read timed out' WHEN 1 THEN ' Connection refused' ELSE '' END AS m FROM events)
SELECT event_id, CASE WHEN contains(m, '402') THEN 'Out of credits at the scraping service' WHEN contains(m, '401') THEN 'The key of the scraping service is invalid or missing' WHEN contains(m, '429') THEN 'Rate limit hit — wait a few minutes and try again'
WHEN contains(m, 'timed out') THEN 'Request timed out scraping ' || substr(m, 1, 80) WHEN contains(m, 'Connection') THEN 'Network error — could not reach the site or the scraping service' ELSE 'Scrape failed unexpectedly — check the error log for details' END AS told FROM t""")
def friendly_errors(t):
    message = F.concat(F.col("event_type"), F.lit(" HTTP "), (F.lit(400) + F.col("user_id") % 30).cast("string"), F.when(F.col("user_id") % 4 == 0, " Read timed out").when(F.col("user_id") % 4 == 1, " Connection refused").otherwise(""))
    return t("events").select("event_id", listing.friendly_message(message).alias("told"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages")
def html_escape_without_quotes(t):
    return t("pages").select("page_id", F.md5(listing.html_escape(F.col("html"), quotes=False)).alias("escaped_md5"))


@query("SELECT page_id, md5(base64(encode(html))) AS encoded_md5, md5(html) AS decoded_md5 FROM pages")
def base64_round_trip(t):
    # Spark breaks no lines here, as its base64 takes the session's setting for that.
    encoded = F.regexp_replace(F.base64(F.encode("html", "utf-8")), r"\r\n", "")
    return t("pages").select("page_id", F.md5(encoded).alias("encoded_md5"), F.md5(F.decode(F.unbase64(encoded), "utf-8")).alias("decoded_md5"))


@query("""WITH s AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size <= 1), m AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand <> '' AND p_brand NOT IN (SELECT name FROM s))
SELECT 'All' AS name, '' AS parent, true AS is_group WHERE EXISTS (SELECT 1 FROM m) UNION ALL SELECT name, 'All', false FROM m""")
def ensure_groups(t):
    brands = t("part").select(F.col("p_brand").alias("name"), "p_size")
    return records.ensure_groups(brands.filter("p_size <= 1").select("name"), brands.select("name"), "All")


@query("SELECT page_id, n AS page, regexp_extract(url, '^([^?#]*)', 1) || '?p=' || n || regexp_extract(url, '(#.*)$', 1) AS page_url FROM pages, range(1, 31) r(n)")
def listing_page_urls(t):
    return records.page_table(t("pages").select("page_id", "url"), "url").select("page_id", "page", "page_url")


@query("""SELECT o_orderkey AS id, o_orderpriority AS categories, CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'F' THEN 'Kept' ELSE 'Skipped' END AS review_status, c_name AS product_name, '' AS sku, 'http://' || o_orderkey AS source_product_url,
CAST(o_custkey AS VARCHAR) AS source_site, '$' || o_totalprice AS source_price, o_orderdate AS scraped_at, '' AS product_image_url, CASE WHEN o_orderkey % 2 = 0 THEN 'note ' || o_orderkey END AS notes FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_custkey = 3 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 24""")
def review_cards(t):
    status = F.when(F.col("o_orderstatus") == "P", "Pending").when(F.col("o_orderstatus") == "F", "Kept").otherwise("Skipped")
    rows = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("categories"), status.alias("review_status"), F.col("c_name").alias("product_name"), F.lit("").alias("sku"), F.concat(F.lit("http://"), text("o_orderkey")).alias("source_product_url"),
        text("o_custkey").alias("source_site"), F.concat(F.lit("$"), text("o_totalprice")).alias("source_price"), F.col("o_orderdate").alias("scraped_at"), F.lit("").alias("product_image_url"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("note "), text("o_orderkey"))).alias("notes"),
    )
    return review.queue_page(rows, site="3", status="")


@query("""WITH u AS (SELECT page_id, substr(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''), 1, 140) AS url FROM pages WHERE url ILIKE '%a%')
SELECT url, min(page_id) AS page_id FROM u GROUP BY url ORDER BY 2 LIMIT 50""")
def url_candidates_search(t):
    rows = t("pages").filter(F.col("url").ilike("%a%")).select("page_id", listing.clean_url(F.col("url")).alias("url"))
    return tables.first_wins(rows, ["url"], ["page_id"]).select("url", "page_id").orderBy("page_id").limit(50)


@query("SELECT count(*) AS created FROM orders WHERE o_orderstatus = 'F'")
def created_count(t):
    return t("orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("created"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('F', 'P') THEN NULL ELSE 'Invalid status: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'Finalized' END END AS error FROM orders""")
def status_validation(t):
    status = F.when(F.col("o_orderstatus") == "F", "Kept").when(F.col("o_orderstatus") == "P", "Skipped").when(F.col("o_orderkey") % 3 != 0, "Finalized")
    return t("orders").select(F.col("o_orderkey").alias("id"), review.status_error(status).alias("error"))


@query("""SELECT p_brand AS label FROM part UNION ALL SELECT 'Section' WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#1') UNION ALL SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#1')
UNION ALL SELECT p_type FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT 'Section'""")
def sidebar_guard(t):
    # The first table has the section, so nothing changes; the second lacks it and loses a label.
    once = records.reinject(t("part").select(F.col("p_brand").alias("label")), ["Brand#2"], t("nation").select(F.col("n_name").alias("label")), "Brand#1")
    added = t("region").filter("r_regionkey = 0").select(F.lit("Section").alias("label"))
    return once.unionByName(records.reinject(t("part").select(F.col("p_type").alias("label")), ["PROMO"], added, "Section"))
