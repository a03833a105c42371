"""Queries of the flows between tables: link chains, saving, publishing, parsing by item, searching; each with its DuckDB SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import listing
from ..operators import chains, finalize, publish, records, saving, search, tables
from ..shared import new_folder
from ..sources import store
from ..sources.pages import listings
from ..streaming import seen

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


#: Page n of store s is recorded as page 40 s + n. The links in its HTML are its products.
PAGES = 40


def _site():
    return F.floor(F.col("page_id") / PAGES).cast("string")


def _starts(t) -> DataFrame:
    first = t("pages").filter(F.col("page_id") % PAGES == 0)
    return first.select(_site().alias("site"), F.concat(F.lit("http://s"), _site(), F.lit(".example/products.json?page=0")).alias("url"))


def _responses(t, product=lambda h, i: F.struct(h.alias("handle")), links='<a href="/([^"]*)"') -> DataFrame:
    number, store = F.col("page_id") % PAGES, F.floor(F.col("page_id") / PAGES)
    url = lambda n: F.concat(F.lit("http://s"), store.cast("string"), F.lit(".example/products.json?page="), n.cast("string"))
    size = F.char_length("html")
    handles = F.regexp_extract_all("html", F.lit(links), F.lit(1))
    none = F.array().cast("array<string>")
    body = F.to_json(F.struct(F.transform(F.when(size % 83 == 7, none).otherwise(handles), product).alias("products")))
    ahead = F.when(F.char_length("url") % 37 == 3, F.lit(0)).when(size % 71 == 9, F.lit(-1)).otherwise(number + 1)
    link = F.concat(F.lit("<"), url(number - 1), F.lit('>; rel="previous", <'), url(ahead), F.lit('>; rel="next"'))
    status = F.when(size % 89 == 5, 404).otherwise(200)
    return t("pages").select(url(number).alias("url"), status.alias("status"), F.when(size % 79 == 2, "no JSON").otherwise(body).alias("body"), link.alias("link"))


@query(r"""WITH RECURSIVE p AS (SELECT page_id // 40 AS s, page_id % 40 AS n, length(html) AS z, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS h,
CASE WHEN length(url) % 37 = 3 THEN 0 WHEN length(html) % 71 = 9 THEN -1 ELSE page_id % 40 + 1 END AS next FROM pages),
g AS (SELECT s, n, next, h FROM p WHERE z % 89 <> 5 AND z % 79 <> 2 AND z % 83 <> 7 AND len(h) > 0),
r AS (SELECT s, n, next, h, 1 AS page FROM g WHERE n = 0 UNION ALL SELECT g.s, g.n, g.next, g.h, r.page + 1 FROM r JOIN g ON g.s = r.s AND g.n = r.next WHERE r.next > 0),
x AS (SELECT s, page, unnest(range(len(h))) AS seq, h FROM r)
SELECT CAST(s AS VARCHAR) AS site, page, CAST(seq AS INTEGER) AS seq, h[seq + 1] AS handle FROM x""")
def store_page_chain(t):
    starts = _starts(t)
    products = chains.store_products(_responses(t), starts, ["status", "body", "link"])
    return products.select("site", "page", "seq", F.get_json_object("product", "$.handle").alias("handle"))


def _fold(columns: dict[str, str]) -> str:
    return ", ".join(f"arg_max({c}, struct_pack(ts := ts, event_id := event_id)) FILTER ({c} IS NOT NULL) AS {name}" for name, c in columns.items())


@query(f"""WITH u AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('signup', 'error') THEN event_type END AS s, CASE WHEN event_type = 'purchase' THEN value END AS v, CASE WHEN event_type = 'view' AND value > 20 THEN event_id END AS f FROM events)
SELECT user_id, {_fold({"status": "s", "products_saved": "v", "urls_found": "f"})} FROM u GROUP BY user_id""")
def run_log_folded(t):
    kind = F.col("event_type")
    updates = t("events").select(
        "user_id", "ts", "event_id", F.when(kind.isin("signup", "error"), kind).alias("status"), F.when(kind == "purchase", F.col("value")).alias("products_saved"), F.when((kind == "view") & (F.col("value") > 20), F.col("event_id")).alias("urls_found")
    )
    return tables.fold_updates(updates, ["user_id"], ["ts", "event_id"])


@query(r"""WITH c AS (SELECT page_id, url, substr(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''), 1, 140) AS clean FROM pages)
SELECT page_id, page_id % 3 = 0 AS stored, clean IN (SELECT url FROM c WHERE page_id % 3 = 0) AS already_in_db, NOT url IN (SELECT url FROM c WHERE page_id % 3 = 0) AND NOT clean IN (SELECT url FROM c WHERE page_id % 3 = 0) AS saved FROM c""")
def cleaned_url_check(t):
    # Raw URLs are stored and cleaned ones are looked up: a stored URL with a query is not found, so counts fall short, and its raw form keeps it from being saved twice.
    rows = t("pages").select("page_id", "url", listing.clean_url(F.col("url")).alias("clean"))
    stored = rows.filter("page_id % 3 = 0").select("url").distinct()
    marked = rows.join(stored.select(F.col("url").alias("clean"), F.lit(True).alias("had")), "clean", "left").join(stored.withColumn("same", F.lit(True)), "url", "left")
    had, same = F.coalesce("had", F.lit(False)), F.coalesce("same", F.lit(False))
    return marked.select("page_id", (F.col("page_id") % 3 == 0).alias("stored"), had.alias("already_in_db"), (~had & ~same).alias("saved"))


@query(r"""WITH u AS (SELECT substr(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''), 1, 140) AS url, min(page_id) AS id FROM pages GROUP BY 1),
w AS (SELECT id, url, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')), '[\p{L}\p{N}]+'))) AS word FROM u),
q AS (SELECT s_name AS query, unnest(list_distinct(['en', 'html', CAST(s_suppkey AS VARCHAR), CASE s_suppkey % 3 WHEN 0 THEN 'fr' ELSE 'de' END])) AS word FROM supplier),
m AS (SELECT query, id, url, count(*) AS matched FROM q JOIN w ON q.word = w.word GROUP BY 1, 2, 3)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY matched DESC, id) AS INTEGER) AS place, url, matched FROM m QUALIFY place <= 150""")
def sitemap_search(t):
    words = F.concat(F.lit("EN, html/"), text("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, " fr-en").otherwise(" De"))
    return search.search_paths(search.path_index(t("pages"), "page_id"), t("supplier").select(F.col("s_name").alias("query"), words.alias("words")))


@query("""WITH m AS (SELECT c_custkey, unnest([c_custkey, c_custkey * 7, -1]) AS k FROM customer WHERE c_custkey % 5 <> 4)
SELECT c_custkey, 's' || k AS site, 'log-' || k AS log_name, coalesce(o_orderstatus, 'Failed') AS status, o_totalprice AS saved FROM (SELECT DISTINCT c_custkey, k FROM m) LEFT JOIN orders ON o_orderkey = k""")
def log_lookup(t):
    entry = lambda k: F.concat(F.lit('"s'), k.cast("string"), F.lit('":"log-'), k.cast("string"), F.lit('"'))
    key = F.col("c_custkey")
    keys = F.array_distinct(F.array(key, key * 7, F.lit(-1).cast(dict(t("customer").dtypes)["c_custkey"])))
    argument = F.when(key % 5 == 4, "no map").otherwise(F.concat(F.lit("{"), F.array_join(F.transform(keys, entry), ","), F.lit("}")))
    logs = t("orders").select(F.concat(F.lit("log-"), text("o_orderkey")).alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("saved"))
    return records.lookup(t("customer").select("c_custkey", argument.alias("argument")), logs, "argument", ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_partkey AND o_orderstatus <> 'O')")
def new_to_bucketed_store(t):
    spark = t("orders").sparkSession
    name = f"store_{uuid.uuid4().hex}"
    stored = t("orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_partkey"), "o_orderstatus")
    store.write_store(stored, name, new_folder(spark, "store"), ["l_partkey"])
    return store.new_to_store(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), name, ["l_partkey"])


_RAW = """SELECT l_suppkey AS site, 'http://p/' || l_partkey AS url, l_partkey AS k, CASE l_linenumber % 4 WHEN 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS price, l_shipdate, l_orderkey, l_linenumber, l_returnflag FROM lineitem"""


@query(f"""WITH raw AS ({_RAW}), s AS (SELECT p_partkey AS k, p_partkey % 10 AS site FROM part WHERE p_size <= 15),
r AS (SELECT raw.*, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.k = raw.k AND s.site = raw.site) THEN 'skipped' WHEN raw.k % 11 = 0 THEN 'no url' WHEN price = 'n/a' THEN 'price' WHEN raw.k IN (SELECT k FROM s) THEN 'stored' END AS reason FROM raw),
g AS (SELECT CASE WHEN k % 11 = 0 THEN '' ELSE url END AS url, reason, CASE WHEN reason IN ('no url', 'price') THEN concat_ws('|', site, l_shipdate, l_orderkey, l_linenumber, price, l_returnflag) END AS own, count(*) AS copies,
min(struct_pack(l_shipdate := l_shipdate, l_orderkey := l_orderkey, l_linenumber := l_linenumber, site := site)) AS first FROM r GROUP BY 1, 2, 3),
o AS (SELECT url, first.site AS site, first.l_orderkey AS l_orderkey, CASE WHEN reason IS NULL THEN 'saved' WHEN reason IN ('skipped', 'stored') THEN 'known' ELSE 'rejected' END AS outcome, reason, copies FROM g),
n AS (SELECT count(*) FILTER (outcome = 'saved') AS saved, count(*) FILTER (reason = 'stored') AS others, coalesce(sum(copies) FILTER (reason = 'skipped'), 0) AS skipped, coalesce(sum(copies) FILTER (outcome = 'rejected'), 0) AS rejected FROM o)
SELECT url, site, l_orderkey, outcome, reason, copies FROM o
UNION ALL SELECT NULL, NULL, NULL, 'counter', unnest(['found', 'skipped', 'saved', 'rejected']), unnest([saved + others + skipped, skipped, saved, rejected]) FROM n""")
def save_products(t):
    """What becomes of each row, as it was written, and the counters that were taken while writing."""
    lines = t("lineitem")
    spark = lines.sparkSession
    key = F.col("l_partkey")
    url = F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("http://p/"), key.cast("string")))
    price = F.when(F.col("l_linenumber") % 4 == 0, "n/a").otherwise(text("l_quantity"))
    raw = lines.select(F.col("l_suppkey").alias("site"), url.alias("source_product_url"), key.alias("k"), price.alias("price"), "l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag")
    stored = t("part").filter("p_size <= 15").select(F.col("p_partkey").alias("k"), F.concat(F.lit("http://p/"), text("p_partkey")).alias("source_product_url"), (F.col("p_partkey") % 10).alias("site"))
    found = saving.outcomes(raw, stored, ["source_product_url"], ["l_shipdate", "l_orderkey", "l_linenumber", "site"], saving.product_rules(raw), skip=["site", "k"])
    path = new_folder(spark, "saved")
    counted = saving.save(found, path)
    rows = spark.read.parquet(path).select(F.col("source_product_url").alias("url"), "site", "l_orderkey", "outcome", "reason", "copies")
    more = spark.createDataFrame([(None, None, None, "counter", k, v) for k, v in counted.items()], rows.schema)
    return rows.unionByName(more)


@query("""WITH c AS (SELECT o_custkey AS collection, o_orderkey AS id, 'SKU-' || (o_orderkey % 997) AS item_code, o_totalprice AS rate FROM orders WHERE o_orderstatus = 'F'),
s AS (SELECT 'SKU-' || p_partkey AS item_code, p_retailprice AS rate FROM part WHERE p_partkey < 500),
i AS (SELECT 'items' AS output, item_code AS key, CAST(arg_min(id, struct_pack(c := collection, i := id)) AS VARCHAR) AS value FROM c WHERE item_code NOT IN (SELECT item_code FROM s) GROUP BY item_code),
n AS (SELECT item_code, arg_max(rate, struct_pack(c := collection, i := id)) AS rate FROM c WHERE rate <> 0 GROUP BY item_code),
p AS (SELECT 'prices', coalesce(s.item_code, n.item_code), CAST(CAST(round(coalesce(n.rate, s.rate) * 100) AS BIGINT) AS VARCHAR) FROM s FULL JOIN n ON s.item_code = n.item_code),
h AS (SELECT 'collections', CAST(o_custkey AS VARCHAR), CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR) FROM orders GROUP BY o_custkey),
k AS (SELECT 'children', collection || '/' || row_number() OVER (PARTITION BY collection ORDER BY id), item_code FROM c),
d AS (SELECT 'products', CAST(o_orderkey AS VARCHAR), CASE o_orderstatus WHEN 'F' THEN 'Finalized' ELSE 'Pending' END FROM orders)
SELECT * FROM i UNION ALL SELECT * FROM p UNION ALL SELECT * FROM h UNION ALL SELECT * FROM k UNION ALL SELECT * FROM d""")
def finalize_published(t):
    """Each customer's collection of its own orders; all five outputs published together and read back."""
    orders = t("orders")
    spark = orders.sparkSession
    code = lambda c: F.concat(F.lit("SKU-"), c.cast("string"))
    products = orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "Kept").otherwise("Pending").alias("review_status"), code(F.col("o_orderkey") % 997).alias("sku"), text("o_orderkey").alias("product_name"),
        F.lit("site").alias("source_site"), F.concat(F.lit("http://o/"), text("o_orderkey")).alias("source_product_url"), F.concat(F.lit("$"), text("o_totalprice")).alias("source_price"),
    )
    part = t("part").filter("p_partkey < 500").select(code(F.col("p_partkey")).alias("item_code"), F.col("p_retailprice").alias("rate"))
    named = orders.select(F.col("o_custkey").alias("collection"), F.col("o_orderkey").alias("id"))
    root = new_folder(spark, "published")
    publish.publish(spark, root, {"products": products, "prices": part, "named": named}, lambda now: finalize.outputs(now["products"], now["prices"], now["prices"], now["named"].select("collection").distinct(), now["named"], "2024-05-01"))
    read = lambda name: publish.read_published(spark, root, name)
    row = lambda df, key, value: df.select(key.cast("string").alias("key"), value.cast("string").alias("value"))
    out = {
        "items": row(read("items"), F.col("item_code"), F.col("item_name")), "prices": row(read("prices"), F.col("item_code"), F.round(F.col("rate") * 100).cast("long")),
        "collections": row(read("collections"), F.col("collection"), F.col("created")), "children": row(read("children"), F.concat_ws("/", F.col("collection"), F.col("idx")), F.col("item_code")),
        "products": row(read("products"), F.col("id"), F.col("review_status")),
    }
    parts = [df.select(F.lit(name).alias("output"), "key", "value") for name, df in out.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("""WITH r AS (SELECT 'u' || l_partkey AS url, CAST(l_suppkey % 20 AS VARCHAR) AS site, 'run-' || (10 + l_orderkey % 50) AS run, l_linenumber AS page, l_orderkey AS seq, l_returnflag <> 'R' AS fit FROM lineitem),
o AS (SELECT url, min(struct_pack(run := run, page := page, seq := seq, site := site)) AS o FROM r WHERE fit GROUP BY url),
e AS (SELECT r.url, r.site, r.run, fit, count(*) AS copies, min(struct_pack(run := r.run, page := page, seq := seq, site := r.site)) AS first FROM r GROUP BY r.url, r.site, r.run, fit),
d AS (SELECT e.*, o.o.site = e.site AND o.o.run < e.run AS had, fit AND first = o.o AS own FROM e LEFT JOIN o ON o.url = e.url),
f AS (SELECT url, site, run, CASE WHEN had THEN 'skipped' WHEN NOT fit THEN 'unfit' ELSE 'known' END AS decision, CASE WHEN own THEN copies - 1 ELSE copies END AS copies FROM d
UNION ALL SELECT url, site, run, 'saved', 1 FROM d WHERE own)
SELECT url AS source_product_url, site, run, decision, copies FROM f WHERE copies > 0""")
def seen_sets(t):
    rows = t("lineitem").select(
        F.concat(F.lit("u"), text("l_partkey")).alias("source_product_url"), (F.col("l_suppkey") % 20).cast("string").alias("site"), F.concat(F.lit("run-"), (10 + F.col("l_orderkey") % 50).cast("string")).alias("run"),
        F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("seq"), (F.col("l_returnflag") != "R").alias("fit"),
    )
    return seen.decide(rows)


@query(r"""WITH RECURSIVE p AS (SELECT page_id // 40 AS s, page_id % 40 AS n, length(html) AS z, regexp_extract_all(html, '<a href="/([a-z]*)"', 1) AS h, CASE WHEN length(url) % 37 = 3 THEN 0 WHEN length(html) % 71 = 9 THEN -1 ELSE page_id % 40 + 1 END AS next FROM pages),
g AS (SELECT s, n, next, h FROM p WHERE z % 89 <> 5 AND z % 79 <> 2 AND z % 83 <> 7 AND len(h) > 0),
r AS (SELECT s, n, next, h, 1 AS page FROM g WHERE n = 0 UNION ALL SELECT g.s, g.n, g.next, g.h, r.page + 1 FROM r JOIN g ON g.s = r.s AND g.n = r.next WHERE r.next > 0),
x AS (SELECT CAST(s AS VARCHAR) AS site, page, seq, h[seq + 1] AS handle FROM (SELECT s, page, h, unnest(range(len(h))) AS seq FROM r)),
k AS (SELECT 's' || (page_id // 40) AS k, regexp_extract(html, '<a href="/([a-z]*)"', 1) AS handle FROM pages WHERE page_id % 9 = 0)
SELECT site, page, CAST(seq AS INTEGER) AS seq, 'http://s' || site || '.example/products/' || handle AS source_product_url, CASE WHEN seq % 3 = 0 THEN 'Gold ring ' ELSE 'Chains ' END || handle AS product_name, 'http://i/' || handle AS product_image_url,
CASE WHEN seq % 2 = 0 THEN '5.50' ELSE '' END AS price, CASE WHEN seq % 2 = 0 THEN 'sku-' || handle ELSE '' END AS sku, 'a ' || handle AS description, CASE WHEN seq % 3 = 0 THEN 'Hats' ELSE '' END AS category
FROM x WHERE handle <> '' AND seq % 3 <> 1 AND seq % 5 <> 4 AND NOT EXISTS (SELECT 1 FROM k WHERE k.k = 's' || site AND k.handle = x.handle)""")
def store_listings(t):
    """The whole store reader: chains of pages, what a site has left out before the classifier, the classifier, an image, the field map."""
    starts = _starts(t)
    none = F.lit(None).cast("array<struct<src:string>>")
    product = lambda h, i: F.struct(
        F.concat(F.when(i % 3 == 0, "Gold ring ").when(i % 3 == 1, "Hat ").otherwise("Chains "), h).alias("title"), h.alias("handle"), F.when(i % 3 == 0, "Hats").alias("product_type"), F.concat(F.lit("<p>a "), h, F.lit("</p>")).alias("body_html"),
        F.when(i % 5 != 4, F.array(F.struct(F.concat(F.lit("http://i/"), h).alias("src")))).otherwise(none).alias("images"),
        F.when(i % 2 == 0, F.array(F.struct(F.lit("5.50").alias("price"), F.concat(F.lit("sku-"), h).alias("sku")))).alias("variants"),
    )
    stored = t("pages").filter("page_id % 9 = 0").select(
        _site().alias("site"), F.concat(F.lit("http://s"), _site(), F.lit(".example/products/"), F.regexp_extract("html", '<a href="/([a-z]*)"', 1)).alias("url")
    )
    raw = chains.store_products(_responses(t, product, '<a href="/([a-z]*)"'), starts, ["status", "body", "link"])
    endpoint = F.concat(F.lit("http://s"), F.col("site"), F.lit(".example/products.json"))
    return listings(raw, endpoint, stored)


@query("""WITH a AS (SELECT page_id, n AS attempt, CASE (length(html) + 7 * n * n) % 6 WHEN 0 THEN 'HTTP 429: ' WHEN 1 THEN 'Read timed out' WHEN 2 THEN 'HTTP 500: ' WHEN 3 THEN 'HTTP 429: ' WHEN 4 THEN 'Rate limit' END AS error FROM pages, range(1, 5) r(n)),
e AS (SELECT page_id, coalesce(min(attempt) FILTER (error IS NULL OR error = 'HTTP 500: '), 4) AS stop FROM a GROUP BY page_id),
f AS (SELECT page_id, least(stop, 3) AS attempts, CASE WHEN stop <= 3 THEN stop - 1 ELSE 3 END AS waits FROM e)
SELECT f.page_id, attempts, CAST(5 * waits * (waits + 1) AS BIGINT) AS waited, error FROM f JOIN a ON a.page_id = f.page_id AND a.attempt = f.attempts""")
def page_retries(t):
    kind = (F.char_length("html") + 7 * F.col("attempt") * F.col("attempt")) % 6
    error = F.when(kind.isin(0, 3), "HTTP 429: ").when(kind == 1, "Read timed out").when(kind == 2, "HTTP 500: ").when(kind == 4, "Rate limit")
    attempts = t("pages").select("page_id", "html", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt")).select("page_id", "attempt", error.alias("error"))
    return records.after_retries(attempts, ["page_id"])
