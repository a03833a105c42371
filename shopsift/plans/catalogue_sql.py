"""DuckDB SQL of the catalogue's queries, over the same tables."""

from ..functions.listing import JEWELRY_WORDS

_WORDS = "|".join(JEWELRY_WORDS)
_KEPT = "SELECT CAST(l_partkey AS VARCHAR) AS item_code, l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS rate, l_shipdate FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"
_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'F' THEN 'Kept' ELSE 'Skipped' END"
_HOSTS = r"SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS host FROM pages"
_CLEAN = r"""substr(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''), 1, 140)"""

SQL: dict[str, str] = {
    "site_stats": "SELECT s_suppkey, s_name, count(l_suppkey) AS total_products, max(l_shipdate) AS last_scraped FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2",
    "site_stats_with_zero": "SELECT c_custkey AS s_suppkey, c_name AS s_name, count(l_suppkey) AS total_products, max(l_shipdate) AS last_scraped FROM customer LEFT JOIN lineitem ON c_custkey = l_suppkey GROUP BY 1, 2",
    "collections_counts": "SELECT o_orderkey, o_orderdate, count(l_orderkey) AS item_count FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "collection_items_priced": "SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_shipdate, l.l_partkey AS p_partkey, i.p_name, p.p_retailprice AS price_list_rate, CASE WHEN p.p_partkey IS NOT NULL THEN 'USD' END AS currency FROM lineitem l LEFT JOIN part i ON i.p_partkey = l.l_partkey LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_type = 'PROMO'",
    "run_log_report": "SELECT l_orderkey, l_suppkey, count(*) AS products, min(l_shipdate) AS scraped_at FROM lineitem GROUP BY 1, 2",
    "review_queue_page": f"SELECT o_orderkey AS id, {_STATUS} AS review_status, o_orderpriority AS categories, o_orderdate AS scraped_at FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 24 OFFSET 24",
    "review_queue_search": "SELECT p_partkey AS id, p_name AS product_name, p_brand AS sku FROM part WHERE p_name ILIKE '%RING%' OR p_brand ILIKE '%RING%' ORDER BY p_retailprice DESC, p_partkey LIMIT 24",
    "review_summary": "SELECT count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS kept, count(*) FILTER (o_orderstatus NOT IN ('P', 'F')) AS skipped FROM orders",
    "review_page_count": "SELECT count(*) AS total, CAST(ceil(count(*) / 24.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus = 'P'",
    "status_update": f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'Kept' ELSE {_STATUS} END AS review_status FROM orders",
    "notes_update": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'note ' || o_orderkey END AS notes FROM orders",
    "toggle_active": "SELECT s_suppkey, s_suppkey % 3 <> 0 AS is_active FROM supplier",
    "finalize_items_first_wins": f"SELECT item_code, l_orderkey, l_suppkey FROM ({_KEPT}) WHERE item_code NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_type = 'PROMO') QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, rate) = 1",
    "finalize_price_last_wins": f"WITH n AS (SELECT item_code, rate FROM ({_KEPT}) WHERE rate > 0 QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, rate DESC) = 1) SELECT CAST(p_partkey AS VARCHAR) AS item_code, coalesce(n.rate, p_retailprice) AS rate FROM part LEFT JOIN n ON n.item_code = CAST(p_partkey AS VARCHAR) UNION ALL SELECT item_code, rate FROM n WHERE item_code NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)",
    "finalize_children": f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, item_code, l_suppkey, l_shipdate, rate) AS idx, item_code FROM ({_KEPT})",
    "finalize_status": f"SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'Finalized' ELSE {_STATUS} END AS review_status FROM orders",
    "ensure_dimensions": "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <= 1)",
    "factory_sheet": """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS row, CAST(l_partkey AS VARCHAR) AS style_number, coalesce(p_name, '') AS product_name,
coalesce(p_type, '') AS description, CASE WHEN p_partkey IS NULL THEN '' ELSE 'http://i/' || p_partkey || '.png' END AS image, 'http://s' || l_suppkey || '/p/' || l_partkey AS product_url FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
    "factory_filename": "SELECT p_partkey, translate(p_name || '/' || p_brand, ' /', '_-') || '_factory.xlsx' AS file_name FROM part",
    "already_saved_semi": f"WITH h AS ({_HOSTS}) SELECT page_id, host FROM h WHERE host IN (SELECT host FROM h WHERE page_id % 5 = 0)",
    "new_only_anti": f"WITH h AS ({_HOSTS}) SELECT page_id, host FROM h WHERE host <> '' AND host NOT IN (SELECT host FROM h WHERE page_id % 5 = 0)",
    "ingest_counters": f"WITH h AS ({_HOSTS}), k AS (SELECT DISTINCT host FROM h WHERE page_id % 5 = 0) SELECT count(*) AS urls_found, count(DISTINCT k.host) AS already_in_db, count(DISTINCT CASE WHEN k.host IS NULL THEN h.host END) AS products_saved FROM h LEFT JOIN k ON h.host = k.host",
    "dedupe_first_wins": f"SELECT host, min(page_id) AS page_id FROM ({_HOSTS}) GROUP BY host",
    "dedupe_documents": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(text, ' ')",
    "pagination_stop": """WITH RECURSIVE e AS (SELECT event_id, event_id // 20 AS page, user_id AS url FROM events), b AS (SELECT page, list(url) AS urls FROM e GROUP BY page),
r AS (SELECT page, urls, list_filter(urls, lambda u: false) AS seen FROM b WHERE page = 0
UNION ALL SELECT b.page, b.urls, list_distinct(list_concat(r.seen, r.urls)) FROM r JOIN b ON b.page = r.page + 1 WHERE len(list_filter(r.urls, lambda u: NOT list_contains(r.seen, u))) > 0)
SELECT event_id, e.page, url FROM r JOIN e ON e.page = r.page WHERE NOT list_contains(r.seen, url)""",
    "topup_merge": "WITH l AS (SELECT CAST(r_regionkey AS BIGINT) AS key, 'Brand#' || r_regionkey AS brand FROM region) SELECT * FROM l UNION ALL SELECT min(p_partkey), p_brand FROM part WHERE p_brand NOT IN (SELECT brand FROM l) GROUP BY p_brand",
    "classify_keyword": rf"SELECT p_partkey, regexp_matches(p_type || ' ' || p_name || ' ' || p_brand, '\b({_WORDS})\b', 'i') AS is_jewelry FROM part",
    "normalize_tags": "SELECT p_partkey, replace(p_type || '_x', '_', ' ') || '|' || trim(translate(p_brand || ' - y', '-', ' ')) AS tags FROM part",
    "strip_html": r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS description_md5 FROM pages",
    "url_functions": rf"SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS base, {_CLEAN} AS clean, 'x' || page_id AS handle, regexp_extract(url, '^([^?#]*)', 1) || '?p=' || (page_id + 1) || regexp_extract(url, '(#.*)$', 1) AS page_url, replace(url, ',', '') AS next, 'http://a.b/products/' || page_id AS product_url, NOT regexp_matches(url, '(/collections/?$|/category/?$|/search|/cart|/account|/blogs|\?|#)') AND regexp_matches(url, '(/products/|/p/[^/]+/|\.html$|/[a-z0-9-]+-by-[a-z0-9-]+)') AS is_product FROM pages",
    "parse_price": "SELECT p_partkey, p_size * 1000 + p_partkey % 1000 + 0.5::DOUBLE AS price, '$' || (p_size * 1000 + p_partkey % 1000) || '.50' AS shown FROM part",
    "item_code": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE substr(regexp_replace(p_name, '[^A-Za-z0-9 ]', '', 'g'), 1, 30) || '-' || upper(substr(sha256(p_name), 1, 6)) END AS item_code FROM part",
    "normalise_product": "SELECT p_partkey, p_name AS product_name, CASE WHEN p_size > 25 THEN 'i' || p_size WHEN p_size > 10 THEN 'alt' ELSE '' END AS image FROM part",
    "images_topup": r"""WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="/([^"]*)">', 1), lambda h: 'https://a.b/' || h || '.JPG?w=1') AS l FROM pages),
u AS (SELECT page_id, l, unnest(range(len(l) + 1)) AS i FROM l),
f AS (SELECT page_id, CASE WHEN i = 0 THEN coalesce(l[1], 'https://a.b/.JPG?w=1') ELSE l[i] END AS url, min(i) AS i FROM u WHERE i = 0 OR regexp_full_match(l[i], 'https?://[^\s"''()<>]+') GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place FROM f)
SELECT page_id, string_agg(url, ' ' ORDER BY place) AS images FROM n WHERE place <= 5 GROUP BY page_id""",
    "url_candidates_limit": rf"SELECT min(page_id) AS page_id, {_CLEAN} AS url FROM pages GROUP BY 2 ORDER BY 1 LIMIT 50",
    "error_taxonomy": """WITH t AS (SELECT event_id, event_type || ' HTTP ' || (400 + user_id % 30) || CASE user_id % 4 WHEN 0 THEN ' Read timed out' WHEN 1 THEN ' Connection refused' ELSE '' END AS m FROM events)
SELECT event_id, CASE WHEN m LIKE '%402%' THEN 'credits' WHEN m LIKE '%401%' THEN 'key' WHEN m LIKE '%429%' THEN 'rate' WHEN m ILIKE '%timed out%' THEN 'timeout' WHEN m ILIKE '%connection%' THEN 'network' ELSE 'other' END AS kind,
CASE WHEN m LIKE '%402%' THEN 'abort' WHEN m LIKE '%429%' OR m ILIKE '%timed out%' THEN 'wait' ELSE 'skip' END AS retry,
CASE WHEN m LIKE '%401%' THEN 'Invalid API key (401 Unauthorized)' WHEN m LIKE '%403%' THEN 'Access denied (403 Forbidden)' ELSE 'Connection failed: ' || m END AS message FROM t""",
    "progress_elapsed": """WITH e AS (SELECT o_orderkey, coalesce(date_diff('second', o_orderdate, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey)), 0) AS elapsed FROM orders), a AS (SELECT *, abs(elapsed) % 4000 AS s FROM e)
SELECT o_orderkey, elapsed, CASE WHEN s > 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS shown FROM a""",
    "progress_rollup": "SELECT user_id, count(*) AS logs, count(*) FILTER (event_type <> 'error') AS saved, bool_or(event_type = 'error') AS any_failed, bool_and(event_type IN ('error', 'purchase')) AS all_over FROM events GROUP BY user_id",
    "progress_missing_log": "SELECT s_name, count(e.user_id) AS urls_found, CASE WHEN count(e.user_id) = 0 THEN 'Failed' ELSE 'Done' END AS status FROM supplier LEFT JOIN events e ON e.user_id = s_suppkey * 2 GROUP BY s_suppkey, s_name",
    "badge_text": """WITH e AS (SELECT event_id, user_id AS u, user_id % 3 AS n, user_id % 2 AS known, user_id % 4 AS found, CAST(floor(value) AS BIGINT) AS s,
CASE WHEN event_type = 'error' THEN 'Failed' WHEN user_id % 3 = 0 THEN 'Done' WHEN event_type = 'signup' THEN 'Queued' ELSE 'Running' END AS status,
CASE WHEN user_id % 2 = 0 THEN 'Rate limit hit' WHEN user_id % 5 = 0 THEN 'out of CREDITS' WHEN user_id % 7 = 0 THEN '' ELSE 'timed out' END AS log FROM events),
d AS (SELECT *, CASE WHEN s > 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS took FROM e)
SELECT event_id, CASE WHEN status = 'Failed' THEN CASE log WHEN 'Rate limit hit' THEN 'Rate Limited' WHEN 'out of CREDITS' THEN 'No Credits' WHEN 'timed out' THEN 'Timed Out' ELSE 'Failed' END ELSE status END AS badge,
CASE WHEN known > 0 AND n = 0 THEN '1 already in DB — all up to date' WHEN known > 0 THEN n || ' new · 1 already saved' ELSE n || ' new product' || CASE WHEN n <> 1 THEN 's' ELSE '' END || ' saved' END AS done,
CASE status WHEN 'Failed' THEN CASE WHEN log = '' THEN 'Unknown error' ELSE log END WHEN 'Queued' THEN 'Waiting in queue…'
WHEN 'Running' THEN CASE WHEN found > 0 THEN n || ' new saved so far · ' || found || ' scanned (' || took || ')' ELSE 'Scanning site… (' || took || ')' END
ELSE CASE WHEN n = 0 AND known = 0 AND found = 0 THEN 'No products found on this site' WHEN known > 0 AND n = 0 THEN '1 already in DB — all up to date' WHEN known > 0 THEN n || ' new · 1 already saved' ELSE n || ' new product' || CASE WHEN n <> 1 THEN 's' ELSE '' END || ' saved' END END AS line FROM d""",
    "categories_tags": "SELECT p_partkey, p_brand || ' · ' || p_type AS tags FROM part",
    "html_escape": """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5 FROM pages""",
    "site_filter": "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), 'r#00000001')",
    "active_sites": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 <> 0",
    "method_dispatch": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Store' WHEN 1 THEN 'Listing' ELSE CASE WHEN s_suppkey % 10 = 0 THEN 'Listing' ELSE 'Store' END END AS method FROM supplier",
    "cascade_delete": """SELECT s_suppkey AS l_suppkey, s_name, p.products FROM (SELECT * FROM supplier WHERE s_suppkey % 10 <> 3)
FULL JOIN (SELECT l_suppkey, count(*) AS products FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3) GROUP BY l_suppkey) p ON p.l_suppkey = s_suppkey""",
    "registry_upsert": """WITH c AS (SELECT n_nationkey + 10 AS n_nationkey, upper(n_name) AS n_name, -1 AS status FROM nation WHERE n_nationkey % 2 = 0), n AS (SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey * 3 FROM region))
SELECT coalesce(n.n_nationkey, c.n_nationkey) AS n_nationkey, coalesce(c.n_name, n.n_name) AS n_name, coalesce(n.n_regionkey, c.status) AS status FROM n FULL JOIN c ON n.n_nationkey = c.n_nationkey""",
    "sidebar_reinject": "SELECT r_name AS label FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE') UNION ALL SELECT 'A' || n_name FROM nation WHERE n_nationkey < 3",
    "image_fields": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'png' WHEN p_size % 4 = 1 THEN 'gif' ELSE 'jpeg' END AS ext, CAST(p_size * 7 * 120 // greatest(p_size % 5, 1) AS BIGINT) AS width, base64(encode(p_name)) AS encoded FROM part",
}
