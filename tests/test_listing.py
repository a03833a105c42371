"""Truth tables of the listing functions, the page source and incremental ingest."""

import json

import pytest
from pyspark.sql import functions as F

from shopsift.functions import listing
from shopsift.operators import records, review, tables
from shopsift.plans import catalogue
from shopsift.sources.pages import RecordedPages, listings, recorded_pages
from shopsift.streaming.ingest import ingest_stream

CASES = [
    (listing.parse_price, {"$1,299.00": 1299.0, "1.234,56": 1.23456, ".99": 99.0, "$10 - $20": 10.0, "12.": 12.0, "free": 0.0, "": 0.0, None: 0.0, "USD 45": 45.0, "1e5": 1.0}),
    (lambda c: F.array_join(listing.normalize_tags(c), "|"), {'["LC_Jewelry",""," a-b "]': "LC Jewelry|a b", "x, y": "x|y", None: ""}),
    (listing.strip_html, {"<p>a</p><b>b</b>": "a  b", "&amp;": "&amp;", None: ""}),
    (listing.clean_url, {"https://a.b/c/d?x=1#t": "https://a.b/c/d", "https://a.b/c;p=1?q": "https://a.b/c", "HTTPS://A.b/c": "https://A.b/c", "https://a.b/x y?z": "https://a.b/x y"}),
    (listing.base_url, {"http://a.b:80/c": "http://a.b:80"}),
    (listing.collection_handle, {"http://a.b/collections/gold-rings/": "gold-rings", "http://a.b/products/x": None}),
    (lambda c: listing.page_url(c, F.lit(2)), {"https://a.b/c?sort=x": "https://a.b/c?p=2", "https://a.b/c#t": "https://a.b/c?p=2#t"}),
    (listing.link_next, {'<u1>; rel="previous", <u2>; rel="next"': "u2", '<u1>; rel="previous"': None, None: None}),
    (listing.error_kind, {"HTTP 402": "credits", "HTTP 401": "key", "429": "rate", "Read timed out": "timeout", "Connection refused": "network", "boom": "other", "402 429": "credits"}),
    (listing.is_product_url, {"http://a.b/products/a": True, "http://a.b/p/x/y": True, "/a.html": True, "/products/a?v=1": False, "/cart": False}),
    (lambda c: F.array_join(listing.comma_list(c), " · "), {"Earrings, ,Necklaces": "Earrings · Necklaces", None: ""}),
    (lambda c: listing.is_jewelry(F.lit(None), F.lit(None), c), {"gold-ring": True, "Ring": True, "rings!": True, "string": False, "LC_ring": False}),
    (lambda c: listing.is_jewelry(F.lit(None), c, F.lit(None)), {"LC_Jewelry": True}),
    (lambda c: listing.duration_text(c.cast("long")), {"60": "60s", "61": "1m 1s"}),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_truth_table(spark, number):
    build, table = CASES[number]
    df = spark.createDataFrame([(k,) for k in table], "v string").select("v", build(F.col("v")).alias("got"))
    assert {r.v: r.got for r in df.collect()} == table


def test_item_code(spark):
    df = spark.createDataFrame([(" A1 ", None), (" ", "Gold Ring!"), (None, None)], "sku string, name string")
    got = [r[0] for r in df.select(listing.item_code(F.col("sku"), F.col("name"))).collect()]
    assert got[0] == "A1" and got[1].startswith("Gold Ring-") and len(got[1]) == 16 and got[2].startswith("ITEM-")


def test_pages_stop_when_nothing_is_new(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c")], "page long, url string")
    assert sorted(tuple(r) for r in tables.until_nothing_new(df, "page", "url", 4).filter("page > 0").collect()) == []
    df = df.withColumn("page", F.col("page") - 1)
    assert sorted(tuple(r) for r in tables.until_nothing_new(df, "page", "url", 4).collect()) == [(0, "a"), (0, "a"), (0, "b")]


def test_only_the_stop_rule_ends_the_pages(spark, tmp_path):
    # 150 pages of 20 events with a new user each, a page without, and a page with new ones.
    users = [e // 20 if e < 3000 else 7 if e < 3020 else e for e in range(3040)]
    spark.createDataFrame(list(enumerate(users)), "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.event_id for r in catalogue.QUERIES["pagination_stop"](spark, str(tmp_path)).collect()) == list(range(3000))
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "b"), (3, "a"), (4, "c")], "page long, url string")
    assert sorted(r.page for r in tables.until_nothing_new(df, "page", "url").collect()) == [0, 1, 2]
    assert sorted(r.page for r in tables.until_nothing_new(df.filter("page < 3"), "page", "url").collect()) == [0, 1, 2]
    assert tables.until_nothing_new(df.filter("page > 0"), "page", "url").collect() == []


def test_merge_keeps_columns_out_of_the_list(spark):
    a = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep")], "k int, v string, w string")
    b = spark.createDataFrame([(2, None, "new"), (3, "c", "new")], "k int, v string, w string")
    assert sorted(tuple(r) for r in tables.merge(a, b, ["k"], ["v"]).collect()) == [(1, "a", "keep"), (2, None, "keep"), (3, "c", "new")]


def test_status_is_checked(spark):
    with pytest.raises(ValueError):
        review.set_status(spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1,)], "id int"), "Finalized")


def test_recorded_pages_and_incremental_ingest(spark, tmp_path):
    product = lambda h, **k: {"title": "Gold ring", "handle": h, "tags": ["x"], "images": [{"src": "i"}], "variants": [{"price": "5", "sku": "s"}], "body_html": "<p>a</p>"} | k
    pages = {"s-1": [product("a"), product("b", images=[]), product("c", title="Hat")], "s-2": [product("a"), product("d")], "s-3": [], "s-4": [product("z")]}
    folder = tmp_path / "pages"
    folder.mkdir()
    for name, products in pages.items():
        (folder / f"{name}.json").write_text(json.dumps({"products": products}))
    spark.dataSource.register(RecordedPages)
    raw = spark.read.format("recorded_pages").load(str(folder))
    assert raw.count() == 5
    by_files = recorded_pages(spark, str(folder))
    key = lambda r: (r.site, r.page, r.seq, json.loads(r.product)["handle"])
    assert sorted(map(key, raw.collect())) == sorted(map(key, by_files.collect()))
    got = listings(raw, "http://a.b/products.json")
    assert sorted(r.source_product_url for r in got.collect()) == ["http://a.b/products/a"] * 2 + ["http://a.b/products/d"]

    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    got.write.parquet(landing)
    for _ in range(2):
        stream = spark.readStream.schema(got.schema).parquet(landing)
        assert ingest_stream(stream, store, str(tmp_path / "checkpoint")).awaitTermination(120)
        got.write.mode("append").parquet(landing)
    assert sorted(r.source_product_url for r in spark.read.parquet(store).collect()) == ["http://a.b/products/a", "http://a.b/products/d"]


def test_ingest_by_site_and_url(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    for site in ("x", "y"):
        spark.createDataFrame([(site, 1, i, f"u{i}") for i in range(5)], "site string, page int, seq int, source_product_url string").write.mode("append").parquet(landing)
        stream = spark.readStream.schema("site string, page int, seq int, source_product_url string").parquet(landing)
        assert ingest_stream(stream, store, str(tmp_path / "checkpoint"), ["site", "source_product_url"]).awaitTermination(120)
    assert spark.read.parquet(store).count() == 10


@pytest.mark.parametrize("given,want", [(None, ["a", "b"]), ("", ["a", "b"]), ("x", ["x"]), ('"x"', ["x"]), ('["x", "y"]', ["x", "y"]), ("[]", ["a", "b"]), (["x"], ["x"])])
def test_site_arguments(spark, given, want):
    assert records.site_arguments(given, ["a", "b"]) == want
    if not isinstance(given, list):
        got = spark.createDataFrame([(given,)], "s string").select(records.site_argument_column(F.col("s"), F.array(F.lit("a"), F.lit("b"))).alias("n"))
        assert got.first().n == want


def test_config_value_raises_where_none_is_set(spark):
    rows = spark.createDataFrame([("", None)], "a string, b string")
    with pytest.raises(Exception, match="not set"):
        rows.select(records.config_value(F.col("a"), F.col("b"))).collect()


def test_merge_takes_one_of_repeated_keys_and_may_only_update(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "id int, v string")
    assert sorted(map(tuple, tables.merge(target, changes, ["id"]).collect())) == [(1, "y"), (2, "b"), (3, "z")]
    assert sorted(map(tuple, tables.merge(target, changes, ["id"], insert=False).collect())) == [(1, "y"), (2, "b")]


def test_reinject_once(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "label string")
    added = spark.createDataFrame([("Section",), ("c",)], "label string")
    once = records.reinject(rows, ["b"], added, "Section")
    assert sorted(r.label for r in once.collect()) == ["Section", "a", "c"]
    assert sorted(r.label for r in records.reinject(once, ["c"], added, "Section").collect()) == ["Section", "a", "c"]
