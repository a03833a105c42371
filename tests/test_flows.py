"""Link chains, saving, publishing, the keyed stream, the bucketed store and searching, on fixtures that plain Python judges."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shopsift.functions import listing
from shopsift.operators import chains, finalize, publish, records, saving, search, tables
from shopsift.sources import store
from shopsift.streaming import seen


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def read_chain(pages, url):
    """What a reader that goes from page to page meets."""
    out = []
    while url in pages and url not in out:
        out.append(url)
        url = pages[url]
    return out


def test_chains_of_any_shape(spark):
    """Unequal lengths, one page, a cycle at the start, a cycle further on, a dead link, chains that merge, a start that is not recorded."""
    links = {f"a{k}": f"a{k + 1}" for k in range(37)} | {"a37": None, "b0": None, "c0": "c1", "c1": "c2", "c2": "c0", "d0": "d1", "d1": "d2", "d2": "d3", "d3": "d1", "e0": "e1", "e1": "gone", "f0": "a30", "self": "self"}
    starts = {"a": "a0", "b": "b0", "c": "c0", "d": "d0", "e": "e0", "f": "f0", "g": "gone", "h": "self", "i": "a0"}
    pages = spark.createDataFrame(list(links.items()), "url string, next string")
    found = chains.follow_links(pages, spark.createDataFrame(list(starts.items()), "site string, url string"))
    want = [(s, u, k) for s, start in starts.items() for k, u in enumerate(read_chain(links, start), 1)]
    assert rows(found, "site", "url", "place") == sorted(want, key=str)


def test_random_links(spark):
    random.seed(4)
    links = {str(k): str(random.randrange(260)) for k in range(200)}
    starts = [(f"s{k}", str(k)) for k in range(0, 260, 7)]
    found = chains.follow_links(spark.createDataFrame(list(links.items()), "url string, next string"), spark.createDataFrame(starts, "site string, url string"))
    assert rows(found, "site", "url", "place") == sorted(((s, u, k) for s, start in starts for k, u in enumerate(read_chain(links, start), 1)), key=str)


def test_bad_responses_end_a_chain(spark):
    link = lambda u: f'<x>; rel="previous", <{u}>; rel="next"'
    body = lambda *h: json.dumps({"products": [{"handle": x} for x in h]})
    got = [("a1", 200, body("x", "y"), link("a2"), 0), ("a1", 500, "", None, 1), ("a2", 200, body("z"), link("a3"), 0), ("a3", 404, body("w"), link("a4"), 0), ("a4", 200, body("v"), None, 0)]
    got += [("b1", 200, body("q"), link("b2"), 0), ("b2", 200, "no JSON", link("a1"), 0), ("c1", 200, '{"products":[]}', link("a1"), 0), ("d1", 200, '{"products":{"a":1}}', None, 0), (None, 200, body("n"), None, 0)]
    responses = spark.createDataFrame(got, "url string, status int, body string, link string, seq int")
    starts = spark.createDataFrame([(s, f"{s}1") for s in "abcd"], "site string, url string")
    products = chains.store_products(responses, starts, ["seq"])
    assert rows(products.select("site", "page", "seq", F.get_json_object("product", "$.handle"))) == [("a", 1, 0, "x"), ("a", 1, 1, "y"), ("a", 2, 0, "z"), ("b", 1, 0, "q")]
    assert chains.store_products(responses.limit(0), starts, ["seq"]).collect() == []


RAW = "site string, source_product_url string, price string, endpoint string, seq int"


def test_outcomes_lose_no_row_and_counters_are_those_of_a_separate_count(spark, tmp_path):
    random.seed(2)
    raw = [(random.choice("ab"), random.choice(["u1", "u2", "u3", "u4", "u5", "", None]), random.choice(["1.50", "", "x", None]), random.choice(["collection", "root"]), k // 2) for k in range(300)]
    stored = [("a", "u1"), ("b", "u2"), ("z", "u3")]
    df = spark.createDataFrame(raw, RAW)
    found = saving.outcomes(df, spark.createDataFrame(stored, "site string, source_product_url string"), ["source_product_url"], ["seq", "site"], saving.product_rules(df), ["site", "source_product_url"])
    path = str(tmp_path / "saved")
    counted = saving.save(found, path)
    got = spark.read.parquet(path).collect()
    assert sum(r.copies for r in got) == 300

    def reason(r):
        site, url, price, *_ = r
        return "skipped" if (site, url) in stored else "no url" if not url else "price" if price == "x" else "stored" if url in {u for _, u in stored} else None

    reasons = [(r, reason(r)) for r in raw]
    new = {r[1] for r, why in reasons if why is None}
    assert {r.source_product_url for r in got if r.outcome == "saved"} == new
    for r in (r for r in got if r.outcome == "saved"):
        assert (r.seq, r.site) == min((x[4], x[0]) for x, why in reasons if why is None and x[1] == r.source_product_url)
    skipped, bad = (sum(w in what for _, w in reasons) for what in ({"skipped"}, {"no url", "price"}))
    # A product that both endpoints show counts twice where the site had it, else once.
    assert counted == {"found": len(new) + len({r[1] for r, w in reasons if w == "stored"}) + skipped, "skipped": skipped, "saved": len(new), "rejected": bad}
    rejected = sorted((str(r.site), str(r.source_product_url), str(r.price), r.endpoint, r.seq) for r in got if r.outcome == "rejected" for _ in range(r.copies))
    assert rejected == sorted((str(r[0]), str(r[1]), str(r[2]), r[3], r[4]) for r, w in reasons if w in ("no url", "price"))


def test_counters_are_taken_in_the_pass_that_writes(spark, tmp_path):
    spark.createDataFrame([("a", "u1", "1", "root", 0)], RAW).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    found = saving.outcomes(raw, spark.createDataFrame([], "site string, source_product_url string"), ["source_product_url"], ["seq"], {}, None)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("saving", "saving")
    assert saving.save(found, str(tmp_path / "out")) == {"found": 1, "skipped": 0, "saved": 1, "rejected": 0}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/raw") == 1 and len(jobs.getJobIdsForGroup("saving")) <= 3


def test_rules_for_times_and_bodies(spark):
    df = spark.createDataFrame([("2024-05-01 10:00:00", "{}"), ("yesterday", "{}"), (None, "{"), (None, None)], "scraped_at string, body string")
    assert [r[0] for r in df.select(saving.rejected_for(saving.product_rules(df))).collect()] == [None, "time", "body", "body"]


def test_published_together_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "root")
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    both = lambda t: {"x": t["in"], "y": t["in"].withColumn("v", F.upper("v"))}
    with pytest.raises(LookupError):
        publish.read_published(spark, root, "x")
    assert publish.publish(spark, root, {"in": one}, both) == 1

    def fails(t):
        return {"x": t["in"].withColumn("v", F.lit("new")), "y": t["in"].withColumn("v", F.raise_error(F.lit("lost")).cast("string"))}

    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, root, {"in": one}, fails)
    assert [rows(publish.read_published(spark, root, n)) for n in "xy"] == [[(1, "a")], [(1, "A")]]
    assert publish.publish(spark, root, {"in": one.withColumn("v", F.lit("b"))}, both) == 2
    assert [rows(publish.read_published(spark, root, n)) for n in "xy"] == [[(1, "b")], [(1, "B")]]
    assert rows(publish.read_published(spark, root, "y", 1)) == [(1, "A")] and publish.versions(spark, root) == [1, 2]


def test_old_versions_expire(spark, tmp_path):
    root = str(tmp_path / "root")
    for k in range(4):
        publish.publish(spark, root, {"in": spark.createDataFrame([(k,)], "k int")}, lambda t: {"x": t["in"]})
    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, root, {"in": spark.range(1)}, lambda t: {"x": t["in"].select(F.raise_error(F.lit("lost")).cast("int"))})
    assert publish.expire(spark, root, keep=2) == [1, 2] and publish.versions(spark, root) == [3, 4]
    assert [rows(publish.read_published(spark, root, "x", v)) for v in (3, 4)] == [[(2,)], [(3,)]]
    # What the failed attempt at version 5 left stays until a later version is published.
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "root" / "data").iterdir()) == ["3", "4", "5"]
    publish.publish(spark, root, {"in": spark.range(1)}, lambda t: {"x": t["in"]})
    assert publish.expire(spark, root, keep=1) == [3, 4] and len(list((tmp_path / "root" / "data").iterdir())) == 1


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path / "root")
    df = spark.createDataFrame([(1,)], "k int")

    def late(t):
        assert publish.publish(spark, root, {"in": df}, lambda u: {"x": u["in"]}) == 1
        return {"x": t["in"].withColumn("k", F.lit(2))}

    with pytest.raises(RuntimeError, match="published already"):
        publish.publish(spark, root, {"in": df}, late)
    assert rows(publish.read_published(spark, root, "x")) == [(1,)]


def test_outputs_see_one_snapshot(spark, tmp_path):
    """The input is read once, so values that differ from read to read are the same in all outputs."""
    noisy = spark.range(50).select("id", F.rand().alias("r"))
    root = str(tmp_path / "root")
    publish.publish(spark, root, {"in": noisy}, lambda t: {"x": t["in"], "y": t["in"]})
    assert rows(publish.read_published(spark, root, "x")) == rows(publish.read_published(spark, root, "y"))


def test_requests_take_products_in_order(spark):
    """A request without names takes what is kept still; one with names makes a collection even of nothing."""
    products = spark.createDataFrame([(1, "Kept"), (2, "Kept"), (3, "Pending"), (4, "Kept"), (5, "Kept")], "id int, review_status string")
    requests = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "collection string")
    named = spark.createDataFrame([("a", 1), ("a", 3), ("c", 4), ("e", 1)], "collection string, id int")
    assert rows(records.taken_products(products, requests, named)) == [("a", 1), ("b", 2), ("b", 4), ("b", 5)]
    got = {r.collection: (r.finalized_on is not None, r.created) for r in records.collection_headers(products, requests, named, "2024-05-01").collect()}
    assert got == {"a": (True, 1), "b": (True, 3), "c": (True, 0), "d": (False, 0), "e": (True, 0)}


def test_finalize_outputs(spark):
    products = spark.createDataFrame(
        [(1, "Kept", "A", "ring", "s1", "u1", "$5"), (2, "Kept", "A", "ring two", "s2", "u2", "7.00"), (3, "Kept", "B", None, None, None, "free"), (4, "Skipped", "C", "no", "s", "u", "9")],
        "id int, review_status string, sku string, product_name string, source_site string, source_product_url string, source_price string",
    )
    items = spark.createDataFrame([("Z",)], "item_code string")
    prices = spark.createDataFrame([("A", 1.0), ("Z", 2.0)], "item_code string, rate double")
    requests = spark.createDataFrame([("all",)], "collection string")
    out = finalize.outputs(products, items, prices, requests, spark.createDataFrame([], "collection string, id int"), "2024-05-01")
    assert rows(out["items"]) == [("A", "ring", "s1", "u1"), ("B", "B", "", "")]
    assert rows(out["prices"]) == [("A", 7.0), ("Z", 2.0)]
    assert rows(out["children"], "collection", "idx", "item_code", "item_name") == [("all", 1, "A", "ring"), ("all", 2, "A", "ring two"), ("all", 3, "B", "B")]
    assert rows(out["products"], "id", "review_status") == [(1, "Finalized"), (2, "Finalized"), (3, "Finalized"), (4, "Skipped")]
    assert [r.created for r in out["collections"].collect()] == [3]


LISTED = "source_product_url string, site string, run string, page long, seq long, fit boolean"


def listed(seed, run, pages=4):
    random.seed(seed)
    return [[(random.choice(["u1", "u2", "u3", "u4", "u5", "u6", "", None]), random.choice("abc"), run, page, k, random.random() < 0.6) for k in range(12)] for page in range(pages)]


def write_files(spark, folder, batches):
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, LISTED).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are read in the order of their times


def totals(df):
    return rows(df.groupBy("source_product_url", "site", "run", "decision").agg(F.sum("copies")))


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped between batches, and started again with more input, it says what the batch operator says of all rows."""
    batches = [b for k in range(3) for b in listed(k, f"run-{k}")]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    write_files(spark, folder, batches[:8])
    stream = lambda: spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 1).parquet(folder)
    first = seen.decide_stream(stream(), out, checkpoint, once=False)
    while not first.lastProgress or first.lastProgress["batchId"] < 2:
        assert first.exception() is None
        time.sleep(0.1)
    first.stop()
    part = spark.read.parquet(out).agg(F.sum("copies")).first()[0]
    write_files(spark, folder, batches[8:])
    assert seen.decide_stream(stream(), out, checkpoint).awaitTermination(240)
    whole = spark.createDataFrame([r for b in batches for r in b], LISTED)
    assert totals(spark.read.parquet(out)) == totals(seen.decide(whole))
    filled = whole.filter("source_product_url <> ''").count()
    assert 0 < part < filled == spark.read.parquet(out).agg(F.sum("copies")).first()[0]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != seen.ROCKS


def test_decisions_follow_the_rule_row_by_row(spark):
    batches = [b for k in range(4) for b in listed(10 + k, f"run-{k}")]
    every = sorted((r for b in batches for r in b if r[0]), key=lambda r: (r[2], r[3], r[4], r[1]))
    owner, want = {}, {}
    for url, site, run, *_, fit in every:
        had = owner.get(url)
        if had and had[0] == site and had[1] < run:
            what = "skipped"
        elif not fit:
            what = "unfit"
        elif had:
            what = "known"
        else:
            owner[url], what = (site, run), "saved"
        want[url, site, run, what] = want.get((url, site, run, what), 0) + 1
    assert totals(seen.decide(spark.createDataFrame(every, LISTED))) == sorted(((*k, v) for k, v in want.items()), key=str)


def test_store_is_joined_in_place(spark, tmp_path):
    stored = spark.range(1000).select((F.col("id") * 2).alias("k"), F.lit("x").alias("v"))
    store.write_store(stored, "stored_keys", str(tmp_path / "store"), ["k"], buckets=4)
    new = spark.createDataFrame([(k % 50, k) for k in range(400)] + [(None, -1)], "k long, n long")
    got = store.new_to_store(new, "stored_keys", ["k"])
    assert rows(got) == rows(tables.new_only(new, stored, "k")) and got.count() == 200
    plan = got._jdf.queryExecution().sparkPlan().toString()
    physical = got._jdf.queryExecution().executedPlan().toString()
    scan = physical.split("SelectedBucketsCount")[0].rsplit("SortMergeJoin", 1)[1]
    assert "Bucketed: true" in plan and "Exchange" not in scan.rsplit("FileScan", 1)[0].split("\n")[-1]
    with pytest.raises(ValueError, match="not in buckets"):
        stored.write.saveAsTable("plain_keys")
        store.new_to_store(new, "plain_keys", ["k"])
    spark.sql("DROP TABLE stored_keys")
    spark.sql("DROP TABLE plain_keys")


def test_search_against_brute_force(spark):
    random.seed(7)
    words = ["ring", "gold", "silver", "new", "Éclat", "p1"]
    pages = [(k, f"https://h{k % 3}.example/{'/'.join(random.choices(words, k=random.randrange(4)))}{random.choice(['', '?q=gold', '#ring'])}") for k in range(400)] + [(400, None), (401, "no url at all")]
    asked = [("q1", "Gold RING"), ("q2", "éclat, silver-new"), ("q3", "none"), ("q4", ""), ("q5", None)]
    found = search.search_paths(search.path_index(spark.createDataFrame(pages, "page_id int, url string"), "page_id"), spark.createDataFrame(asked, "query string, words string"), most=9)
    urls = {}
    for k, u in pages:
        if u:
            urls.setdefault(u.split("?")[0].split("#")[0], k)
    split = lambda s: {w for w in __import__("re").findall(r"[^\W_]+", s.lower())}
    want = []
    for q, text in asked:
        scores = [(-len(split(text or "") & split(u.split("://")[-1].partition("/")[2] if "://" in u else u)), k, u) for u, k in urls.items()]
        want += [(q, i, u, -s) for i, (s, _, u) in enumerate(sorted(x for x in scores if x[0])[:9], 1)]
    assert rows(found, "query", "place", "url", "matched") == sorted(want, key=str)


def best_paths(pages, asked, most):
    """By words alone, for URLs that are clean; a null id comes last."""
    split = lambda s: {w for w in re.findall(r"[a-z0-9]+", (s or "").lower())}
    ids, scores = {}, {}
    for k, u in pages:
        ids[u] = min(ids.get(u, float("inf")), float("inf") if k is None else k)
    for q, text in asked:
        for u in ids:
            scores[q, u] = scores.get((q, u), 0) + len(split(text) & split(u.split("://")[1].partition("/")[2]))
    want = []
    for q in {q for q, _ in asked}:
        want += [(q, i, u, -n) for i, (n, _, u) in enumerate(sorted((-n, ids[u], u) for (k, u), n in scores.items() if k == q and n)[:most], 1)]
    return sorted(want, key=str)


def search_fixture(spark, pages, asked, most):
    return search.search_paths(search.path_index(spark.createDataFrame(pages, "page_id int, url string"), "page_id"), spark.createDataFrame(asked, "query string, words string"), most)


@pytest.mark.parametrize("most, few", [(1, 0), (4, 75_000), (4, 0), (30, 75_000), (1000, 75_000)])
def test_search_by_common_and_rare_words(spark, monkeypatch, most, few):
    """Words in most URLs, in some and in one; queries without a common, a rare or any known word, in several rows, without a name; a page without an id."""
    monkeypatch.setattr(search, "FEW", few)
    random.seed(most)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    draw = lambda n: random.choices(words, weights, k=n)
    pages = [(random.randrange(10**6) * 2, f"http://h/{'/'.join(draw(random.randrange(1, 6)))}/p{k % 90}") for k in range(300)]
    pages += [(k + 1, u) for k, u in random.sample(pages, 40)] + [(None, "http://h/w0/none"), (None, pages[0][1])]
    asked = [(f"q{k % 30}", " ".join(draw(random.randrange(1, 5)) + [f"p{k}"] * (k % 3))) for k in range(60)]
    asked += [("common", "w0 w1 W0"), ("rare", "p3, p4"), ("unknown", "x y"), ("empty", ""), ("null", None), (None, "w0 p7"), (None, "w0 p8")]
    assert rows(search_fixture(spark, pages, asked, most), "query", "place", "url", "matched") == best_paths(pages, asked, most)


def largest_step(df):
    """The most rows that a step of the plan made, once it has run."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_searches_share_their_common_words(spark):
    pages = [(k, f"http://h/{'en' if k % 4 else 'de'}/{k}.html") for k in range(2000)]
    asked = [(f"q{k}", f"en html {k}") for k in range(200)]
    found = search_fixture(spark, pages, asked, 5)
    assert rows(found, "query", "place", "url", "matched") == best_paths(pages, asked, 5)
    found.collect()
    assert largest_step(found) <= 5000  # every query with every URL would be 400,000


def test_items_are_parsed_one_by_one(spark):
    body = json.dumps({"success": True, "data": {"json": {"products": [None, {}, [], 5, "x", {"product_name": "a", "images": [], "product_image_url": "i"}, {"price": {"odd": 1}, "images": ["j", 2]}, {"images": "no list", "sku": 7}]}}})
    page = lambda status, text: ("s", 1, status, text)
    pages = records.listing_pages(spark.createDataFrame([page(200, body)], "site string, page int, status int, body string"))
    got = [(r.product_name, r.product_image_url, r.price, r.sku) for r in records.normalised_items(pages).orderBy("seq").collect()]
    assert got == [("a", "i", "", ""), ("", "j", '{"odd":1}', ""), ("", "", "", "7")]
    odd = [page(200, None), page(404, "x"), page(302, '{"success":true}'), page(200, '{"success":true,"data":null}'), page(200, '{"success":"yes?"}')]
    errors = [r.error for r in records.listing_pages(spark.createDataFrame(odd, "site string, page int, status int, body string")).collect()]
    assert errors == ["Scrape failed: ", "HTTP 404: x", None, None, 'Scrape failed: {"success":"yes?"}']


def test_runs_end_where_nothing_is_new_or_on_credits(spark):
    credits = "HTTP 402: Payment Required"
    pages = [("a", 1, None, "u"), ("a", 2, None, "v"), ("b", 1, None, "u"), ("b", 2, "HTTP 500: x", None), ("b", 3, credits, None), ("c", 1, None, "u"), ("c", 2, credits, None), ("d", 1, "HTTP 429: ", None)]
    pages += [("f", 1, None, "u"), ("f", 2, None, "u"), ("f", 3, credits, None), ("g", 1, None, ""), ("g", 2, None, ""), ("h", 2, None, "u"), ("i", 1, credits, None)]
    pages += [("j", k, None, f"u{k}") for k in range(1, 31)] + [("j", 31, credits, None)]
    items = lambda u: [] if u is None else [json.dumps({"product_source_url": u})]
    df = spark.createDataFrame([(s, p, e, items(u)) for s, p, e, u in pages], "site string, page int, error string, items array<string>")
    df = df.select("site", "page", "error", F.transform("items", F.parse_json).alias("products"))
    got = records.listing_runs(df, spark.createDataFrame([(s,) for s in "abcdefghij"], "site string"))
    want = {"a": ("Done", 2), "b": ("Done", 1), "c": ("Failed", 0), "d": ("Done", 0), "e": ("Done", 0), "f": ("Done", 1), "g": ("Done", 2), "h": ("Done", 0), "i": ("Failed", 0), "j": ("Done", 30)}
    assert {r.site: (r.status, r.last_page) for r in got.collect()} == want
    assert {r.log for r in got.filter("log IS NOT NULL").collect()} == {"Out of credits at the scraping service"}


def test_folded_log_equals_merges_step_by_step(spark):
    random.seed(9)
    updates = [(random.choice("xyz"), k, random.choice([None, "Running", "Done"]), random.choice([None, k])) for k in range(40)]
    log = spark.createDataFrame(updates, "name string, seq int, status string, saved int")
    state = {}
    for name, _, *values in updates:
        state[name] = [v if v is not None else old for v, old in zip(values, state.get(name, [None, None]), strict=True)]
    assert rows(tables.fold_updates(log, ["name"], ["seq"])) == sorted((k, *v) for k, v in state.items())
    snapshot = log.select("name").distinct().select("name", F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("saved"))
    for _, seq, *_ in updates[:6]:
        step = log.filter(F.col("seq") == seq)
        for c in ("status", "saved"):
            snapshot = tables.merge(snapshot, step.filter(F.col(c).isNotNull()).select("name", c), ["name"], [c], insert=False)
    assert rows(snapshot) == rows(snapshot.select("name").join(tables.fold_updates(log.filter("seq < 6"), ["name"], ["seq"]), "name", "left"))


def test_last_of_repeated_changes_counts(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    changes = spark.createDataFrame([(1, "z", 1), (1, "b", 2), (2, "c", 5), (2, "y", 3)], "k int, v string, at int")
    assert rows(tables.merge(target, changes, ["k"], seq="at")) == [(1, "b"), (2, "c")]


def keep_new(pages):
    """The reference's loop: pages in order, rows whose key no earlier page had."""
    known, out, page = set(), [], 0
    while True:
        batch = [r for r in pages if r[0] == page]
        new = [r for r in batch if r[1] not in known]
        if not new:
            return out
        known |= {r[1] for r in new if r[1]}
        out += new
        page += 1


@pytest.mark.parametrize("seed", range(4))
def test_until_nothing_new_is_the_loop(spark, seed):
    random.seed(seed)
    by_site = {s: [(p, random.choice([None, "", *map(str, range(3 + 2 * p))])) for p in range(random.randrange(1, 9)) for _ in range(random.randrange(4))] for s in "ab"}
    df = spark.createDataFrame([(s, *r) for s, pages in by_site.items() for r in pages], "site string, page int, url string")
    want = sorted(((s, *r) for s, pages in by_site.items() for r in keep_new(pages)), key=str)
    assert rows(tables.until_nothing_new(df, "page", "url", by=["site"])) == want
    assert rows(tables.until_nothing_new(df.filter("site = 'a'"), "page", "url")) == [r for r in want if r[0] == "a"]
    later = df.withColumn("page", F.col("page") + 1)
    assert rows(tables.until_nothing_new(later, "page", "url", by=["site"], start=1).withColumn("page", F.col("page") - 1)) == want


def test_lookup_of_a_map(spark):
    asked = spark.createDataFrame([(1, '{"a":"l1","b":"gone"}'), (2, "no map"), (3, None), (4, "{}")], "id int, names string")
    logs = spark.createDataFrame([("l1", "Done", 5)], "name string, status string, saved int")
    assert rows(records.lookup(asked, logs, "names", ["id"])) == [(1, "a", "l1", "Done", 5), (1, "b", "gone", "Failed", None)]


def test_registry_keeps_what_runs_set(spark):
    registry = spark.createDataFrame([("old", "x", "s0"), ("me", "x", "connected"), ("other", "y", "s2")], "id string, title string, status string")
    legacy = spark.createDataFrame([("old",)], "id string")
    row = spark.createDataFrame([("me", "new", "unknown")], "id string, title string, status string")
    assert rows(records.sync_registry(registry, row, "id", ["status"], legacy)) == [("me", "new", "connected"), ("other", "y", "s2")]
    assert rows(records.sync_registry(registry.filter("id = 'other'"), row, "id", ["status"], legacy)) == [("me", "new", "unknown"), ("other", "y", "s2")]


def test_strip_takes_no_break_spaces(spark):
    df = spark.createDataFrame([("   a b \x85　\n",)], "v string")
    assert df.select(listing.strip(F.col("v"))).first()[0] == "a b"


def test_calls_end_by_their_attempts(spark):
    wait, bad, credits = "HTTP 429: ", "HTTP 500: ", "HTTP 402: Payment Required"
    calls = {"a": [None], "b": [wait, None], "c": [wait, wait, wait], "d": [wait, wait, wait, None], "e": [bad, None], "f": [wait, credits, None], "g": [wait]}
    want = {"a": (1, 0, None), "b": (2, 10, None), "c": (3, 60, wait), "d": (3, 60, wait), "e": (1, 0, bad), "f": (2, 10, credits), "g": (1, 10, wait)}
    df = spark.createDataFrame([(k, n, e) for k, errors in calls.items() for n, e in enumerate(errors, 1)], "call string, attempt int, error string")
    assert rows(records.after_retries(df, ["call"])) == sorted((k, *v) for k, v in want.items())
