"""Every query on tables with clashing extra columns, null ids, ties and repeated rows."""

import pytest

from shopsift.llm import decontam, exact_dedup, language, near_dedup, queries, warc

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
NAMES = """
id label place bucket ones zeros word form root near less best best_id letter member h1 h2 h3 h4 cut prefix_end output predicted
k h key sig node n bands band component component_id kept items words w hits found start end pos off term count need set rows digest text_sha256 keep_id group_size
points norm slot shard historical held_out score lang_pred n_tokens ids bytes spans votes kind file block payload payload_digest record_type refers_to wid many first total
""".split()


def write(spark, folder, clash):
    """Two copies of each row; ``clash`` adds a column of every name in ``NAMES``."""
    docs = [(1, "One text that stands alone, mail a@b.org", "en"), (2, PASSAGE, "en"), (3, PASSAGE, None), (4, None, "fr"), (None, "a text without an id", "fr"), (None, None, None), (5, "", "en")]
    pages = [(1, "u", "<p>same</p>"), (2, "u", "<p>same</p>"), (3, None, None)]
    tables = {
        "documents": spark.createDataFrame(docs * 2, "doc_id long, text string, lang string"),
        "benchmark": spark.createDataFrame([("a", PASSAGE), (None, "one text"), ("a", PASSAGE)], "item_id string, text string"),
        "labels": spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 1)], "doc_id long, quality int"),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
    }
    for name, table in tables.items():
        if clash:
            table = table.selectExpr("*", *[f"'clash' AS {c}" for c in NAMES])
        table.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return [write(spark, tmp_path_factory.mktemp("odd"), clash) for clash in (False, True)]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, folders, name):
    plain, clashing = ([tuple(map(str, r)) for r in queries.QUERIES[name](spark, f).collect()] for f in folders)
    assert len(plain) == {"op2_warc": 3, "op13_spelling_variants": 8}.get(name, 14)
    assert sorted(plain) == sorted(clashing)


@pytest.mark.parametrize("old", ["doc_id IS NULL", "doc_id IS NOT NULL", "true", "false"])
def test_null_ids_rank_last(spark, old):
    rows = [(None, "a b"), (7, "a b"), (9, "a  b"), (3, "c"), (None, "d e"), (None, "d  e"), (4, "d e"), (None, "f"), (None, "f"), (8, "g h"), (None, "g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs, exact_dedup.F.expr(old)).select("text_sha256", "keep_id", "group_size").distinct().collect()
    assert sorted((str(r.keep_id), r.group_size) for r in got) == [("3", 1), ("8", 2), ("9", 3), ("None", 2), ("None", 3)]
    stay = [tuple(r) for r in exact_dedup.keep_distinct(docs).collect()]
    assert sorted(stay, key=str) == sorted([(9, "a  b"), (3, "c"), (None, "d  e"), (None, "f"), (8, "g h")], key=str)


def test_null_page_id_revisits(spark):
    pages = spark.createDataFrame([(None, "u", "same"), (5, "u", "same"), (3, "u", "same"), (None, "u", "alone")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    assert got == sorted([("None", "revisit", 3), ("5", "revisit", 3), ("3", "response", None), ("None", "response", None)])


def test_pipeline_stages_keep_rows_without_an_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, long), (2, long + " more"), (None, "another text"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (r.text and r.text[-4:] for r in near_dedup.keep_one(docs).collect()))) == ["None", "more", "text"]
    bench = spark.createDataFrame([("a", "another text")], "item_id string, text string")
    assert decontam.keep_clean(docs, bench).count() == 4


def test_language_stage(spark):
    """Without languages every text with a letter stays; with them texts in none of them go."""
    import base64
    import random

    random.seed(1)
    docs = spark.createDataFrame([(1, "hello", None), (2, "", None), (3, None, None), (4, "12 34", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in language.keep_identified(docs).collect()] == [1]
    noise = [(10**9 + i, base64.b64encode(random.randbytes(300)).decode(), None) for i in range(4)]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    kept = [r.doc_id for r in language.keep_identified(table.unionByName(spark.createDataFrame(noise, table.schema))).select("doc_id").collect()]
    assert len(kept) == table.filter("text rlike '[a-zA-Z]'").count() and max(kept) < 10**9


def kept_rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(1, "alpha"), (1, "beta")], [(1, "alpha"), (1, "beta")]),
        ([(0, "x"), (1, "x"), (1, "y")], [(0, "x"), (1, "y")]),
        ([(1, "a b"), (1, "a  b"), (2, "a b")], [(1, "a  b")]),
        ([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (3, None), (4, "")], [(1, "a"), (None, "b"), (3, None)]),
        ([], []),
    ],
)
def test_exact_dedup_stage_goes_by_id_and_text(spark, rows, want):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", exact_dedup.F.lit("clash"))
    assert kept_rows(exact_dedup.keep_distinct(docs).drop("digest")) == sorted(map(str, want))


def test_near_dedup_stage_goes_by_id_and_text(spark):
    words = [f"w{i}" for i in range(80)]
    one, near, other = " ".join(words), " ".join(words + ["more"]), " ".join(f"x{i}" for i in range(50))
    keep = lambda rows: kept_rows(near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")))
    assert keep([(1, one), (1, other)]) == sorted(map(str, [(1, one), (1, other)]))
    # Ids of several texts rank last, so of the two near texts the one with an id of its own stays.
    assert keep([(1, one), (1, other), (5, near)]) == sorted(map(str, [(1, other), (5, near)]))
    assert keep([(2, one), (5, near), (None, other)]) == sorted(map(str, [(2, one), (None, other)]))
    assert keep([]) == []


def test_pipeline_on_odd_tables(spark, folders, tmp_path):
    import corpus_pipeline

    plain, clashing = (kept_rows(corpus_pipeline.run(spark, f)) for f in folders)
    assert plain == clashing and plain
    empty = tmp_path / "empty"
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folders[0]}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
