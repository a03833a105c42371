"""The pipeline against a brute-force version, at the smallest scale."""

import re

import duckdb

import corpus_pipeline
from shopsift.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def brute():
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    best = {}
    for i, t in docs:
        best.setdefault("".join(lower_free(t)), []).append((-len(t), i, t))
    docs = sorted((i, t) for group in best.values() for _, i, t in [min(group)])
    sets = {}
    for i, t in docs:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = [(i, t) for i, t in docs if find(i) == i]
    windows = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        w = WORD.findall(lower(t or ""))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    out = set()
    for i, t in docs:
        w = WORD.findall(lower(t))
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.add(i)
    return out


def lower_free(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text)


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == brute()
    plain = {r.doc_id: r.ids_sha256 for r in queries.QUERIES["op6_byte_bpe"](spark, SF).collect()}
    assert all(plain[i] == v for i, v in got.items())


def test_sql(spark):
    import sys

    sys.path.insert(0, "tests")
    from oracle import same

    for name, sql in queries.SQL.items():
        same(spark, SF, queries.QUERIES[name], sql)


def test_sql_on_null_ids(spark, tmp_path):
    """op4 where rows without an id share a group: SQL and query leave the id null only where no other row is as long."""
    rows = [(None, "a b"), (7, "a b"), (9, "a  b"), (3, "c"), (None, "d e"), (4, "d e"), (None, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op4_exact_dedup"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.SQL["op4_exact_dedup"])
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
