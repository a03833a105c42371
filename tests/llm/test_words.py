"""Fill-in-the-middle, spelling variants and the quality classifier against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shopsift.llm import fim, quality, queries, variants

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
ODD = [None, "", " ", " \n\t", "a", "one two  three\n", " lead", "mark <P> inside", "broken <P and S> marks <", "é ü z 🙂 end", "x" * 70_000 + " " + "y z " * 40_000, " " * 100_000, "nul\x00 a\x0bb\x0cc\x85d"]


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_fim(own, text):
    text = text or ""
    units = re.findall(fim.UNIT, text)
    h = [int(sha(f"42:{'' if own is None else own}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (own, len(units), "plain", None, None, sha(text), sha(text))
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"
    return (own, len(units), form, len(a), len(b), sha(out), sha(text))


def test_fill_in_middle(spark):
    rows = documents(spark) + [(10**6 + k, t) for k, t in enumerate(ODD * 6)] + [(None, t) for t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in fim.digest_columns(fim.fill_in_middle(docs)).collect()]
    assert sorted(got, key=str) == sorted((brute_fim(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_parameters(spark):
    docs = spark.createDataFrame([(k, f"a b c {k} d") for k in range(200)], "id long, body string")
    found = fim.fill_in_middle(docs, seed=7, rate=100, spm=0, id_col="id", text_col="body")
    assert {r.form for r in found.collect()} == {"psm"}
    assert {r.t for r in found.select(fim.restored(found["output"], found["form"]).alias("t")).collect()} == {f"a b c {k} d" for k in range(200)}


def test_unit_ends_in_steps(monkeypatch):
    monkeypatch.setattr(fim, "STEP", 4)
    random, split = np.random.default_rng(3), fim.splitter()
    for _ in range(500):
        text = "".join(random.choice(list("ab \n\té🙂\x85"), random.integers(0, 40)))
        assert fim.unit_ends(split, text).tolist() == [m.end() for m in re.finditer(fim.UNIT, text)]


def brute_variants(rows):
    counts = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near = {w: set() for w in words}
    for w in words:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))} & words.keys()
        near[w] |= cut
        for x in cut:
            near[x].add(w)
    for length in {len(w) for w in words}:
        own = sorted(w for w in words if len(w) == length)
        table = np.array([[ord(c) for c in w] for w in own])
        for k, w in enumerate(own):
            near[w] |= {own[j] for j in np.flatnonzero((table != table[k]).sum(1) == 1)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def found_variants(docs):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(docs).collect()]


def test_spelling_variants(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = found_variants(docs)
    want = brute_variants(documents(spark))
    assert len(got) == len(want) and set(got) == want and any(f and f != r for _, f, r, *_ in got)


def test_spelling_variants_of_odd_words(spark):
    """Ties, chains, runs of one letter, letters beyond ASCII, words about the length at which keys become digests, very long ones."""
    long = "".join("abcdefghij"[k * 7 % 10] for k in range(3000))
    lines = ["color colour " * 4 + "colour " * 8, "aaaaa aaaaaa aaaaaaa " * 3 + "aaaaaa " * 9, "stràsse strâsse strasse Strasse STRÀSSE " * 3, "tests testa testb " * 5 + "testc " * 3, f"{long} " * 7 + f"{long[:-1]} " * 3 + f"{long}x " * 3 + f"{long[:100]}Q{long[101:]} " * 20]
    for size in range(60, 71):
        lines.append(f"{'é' * 3}{'b' * size} " * 9 + f"{'é' * 3}{'b' * (size - 1)}c " * 4 + f"{'é' * 3}{'b' * size}d " * 3)
    rows = [(k, t) for k, t in enumerate(lines)] + [(None, lines[0]), (5, None), (6, ""), (7, "12 34"), (0, lines[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found_variants(docs)
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows)


def test_words_handed_on_early(spark, monkeypatch):
    rows = [(k, f"alphabet{'abcdefgh'[k % 8]} alphabets") for k in range(60)]
    monkeypatch.setattr(variants, "AT_ONCE", 2)
    assert set(found_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_variants(rows)


def test_near_needs_a_ratio(spark):
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)


def test_features():
    """The features of a text are those of its n-grams, words and signs, whatever stands in memory from texts before."""
    f = quality.Features()
    first = set(f(b"One two two, Three!").tolist())
    assert set(f(b"").tolist()) == set() and set(f(b"One two two, Three!").tolist()) == first
    assert len(first) == len(f(b"One two two, Three!"))
    ngrams = {t[i : i + n] for t in (b"one two two, three!",) for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    part = quality.Features.parts(np.frombuffer(b"One two two, Three!", np.uint8))
    assert [len(set(p.tolist())) for p in part[:3]] == [len({g for g in ngrams if len(g) == n}) for n in (1, 2, 3)]
    assert first == set(np.concatenate(part).tolist())
    plain, repeated = (set(f(t).tolist()) for t in (b"one two one two", b"one one two two"))
    assert plain != repeated


def test_features_of_long_texts(monkeypatch):
    text = b"some words of a text, and more of them " * 20
    whole = set(quality.Features()(text).tolist())
    monkeypatch.setattr(quality, "AT_ONCE", 195)  # at a word's start
    assert set(quality.Features()(text).tolist()) >= whole


def test_dual_descent_is_optimal():
    """At the optimum each dual variable and margin meet the conditions of Karush, Kuhn and Tucker."""
    random = np.random.default_rng(5)
    x = random.normal(size=(60, 8))
    sign = np.where(x @ random.normal(size=8) + random.normal(size=60) > 0, 1.0, -1.0)
    rows = [(np.arange(8), v) for v in x]
    cost = np.full(60, 0.5)
    w = quality.dual_descent(rows, sign, cost, 8, rounds=3000)
    full = np.concatenate([x, np.ones((60, 1))], 1)
    value = lambda u: u @ u / 2 + (cost * np.maximum(0, 1 - sign * (full @ u))).sum()
    assert all(value(w) <= value(w + random.normal(size=9) * s) + 1e-6 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_log_count_ratios(spark):
    docs = spark.createDataFrame([(k, f"good text {k}" if k % 2 else f"bad!!! text {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 0), (1, 1), (3, None), (None, 1)], "doc_id long, quality int")
    rows = quality.labelled(docs, labels, "quality")
    assert sorted((r.id, r.label) for r in rows.collect()) == [(k, k % 2) for k in range(40)]
    model = quality.learn(rows)
    f = quality.Features()
    good, bad = set(f(b"good text").tolist()), set(f(b"bad!!! text").tolist())
    assert np.median(model.ratio[list(good - bad)]) > 0 > np.median(model.ratio[list(bad - good)])
    assert model.score(f(b"good text")) > 0.7 > 0.3 > model.score(f(b"bad!!! text"))


@pytest.mark.parametrize("rows,score", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0)], 0.0)])
def test_quality_without_two_classes(spark, rows, score):
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    got = quality.score_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
    assert [(r.score, r.predicted) for r in got] == [(score, int(score >= 0.7))] * 2


def test_quality_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_quality"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"good text {k}" if k % 2 else f"bad!!! text {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    few = [tuple(r) for r in quality.score_quality(docs, labels).collect()]
    monkeypatch.setattr(quality, "FEW", 3)
    assert sorted(few) == sorted(tuple(r) for r in quality.score_quality(docs, labels).collect())


def test_smallest_keys(spark):
    rows = spark.range(5000).selectExpr("CAST(id % 2 AS INT) AS label", "xxhash64(id div 3) AS key").repartition(4)
    want = [(k, x) for k in (0, 1) for x in sorted({r.key for r in rows.collect() if r.label == k})[:100]]
    assert sorted(quality._smallest(rows, 100)) == want
