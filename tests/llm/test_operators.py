"""Every query on a small table of odd rows, against brute force, and round trips of the formats."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from shopsift.llm import bpe, decontam, exact_dedup, language, licenses, lm, near_dedup, pii, queries, rans, warc

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(6000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
TEXTS = {
    1: "Write to anna@example.com or call +49 (30) 1234-5678 today. " * 3, 2: None, 3: "", 4: " \t\n", 5: "one", 6: LONG, 7: LONG, 8: LONG + " extra",
    9: "x" * 500 + " tail\n\n  gap", 10: f"Before it {PASSAGE.upper()} after it", 11: PASSAGE, 12: "Card 4111 1111 1111 1111 and host 10.0.0.1.", 13: "12345 67890 !!",
    14: "Licensed under CC BY 4.0. All rights reserved. GNU General Public License, version 3.", 15: "Éléphant à l'école, où êtes-vous?", 16: "Die Straße ist für die Größe zu schmal.",
    17: "one", 18: " one ", 19: " leading and trailing \n",
}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, ["en", "fr", None][i % 3], "src", 0, "clash") for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, term string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("a", PASSAGE), ("b", None), ("c", "one"), ("d", "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (6, 0), (9, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(3, "http://a.b/ x", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (4, "u", LONG)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows(spark, sf, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_pii(spark, sf):
    got = rows(spark, sf, "op1_pii")
    assert len(got) == len(TEXTS) and (got[1].n_email, got[1].n_phone) == (3, 3) and (got[12].n_card, got[12].n_ip) == (1, 1)
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    assert got[1].spans.startswith("email:9:25,")


def test_warc(spark, sf):
    got = rows(spark, sf, "op2_warc")
    assert (got[1].record_type, got[3].record_type, got[3].refers_to) == ("response", "revisit", 1)
    assert got[2].payload_bytes == 0 and got[3].payload_bytes == 9
    assert got[4].payload_digest == base64.b32encode(hashlib.sha1(LONG.encode()).digest()).decode()
    records = [warc.make_record(i, f"u{i}", f"page {i} ".encode() * 50, None) for i in range(300)]
    archive = warc.make_archive(records)
    assert list(warc.read_frames(archive)) == records
    for bad in (archive[:-3], b"\0" * 8 + archive[8:], archive[8:]):
        with pytest.raises(ValueError):
            list(warc.read_frames(bad))
    with pytest.raises(ValueError):
        warc.parse_record(records[0].replace(b"page 0", b"page zero", 1))


def test_token_ids(spark, sf):
    got, start = rows(spark, sf, "op3_token_ids"), 0
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i in sorted(TEXTS):
        ids = [*tok.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)


def test_rans_blocks_and_checkpoints():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 2 * rans.BLOCK + 12345), 50_000).astype(np.uint32)
    data = rans.make_file(0, 0, [5, None], np.array([10, len(ids) - 10]), ids)
    file = rans.IdFile(data)
    assert (file.ids() == ids).all() and file.doc_ids == [5, None]
    assert (file.block(1, 2) == ids[rans.BLOCK + 2 * rans.EVERY * rans.LANES : 2 * rans.BLOCK]).all()
    assert len(data) < 0.5 * ids.nbytes
    with pytest.raises(ValueError):
        rans.IdFile(data[:-10] + b"0123456789")


def test_exact_dedup(spark, sf):
    got = rows(spark, sf, "op4_exact_dedup")
    assert [got[i].keep_id for i in (2, 3, 4)] == [4, 4, 4] and got[5].keep_id == 18 and got[17].group_size == 3 and got[7].keep_id == 6


def test_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    assert sorted(exact_dedup.PerfectHash.build(digests).slots(digests)) == list(range(5000))


def test_language_model(spark, sf):
    got = rows(spark, sf, "op5_context_mixing")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in TEXTS}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in TEXTS.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0
    assert got[9].score < -5  # a run of one letter beyond a key's length is paid for in pieces


def test_language_model_is_normalised():
    keys = [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)]
    tables = lm.Tables(np.zeros(0, np.int64), np.zeros(0))
    total = 10 ** lm.score_keys(keys, np.ones(len(keys)), tables, lm.Mixer())
    assert 0 < total.reshape(26, 26).sum(1).max() < 1.0001  # of the bytes after the first
    # Every continuation of two bytes and the end of the word: each bit's two probabilities sum to one.
    whole = [b"a" + bytes([b]) + end for b in range(33, 127) for end in (b"", b"x")] + [b"a"]
    assert (10 ** lm.score_keys(whole, np.ones(len(whole)), tables, lm.Mixer())).sum() < 1.0001
    rng = np.random.default_rng(2)
    first = 10 ** lm.first_byte_scores(rng.poisson(0.3, (lm.CLASSES, 256)).astype(float))
    assert np.allclose(first.sum(1), 1)


def test_language_model_reads_words_in_order(spark):
    texts = [(i, " ".join(["red", "apples", "grow", "on", "trees"] * 20)) for i in range(10)] + [(100, " ".join(["trees", "on", "grow", "apples", "red"] * 20))]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    texts += [(held[0], "red apples grow on trees red apples grow on trees"), (held[1], "trees grow red on apples trees grow red on apples")]
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]]


def test_language_model_splits_large_prefixes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = sorted({f"https://www.{''.join(rng.choice(list('abcdef'), rng.integers(1, 9)))}.org" for _ in range(400)} | {"x" * 60 + str(i) for i in range(90)} | {"plain", "words"})
    text = " ".join(words)
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")

    def run(most_keys):
        found = []

        def score(vocab, score_bucket, shared, n_keys):
            def bucket(table, carried):
                assert (carried is not None) == (most_keys == 60)
                if carried is not None:
                    coded = [(k, d) for k, d in zip(table.column("key").to_pylist(), table.column("depth").to_pylist()) if lm.is_coded(k)]
                    assert max(Counter(lm.path_of(k)[: 1 + d] for k, d in coded).values(), default=0) <= most_keys
                return score_bucket(table, carried)

            out = split(vocab, bucket, shared, n_keys, most_keys).collect()
            found.append({bytes(r["key"]): r["score"] for r in out if lm.is_coded(bytes(r["key"]))})
            return spark.createDataFrame(out, "key binary, n_train long, n_all long, base double, score double")

        split = lm.score_vocab
        with monkeypatch.context() as m:
            m.setattr(lm, "score_vocab", score)
            assert all(r.score < 0 for r in lm.score_texts(docs).collect())
        return found[0]

    whole, parts = run(100_000), run(60)
    assert whole.keys() == parts.keys() and {lm.path_of(k) for k in whole} == {bytes(r[0]) for r in spark.createDataFrame([(bytearray(k),) for k in whole], "key binary").select(lm.path()).collect()}
    urls = [k for k in whole if k.startswith(b"https")]
    # A word's score is that of its bytes after the first.
    after = Counter()
    for k in parts:
        if lm.coded(k)[0] == 0 and not k.startswith(lm.LONG):
            after[k[:1]] += 10 ** parts[k]
    assert max(after.values()) < 1.0001
    assert np.mean([abs(whole[k] - parts[k]) for k in urls]) < 0.15 and abs(np.mean([whole[k] - parts[k] for k in urls])) < 0.1


def test_byte_bpe(spark, sf):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, sf, "op6_byte_bpe")
    for i, t in TEXTS.items():
        ids = want.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_decontamination(spark, sf):
    got = rows(spark, sf, "op7_decontamination")
    assert (got[10].n_words, got[10].n_hit, got[10].n_items, got[10].contaminated) == (21, 17, 1, True)
    assert got[11].n_hit == 17 and got[5].contaminated and got[6].n_hit == 0 and got[2].n_words == 0
    assert got[5].items_sha256 == hashlib.sha256(b"c").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "big x x red y house"), (2, "big and a b c d e f g h i j k l red house")], "doc_id long, text string")
    phrases = spark.createDataFrame([("p", ["red", "big", "house"])], "wid string, terms array<string>")
    got = decontam.proximity(docs, phrases, slack=4).collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(1, 0, 6)]
    # A phrase of 90 words whose last word comes at the end; repeated rows and phrases change nothing.
    long = ["red"] * 89 + ["house"]
    docs = spark.createDataFrame([(1, " ".join(long))] * 2, "doc_id long, text string")
    got = decontam.proximity(docs, spark.createDataFrame([("p", long)] * 2, "wid string, terms array<string>"), slack=0).collect()
    assert sorted((r.start, r.end) for r in got) == [(i, 90) for i in range(89)]


def test_near_dedup(spark, sf):
    got = rows(spark, sf, "op8_near_dedup")
    assert [got[i].component_id for i in (6, 7, 8)] == [6, 6, 6] and got[5].component_id == 5 == got[17].component_id == got[18].component_id
    assert (got[2].n_shingles, got[2].component_id, got[2].kept, got[3].component_id) == (0, 2, True, 3) and got[11].component_id == 10  # 16 of 20 shingles


def test_sketch_concentrates():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = np.unique(base[:900]), np.unique(base[100:])
    same = np.mean(near_dedup.sketch(a, 1024) == near_dedup.sketch(b, 1024))
    assert abs(same - 0.8) < 0.06 and (near_dedup.sketch(base[:1]) != near_dedup.NONE).all()


def test_large_bucket_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [(k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(60)] + [(100 + k, " ".join(f"{k}u{i}" for i in range(50))) for k in range(20)]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2).collect()
    assert {r.component_id for r in got if r.doc_id < 60} == {0} and all(r.kept for r in got if r.doc_id >= 100)


def test_language(spark, sf):
    got = rows(spark, sf, "op9_language")
    assert {got[i].lang_pred for i in (2, 3, 4, 13)} == {"und"} and {r.lang_pred for r in got.values()} <= {"und", "en", "fr"}
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_language_sample_has_every_language_and_no_copies(spark, monkeypatch):
    copies = [(i, "one text that all share", "en") for i in range(300)]
    others = [(1000 + i, f"english number {i} of many", "en") for i in range(40)] + [(2000 + i, f"deutsche zahl {i}", "de") for i in range(200)]
    docs = spark.createDataFrame([*copies, *others, (5000, "kielet ovat harvinaisia", "fi")], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "train", lambda samples, classes: seen.append(samples))
    langs, _ = language.learn(docs, language.F.lit(True), 20)
    assert langs == ["de", "en", "fi"] and Counter(k for _, k in seen[0]) == {0: 20, 1: 20, 2: 1}
    assert len(set(seen[0])) == 41
    tables = docs.selectExpr("lang", "text", "xxhash64(text, 17) AS h").distinct().orderBy("h").collect()
    for k, lang in enumerate(langs):
        assert [p.decode() for p, y in seen[0] if y == k] == [r.text for r in tables if r.lang == lang][:20]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in language.initial(3).items()}
    data, y, mask = rng.integers(97, 120, (5, 4)).astype(np.uint8), rng.integers(0, 3, 4), np.ones((5, 4))
    _, grad = language.gradients(p, data, mask, y)
    for k, at in (("hf", (2, 3)), ("hb", (1, 17)), ("o", (3, 1))):
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert (language.gradients(up, data, mask, y)[0] - language.gradients(down, data, mask, y)[0]) / 2e-2 == pytest.approx(grad[k][at], rel=0.02, abs=1e-6)


def test_licenses(spark, sf):
    got = rows(spark, sf, "op10_licenses")
    assert (got[14].n_base, got[14].base_labels, got[14].first_word) == (3, "cc-by,gpl,reserved", 2) and "cc-by-4.0" in got[14].labels
    assert (got[2].n_words, got[2].first_word, got[2].labels) == (0, None, "")
    assert licenses.scan("nothing here", {})[1] == 0 and pii.luhn("4111111111111111")


def test_scores_are_the_same_on_any_partitioning(spark):
    """4 partitions, and 32 without adaptive execution."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: r.score for r in lm.score_texts(docs).collect()}
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(k) for k in names]
    try:
        for k, v in zip(names, ("32", "false"), strict=True):
            spark.conf.set(k, v)
        other = {r.doc_id: r.score for r in lm.score_texts(docs.repartition(7)).collect()}
    finally:
        for k, v in zip(names, before, strict=True):
            spark.conf.set(k, v)
    assert one.keys() == other.keys() and all(math.isclose(one[k], other[k], rel_tol=1e-6) for k in one)


def test_rows_that_share_an_id_are_parted_by_their_texts(spark, tmp_path):
    """Ids that repeat or are missing, in several partitions: rows stand in order of id and text."""
    docs = spark.createDataFrame([(None if k % 3 else 7, f"{k % 40:03d} text " * 20) for k in range(120)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    rans.write_ids(docs, path, P.path("byte_bpe_50k.json"), 2)
    read = rans.read_ids(spark, path)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [tok.encode(t, add_special_tokens=False).ids + [2] for _, t in sorted((r.doc_id or -1, r.text) for r in docs.collect())]
    assert [r.ids for r in read.orderBy("partition", "number", "place").collect()] == want
    assert read.select("partition").distinct().count() > 2
    got = rans.id_round_trip(docs, P.path("byte_bpe_50k.json"), 2).orderBy("start").collect()
    assert [r.start for r in got] == [sum(map(len, want[:k])) for k in range(len(want))]


def test_partitions_of_token_files():
    assert [rans.partitions(size, 6) for size in (0, 10**8, 10**9, 10**10, 10**14)] == [6, 7, 48, 48, 390_625]
