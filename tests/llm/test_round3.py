"""Findings of round 3: what op5 and op3 count, send and encode only once."""

import re
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from shopsift.llm import bpe, lm
from shopsift.llm.common import byte_strings

ODD = ["", " ", " \t", "a", "a ", " a", "A b\n", "\n\na\n B\t\t c", "x" * 47, "x" * 48 + " " + "y" * 200, " " * 60, " " * 48 + "a" + "\n" * 100, "É b  Éa\x85c\x1cd", "\x00a\x01 b", "we we We  we"]


def random_texts(n: int) -> list[str]:
    rng = np.random.default_rng(3)
    return ["".join(rng.choice(list("abA \n\tÉ "), rng.integers(0, 90))) for _ in range(n)]


def plain_keys(text: str) -> Counter:
    """All keys of one text, read run by run."""
    data = text.encode().lower()
    runs = re.findall(rb"[\t-\r ]+|[^\t-\r ]+", data)
    found, before = Counter({b"": 1}), b"s"
    for run in runs:
        kind = b"w" if lm.is_base(run) else b"g"
        found[lm.MOVE + before + kind] += 1
        before = kind
        if kind == b"w" or len(run) <= lm.LONGEST:
            found[run] += 1
        if len(run) > lm.LONGEST:
            found.update(lm.parts(run))
    found[lm.MOVE + before + b"e"] += 1
    return found


def batch(texts: list[str], held: list[bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array(held)], names=["doc_id", "text", "held"])


def test_keys_of_many_texts_are_those_of_each():
    texts = ODD + random_texts(150)
    found = lm.Occurrences(pa.array(["zz zz", *texts], pa.string()).slice(1))
    keys = byte_strings(found.keys)
    assert len(set(keys)) == len(keys) and keys == found.keys.to_pylist() and byte_strings(found.keys.slice(3, 4)) == keys[3:7]
    for doc, text in enumerate(texts):
        own = Counter()
        for k in found.word[found.word_doc == doc]:
            own[keys[k]] += 1
        for k, n in zip(found.other[found.other_doc == doc], found.times[found.other_doc == doc], strict=True):
            own[keys[k]] += int(n)
        assert own == plain_keys(text), text
    assert lm.Occurrences(pa.array([], pa.string())).counts(np.zeros(0, bool)).sum() == 0


def test_a_task_counts_each_key_once(monkeypatch):
    """Training and other texts, and all of a task's batches, share a key's row."""
    texts = ODD + random_texts(150)
    held = [i % 3 == 0 for i in range(len(texts))]
    some = batch(texts, held)
    want_all, want_train = Counter(), Counter()
    for text, out in zip(texts, held, strict=True):
        want_all.update(plain_keys(text))
        want_train.update({} if out else plain_keys(text))
    monkeypatch.setattr(lm, "BATCH_BYTES", 500)
    for most in (10**6, 20):  # the second: rows are passed on as soon as there are many
        monkeypatch.setattr(lm, "MOST_KEYS", most)
        rows = [r for b in lm._count(iter([some.slice(0, 40), some.slice(40)])) for r in b.to_pylist() if not r["key"].startswith(lm.PAIR)]
        got = pa.Table.from_pylist(rows).group_by("key").aggregate([("n_train", "sum"), ("n_all", "sum")]).to_pylist()
        assert {r["key"]: r["n_all_sum"] for r in got} == want_all and {r["key"]: r["n_train_sum"] for r in got if r["n_train_sum"]} == want_train
        assert (len(rows) == len(want_all)) == (most == 10**6)


def test_a_group_of_texts_sends_each_rare_key_once():
    texts = ODD + random_texts(60)
    index = [b" ", b"a", b""]
    out = lm._one_batch(batch(texts, [False] * len(texts)), 0, pa.array(index, pa.binary()), np.ones((3, 3)), 4, np.zeros(lm.CLASSES * 256))
    rare = set().union(*map(plain_keys, texts)) - set(index)
    assert sum(n or 0 for n in out.column("many").to_pylist()) == len(rare)


def test_a_piece_seen_before_is_not_encoded_again(monkeypatch):
    """Ids are the library's, with pieces that are known, forgotten, long, and in small and large calls."""
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts, sent = [*ODD, "naïve Straße 12345 x=1; " * 3, "q" * 90, "a <|endoftext|> b", *random_texts(100)], []
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (10**6, 40, 0):
        monkeypatch.setattr(bpe, "KNOWN", most)
        encoder, plain = bpe.PieceEncoder(tok), bpe.PieceEncoder(tok)._distinct
        monkeypatch.setattr(encoder, "_distinct", lambda pieces, plain=plain: sent.append(len(pieces)) or plain(pieces))
        for some in (range(len(texts)), range(0, len(texts), 2), range(len(texts) - 1, -1, -1), range(3)):
            many, ids = encoder.encode(pa.array([texts[i] for i in some], pa.string()))
            assert ids.tolist() == [x for i in some for x in want[i]] and many.tolist() == [len(want[i]) for i in some]
        assert len(encoder.known[0]) <= most and max(map(len, byte_strings(encoder.known[0])), default=0) <= bpe.KNOWN_BYTES
    monkeypatch.setattr(bpe, "KNOWN", 10**6)
    encoder, words = bpe.PieceEncoder(tok), pa.array([" ".join(f"word{i}" for i in range(300))])
    first = encoder.encode(words)
    monkeypatch.setattr(encoder, "_distinct", lambda pieces, plain=encoder._distinct: sent.append(len(pieces)) or plain(pieces))
    again = encoder.encode(words)
    assert sent[-1] == 0 and (first[1] == again[1]).all() and (first[0] == again[0]).all()


def test_a_round_trip_runs_in_one_worker_a_task(spark):
    """Encoding and decoding share a Python process, whose memory is bounded; the results are those of the two steps and of the library."""
    path = P.path("byte_bpe_50k.tiktoken")
    long = " ".join(f"word{i} naïve" for i in range(bpe.TRIP_BYTES // 12))
    texts = [None, "", *ODD, "", long, "a", long[: bpe.TRIP_BYTES // 3], long[5:], *random_texts(30), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    trip = bpe.round_trip(docs, path, P.PATTERN)
    assert trip._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: r for r in trip.collect()}
    assert len(got) == len(texts)
    encoded = bpe.encode(docs, path, P.PATTERN)
    back = {r.doc_id: r for r in bpe.decode(encoded, path).collect()}
    tok = bpe.load_ranks_tokenizer(path, P.PATTERN)
    for i, text in enumerate(texts):
        ids, r = tok.encode(text or "", add_special_tokens=False).ids, got[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256((text or "").encode()).hexdigest() and (r.n_chars, r.n_split) == (back[i].n_chars, back[i].n_split)
    few = bpe.PieceEncoder(tok, 40)
    for _ in range(2):
        few.encode(pa.array(random_texts(100)))
        assert len(few.known[0]) <= 40
