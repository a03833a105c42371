"""Language of texts by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read the UTF-8 bytes, one in each direction; at every
position their states give a distribution over the learned languages, and a
document's probabilities are the softmax of the pooled log-probabilities of its
positions that belong to letters. Gates and candidates use the cheap squashing
functions x / (1 + |x|), shifted and scaled to (0, 1) for gates. The network is
trained in numpy by backpropagation through time with Adam.

Every language with a labelled row is a class. Of each language it learns from
at most ``SAMPLE`` distinct texts, those with the smallest hashes, of each a
piece of ``PIECE`` characters; the caller says which rows may be learned from. Prediction reads whole texts: a text is cut into
segments of ``SPAN`` bytes, which a task runs in lockstep, so its time follows
its length alone.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text where nothing can be learned from; repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

SAMPLE = 1600
PIECE = 600
HIDDEN = 8
SPAN = 128
LANES = 2048
UNDETERMINED = "und"
LEAST, ENOUGH = 0.8, 200  # certainty below which a text of so many letters is in none of the learned languages
Params = dict[str, np.ndarray]


def _squash(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x / (1 + |x|) and its derivative."""
    d = 1 / (1 + np.abs(x))
    return x * d, d * d


def initial(classes: int, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    p = {}
    for way in "fb":
        p["x" + way] = rng.normal(0, 0.4, (256, 3 * HIDDEN))
        p["h" + way] = rng.normal(0, 0.5 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
        p["x" + way][:, HIDDEN : 2 * HIDDEN] += 1.0  # update gates begin by keeping
    p["o"] = rng.normal(0, 0.3, (2 * HIDDEN, classes))
    p["c"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def run_states(p: Params, way: str, data: np.ndarray, keep: bool = False):
    """States after each byte, steps x lanes x HIDDEN; with ``keep`` also what backpropagation needs."""
    n = HIDDEN
    table, u = p["x" + way], p["h" + way]
    ur, uc = np.ascontiguousarray(u[:, : 2 * n]), np.ascontiguousarray(u[:, 2 * n :])
    steps, lanes = data.shape
    h = np.zeros((lanes, n), np.float32)
    out, kept = np.empty((steps, lanes, n), np.float32), []
    order = range(steps) if way == "f" else range(steps - 1, -1, -1)
    for t in order:
        x = table.take(data[t], axis=0)
        g = h @ ur
        g += x[:, : 2 * n]
        if keep:
            s, ds = _squash(g)
        else:
            s = g / (1 + np.abs(g))
        gates = 0.5 * s + 0.5
        r, z = gates[:, :n], gates[:, n:]
        rh = r * h
        a = rh @ uc
        a += x[:, 2 * n :]
        if keep:
            c, dc = _squash(a)
            kept.append((t, h, r, z, rh, c, 0.5 * ds, dc))
        else:
            c = a / (1 + np.abs(a))
        h = c + z * (h - c)
        out[t] = h
    return out, kept


def fast_states(p: Params, way: str, data: np.ndarray) -> np.ndarray:
    """The states of :func:`run_states`, in place and with each gate's columns together."""
    n = HIDDEN
    tables = [np.ascontiguousarray(p["x" + way][:, i * n : (i + 1) * n]) for i in range(3)]
    u = p["h" + way]
    gates_u, half_uc = np.stack([u[:, :n], u[:, n : 2 * n]]), np.ascontiguousarray(0.5 * u[:, 2 * n :])
    steps, lanes = data.shape
    out = np.empty((steps, lanes, n), np.float32)
    h = np.zeros((lanes, n), np.float32)
    g, g2 = np.empty((2, lanes, n), np.float32), np.empty((2, lanes, n), np.float32)
    c, c2 = np.empty((lanes, n), np.float32), np.empty((lanes, n), np.float32)
    half, one = np.float32(0.5), np.float32(1)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        d = data[t]
        tables[0].take(d, axis=0, out=g[0], mode="clip")
        tables[1].take(d, axis=0, out=g[1], mode="clip")
        tables[2].take(d, axis=0, out=c, mode="clip")
        np.matmul(h, gates_u, out=g2)
        g += g2
        np.abs(g, out=g2)
        g2 += one
        g /= g2
        g += one  # twice the gates
        r, z = g
        r *= h
        np.matmul(r, half_uc, out=c2)
        c += c2
        np.abs(c, out=c2)
        c2 += one
        c /= c2
        z *= half
        h -= c
        h *= z
        h += c
        out[t] = h
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def gradients(p: Params, data: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean loss over labelled positions and its gradients, by backpropagation through time.

    ``data``: steps x lanes of bytes; ``mask``: the positions that count; ``y``: a class a lane.
    """
    n, (steps, lanes) = HIDDEN, data.shape
    forward, kept_f = run_states(p, "f", data, True)
    backward, kept_b = run_states(p, "b", data, True)
    both = np.concatenate([forward, backward], 2)
    logp = _log_softmax(both @ p["o"] + p["c"])
    total = max(1.0, float(mask.sum()))
    loss = -float((logp[:, np.arange(lanes), y] * mask).sum()) / total
    d = np.exp(logp)
    d[:, np.arange(lanes), y] -= 1
    d *= (mask / total)[:, :, None]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["o"] = np.einsum("tln,tlk->nk", both, d, optimize=True)
    grad["c"] = d.sum((0, 1))
    dstates = d @ p["o"].T
    for way, kept, part in (("f", kept_f, dstates[:, :, :n]), ("b", kept_b, dstates[:, :, n:])):
        u, dx, dh = p["h" + way], np.empty((steps, lanes, 3 * n), np.float32), np.zeros((lanes, n), np.float32)
        ur, uc = u[:, : 2 * n], u[:, 2 * n :]
        for t, h, r, z, rh, c, ds, dc in reversed(kept):
            dh = dh + part[t]
            da = dh * (1 - z) * dc
            dz = dh * (h - c) * ds[:, n:]
            drh = da @ uc.T
            dr = drh * h * ds[:, :n]
            gates = np.concatenate([dr, dz], 1)
            grad["h" + way][:, : 2 * n] += h.T @ gates
            grad["h" + way][:, 2 * n :] += rh.T @ da
            dx[t, :, : 2 * n], dx[t, :, 2 * n :] = gates, da
            dh = dh * z + drh * r + gates @ ur.T
        flat = data.reshape(-1)
        for j in range(3 * n):
            grad["x" + way][:, j] = np.bincount(flat, weights=dx.reshape(-1, 3 * n)[:, j], minlength=256)
    return loss, grad


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters or of characters beyond ASCII."""
    low = data | 0x20
    return ((low >= 97) & (low <= 122)) | (data >= 128)


def train(samples: list[tuple[bytes, int]], classes: int, steps: int = 260, lanes: int = 192, span: int = 48, seed: int = 3) -> Params:
    rng = np.random.default_rng(seed)
    p = initial(classes)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    by_class: list[list[bytes]] = [[] for _ in range(classes)]
    for s, k in samples:
        by_class[k].append(s)
    for step in range(steps):
        y = rng.integers(0, classes, lanes)
        data = np.full((span, lanes), 32, np.uint8)
        for lane, k in enumerate(y):
            s = by_class[k][rng.integers(len(by_class[k]))]
            at = rng.integers(0, max(1, len(s) - span + 1))
            piece = np.frombuffer(s[at : at + span], np.uint8)
            data[: len(piece), lane] = piece
        _, grad = gradients(p, data, letters(data).astype(np.float32), y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, 2.0 * (1 - step / steps) + 0.05)
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-7)).astype(np.float32)
    return p


def label_positions(p: Params, segments: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Summed log-probabilities of the letter positions of each segment, and of each position's best label at last: segments x (classes + 1).

    ``segments``: steps x lanes of bytes, blank beyond each lane's ``spans``.
    """
    n, classes = HIDDEN, len(p["c"])
    mask = letters(segments) & (np.arange(len(segments))[:, None] < spans[None, :])
    forward, backward = fast_states(p, "f", segments).reshape(-1, n), fast_states(p, "b", segments).reshape(-1, n)
    logits = forward @ p["o"][:n]
    logits += backward @ p["o"][n:]
    logits += p["c"]
    # States lie within (-1, 1), which bounds the logits, so exp needs no shift.
    norm = np.exp(logits) @ np.ones(classes, np.float32)
    np.log(norm, out=norm)
    best = logits[:, 0].copy()
    for k in range(1, classes):
        np.maximum(best, logits[:, k], out=best)
    norm *= mask.reshape(-1)
    logits *= mask.reshape(-1, 1)
    best *= mask.reshape(-1)
    total = np.concatenate([logits.reshape(*segments.shape, classes).sum(0), best.reshape(segments.shape).sum(0)[:, None]], 1)
    return total - norm.reshape(segments.shape).sum(0)[:, None]


def score_texts(p: Params, texts: list[bytes]) -> np.ndarray:
    """Summed log-probabilities of each text's letter positions, and of their best labels at last: texts x (classes + 1)."""
    total = np.zeros((len(texts), len(p["c"]) + 1))
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    count = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    at = begin[owner] + (np.arange(len(owner)) - first[owner]) * SPAN
    spans = np.minimum(SPAN, begin[owner] + sizes[owner] - at)
    # Segments run in order of their length, so those that run together are about as long.
    order = np.argsort(spans, kind="stable")
    for lo in range(0, len(order), LANES):
        lanes = order[lo : lo + LANES]
        span = int(spans[lanes].max())
        place = at[lanes][None, :] + np.arange(span)[:, None]
        inside = np.arange(span)[:, None] < spans[lanes][None, :]
        segments = np.where(inside, data[np.minimum(place, len(data) - 1)], 32).astype(np.uint8)
        np.add.at(total, owner[lanes], label_positions(p, segments, spans[lanes]))
    return total


def learn(docs: DataFrame, may_learn: Column, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], Params | None]:
    """The learned languages, sorted, and the network; from at most ``sample`` distinct texts of each language in ``docs``."""
    n = F.char_length(text_col)
    key = F.xxhash64(text_col, F.lit(17))
    piece = F.substring(F.col(text_col), F.pmod(key, F.greatest(n - PIECE, F.lit(1))).cast("int") + 1, F.lit(PIECE))
    rows = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), key.alias("key"), piece.alias("piece"))
    # A row a language. Copies have one key, so the estimate of distinct keys tells which bound leaves about four times the sample.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], None
    bounds = {lang: 2**64 * 4 * sample // n - 2**63 for lang, n in sizes.items() if n > 4 * sample}
    found = _smallest(rows, {lang: bounds.get(lang, 2**63 - 1) for lang in langs}, sample)
    # Should the estimate have been far off, the language goes without a bound, so the sample is the same either way.
    short = [lang for lang in bounds if len(found.get(lang, ())) < sample]
    if short:
        found |= _smallest(rows, dict.fromkeys(short, 2**63 - 1), sample)
    samples = [(piece.encode(), k) for k, lang in enumerate(langs) for piece in found[lang]]
    return langs, train(samples, len(langs))


def _smallest(rows: DataFrame, bounds: dict[str, int], sample: int) -> dict[str, list[str]]:
    """The pieces with the ``sample`` smallest distinct keys of each language, of keys up to its bound."""
    few = rows.sparkSession.createDataFrame(list(bounds.items()), "lang string, bound long")  # a row a language
    some = rows.join(F.broadcast(few), "lang").filter("key <= bound")
    distinct = some.groupBy("lang", "key").agg(F.min("piece").alias("piece"))  # copies combine before the shuffle
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    out: dict[str, list[str]] = {}
    for r in distinct.withColumn("place", place).filter(F.col("place") <= sample).orderBy("lang", "key").collect():
        out.setdefault(r["lang"], []).append(r["piece"])
    return out


def labeller(langs: list[str], params: Params | None):
    """An Arrow function of (text, has_letter).

    It gives lang_pred, the most probable language; score, its pooled
    probability; n_letters, the text's bytes in letters; certainty, the geometric
    mean over those of the probability that each position gives to its own label.
    """
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("n_letters", pa.int64()), ("certainty", pa.float64())])

    def label(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, flags in columns:
            use = np.flatnonzero(np.array(flags.to_pylist(), bool) & (params is not None))
            names, scores, many, certain = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for some in _runs(texts, use):
                data = [texts[i].as_py().encode() for i in some.tolist()]
                got = score_texts(params, data)
                # Neighbouring positions say much the same, so their sum is scaled down before it is a probability.
                p = np.exp(_log_softmax(got[:, :-1] / 16))
                names[some], scores[some] = np.array(langs, object)[p.argmax(1)], p.max(1)
                many[some] = [np.count_nonzero(letters(np.frombuffer(d, np.uint8))) for d in data]
                certain[some] = np.exp(got[:, -1] / many[some])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(many), pa.array(certain)], fields=list(kind))

    label.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    # Else the optimizer would run the network once for each use of its result.
    return F.arrow_udf(label, "lang_pred string, score double, n_letters long, certainty double").asNondeterministic()


def has_letter(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, langs: list[str], params: Params | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the pooled probability) of every row."""
    bounded_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), labeller(langs, params)(F.col(text_col), has_letter(text_col)).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")


def _runs(texts: pa.Array, use: np.ndarray, most: int = 2_000_000) -> Iterator[np.ndarray]:
    """Runs of the rows ``use`` with about ``most`` bytes of text at most, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)[use]
    lo, ends = 0, np.cumsum(sizes)
    while lo < len(use):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield use[lo:hi]
        lo = hi


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    langs, params = learn(docs, ~held_out())
    found = predict(docs, langs, params)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST, enough: int = ENOUGH) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is found to be in a language.

    Texts that are ``und`` go (null, or without a letter), and so do those of
    ``enough`` letters whose positions are sure of their labels by less than
    ``least``, such as encoded data and unknown languages; texts that mix learned
    languages stay, and of shorter texts too little is known.
    Where no row has a language to learn from, every text with a letter stays.
    """
    langs, params = learn(docs, ~held_out())
    if params is None:
        return docs.filter(has_letter())
    bounded_batches(docs.sparkSession)
    name = "__found" + "_" * max(map(len, docs.columns))
    found = docs.withColumn(name, labeller(langs, params)(F.col("text"), has_letter()))
    got = F.col(name)
    return found.filter((got["lang_pred"] != UNDETERMINED) & ((got["certainty"] >= least) | (got["n_letters"] < enough))).select(*docs.columns)
