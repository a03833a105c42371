"""Text quality by naive Bayes support vectors.

Features are n-grams as indicators, hashed to ``BUCKETS``: 1 to 3 bytes of the
lower-cased text; words and pairs of words; and 1 to 4 signs of the text's shape,
where a sign is a kind of character (upper or lower case, digit, blank, line end,
beyond ASCII, or a punctuation mark itself), runs of one kind being one sign, or
tells of a word whether it repeats the word before. An indicator is scaled by its
class log-count ratio r = log(p / |p|) / (q / |q|), with p and q one more than the
number of texts of either class that have it; these counts are taken over all
labelled texts. Each text's vector is scaled to length 1, and a linear hinge-loss
model over it is fitted by dual coordinate descent, from ``SAMPLE`` labelled
texts of each class at most, those with the smallest hash. Margins become
probabilities by a logistic curve, fitted on margins of models that had not
learned from the text (``FOLDS`` parts).

Counts combine within a task in two arrays of ``BUCKETS`` entries, so what is
shuffled is BUCKETS rows a task at most, and the model is BUCKETS numbers,
whatever the corpus. The fit runs on the driver over the bounded sample; texts
are scored whole by an Arrow function.

Defined results: a null text is the empty one, which has no features and is
scored by the model's constant; labels that are null are left out, and a text
with several labels has the one of most rows, 1 in a tie; rows that repeat an id
are all returned; where only one class is labelled the score is that label, and
0.5 where none is; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, give_back, stored

BUCKETS = 1 << 18
SAMPLE = 1500
#: Labels that are sent to every task, some 16 MB.
FEW = 1_000_000
FOLDS = 3
#: The hinge loss's weight, and rounds of coordinate descent.
COST, ROUNDS = 1.0, 12
#: Bytes of a text that are looked at together, and what they share with the next; a word at the border counts as cut there.
AT_ONCE, OVERLAP = 1 << 20, 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_KIND = np.arange(256, dtype=np.uint8)  # a punctuation mark is its own sign
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 4
_KIND[[9, 32]], _KIND[10:14] = 5, 6
_SAME, _OTHER = 7, 8
_STEP, _SPREAD = np.uint32(16777619), np.uint32(0x9E3779B1)


def _grams(codes: np.ndarray, longest: int, family: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of up to ``longest`` codes."""
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, min(longest, len(codes)) + 1):
        h = h[: len(codes) - n + 1] * _STEP
        h += codes[n - 1 :]
        yield (((h ^ np.uint32(0x51CC1 * (family + n))) * _SPREAD) >> np.uint32(14)).astype(np.int32)  # the upper 18 bits


class Features:
    """The distinct buckets of a text's features; memory for them is used again for each text."""

    def __init__(self) -> None:
        self.last = np.zeros(BUCKETS, np.int32)

    def distinct(self, buckets: list[np.ndarray]) -> np.ndarray:
        own = np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
        place = np.arange(len(own), dtype=np.int32)
        self.last[own] = place  # of equal buckets one remains
        return own[self.last[own] == place]

    def __call__(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        # Long texts go in parts that overlap by what an n-gram needs.
        parts = [self.distinct(self.parts(data[at : at + AT_ONCE + OVERLAP])) for at in range(0, len(data), AT_ONCE)]
        return parts[0] if len(parts) == 1 else self.distinct(parts)

    @staticmethod
    def parts(data: np.ndarray) -> list[np.ndarray]:
        folded = _FOLD[data]
        out = [*_grams(folded, 3, 0)]
        kinds = _KIND[data]
        out += _grams(kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])].astype(np.uint32), 4, 30)
        where = np.flatnonzero(~_SPACE[data])
        if len(where):
            first = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1] + 1) + 1])
            # A word's hash is a sum over its bytes by their place in it.
            place = np.arange(len(where), dtype=np.uint32) - np.repeat(first, np.diff(first, append=len(where))).astype(np.uint32)
            term = (folded[where] + np.uint32(1)) * (place * _SPREAD + np.uint32(0xB5297A4D))
            term ^= term >> np.uint32(15)
            words = np.add.reduceat(term * _STEP, first, dtype=np.uint32)
            out += _grams(words, 2, 10)
            out += _grams(np.where(np.concatenate([[False], words[1:] == words[:-1]]), _SAME, _OTHER).astype(np.uint32), 4, 20)
        return out


@dataclass
class Model:
    """``ratio`` scales indicators, ``weight`` is linear over scaled vectors of length 1; the score is logistic(slope * margin + shift)."""

    ratio: np.ndarray
    weight: np.ndarray
    constant: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(np.square(self.ratio[found]).sum()))
        return self.constant + (float(self.ratio[found] @ self.weight[found]) / length if length else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: np.ndarray, size: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Weights, the constant last, of the linear hinge-loss model: minimise |w|^2 / 2 + the sum of cost * max(0, 1 - sign * w x).

    Each step sets one dual variable, within [0, cost], to the optimum given the others. ``rows`` are (places, values).
    """
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for _, v in rows])
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in random.permutation(len(rows)):
            at, v = rows[i]
            slope = sign[i] * (float(w[at] @ v) + w[-1]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * sign[i]:
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w


def _logistic(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, by Newton's method; targets keep off 0 and 1 by the classes' sizes."""
    ones = float(label.sum())
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(b[0]), 0.0), float(b[1])


def fit(samples: list[tuple[str, int]], ratio: np.ndarray, cost: float = COST) -> Model:
    """The model of (text, label) samples of both classes."""
    features = Features()
    places = [features(t.encode()) for t, _ in samples]
    rows = []
    for at in places:
        v = ratio[at]
        length = float(np.sqrt(v @ v))
        rows.append((at, (v / length if length else v).astype(np.float32)))
    label = np.array([k for _, k in samples])
    sign = 2.0 * label - 1
    share = np.where(label == 1, label.mean(), 1 - label.mean())
    costs = cost / (2 * share)  # both classes weigh alike
    fold = np.arange(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        own = np.flatnonzero(fold != k)
        w = dual_descent([rows[i] for i in own], sign[own], costs[own], BUCKETS)
        for i in np.flatnonzero(fold == k):
            margins[i] = float(w[rows[i][0]] @ rows[i][1]) + w[-1]
    slope, shift = _logistic(margins, label)
    w = dual_descent(rows, sign, costs, BUCKETS)
    return Model(ratio.astype(np.float32), w[:-1].astype(np.float32), float(w[-1]), slope, shift)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, ones, zeros) of a task's labelled texts."""
    have, features = np.zeros((2, BUCKETS), np.int64), Features()
    for batch in batches:
        for text, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            have[k, features(text.as_py().encode())] += 1
    at = np.flatnonzero(have.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(have[1, at]), pa.array(have[0, at])], names=["bucket", "ones", "zeros"])
    give_back()


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of the texts that have a label.

    Up to ``FEW`` labels, which are counted, go to every task; of more, texts are
    joined by a shuffle and written once.
    """
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    one = cut(one.agg((F.avg(F.col(label_col).cast("int")) >= 0.5).cast("int").alias("label")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(one), "id") if one.count() <= FEW else stored(rows.join(one, "id"), "labelled")


def _smallest(keyed: DataFrame, sample: int) -> list[tuple[int, int]]:
    """The ``sample`` smallest distinct keys of each label."""
    # Keys are spread evenly, so the estimate of their number tells a bound below which about four times the sample is.
    sizes = {r["label"]: r["n"] for r in keyed.groupBy("label").agg(F.approx_count_distinct("key").alias("n")).collect()}  # two rows
    bounds = {k: 2**64 * 4 * sample // n - 2**63 for k, n in sizes.items() if n > 4 * sample}
    place = F.row_number().over(Window.partitionBy("label").orderBy("key"))
    out: list[tuple[int, int]] = []
    for k in sizes:
        own = keyed.filter(F.col("label") == k)
        for bound in (bounds.get(k), None):  # should the estimate have been far off, the label goes without a bound
            keys = own.filter(F.col("key") <= bound) if bound is not None else own
            found = keys.select("label", "key").distinct().withColumn("place", place).filter(F.col("place") <= sample).select("label", "key").collect()
            if len(found) == sample or bound is None:
                break
        out += [tuple(r) for r in found]
    return out


def learn(rows: DataFrame, sample: int = SAMPLE) -> Model | float:
    """The model from (text, label) rows; a constant score where no two classes are labelled."""
    bounded_batches(rows.sparkSession)
    rows = rows.select("text", "label")
    counts = rows.mapInArrow(_counts, "bucket int, ones long, zeros long").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toArrow()  # BUCKETS rows at most
    p, q = np.ones(BUCKETS), np.ones(BUCKETS)
    at = counts["bucket"].to_numpy()
    p[at] += counts["ones"].to_numpy()
    q[at] += counts["zeros"].to_numpy()
    # Copies have one key. Keys alone are shuffled; then the texts of those that are chosen are read.
    keyed = rows.withColumn("key", F.xxhash64("text", F.lit(29)))
    few = rows.sparkSession.createDataFrame(_smallest(keyed, sample), "label int, key long")
    texts = keyed.join(F.broadcast(few), ["label", "key"]).groupBy("label", "key").agg(F.min("text").alias("text"))
    chosen = [(r["text"], r["label"]) for r in texts.orderBy("key", "label").collect()]
    classes = {k for _, k in chosen}
    if len(classes) < 2:
        return float(classes.pop()) if classes else 0.5
    return fit(chosen, np.log(p / p.sum()) - np.log(q / q.sum()))


def scorer(model: Model | float):
    """An Arrow function from texts to scores."""

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features()
        for texts in columns:
            yield pa.array([model if isinstance(model, float) else model.score(features(t.as_py().encode())) for t in texts], pa.float64())

    score.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double").asNondeterministic()


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", least: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; learned from labels of the rows that are not held out."""
    model = learn(labelled(docs.filter(~held_out()), labels, label_col), sample)
    bounded_batches(docs.sparkSession)
    found = docs.select("doc_id", held_out().alias("held_out"), scorer(model)(F.coalesce("text", F.lit(""))).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= least).cast("int"))
