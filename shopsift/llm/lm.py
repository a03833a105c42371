"""Scores of texts by logistic mixing of hashed-context bit predictors.

A text, A-Z lower-cased, alternates words and gaps of ASCII white space. The
next kind (word, gap or end) has a probability of its own; words and gaps are
coded byte by byte and each byte bit by bit. A word's first byte is predicted by
two contexts, a hash of the word before it and none, and each further byte by
four: hashes of the last one, two and three bytes, counted over word types, and
the whole prefix of the word, counted over tokens. The first four bytes' prefixes
are hashed into a table of bounded size; longer prefixes are counted exactly
where all words with the same prefix meet: the first four bytes or, where too
many words share those, as many more as make groups of bounded size. So this part
grows with the corpus. A mixer adds the logits with weights that a gate picks by
the prefix's count, and an adaptive map refines the sum. All counts cover all
training texts, and mixers learn from all training words: online, by gradient
steps, a word's own occurrence left out of its prefix's counts. The head's mixers
learn in shards by a hash of the words and are averaged by the words that each has
seen. Then weights are held fixed, so a score depends on nothing but the training texts and the text.

Jobs: count words and gaps (combined in tasks before the shuffle); collect the
bounded tables; score each distinct word once by prefix buckets; add up texts.
Words with at least 1/``FREQUENT`` of all tokens, of which there can be no more
than ``FREQUENT``, are broadcast; a text's other words meet their scores by
hash buckets whose number follows the number of tokens.

Defined results: a null text is empty and has the end token alone; rows that
repeat a doc_id are scored one by one; without training texts the base score
takes V and N as 0, and bits have even odds; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_strings, gather, give_back, slices, stored, texts_of

ORDERS = 4  # last byte, last two, last three, whole prefix
SLOTS = 1 << 13
LONGEST = 47  # bytes of a word that one key holds
FREQUENT = 100_000
HEAD = 4  # bytes whose prefixes are hashed
GATES = 24
BINS = 33
LEARN_HEADS = 2_000  # beginnings of keys in a step of the head's mixers
HEAD_KEYS = 400_000  # of a shard that one head mixer learns from
CLASSES = 256  # of previous words
PRIOR = np.float32(0.05)
BUCKET_KEYS, BUCKET_TOKENS = 30_000, 300_000
KEY_BYTES = 8  # of a group's keys beyond HEAD on average; a byte takes some 450 bytes of memory
STEP = 2  # bytes by which a prefix with too many keys is split
BATCH_BYTES, PART_BYTES = 8_000_000, 1_000_000  # of texts whose keys are numbered together, and whose runs are found together
MOST_KEYS = 600_000  # that a task counts before it passes them on

CHUNK, LONG, MOVE, PAIR = b" \x02", b" \x03", b" \x04", b" \x05"  # keys that are neither words nor gaps
WHITE = b" \t\n\x0b\x0c\r"
WHITES = [WHITE[i : i + 1] for i in range(len(WHITE))]


def parts(key: bytes) -> list[bytes]:
    """Keys that code a word or gap beyond ``LONGEST`` bytes: its begin and further pieces."""
    return [LONG + key[: LONGEST + 1]] + [CHUNK + key[i : i + LONGEST] for i in range(LONGEST + 1, len(key) + 1, LONGEST)]


def grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches of (id, text, ...), in groups of about ``most`` bytes of text, or one text."""
    held, size = [], 0
    for batch in batches:
        lo = 0
        for part in slices(batch.column(1), most):
            held.append(batch.slice(lo, len(part)))
            lo, size = lo + len(part), size + (pc.sum(pc.binary_length(part)).as_py() or 0)
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def binary(body: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The byte strings of these lengths that stand one after another in ``body``."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])


def numbered(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, and each one's number among them."""
    found = values.dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


#: The keys that any text may have.
USUAL = [*WHITES, *(MOVE + m for m in (b"sw", b"sg", b"se", b"wg", b"we", b"gw", b"ge")), b""]


def read_runs(texts: pa.Array, first_doc: int) -> dict[str, np.ndarray | list]:
    """Words and gaps of some texts, which are numbered from ``first_doc``; small, since it holds several numbers a run."""
    docs = len(texts)
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    stops = np.cumsum(sizes)
    data = np.frombuffer(b"".join([t.as_buffer() for t in texts]).lower(), np.uint8)
    filled = np.flatnonzero(sizes)
    white = (data == 32) | (data - np.uint8(9) < 5)
    # Runs of white space and of other bytes; a text's first byte begins one.
    new = np.ones(len(data), bool)
    new[1:] = white[1:] != white[:-1]
    new[(stops - sizes)[filled]] = True
    start = np.flatnonzero(new)
    length = np.diff(start, append=len(data)).astype(np.int32)
    many = np.diff(np.searchsorted(start, np.concatenate([[0], stops])))
    doc = np.repeat(np.arange(docs, dtype=np.int32), many)
    gap = white[start]
    words, gaps = np.flatnonzero(~gap), np.flatnonzero(gap)
    word_doc = doc[words]
    n_words, n_gaps = np.bincount(word_doc, minlength=docs), np.bincount(doc[gaps], minlength=docs)

    lead, trail = np.zeros(docs, bool), np.zeros(docs, bool)
    last = np.cumsum(many)
    lead[filled], trail[filled] = gap[(last - many)[filled]], gap[last[filled] - 1]
    some = n_words > 0
    only, trail = lead & ~some, trail & some  # a text of white space alone leads with it
    single = gaps[length[gaps] == 1]
    byte, of = data[start[single]], doc[single]
    usual = [np.bincount(of[byte == c[0]], minlength=docs) for c in WHITES]
    usual += [some & ~lead, lead, ~some & ~lead, np.where(some, n_words - 1 + trail, 0), some & ~trail, n_gaps - (trail | only), trail | only, np.ones(docs, bool)]
    wide = gaps[(length[gaps] > 1) & (length[gaps] <= LONGEST)]
    return {
        "n_bytes": sizes, "n_words": n_words, "usual": np.stack(usual, 1).astype(np.int32),
        "words": data[~white], "word_length": length[words], "word_doc": word_doc + np.int32(first_doc), "first": first_bytes(data, start[words], length[words], word_doc),
        "gaps": gather(data, start[wide], length[wide])[1], "gap_length": length[wide], "gap_doc": doc[wide] + np.int32(first_doc),
        "long": [(data[start[i] : start[i] + length[i]].tobytes(), first_doc + int(doc[i])) for i in np.flatnonzero(length > LONGEST).tolist()],
    }


class Occurrences:
    """All keys of some texts, lower-cased, together.

    ``keys`` are distinct: the words, then the others. Word ``i`` is key
    ``word[i]`` in text ``word_doc[i]``; another key ``other[i]`` occurs ``times[i]``
    times in text ``other_doc[i]``. The empty key is a text's end. ``first`` has what
    :func:`first_bytes` gives for the words in ``first_doc``, those that one key holds.
    """

    def __init__(self, texts: pa.Array):
        some, at = [], 0
        for part in slices(texts, PART_BYTES) if len(texts) else [texts]:
            some.append(read_runs(part, at))
            at += len(part)
        all_of = lambda name: np.concatenate([found.pop(name) for found in some])
        self.n_bytes, self.n_words = all_of("n_bytes"), all_of("n_words")
        self.word_doc, self.first, size = all_of("word_doc"), all_of("first"), all_of("word_length")
        word_keys, self.word = numbered(binary(all_of("words"), size))
        self.first_doc = self.word_doc
        if (size > LONGEST).any():
            self.first, self.first_doc = self.first[size <= LONGEST], self.word_doc[size <= LONGEST]
        usual = all_of("usual")
        whose, which = np.nonzero(usual)
        size = all_of("gap_length")
        gap_keys, gap = numbered(binary(all_of("gaps"), size))
        pieces: dict[bytes, int] = {}
        cut = [(pieces.setdefault(p, len(pieces)), doc) for found in some for run, doc in found["long"] for p in parts(run)]
        piece, piece_doc = np.array(cut, np.int64).reshape(-1, 2).T
        self.keys = pa.concat_arrays([word_keys, pa.array(USUAL, pa.binary()), gap_keys, pa.array(list(pieces), pa.binary())])
        self.other = len(word_keys) + np.concatenate([which, len(USUAL) + gap, len(USUAL) + len(gap_keys) + piece])
        self.other_doc = np.concatenate([whose, all_of("gap_doc"), piece_doc])
        self.times = np.concatenate([usual[whose, which], np.ones(len(gap) + len(piece), np.int32)])

    def counts(self, use: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts that ``use`` marks."""
        own = use[self.other_doc]
        found = np.bincount(self.other[own], self.times[own], len(self.keys)).astype(np.int64)
        return found + np.bincount(self.word if use.all() else self.word[use[self.word_doc]], minlength=len(self.keys))


def is_base(key: bytes) -> bool:
    """Whether a key is a token of the base score: a word or the end."""
    return not key or key[0] not in b" \t\n\x0b\x0c\r"


def coded(key: bytes) -> tuple[int, bytes]:
    """Kind (0 word, 1 gap, 2 piece) and the bytes that code a key."""
    if key.startswith(LONG):
        return (0 if is_base(key[2:]) else 1), key[2:]
    if key.startswith(CHUNK):
        return 2, key[2:].ljust(LONGEST, b"\0") if len(key) == LONGEST + 2 else key[2:] + b" "
    return (0, key + b" ") if is_base(key) else (1, key + b"\0")


def is_coded(key: bytes) -> bool:
    return bool(key) and not key.startswith((MOVE, PAIR)) and (len(key) <= LONGEST or key.startswith((LONG, CHUNK)))


# First bytes


def first_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word: the class of the word before it, by a hash of that word's last two bytes and length, times 256 plus its first byte."""
    if not len(start):
        return np.zeros(0, np.uint16)
    end = start + length - 1
    last = data[end].astype(np.uint32) * np.uint32(263) + data[np.maximum(end - 1, start)].astype(np.uint32) * np.uint32(71) + np.minimum(length, 4).astype(np.uint32)
    before = np.zeros(len(start), np.uint16)
    before[1:] = 1 + last[:-1] * np.uint32(40503) % np.uint32(65537) % np.uint32(CLASSES - 1)  # below 2 ** 32
    before[1:][doc[1:] != doc[:-1]] = 0  # class 0: a text's first word
    return before * np.uint16(256) + data[start]


def first_byte_scores(counts: np.ndarray) -> np.ndarray:
    """log10 probabilities of each byte as a word's first one, for each class of the word before it: classes x 256.

    ``counts``: classes x 256. Two predictors, the class's bytes and those of all
    classes, are mixed bit by bit, by gates of the class's count.
    """

    def nodes(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logit, seen = np.zeros(leaves.shape, np.float32), np.zeros(leaves.shape, np.int64)
        for depth in range(8):
            parts = leaves.reshape(len(leaves), 1 << (depth + 1), -1).sum(2)
            one, total = parts[:, 1::2], parts[:, 0::2] + parts[:, 1::2]
            logit[:, 1 << depth : 2 << depth] = np.log((one + PRIOR) / (total - one + PRIOR))
            seen[:, 1 << depth : 2 << depth] = log_count(total)
        return logit, seen

    own, seen = nodes(counts)
    overall, _ = nodes(counts.sum(0, keepdims=True))
    cls, byte = (a.reshape(-1) for a in np.mgrid[: len(counts), :256])
    steps, node = [], np.ones(len(byte), np.int64)
    for b in range(7, -1, -1):
        x = np.zeros((len(byte), ORDERS + 1), np.float32)
        x[:, 2], x[:, 3], x[:, 4] = overall[0, node], own[cls, node], 1
        bit = (byte >> b) & 1
        steps.append((x, seen[cls, node] * 2, bit, learning_weight(counts.reshape(-1))))
        node = node * 2 + bit
    mixer = Mixer().learn(steps)
    return sum(mixer.cost(x, gate, bit) for x, gate, bit, _ in steps).reshape(len(counts), 256)


# Counting


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "n_train", "n_all"]
    firsts = np.zeros(CLASSES * 256, np.int64)
    found, size = [], 0

    def merged() -> pa.Table:
        whole = pa.concat_tables(found)
        found.clear()
        keys, at = numbered(pa.concat_arrays(whole.column("key").chunks))
        return pa.table([keys, *(np.bincount(at, whole.column(c).to_numpy(), len(keys)).astype(np.int64) for c in names[1:])], names=names)

    for batch in grouped(batches, BATCH_BYTES):
        texts, train = Occurrences(batch.column(1)), ~np.asarray(batch.column(2))
        n_all = texts.counts(np.ones(len(train), bool))
        own = pa.table([texts.keys, pa.array(texts.counts(train)), pa.array(n_all)], names=names).filter(pa.array(n_all > 0))
        firsts += np.bincount(texts.first[train[texts.first_doc]], minlength=len(firsts))
        del texts
        found.append(own)
        size += own.num_rows
        if size > 2 * MOST_KEYS:
            found.append(merged())
            size = found[0].num_rows
            if size > MOST_KEYS:
                yield from found.pop().to_batches(50_000)
                size = 0
    if found:
        yield from merged().to_batches(50_000)
    pairs = np.flatnonzero(firsts)
    yield pa.RecordBatch.from_arrays([pa.array([PAIR + int(i).to_bytes(2) for i in pairs], pa.binary()), pa.array(firsts[pairs]), pa.array(np.zeros(len(pairs), np.int64))], names=names)
    give_back()


# The byte model


class Tables:
    """Logits and counts of each order's bit nodes, from counts of (order, slot, byte)."""

    def __init__(self, cells: np.ndarray, n: np.ndarray):
        leaves = np.zeros(ORDERS * SLOTS * 256, np.float32)
        leaves[cells] = n
        level, totals = leaves.reshape(-1, 256), []
        while level.shape[1] > 1:
            totals.append(level)
            level = level[:, 0::2] + level[:, 1::2]
        totals.append(level)
        totals.reverse()
        # Node 1 is a byte's first bit; the children of node k are 2k and 2k + 1.
        self.logit = np.zeros((ORDERS * SLOTS, 256), np.float16)
        self.seen = np.zeros((ORDERS * SLOTS, 256), np.uint8)
        for depth in range(8):
            one, total = totals[depth + 1][:, 1::2], totals[depth]
            at = slice(1 << depth, 2 << depth)
            self.logit[:, at] = np.log((one + PRIOR) / (total - one + PRIOR))
            self.seen[:, at] = log_count(total)


def log_count(n: np.ndarray) -> np.ndarray:
    return np.minimum(GATES // 2 - 1, np.ceil(np.log2(n + 1))).astype(np.uint8)


def slot(parts_: list[np.ndarray], order: int) -> np.ndarray:
    h = np.full(parts_[0].shape, order + 1, np.uint64)
    for p in parts_:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return order * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64)


def contexts(data: np.ndarray, kind: np.ndarray, j: int) -> list[np.ndarray]:
    """The slots of byte ``j``'s contexts; of whole prefixes only the first ``HEAD``."""
    back = [data[:, j - i] if j >= i else (kind + 1 if j == i - 1 else np.zeros_like(kind)) for i in (1, 2, 3)]
    out = [slot(back[:i], i - 1) for i in (1, 2, 3)]
    if j < HEAD:
        out.append(slot([kind, *[data[:, i] for i in range(j)], np.full_like(kind, j)], 3))
    return out


def matrix(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (a row a key), kinds and lengths."""
    pairs = [coded(k) for k in keys]
    lengths = np.array([len(b) for _, b in pairs], np.int64)
    wide = int(lengths.max(initial=1))
    data = np.frombuffer(b"".join(b.ljust(wide, b"\0") for _, b in pairs), np.uint8).reshape(-1, wide)
    return data, np.array([k for k, _ in pairs], np.uint8), lengths


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ORDERS * SLOTS * 256, np.float32)
    for batch in batches:
        pairs = [(k, n) for k, n in zip(byte_strings(batch.column(0)), batch.column(1).to_pylist(), strict=True) if n and is_coded(k)]
        if not pairs:
            continue
        keys = [k for k, _ in pairs]
        data, kind, lengths = matrix(keys)
        n = np.array([c for _, c in pairs], np.float32)
        for j in range(data.shape[1]):
            on = np.flatnonzero(lengths > j)
            for order, s in enumerate(contexts(data[on], kind[on], j)):
                np.add.at(total, s * 256 + data[on, j], n[on] if order == 3 else np.float32(1))
    cells = np.flatnonzero(total)
    for lo in range(0, len(cells), 100_000):
        some = cells[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.float64))], names=["cell", "n"])


class Mixer:
    """Gated weights over the predictors' logits, and an adaptive map of the result."""

    def __init__(self):
        self.w = np.tile(np.array([0.1, 0.2, 0.3, 0.6, 0.0], np.float32), (GATES, 1))
        grid = np.linspace(-12, 12, BINS).astype(np.float32)
        self.map = np.tile(1 / (1 + np.exp(-grid)), (GATES, 1)).astype(np.float32)

    def mix(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        logit = np.clip(np.einsum("ij,ij->i", x, self.w[gate]), -11.99, 11.99)
        p = 1 / (1 + np.exp(-logit))
        place = (logit + 12) * ((BINS - 1) / 24)
        low = place.astype(np.int64)
        part = place - low
        return p, low, part, self.map[gate, low] * (1 - part) + self.map[gate, low + 1] * part

    def step(self, x, gate, bit, weight, rate: float) -> None:
        p, low, part, _ = self.mix(x, gate)
        norm = np.bincount(gate, weight, GATES) + 20.0
        err = (bit - p) * weight
        for i in range(x.shape[1]):
            self.w[:, i] += (rate * np.bincount(gate, err * x[:, i], GATES) / norm).astype(np.float32)
        for at, share in ((low, 1 - part), (low + 1, part)):
            cell = gate * BINS + at
            mass = np.bincount(cell, weight * share, GATES * BINS)
            pull = np.bincount(cell, weight * share * bit, GATES * BINS)
            flat = self.map.reshape(-1)
            flat += (0.3 * (pull - mass * flat) / (mass + 10)).astype(np.float32)

    def cost(self, x, gate, bit) -> np.ndarray:
        """log10 of each bit's probability."""
        p, _, _, refined = self.mix(x, gate)
        one = np.clip(0.5 * (p + refined), 1e-6, 1 - 1e-6)
        return np.log10(np.where(bit, one, 1 - one))

    def cells(self) -> np.ndarray:
        return np.concatenate([self.w.reshape(-1), self.map.reshape(-1)])

    def set_cells(self, cells: np.ndarray) -> Mixer:
        self.w = cells[: self.w.size].reshape(self.w.shape).astype(np.float32)
        self.map = cells[self.w.size :].reshape(self.map.shape).astype(np.float32)
        return self

    def learn(self, steps: list[tuple], rounds: int = 4) -> Mixer:
        for r in range(rounds):
            for x, gate, bit, weight in steps:
                if len(bit):
                    self.step(x.astype(np.float32, copy=False), gate.astype(np.int64, copy=False), bit, weight, 0.6 / (1 + r))
        return self


def bits(data, kind, lengths, n, tables: Tables, from_byte: int, to_byte: int, left_out: np.ndarray | None):
    """For each bit position: rows, predictors' logits, gates and bits.

    Rows are sorted by kind and bytes. ``n`` are the rows' training counts. For
    the rows that ``left_out`` marks, which have training counts, the same comes
    again with one occurrence of theirs left out of their prefix's.
    """
    on = np.arange(len(data))
    first = np.zeros(len(data), bool)
    first[:1] = True
    first[1:] = (data[1:, :from_byte] != data[:-1, :from_byte]).any(1) | (kind[1:] != kind[:-1])
    group = np.cumsum(first) - 1
    for j in range(from_byte, min(to_byte, data.shape[1])):
        keep = lengths[on] > j
        on, group = on[keep], group[keep]
        if not len(on):
            return
        slots = contexts(data[on], kind[on], j)
        node = np.ones(len(on), np.int64)
        byte = data[on, j]
        for b in range(7, -1, -1):
            bit = (byte >> b) & 1
            x = np.ones((len(on), ORDERS + 1), np.float32)
            for i, s in enumerate(slots):
                x[:, i] = tables.logit[s, node]
            if j < HEAD:
                seen = tables.seen[slots[3], node]
            else:
                total = np.bincount(group, n[on])[group]
                ones = np.bincount(group, n[on] * bit)[group]
                x[:, 3] = np.log((ones + PRIOR) / (total - ones + PRIOR))
                seen = log_count(total)
                if left_out is not None:
                    out = np.flatnonzero(left_out[on])
                    total, ones = total[out] - 1, ones[out] - bit[out]
                    own = x[out]
                    own[:, 3] = np.log((ones + PRIOR) / (total - ones + PRIOR))
                    own_gate = log_count(total).astype(np.int64) * 2 + (tables.seen[slots[2][out], node[out]] > 0)
                change = np.zeros(len(on), bool)
                change[1:] = (group[1:] != group[:-1]) | (bit[1:] != bit[:-1])
                group = np.cumsum(change)
            gate = seen.astype(np.int64) * 2 + (tables.seen[slots[2], node] > 0)
            yield (on, x, gate, bit) if left_out is None else (on, x, gate, bit, (on[out], own, own_gate, bit[out]))
            node = node * 2 + bit


def learning_weight(n: np.ndarray) -> np.ndarray:
    """What a training key counts for in a mixer's steps: the bits of its count."""
    return np.log2(1 + n)


def train_head(keys: list[bytes], weight: np.ndarray, tables: Tables, mixer: Mixer) -> None:
    data, kind, lengths = matrix(keys)
    mixer.learn([(x, g, b, weight[on]) for on, x, g, b in bits(data, kind, lengths, weight, tables, 0, HEAD, None)], 1)


def heads(keys: list[bytes], n: list[int]) -> list[tuple[bytes, float]]:
    """Coded keys that begin alike as one, the shortest, with the sum of their learning weights, in the order of a hash."""
    found: dict[tuple[int, bytes], list] = {}
    for key, many in zip(keys, n, strict=True):
        if is_coded(key):
            kind, code = coded(key)
            own = found.setdefault((kind, code[:HEAD]), [(len(key), key), []])
            own[0] = min(own[0], (len(key), key))
            own[1].append(many)
    return [(key, float(learning_weight(np.sort(np.array(many))).sum())) for (_, key), many in sorted(found.values(), key=lambda x: (zlib.crc32(x[0][1]), x[0][1]))]


def head_parts(vocab: DataFrame, shared, n_keys: int) -> DataFrame:
    """(cell, value): the head mixers learned from all training keys, averaged by the keys that each has learned from.

    A mixer learns from the keys of a shard, of which their hash and the number of
    keys alone decide, in the order of another hash; so the result is the same
    however rows are dealt to tasks. Keys that begin alike are one step's row with
    the sum of their weights, which moves the mixer as all of them would.
    """
    shards = max(1, -(-n_keys // HEAD_KEYS))

    def learn(table: pa.Table) -> pa.Table:
        tables = object.__new__(Tables)
        tables.logit, tables.seen = shared.value[:2]
        keys, mixer = byte_strings(table.column("key")), Mixer()
        found = heads(keys, table.column("n_train").to_pylist())
        for lo in range(0, len(found), LEARN_HEADS):
            some = found[lo : lo + LEARN_HEADS]
            train_head([k for k, _ in some], np.array([w for _, w in some]), tables, mixer)
        mass = sum(map(is_coded, keys))
        cells = mixer.cells().astype(np.float64)
        give_back()
        return pa.table({"cell": np.arange(len(cells)), "total": cells * mass, "mass": np.full(len(cells), mass, np.int64)})

    keys = vocab.filter("n_train > 0").select("key", "n_train", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(shards)).alias("shard"))
    parts = keys.groupBy("shard").applyInArrow(learn, "cell long, total double, mass long").filter("mass > 0")
    return parts.groupBy("cell").agg((F.sum("total") / F.sum("mass")).alias("value"))


def tail_scores(data, kind, lengths, n, weight, begin, most: int, tables: Tables) -> np.ndarray:
    """log10 probabilities of up to ``most`` bytes from ``begin`` (a number a row) on.

    Rows are sorted by kind and bytes, and all those with the same first ``begin``
    bytes are here. A mixer learns from the rows with a ``weight``.
    """
    steps, all_bits, score = [], [], np.zeros(len(data))
    for depth in np.unique(begin).tolist():
        at = np.flatnonzero(begin == depth)
        for on, x, gate, bit, (rows, own, own_gate, own_bit) in bits(data[at], kind[at], lengths[at], n[at], tables, depth, depth + most, weight[at] > 0):
            steps.append((own.astype(np.float16), own_gate.astype(np.uint8), own_bit, weight[at[rows]].astype(np.float32)))
            all_bits.append((at[on], x.astype(np.float16), gate.astype(np.uint8), bit))
    tail = Mixer().learn(steps, 1)
    del steps
    for on, x, gate, bit in all_bits:
        score[on] += tail.cost(x.astype(np.float32), gate.astype(np.int64), bit)
    return score


def in_order(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return np.lexsort([*(data[:, j] for j in range(data.shape[1] - 1, -1, -1)), kind])


def score_keys(keys: list[bytes], n: np.ndarray, tables: Tables, head: Mixer, begin: np.ndarray | None = None) -> np.ndarray:
    """log10 probabilities of coded keys' first ``HEAD`` bytes and those from ``begin`` (``HEAD`` if not given) on."""
    data, kind, lengths = matrix(keys)
    order = in_order(data, kind)
    data, kind, lengths, counts = data[order], kind[order], lengths[order], n[order].astype(np.float64)
    score = np.zeros(len(keys))
    # The first byte of a word depends on the word before it and is scored with the text.
    inner = np.array([kind[r] != 0 or keys[i].startswith(LONG) for r, i in enumerate(order)], bool)
    # Keys that begin alike have the same head, which is scored once.
    new = np.ones(len(keys), bool)
    new[1:] = (data[1:, :HEAD] != data[:-1, :HEAD]).any(1) | (kind[1:] != kind[:-1]) | (inner[1:] != inner[:-1]) | (np.minimum(lengths[1:], HEAD) != np.minimum(lengths[:-1], HEAD))
    one = np.flatnonzero(new)
    heads = np.zeros(len(one))
    for number, (on, x, gate, bit) in enumerate(bits(data[one, :HEAD], kind[one], lengths[one], counts[one], tables, 0, HEAD, None)):
        heads[on] += head.cost(x, gate, bit) * (inner[one[on]] if number < 8 else 1)
    score += heads[np.cumsum(new) - 1]
    begin = np.full(len(keys), HEAD) if begin is None else begin[order]
    score += tail_scores(data, kind, lengths, counts, learning_weight(counts), begin, data.shape[1], tables)
    out = np.zeros(len(keys))
    out[order] = score
    give_back()
    return out


# Groups of keys by prefix


def path_of(key: bytes) -> bytes:
    kind, code = coded(key)
    return bytes([kind]) + code


def path() -> Column:
    """:func:`path_of` of column ``key``, null where a key is not coded."""
    size, mark, rest = F.octet_length("key"), F.substring("key", 1, 2), F.substring("key", 3, LONGEST + 1)
    word, gap, piece = (F.lit(bytes([k])) for k in range(3))
    coded_ = F.when(mark == F.lit(LONG), F.concat(F.when(is_white(rest), gap).otherwise(word), rest))
    coded_ = coded_.when(mark == F.lit(CHUNK), F.concat(piece, rest, F.when(size == LONGEST + 2, F.lit(b"")).otherwise(F.lit(b" "))))
    short = (size > 0) & (size <= LONGEST) & (mark != F.lit(MOVE)) & (mark != F.lit(PAIR))
    return coded_.when(short & is_white(F.col("key")), F.concat(gap, "key", F.lit(b"\0"))).when(short, F.concat(word, "key", F.lit(b" ")))


def is_white(data: Column) -> Column:
    return F.substring(data, 1, 1).isin(*[bytes([b]) for b in b" \t\n\x0b\x0c\r"])


def prefix(depth: int) -> Column:
    return F.substring("path", 1, 1 + depth)


def large_prefixes(paths: DataFrame, most_keys: int) -> dict[int, set[bytes]]:
    """By depth, the prefixes with more keys or bytes than a group may hold; few, since each level's hold different keys."""
    found, depth, rows = {}, HEAD, paths
    while depth <= LONGEST:
        sizes = rows.groupBy(prefix(depth).alias("prefix")).agg(F.count("*").alias("many"), F.sum(F.octet_length("path") - 1 - depth).alias("tail"))
        large = {bytes(r["prefix"]) for r in sizes.filter((F.col("many") > most_keys) | (F.col("tail") > KEY_BYTES * most_keys)).select("prefix").collect()}
        if not large:
            break
        found[depth] = large
        rows = under(paths, depth, large)
        depth += STEP
    return found


def under(paths: DataFrame, depth: int, prefixes: set[bytes]) -> DataFrame:
    few = paths.sparkSession.createDataFrame([(bytearray(p),) for p in sorted(prefixes)], "__prefix binary")
    return paths.join(F.broadcast(few), prefix(depth) == F.col("__prefix"), "left_semi")


def score_vocab(vocab: DataFrame, score_bucket, shared, n_keys: int, most_keys: int | None = None) -> DataFrame:
    """Rows of ``vocab`` with base and score, by groups of keys with the same prefix.

    A prefix too large for a group is split at ``STEP`` more bytes, again and again.
    Its keys then have the scores of those bytes in common where the bytes are the
    same, so each of the at most 256 ** ``STEP`` continuations is scored once, from
    the counts of all its keys, and its score carried along to the group below.
    """
    most_keys = most_keys or BUCKET_KEYS
    spark, schema = vocab.sparkSession, "key binary, n_train long, n_all long, base double, score double"
    paths = vocab.withColumn("path", path())
    total = paths.agg(F.sum(F.octet_length("path") - 1 - HEAD)).first()[0] or 0
    buckets = max(8, -(-n_keys // most_keys), -(-total // (KEY_BYTES * most_keys)))
    large = large_prefixes(paths.filter("path IS NOT NULL"), most_keys)
    if not large:
        by_prefix = paths.withColumn("bucket", F.crc32(F.coalesce(prefix(HEAD), "key")) % buckets).drop("path")
        return by_prefix.groupBy("bucket").applyInArrow(lambda key, table: score_bucket(table, None), schema)

    weight = F.log2(F.col("n_train") + 1)
    levels = [
        under(paths, depth, some).groupBy(prefix(depth).alias("parent"), prefix(depth + STEP).alias("node")).agg(F.sum("n_train").alias("n"), F.sum(weight).alias("weight")).withColumn("depth", F.lit(depth))
        for depth, some in large.items()
    ]

    def score_nodes(key: tuple, table: pa.Table) -> pa.Table:
        logit, seen, _ = shared.value
        tables = object.__new__(Tables)
        tables.logit, tables.seen = logit, seen
        nodes = table.column("node").to_pylist()
        n, begin = (np.array(table.column(c).to_pylist(), np.int64) for c in ("n", "depth"))
        weights = np.array(table.column("weight").to_pylist(), np.float64)
        lengths = np.array([len(p) - 1 for p in nodes], np.int64)
        wide = int(lengths.max())
        data = np.frombuffer(b"".join(p[1:].ljust(wide, b"\0") for p in nodes), np.uint8).reshape(-1, wide)
        kind = np.array([p[0] for p in nodes], np.uint8)
        order = in_order(data, kind)
        got = np.zeros(len(nodes))
        got[order] = tail_scores(data[order], kind[order], lengths[order], n[order].astype(np.float64), weights[order].astype(np.float64), begin[order], STEP, tables)
        return pa.table([table.column("parent"), table.column("node"), pa.array(got)], names=["parent", "node", "own"])

    nodes = functools.reduce(DataFrame.unionByName, levels).withColumn("bucket", F.crc32("parent") % max(8, sum(map(len, large.values()))))
    nodes = stored(nodes.groupBy("bucket").applyInArrow(score_nodes, "parent binary, node binary, own double"))
    all_large = [(bytearray(p),) for some in large.values() for p in sorted(some)]
    above = {p: 0.0 for p in large[HEAD]}
    inner = nodes.join(F.broadcast(spark.createDataFrame(all_large, "node binary")), "node", "left_semi").collect()  # only large prefixes
    for r in sorted(inner, key=lambda r: len(r["node"])):
        above[bytes(r["node"])] = above[bytes(r["parent"])] + r["own"]
    sums = spark.createDataFrame([(bytearray(p), v) for p, v in above.items()], "parent binary, above double")
    carried = nodes.join(F.broadcast(sums), "parent").select("node", (F.col("own") + F.col("above")).alias("carried"), (F.crc32("node") % buckets).alias("bucket"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depths, at = [], []
            for key, p in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                depth = HEAD
                while p is not None and p[: 1 + depth] in large.get(depth, ()):
                    depth += STEP
                depths.append(depth)
                at.append(zlib.crc32(key if p is None else p[: 1 + depth]) % buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(depths, pa.int32()), pa.array(at, pa.int64())], names=["key", "n_train", "n_all", "depth", "bucket"])

    placed = paths.select("key", "n_train", "n_all", "path").mapInArrow(place, "key binary, n_train long, n_all long, depth int, bucket long")
    return placed.groupBy("bucket").cogroup(carried.groupBy("bucket")).applyInArrow(lambda key, table, carried: score_bucket(table, carried), schema)


# Texts


def _sum_texts(frequent, rare_buckets: int, firsts: np.ndarray):
    index = pa.array([k for k, *_ in frequent], pa.binary())
    values = np.array([[b * is_base(k), s, float(c > 0 and is_base(k))] for k, c, b, s in frequent]).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(grouped(batches, BATCH_BYTES), first):
            yield _one_batch(batch, number, index, values, rare_buckets, firsts)
        give_back()

    return run


NAMES = ["batch", "bucket", "doc_ids", "held", "many", "packed", "sums"]
PARTIAL = "batch long, bucket long, doc_ids array<long>, held array<boolean>, many long, packed binary, sums binary"


def _one_batch(batch: pa.RecordBatch, number: int, index: pa.Array, values: np.ndarray, buckets: int, firsts: np.ndarray) -> pa.RecordBatch:
    """Row -1 with the texts' sums over frequent keys, and a row for each bucket of other keys.

    Such a row has its distinct keys' lengths and numbers of occurrences, the
    occurrences' texts and times, and the keys.
    """
    n, texts = batch.num_rows, Occurrences(batch.column(1))
    at = pc.index_in(texts.keys, value_set=index).fill_null(-1).to_numpy()
    own = np.concatenate([values, np.zeros((1, 3))]).T.copy()[:, at]  # the keys' values, none of those not frequent
    sums = np.zeros((n, 5))  # base, score, known, tokens, bytes
    for i in range(3):
        sums[:, i] = np.bincount(texts.word_doc, own[i][texts.word], n) + np.bincount(texts.other_doc, own[i][texts.other] * texts.times, n)
    sums[:, 1] += np.bincount(texts.first_doc, firsts[texts.first], n)
    sums[:, 3], sums[:, 4] = texts.n_words + 1, texts.n_bytes
    rows = [(number, -1, batch.column(0).to_pylist(), batch.column(2).to_pylist(), None, None, sums.tobytes())]

    words, other = at[texts.word] < 0, at[texts.other] < 0
    key = np.concatenate([texts.word[words], texts.other[other]])
    docs = np.concatenate([texts.word_doc[words], texts.other_doc[other]]).astype("<i4")
    times = np.concatenate([np.ones(int(words.sum()), "<i4"), texts.times[other].astype("<i4")])
    seen = np.bincount(key, minlength=len(at))
    rare = np.flatnonzero(seen)
    some = byte_strings(texts.keys.take(pa.array(rare)))
    bucket = np.fromiter(map(zlib.crc32, some), np.int64, len(some)) % buckets
    order = np.argsort(bucket, kind="stable")
    place = np.zeros(len(at), np.int32)
    place[rare[order]] = np.arange(len(rare))
    by_key = np.argsort(place[key], kind="stable")
    docs, times = docs[by_key], times[by_key]
    seen, sizes = seen[rare[order]].astype("<i4"), np.fromiter(map(len, some), "<i4", len(some))[order]
    ends = np.concatenate([[0], np.cumsum(seen)])
    pack = zstandard.ZstdCompressor(level=1).compress
    cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(rare)]
    for lo, hi in itertools.pairwise(cuts) if len(rare) else ():
        a, b = ends[lo], ends[hi]
        data = b"".join([sizes[lo:hi].tobytes(), seen[lo:hi].tobytes(), docs[a:b].tobytes(), times[a:b].tobytes(), *[some[i] for i in order[lo:hi].tolist()]])
        rows.append((number, int(bucket[order[lo]]), None, None, hi - lo, pack(data), None))
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)


def _look_up(key: tuple, rows: pa.Table, vocab: pa.Table) -> pa.Table:
    keys = vocab.column("key").cast(pa.binary()).combine_chunks()
    base_key = ~np.asarray(pc.is_in(pc.binary_slice(keys, 0, 1), value_set=pa.array(WHITES)))
    n_train, base, score = (vocab.column(c).to_numpy() for c in ("n_train", "base", "score"))
    values = np.stack([base * base_key, score, (n_train > 0) & base_key], 1).astype(float)
    batches, ats, sums, unpack = [], [], [], zstandard.ZstdDecompressor().decompress
    packed = [(batch, many, unpack(data)) for batch, many, data in zip(*(rows.column(c).to_pylist() for c in ("batch", "many", "packed")), strict=True)]
    wanted = []
    for _, many, data in packed:
        sizes, seen = np.frombuffer(data, "<i4", 2 * many).reshape(2, many)
        wanted.append(binary(np.frombuffer(data, np.uint8, offset=8 * (many + int(seen.sum()))), sizes))
    found = pc.index_in(pa.concat_arrays(wanted), value_set=keys) if wanted else pa.array([], pa.int32())
    if found.null_count:
        raise ValueError("a text's key is not in the vocabulary")
    found, lo = found.to_numpy(), 0
    for batch, many, data in packed:
        seen = np.frombuffer(data, "<i4", many, 4 * many)
        docs, times = np.frombuffer(data, "<i4", 2 * int(seen.sum()), 8 * many).reshape(2, -1)
        got = values[np.repeat(found[lo : lo + many], seen)] * times[:, None]
        lo += many
        ids, place = np.unique(docs, return_inverse=True)
        batches.append(batch)
        ats.append(ids.astype("<i4").tobytes())
        sums.append(np.stack([np.bincount(place, got[:, i], len(ids)) for i in range(3)], 1).tobytes())
    del wanted, packed, found, keys
    give_back()
    return pa.table([pa.array(batches, pa.int64()), pa.array(ats, pa.binary()), pa.array(sums, pa.binary())], names=["batch", "at", "sums"])


def _add_up(key: tuple, main: pa.Table, rest: pa.Table) -> pa.Table:
    head = main.to_pylist()[0]
    sums = np.frombuffer(head["sums"]).reshape(-1, 5).copy()
    for at, more in zip(rest.column("at").to_pylist(), rest.column("sums").to_pylist(), strict=True):
        sums[np.frombuffer(at, "<i4"), :3] += np.frombuffer(more).reshape(-1, 3)
    ints = lambda i: pa.array(np.rint(sums[:, i]).astype(np.int64))
    return pa.table([pa.array(head["doc_ids"], pa.int64()), pa.array(head["held"], pa.bool_()), ints(3), ints(2), pa.array(sums[:, 0]), pa.array(sums[:, 1]), ints(4)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row.

    Texts whose crc32(doc_id) mod 5 is not 1 are learned from.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    source = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    bounded_batches(spark)
    counted = source.mapInArrow(_count, "key binary, n_train long, n_all long")
    vocab = stored(counted.groupBy("key").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")))

    base = (F.octet_length("key") == 0) | ~is_white(F.col("key"))
    n_base = F.when(base, F.col("n_train")).otherwise(0)
    row = vocab.agg(F.sum(n_base), F.count_if(base & (F.col("n_train") > 0)), F.sum("n_all"), F.count("*")).first()
    train_tokens, types, all_tokens, n_keys = (x or 0 for x in row)
    norm = train_tokens + 0.5 * (types + 1)

    cells = vocab.mapInArrow(_cells, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most ORDERS * SLOTS * 256 rows
    moves = {r["key"]: r["n_train"] for r in vocab.filter(F.substring("key", 1, 2) == F.lit(MOVE)).collect()}  # at most 7
    tables = Tables(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float32))
    pairs = vocab.filter(F.substring("key", 1, 2) == F.lit(PAIR)).select("key", "n_train").collect()  # at most CLASSES * 256
    first_counts = np.zeros(CLASSES * 256)
    first_counts[[int.from_bytes(bytes(r["key"])[2:]) for r in pairs]] = [r["n_train"] for r in pairs]
    firsts = first_byte_scores(first_counts.reshape(CLASSES, 256)).reshape(-1)
    learned = head_parts(vocab, spark.sparkContext.broadcast((tables.logit, tables.seen)), n_keys).toPandas().sort_values("cell")  # a row a cell
    head = Mixer() if learned.empty else Mixer().set_cells(learned["value"].to_numpy())
    shared = spark.sparkContext.broadcast((tables.logit, tables.seen, head))

    def move_score(key: bytes) -> float:
        ways = {b"s": b"wge", b"w": b"ge", b"g": b"we"}[key[2:3]]
        n = [moves.get(MOVE + key[2:3] + bytes([w]), 0) + 0.5 for w in ways]
        return float(np.log10((moves.get(key, 0) + 0.5) / sum(n)))

    def score_bucket(table: pa.Table, carried: pa.Table | None) -> pa.Table:
        logit, seen, head = shared.value
        tables = object.__new__(Tables)
        tables.logit, tables.seen = logit, seen
        keys, n = byte_strings(table.column("key")), table.column("n_train").to_numpy().astype(float)
        score = np.zeros(len(keys))
        use = np.flatnonzero(np.array([is_coded(k) for k in keys], bool))
        if len(use):
            begin = None if carried is None else np.array(table.column("depth").to_pylist(), np.int64)[use]
            score[use] = score_keys([keys[i] for i in use], n[use], tables, head, begin)
            if carried is not None:
                more = dict(zip(carried.column("node").to_pylist(), carried.column("carried").to_pylist(), strict=True))
                for i, depth in zip(use[begin > HEAD].tolist(), begin[begin > HEAD].tolist(), strict=True):
                    score[i] += more[path_of(keys[i])[: 1 + depth]]
        for i, k in enumerate(keys):
            if k.startswith(MOVE):
                score[i] = move_score(k)
        return pa.table([table.column("key"), table.column("n_train"), table.column("n_all"), pa.array(np.log10((n + 0.5) / norm)), pa.array(score)], names=["key", "n_train", "n_all", "base", "score"])

    scored = stored(score_vocab(vocab, score_bucket, shared, n_keys))

    common = F.col("n_all") * FREQUENT >= all_tokens
    frequent = [(bytes(r["key"]), r["n_train"], r["base"], r["score"]) for r in scored.filter(common).collect()]  # at most FREQUENT rows
    rare_tokens = scored.filter(~common).agg(F.coalesce(F.sum("n_all"), F.lit(0))).first()[0]
    rare_buckets = max(8, -(-rare_tokens // BUCKET_TOKENS))
    partial = stored(source.mapInArrow(_sum_texts(frequent, rare_buckets, firsts), PARTIAL))
    rare = scored.filter(~common).withColumn("bucket", F.crc32("key") % rare_buckets)
    found = partial.filter("bucket >= 0").groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(_look_up, "batch long, at binary, sums binary")
    total = partial.filter("bucket < 0").groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    per_byte = F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", per_byte.alias("bits_per_byte"))
