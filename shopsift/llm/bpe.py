"""Byte-level BPE encoding and decoding with the tokenizers library.

The merge rules come from a table of ranks: a pair of tokens merges when its
concatenation has a rank, lowest rank first. Texts arrive in Arrow batches. The
pattern never joins characters across a boundary between a non-space and a
following white-space character other than by one leading blank, so texts are
cut there, and the library encodes each distinct piece of some 16 MB of texts
once, and not at all if the worker process saw it in its last texts. This gives
the library's ids at a fraction of its cost.

Decoding reverses the byte table (each byte has a printable character of its
own in the vocabulary) and joins bytes before it decodes UTF-8, so characters
split over tokens come out whole; offsets tell for each token its bytes and the
characters they touch.

Defined results: a null text is empty; an empty text has no ids; repeated rows
give repeated results; ids outside the vocabulary raise an error.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .common import byte_strings, gather, give_back, per_batch, slices, texts_of

#: Unicode's White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Texts with one of these are cut by ``PIECES``; others have single blanks and line feeds between words, and no other white space.
ODD = f"[\x01\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|^$|^[ \n]|[ \n]$|[ \n][ \n]"
#: Letters that every Unicode version since 6 has: Latin, Greek, Cyrillic, Arabic, kana, Han, Hangul.
LETTERS = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03f5\u0400-\u0481\u048a-\u0523\u0620-\u064a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+[!-/:-@\\[-`{-~]*$"
CLOSING = "[!-/:-@\\[-`{-~]+$"
GROUP_BYTES = 16_000_000  # of texts whose distinct pieces are encoded together
KNOWN, KNOWN_BYTES = 600_000, 64  # pieces whose ids an encoder remembers, those of the last texts, and the bytes of one at most
TRIP_BYTES, TRIP_KNOWN = 1_000_000, 200_000  # the same of a round trip, whose workers stand beside whatever the executor holds


@functools.cache
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A tokenizers library BPE that merges by rank of the concatenation.

    Every way to split a token into two tokens is a merge; splits of a token
    with a lower rank come first.
    """
    table = byte_alphabet()
    as_text = {t: "".join(table[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((as_text[token[:i]], as_text[token[i:]]))
    vocab = {as_text[t]: r for t, r in ranks.items()}
    out = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return out


@functools.cache
def load_ranks_tokenizer(path: str, pattern: str) -> Tokenizer:
    return tokenizer_from_ranks(read_ranks(path), pattern)


@functools.cache
def load_json_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class PieceEncoder:
    """Ids of whole texts by the library, each distinct piece of a batch encoded once.

    Arrow cuts the texts and numbers the distinct pieces. Those of letters of
    long-settled scripts, also with closing punctuation, go to the library's
    model as byte-alphabet strings, many in one call with bytes between them that
    UTF-8 never has and that no merge takes; all others go through the library's
    own pre-tokenizer. Texts that hold an added token go to the library whole.
    The ids of the pieces seen last are remembered; they are the same in any text.
    """

    def __init__(self, tokenizer: Tokenizer, most: int | None = None):
        self.tokenizer = tokenizer
        self.most = most  # pieces that are remembered; None: KNOWN
        self.alphabet = dict(byte_alphabet())
        self.letters = Tokenizer(tokenizer.model)
        joined = Counter(itertools.chain.from_iterable(map(set, tokenizer.get_vocab())))
        never = [c for b in (0xFF, 0xFE, 0xC0, 0xC1, *range(0xF5, 0xFE)) if joined[c := self.alphabet[b]] == 1]
        if len(never) < 2:
            raise ValueError("the vocabulary merges bytes that UTF-8 never has")
        self.between, self.within = never[:2]
        self.between_id, self.within_id = map(tokenizer.token_to_id, never[:2])
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.known = (pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4"))  # pieces, lengths, ids

    def _letters(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of pieces of letters and closing punctuation, a NUL between the two."""
        lengths, found, raw = [], [], byte_strings(pieces)
        for lo in range(0, len(pieces), 128):
            joined = b"\n".join(raw[lo : lo + 128]).decode("latin-1").translate(self.alphabet)
            mapped = joined.replace(self.alphabet[10], self.between).replace(self.alphabet[0], self.within)
            ids = np.array(self.letters.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            ids = ids[ids != self.within_id]
            stops = np.flatnonzero(ids == self.between_id)
            lengths.append(np.diff(stops, prepend=-1, append=len(ids)) - 1)
            found.append(np.delete(ids, stops))
        return (np.concatenate(lengths), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def _others(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lengths, found = [], []
        for lo in range(0, len(pieces), 1024):
            part = pieces.slice(lo, 1024).to_pylist()
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            lengths.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
            found.append(np.array(got.ids, "<u4"))
        return (np.concatenate(lengths), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def _remembered(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """:func:`_distinct`, but of pieces that are not known only; those seen last are known from then on."""
        known, size, ids = self.known
        if 8 * len(pieces) < len(known):  # the look-up would cost more than it saves
            return self._distinct(pieces)
        at = pc.index_in(pieces, value_set=known).fill_null(-1).to_numpy()
        new = np.flatnonzero(at < 0)
        more_size, more_ids = self._distinct(pieces.take(pa.array(new)))
        both_size, both_ids = np.concatenate([size, more_size]), np.concatenate([ids, more_ids])
        both_start = np.cumsum(both_size) - both_size
        place = at.astype(np.int64)
        place[new] = len(known) + np.arange(len(new))
        lengths, found = gather(both_ids, both_start[place], both_size[place])

        most = KNOWN if self.most is None else self.most
        short = np.flatnonzero(np.asarray(pc.binary_length(pieces)) <= KNOWN_BYTES)[:most]
        older = np.ones(len(known), bool)
        older[at[at >= 0]] = False
        older = np.flatnonzero(older)[: most - len(short)]
        kept = np.concatenate([place[short], older])
        names = pa.concat_arrays([pieces.take(pa.array(short)), known.take(pa.array(older))])
        self.known = (names, *gather(both_ids, both_start[kept], both_size[kept]))
        return lengths, found

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of each of the distinct pieces, in order."""
        plain = pc.match_substring_regex(pieces, LETTERS)
        rows = np.asarray(plain)
        parts = [self._letters(pc.replace_substring_regex(pieces.filter(plain), CLOSING, "\x00\\0")), self._others(pieces.filter(pc.invert(plain)))]
        order = np.concatenate([np.flatnonzero(rows), np.flatnonzero(~rows)])
        lengths = np.concatenate([n for n, _ in parts])
        start = np.cumsum(lengths) - lengths
        back = np.argsort(order)
        return gather(np.concatenate([i for _, i in parts]), start[back], lengths[back])

    @staticmethod
    def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts' pieces, which are encoded independently, and how many each has.

        A piece is a word with one leading blank, or white space.
        """
        plain = pc.invert(pc.match_substring_regex(texts, ODD))
        some = pc.replace_substring(pc.replace_substring(texts.filter(plain), " ", "\x01 "), "\n", "\x01\n\x01")
        words = pc.split_pattern(some, "\x01")
        use = np.asarray(plain)
        many = np.zeros(len(texts), np.int64)
        many[use] = np.asarray(pc.list_value_length(words))
        if use.all():
            return words.flatten(), many
        rest = [PIECES.findall(t) for t in texts.filter(pc.invert(plain)).to_pylist()]
        many[~use] = [len(r) for r in rest]
        both = pa.concat_arrays([words.flatten(), pa.array(itertools.chain.from_iterable(rest), pa.string())])
        first = np.zeros(len(texts), np.int64)
        first[use] = np.cumsum(many[use]) - many[use]
        first[~use] = many[use].sum() + np.cumsum(many[~use]) - many[~use]
        place = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        return both.take(pa.array(place)), many

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, all ids) of texts without nulls."""
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for part in slices(texts, GROUP_BYTES):
            whole = np.zeros(len(part), bool)
            for token in self.added:
                whole |= np.asarray(pc.match_substring(part, token))
            if whole.any():  # one by one: an added token is not known beforehand to stand at a piece's border
                for text, odd in zip(part, whole.tolist(), strict=True):
                    n, own = (None, np.array(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, "<u4")) if odd else self._encode(pa.array([text]))
                    lengths.append(np.array([len(own)]))
                    ids.append(own)
                continue
            n, own = self._encode(part)
            lengths.append(n)
            ids.append(own)
        return np.concatenate(lengths), np.concatenate(ids)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, many = self.cut(texts)
        numbered = pieces.dictionary_encode()
        size, ids = self._remembered(numbered.dictionary)
        start, at = np.cumsum(size) - size, np.asarray(numbered.indices)
        size_of, ids = gather(ids, start[at], size[at])
        total = np.concatenate([[0], np.cumsum(size_of)])
        return np.diff(total[np.concatenate([[0], np.cumsum(many)])]), ids


@functools.cache
def worker_encoder(path: str, pattern: str | None = None, most: int | None = None) -> PieceEncoder:
    """The encoder of a worker process, which its tasks share."""
    return PieceEncoder(load_ranks_tokenizer(path, pattern) if pattern else load_json_tokenizer(path), most)


def as_lists(many: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    """Each text's ids as a list."""
    ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view("<i4")))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, n_bytes: each whole text by the ranks at ``path``."""
    source = texts_of(docs, id_col, text_col)

    def make():
        encoder = worker_encoder(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = as_lists(*encoder.encode(batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), ids, pc.binary_length(batch.column(1)).cast(pa.int64())], names=["doc_id", "ids", "n_bytes"])

        return step

    return per_batch(source, make, f"doc_id {dict(source.dtypes)['doc_id']}, ids array<int>, n_bytes long")


@functools.cache
def token_table(path: str) -> list[bytes]:
    """The bytes of each id, by reversing the byte alphabet over the library's vocabulary."""
    reverse = {c: b for b, c in byte_alphabet().items()}
    vocab = {"".join(byte_alphabet()[b] for b in t): r for t, r in read_ranks(path).items()}
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(reverse[c] for c in token)
    return table


def offsets(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of these byte lengths over UTF-8 ``data``: byte ends, first character and end character of each.

    A character that is split over tokens belongs to each of them.
    """
    ends = np.cumsum(lengths)
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    # The character that a byte belongs to is the one whose lead byte came last.
    first = np.maximum(lead[np.minimum(ends - lengths + 1, len(data))] - 1, 0)
    return ends, first, lead[ends]


def decoded(ids: pa.ListArray, table: list[bytes], length: np.ndarray) -> Iterator[tuple[np.ndarray, bytes, int, int]]:
    """For each list of ids: the ids, their bytes, the characters and how many characters are split over tokens."""
    flat, cuts = ids.flatten().to_numpy(zero_copy_only=False), np.asarray(ids.offsets) - ids.offsets[0].as_py()
    for lo, hi in itertools.pairwise(cuts.tolist()):
        own = flat[lo:hi]
        raw = b"".join(map(table.__getitem__, own.tolist()))
        _, first, end = offsets(raw, length[own])
        # A token that begins within a character shares it with the token before.
        yield own, raw, int(end[-1]) if hi > lo else 0, len(np.unique(first[1:][first[1:] < end[:-1]]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data (the decoded bytes), text (null where they are not UTF-8), n_chars, n_split of (doc_id, ids).

    ``n_split`` counts the characters that are split over tokens.
    """

    def make():
        table = token_table(path)
        length = np.array([len(t) for t in table], np.int64)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, data, chars, split = zip(*decoded(batch.column(1), table, length), strict=True)
            texts = [raw.decode() if _is_utf8(raw) else None for raw in data]
            types = (pa.binary(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (data, texts, chars, split), types)], names=["doc_id", "data", "text", "n_chars", "n_split"])

        return step

    id_type = dict(encoded.dtypes)["doc_id"]
    return per_batch(encoded.select("doc_id", "ids"), make, f"doc_id {id_type}, data binary, text string, n_chars long, n_split long")


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars, n_split: encode, then decode the ids.

    One worker does both, so a task has one Python process. It takes
    ``TRIP_BYTES`` of texts, or one text, at a time, and gives back the memory
    that encoding them took before it decodes.
    """
    source = texts_of(docs)

    def make():
        encoder, table = worker_encoder(path, pattern, TRIP_KNOWN), token_table(path)
        number = [str(i) for i in range(len(table))]
        length = np.array([len(t) for t in table], np.int64)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for texts in slices(batch.column(1), TRIP_BYTES):
                ids = as_lists(*encoder.encode(texts))
                give_back()
                rows += [
                    (len(own), hashlib.sha256(" ".join(map(number.__getitem__, own.tolist())).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), chars, split)
                    for own, raw, chars, split in decoded(ids, table, length)
                ]
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True), types)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars", "n_split"])

        return step

    id_type = dict(source.dtypes)["doc_id"]
    return per_batch(source, make, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long, n_split long")
