"""Spelling variants: near words found by wildcard groups, each led to its more frequent form.

Words are runs of letters, counted over all texts. Two words are near if one
code point is inserted, deleted or replaced. A word of L code points stands in L
wildcard groups: the group (position, prefix, suffix) holds the words that have
exactly one code point between that prefix and that suffix. Of each group only
its size and its two most frequent words count: every member has size - 1 near
words there, the best of them being the first, or the second for the first
itself. Prefix and suffix alone make the word that a member becomes by the
deletion of that code point: deletions meet the vocabulary under the same key,
once for each distinct deletion (a run of one letter is deleted from at its
start). Counts add up and best words combine, so no pair is ever made. A group
holds a member for each letter there is, ``LETTERS`` of them at most, whatever
the corpus.

A key is prefix and suffix themselves up to ``RAW`` bytes, beyond that a digest
of either, made along the word, and a word of more bytes is known by its digest;
so a word of any length takes rows and time in proportion to its length.
Occurrences combine before they are shuffled; a word that a third of all rows
share costs a row a task.

Links from words to forms go up in frequency by at least ``RATIO``, so a chain
is as long as the logarithm of the largest count; roots are found by doubling
the links' reach.

Defined results: null and empty texts have no words; a null id is hashed as the
empty string; repeated rows count each time; of equally frequent near words the
smallest in code-point order is the best; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, stored

RUN = re.compile("[A-Za-z\\u00C0-\\u00FF]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Distinct words that a task counts before it hands them on.
AT_ONCE = 200_000
#: Letters that a word can hold: a to z and 64 of Latin-1.
LETTERS = 90
RATIO = 2
#: Bytes of prefix and suffix that are a key themselves; a letter adds two at most. No UTF-8 text holds the marks.
RAW = 64
GAP, LONG = b"\xff", b"\xfe"
HALF = 12
SLOTS = "word_id binary, n long, slot binary, letter string, first boolean"


def with_gap(run: str, start: int) -> str:
    """The run without one code point where 97 divides its CRC-32 going on from ``start``, else the run."""
    h = zlib.crc32(run.encode(), start)
    if h % 97:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def _words(least_points: int):
    """(word, n) of the words of batches (id, text), counted within a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = Counter(RUN.findall(text.as_py().encode().translate(LOWER).decode()))
                start = zlib.crc32(f"{own}:".encode())
                for run, n in runs.items():
                    if len(run) >= least_points and len(word := with_gap(run, start)) >= least_points:
                        counts[word] += n
                if len(counts) >= AT_ONCE:
                    yield _table(counts)
        yield _table(counts)

    return count


def _table(counts: Counter[str]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
    counts.clear()
    return out


def vocabulary(docs: DataFrame, least_points: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word_id, word, n) of the words with enough code points and occurrences in all texts."""
    bounded_batches(docs.sparkSession)
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    words = texts.mapInArrow(_words(least_points), "word string, n long")
    counted = words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    digest = F.concat(F.lit(LONG), F.unhex(F.sha2("word", 256)))
    return counted.select(F.when(F.octet_length("word") > RAW + 2, digest).otherwise(F.col("word").cast("binary")).alias("word_id"), "word", "n")


def _halves(letters: list[bytes]) -> list[bytes]:
    """The digest of the first 0, 1, ... of the ``letters``."""
    running, out = hashlib.blake2b(digest_size=HALF), []
    out.append(running.digest())
    for letter in letters:
        running.update(letter + b"\0")
        out.append(running.digest())
    return out


def _places(word_id: bytes, word: str, n: int) -> Iterator[tuple]:
    """A word's places with one code point taken out, then those with none (``letter`` null)."""
    letters = [c.encode() for c in word]
    ends, whole = [0, *accumulate(map(len, letters))], word.encode()
    before, after = (_halves(letters), _halves(letters[::-1])[::-1]) if len(whole) > RAW else ([], [])

    def key(i: int, j: int) -> bytes:
        if ends[i] + ends[-1] - ends[j] <= RAW:
            return whole[: ends[i]] + GAP + whole[ends[j] :]
        return LONG + before[i] + after[j]

    for i, c in enumerate(word):
        yield word_id, n, key(i, i + 1), c, i == 0 or word[i - 1] != c
    for i in range(len(word) + 1):
        yield word_id, n, key(i, i), None, False


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.bool_())
    for batch in batches:
        places = chain.from_iterable(map(_places, *(batch.column(c).to_pylist() for c in ("word_id", "word", "n"))))
        while rows := list(islice(places, 50_000)):
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows, strict=True), kinds)], names=[c.split()[0] for c in SLOTS.split(", ")])


def near_words(words: DataFrame) -> DataFrame:
    """(word_id, n_near, best_n, best, best_id): how many near words each word has that has any, and the best of them; from (word_id, word, n)."""
    bounded_batches(words.sparkSession)
    slots = words.mapInArrow(_slots, SLOTS).select("word_id", "slot", "first", "letter", (-F.col("n")).alias("less"))
    # A group is LETTERS members at most, most frequent first and then in the order of their letters, and one word without a letter there.
    group = Window.partitionBy("slot").orderBy(F.col("letter").isNull(), "less", "letter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.col("letter").isNotNull()
    row = F.struct("less", "word_id")
    rows = slots.select(
        "word_id", "first", member.alias("member"), F.count("letter").over(group).alias("size"), F.first(row).over(group).alias("top"), F.nth_value(row, 2).over(group).alias("second"),
        F.max(F.when(~member, row)).over(group).alias("short"), F.count_if("first").over(group).alias("longer"), F.min(F.when(F.col("first"), F.struct("less", "letter", "word_id"))).over(group).alias("longest"),
    )
    other = F.when(F.col("word_id") == F.col("top.word_id"), F.col("second")).otherwise(F.col("top"))
    near = lambda n, best: F.struct(n.cast("long").alias("near"), best["less"].alias("less"), best["word_id"].alias("best_id"))
    replaced = F.when(F.col("member") & (F.col("size") > 1), near(F.col("size") - 1, other))
    deleted = F.when(F.col("first") & F.col("short").isNotNull(), near(F.lit(1), F.col("short")))
    inserted = F.when(~F.col("member") & (F.col("longer") > 0), near(F.col("longer"), F.col("longest")))
    found = rows.select("word_id", F.inline(F.array_compact(F.array(replaced, deleted, inserted))))
    # Equally frequent candidates of several groups are told apart by the words themselves.
    long = words.filter(F.octet_length("word") > RAW + 2).select(F.col("word_id").alias("best_id"), F.col("word").alias("long"))
    named = found.join(long, "best_id", "left").withColumn("best", F.coalesce("long", F.col("best_id").cast("string")))
    best = named.groupBy("word_id").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "best", "best_id")).alias("b"))
    return best.select("word_id", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"), F.col("b.best_id").alias("best_id"))


def roots(links: DataFrame) -> DataFrame:
    """(word_id, root): where the chain of forms ends, for each row of ``links`` (word_id, to, root), the word of ``to`` being its ``root`` so far.

    Each round doubles the reach of every link, until none moves.
    """
    links = cut(links)
    while True:
        ahead = links.select(F.col("word_id").alias("to"), F.col("to").alias("__to"), F.col("root").alias("__root"))
        moved = F.col("__to").isNotNull()
        links = cut(links.join(ahead, "to", "left").select("word_id", F.when(moved, F.col("__to")).otherwise(F.col("to")).alias("to"), F.when(moved, F.col("__root")).otherwise(F.col("root")).alias("root"), moved.alias("moved")))
        if links.filter("moved").isEmpty():
            return links.select("word_id", "root")
        links = links.drop("moved")


def spelling_variants(docs: DataFrame, least_points: int = 5, least_count: int = 3, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    A word's form is the best of its near words if that is at least ``ratio``
    times as frequent, else null; its root is where forms lead in the end.
    """
    if ratio < 2:
        raise ValueError("forms are at least twice as frequent as their variants, so that chains end")
    words = stored(vocabulary(docs, least_points, least_count, id_col, text_col), "words")
    near = stored(near_words(words), "near")
    both = words.join(near, "word_id", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    rows = both.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"), F.when(formed, F.col("best_id")).alias("to"))
    ends = roots(rows.filter("to IS NOT NULL").select("word_id", "to", F.col("form").alias("root")))
    return rows.join(ends, "word_id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
