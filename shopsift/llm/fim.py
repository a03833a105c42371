"""Fill-in-the-middle: texts cut at two unit boundaries and put together again in another order.

A unit is a run of other characters with the ASCII white space before it, or a
run of white space at the end. The tokenizers library's ``Split`` pre-tokenizer
isolates the units and tells their code-point offsets; nothing is trained. The
number of offsets is n, and the offset with the rank that a hash of the id picks
is where the prefix or the middle ends. Only the text goes to Python and only
three numbers come back; pieces, output and the way back are built-in functions.

Texts are split in steps of some ``STEP`` code points, each up to the next start
of white space, where a unit begins in any case; so memory beyond the text is
bounded and the time follows the length (a unit itself is never cut).

Defined results: null counts as the empty text, which is plain with n = 0; a
null id is hashed as the empty string; rows that repeat an id are cut by the
same hash, each in its own text; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import bounded_batches

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What marks prefix, suffix and middle; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
STEP = 1 << 16
_BORDER = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]")


def splitter() -> Split:
    return Split(Regex(UNIT), behavior="isolated")


def unit_ends(split: Split, text: str) -> np.ndarray:
    """The code-point offset at which each unit ends."""
    ends, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        border = _BORDER.search(text, at + STEP)
        stop = border.start() + 1 if border else len(text)
        ends.append(at + np.array([end for _, (_, end) in split.pre_tokenize_str(text[at:stop])], np.int64))
        at = stop
    return np.concatenate(ends)


def _cuts() -> Column:
    """An Arrow function of (text, a, b): n, and where prefix and middle end by the ranks ``a % (n + 1)`` and ``b % (n + 1)``."""
    kind = pa.struct([("n", pa.int64()), ("prefix_end", pa.int64()), ("middle_end", pa.int64())])

    def cut(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        split = splitter()
        for texts, first, second in columns:
            out = np.zeros((3, len(texts)), np.int64)
            for i, (text, a, b) in enumerate(zip(texts, first.to_pylist(), second.to_pylist(), strict=True)):
                ends = unit_ends(split, text.as_py())
                offsets = np.concatenate([[0], ends])
                ranks = sorted((a % len(offsets), b % len(offsets)))
                out[:, i] = len(ends), *offsets[ranks]
            yield pa.StructArray.from_arrays([pa.array(x) for x in out], fields=list(kind))

    cut.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    # Else the optimizer would split the text once for each use of the result.
    return F.arrow_udf(cut, "n long, prefix_end long, middle_end long").asNondeterministic()


def hash_numbers(seed: int, id_text: Column) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row an input row: doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``rate`` of 100 texts are transformed, and of those ``spm`` of 100 have the
    suffix first. Lengths are in code points, null for plain texts.
    """
    bounded_batches(docs.sparkSession)
    h = [f"h{k}" for k in range(1, 5)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(k) for k, c in zip(h, hash_numbers(seed, F.col(id_col).cast("string")), strict=True)])
    rows = rows.select("doc_id", "text", "h3", "h4", _cuts()("text", "h1", "h2").alias("cut")).select("doc_id", "text", "h3", "h4", "cut.*")
    text = F.col("text")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    start, end = F.col("prefix_end").cast("int"), F.col("middle_end").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), start), F.substring(text, start + 1, end - start), F.substring(text, end + 1, F.char_length(text))
    rows = rows.withColumn("form", form)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm_)
    moved = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form", F.when(moved, F.col("prefix_end")).alias("prefix_chars"), F.when(moved, F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text before :func:`fill_in_middle`, from its output and form; texts that hold marks are plain, so each mark stands once."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring(F.substring_index(head, SUFFIX, 1), len(PREFIX) + 1, 2**31 - 1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring(F.substring_index(head, PREFIX, 1), len(SUFFIX) + 1, 2**31 - 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest_columns(found: DataFrame) -> DataFrame:
    """The rows of :func:`fill_in_middle` with digests of output and restored text in place of the output."""
    out = F.col("output")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(out, 256).alias("output_sha256"), F.sha2(restored(out, F.col("form")), 256).alias("restored_sha256"))
