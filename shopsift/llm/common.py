"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local
    master gets a folder of its own; a cluster without the setting is an error,
    since a machine-local folder would lose data there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = context._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="shopsift-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session may have ended first; the cluster's own retention applies then
            return

    atexit.register(remove)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from there: smaller on disk than a checkpoint."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold some 4 MB, whatever the rows' width, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return a worker's freed memory to the system, so that what follows in the process has it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def gather(values: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, the runs of ``values`` that begin at ``start``, one after another)."""
    ends = np.cumsum(lengths)
    small = np.int32 if len(values) < 2**31 and (len(ends) == 0 or ends[-1] < 2**31) else np.int64
    at = np.repeat((start - (ends - lengths)).astype(small), lengths)
    at += np.arange(len(at), dtype=small)
    return lengths, values[at]


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of the texts with about ``most`` bytes at most, or one text."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def byte_strings(values: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The values of a binary or string column without nulls; a slice of one buffer each costs less than Arrow's own list."""
    out = []
    for part in values.chunks if isinstance(values, pa.ChunkedArray) else [values]:
        part = part.cast(pa.large_binary())
        ends = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, 8 * part.offset) if len(part) else np.zeros(1, np.int64)
        raw = bytes(part.buffers()[2][int(ends[0]) : int(ends[-1])]) if ends[-1] > ends[0] else b""
        out += [raw[a:b] for a, b in itertools.pairwise((ends - ends[0]).tolist())]
    return out


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with state: ``make`` runs once a task and gives the function for each batch."""

    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)
        del step
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
