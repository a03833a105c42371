"""Several tables published together: all of a version's tables become readable at once, or none does.

A version is a folder with one table each for the inputs' snapshot and the
outputs. Outputs are computed from the snapshot as written, so all see the same
rows however long the job takes or however often a task runs again. The commit
point is one small manifest, named by the version's number and made by a rename
that fails where the name is taken; readers list the manifests and resolve table
names through the latest. What a failed attempt wrote is never named by one.
(On a store without atomic renames, keep the manifests on one that has them.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import hadoop


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the published versions, ascending."""
    fs, folder = hadoop(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The tables of a version, the latest by default, by name."""
    if version is None:
        known = versions(spark, root)
        if not known:
            raise LookupError(f"nothing is published at {root}")
        version = known[-1]
    return json.loads("".join(r.value for r in spark.read.text(f"{root}/manifests/{version}.json").collect()))  # one small file


def read_published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the latest by default."""
    return spark.read.parquet(manifest(spark, root, version)["tables"][name])


def publish(spark: SparkSession, root: str, inputs: dict[str, DataFrame], build: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> int:
    """Snapshot ``inputs``, write the tables that ``build`` makes of them, commit them together; returns the version.

    Where another writer has committed since this one began, it fails and nothing
    changes, since the inputs may be out of date.
    """
    began = versions(spark, root)
    number = began[-1] + 1 if began else 1
    folder = f"{root}/data/{number}-{uuid.uuid4().hex}"
    snapshot = {}
    for name, df in inputs.items():
        path = f"{folder}/input-{name}"
        df.write.parquet(path)
        snapshot[name] = spark.read.schema(df.schema).parquet(path)
    tables = {}
    for name, df in build(snapshot).items():
        tables[name] = f"{folder}/{name}"
        df.write.parquet(tables[name])
    _commit(spark, root, number, {"version": number, "tables": tables})
    return number


def _commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    fs, target = hadoop(spark, f"{root}/manifests/{number}.json")
    _, draft = hadoop(spark, f"{root}/manifests/.{number}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} is published already; begin again from it")


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all versions but the last ``keep`` and what failed attempts before those left; returns the versions that went.

    Manifests go first, so a version is readable as long as it is listed. Readers
    of an old version should be done by then.
    """
    known = versions(spark, root)
    gone, left = known[: max(0, len(known) - keep)], known[max(0, len(known) - keep) :]
    if not left:
        return []
    named = {path for v in left for path in manifest(spark, root, v)["tables"].values()}
    for v in gone:
        fs, target = hadoop(spark, f"{root}/manifests/{v}.json")
        fs.delete(target, False)
    fs, data = hadoop(spark, f"{root}/data")
    for status in fs.listStatus(data):
        name = status.getPath().getName()
        # Folders of later numbers may be those of a writer that is at work.
        if int(name.split("-")[0]) <= left[-1] and not any(f"/{name}/" in path for path in named):
            fs.delete(status.getPath(), True)
    return gone
