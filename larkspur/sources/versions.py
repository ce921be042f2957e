"""Versions of a set of tables: data folders that are written whole, and a manifest for each version that names them.

A manifest appears by one rename, so a reader sees all tables of one version or
of the one before, and a write that fails on the way leaves nothing to be seen.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import SparkSession

_FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions that can be read, in ascending order."""
    at, fs = _at(spark, f"{root}/{_FOLDER}")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, Any] | None:
    """The manifest of a version, else of the latest; None if there is none."""
    known = numbers(spark, root)
    if not known or (version is not None and version not in known):
        return None
    path = f"{root}/{_FOLDER}/v{known[-1] if version is None else version}.json"
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def commit(spark: SparkSession, root: str, found: dict[str, Any]) -> dict[str, Any]:
    """Makes the manifest the version it names, if nobody else has made one."""
    final, fs = _at(spark, f"{root}/{_FOLDER}/v{found['version']}.json")
    draft, _ = _at(spark, f"{root}/{_FOLDER}/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    options = jvm.org.apache.hadoop.fs.Options.Rename
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, final, gateway.new_array(options, 0))  # fails where the version is there already
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(final):
            raise Conflict(f"version {found['version']} of {root} is there already") from e
        raise
    return found


def expire(spark: SparkSession, root: str, keep: int, unnamed_after: float = 86_400.0) -> list[int]:
    """Deletes all but the last ``keep`` versions and the data that only they name; returns their numbers.

    Data that no version names, which a failed write leaves, goes when it is
    older than ``unnamed_after`` seconds: a younger folder may be of a write under way.
    """
    known = numbers(spark, root)
    gone, kept = known[: max(len(known) - keep, 0)], known[max(len(known) - keep, 0) :]
    named = lambda n: {path.split("/")[1] for path in manifest(spark, root, n)["tables"].values()}
    old = set().union(*map(named, gone))
    live = set().union(*map(named, kept))
    for n in gone:
        at, fs = _at(spark, f"{root}/{_FOLDER}/v{n}.json")
        fs.delete(at, False)
    at, fs = _at(spark, f"{root}/data")
    for status in fs.listStatus(at) if fs.exists(at) else ():
        name = status.getPath().getName()
        if name not in live and (name in old or time.time() - status.getModificationTime() / 1000 > unnamed_after):
            fs.delete(status.getPath(), True)
    return gone
