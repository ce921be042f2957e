"""Tables as Parquet: the catalogue's schemas, snapshots that appear at once, and a store that upgrades itself."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import versions

SCHEMAS = {
    "songs": "id long, title string, artist string, chart_written_key string, sounding_key string, original_key string, preferred_key string, default_capo int, bpm int, genre string, feel string, era string, tempo_feel string, beatbuddy_structure string, chart_content string, source_file string, cloud_provider string, cloud_file_id string, ai_confidence double, imported_at timestamp, synced_at timestamp, user_edited_at timestamp, edited_offline boolean",
    "tags": "id long, name string, category string, created_at timestamp",
    "song_tags": "song_id long, tag_id long",
    "setlists": "id long, name string, gig_date date, notes string, created_at timestamp, updated_at timestamp",
    "setlist_songs": "id long, setlist_id long, song_id long, position int, transposed_key string, capo_fret int, sounding_key string, notes string",
    "import_log": "id long, source_file string, song_id long, status string, message string, imported_at timestamp",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; those of the catalogue have a fixed schema."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def open_catalogue(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of one version, the latest if none is named; those that have not been written are empty.

    What has been opened stays readable while newer versions are written.
    """
    found = versions.manifest(spark, folder, version)
    if version is not None and found is None:
        raise ValueError(f"{folder} has no version {version}")
    there = found["tables"] if found else {}
    return {n: spark.read.schema(kind).parquet(f"{folder}/{there[n]}") if n in there else empty_table(spark, n) for n, kind in SCHEMAS.items()}


def write_snapshot(tables: dict[str, DataFrame], folder: str, **more: Any) -> int:
    """Writes tables as the folder's next version and returns its number; tables that are not named stay as they were.

    All are written before the version appears. A write that fails leaves the
    version before, and one that another writer has overtaken raises ``Conflict``.
    ``more`` goes into the manifest.
    """
    spark = next(iter(tables.values())).sparkSession
    before = versions.manifest(spark, folder) or {"version": 0, "tables": {}}
    paths = dict(before["tables"])
    for name, rows in tables.items():
        paths[name] = f"data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{folder}/{paths[name]}")
    return versions.commit(spark, folder, {**before, **more, "version": before["version"] + 1, "tables": paths})["version"]


#: A step from one schema to the next: takes all tables by name, returns those it makes or changes, None for those it drops.
Upgrade = Callable[[dict[str, DataFrame]], dict[str, DataFrame | None]]


def open_store(spark: SparkSession, folder: str, upgrades: Sequence[Upgrade]) -> dict[str, DataFrame]:
    """The tables of a store at the schema that ``upgrades`` lead to.

    The store remembers how many steps it has taken; those it lacks are taken
    in order on opening, and their tables appear together as one version. A store
    that has taken more steps than are known is refused.
    """
    stored = lambda: {n: spark.read.parquet(f"{folder}/{path}") for n, path in found["tables"].items()}
    found = versions.manifest(spark, folder) or {"version": 0, "tables": {}}
    taken = found.get("schema", 0)
    if taken > len(upgrades):
        raise ValueError(f"{folder} has schema {taken}, newer than {len(upgrades)}")
    if taken < len(upgrades):
        tables, changed = stored(), {}
        for step in upgrades[taken:]:
            made = step(tables)
            changed |= made
            tables = {n: t for n, t in (tables | made).items() if t is not None}
        paths = {n: p for n, p in found["tables"].items() if n in tables}
        for name in changed.keys() & tables.keys():
            paths[name] = f"data/{name}-{uuid.uuid4().hex}"
            tables[name].write.parquet(f"{folder}/{paths[name]}")
        found = versions.commit(spark, folder, {**found, "version": found["version"] + 1, "schema": len(upgrades), "tables": paths})
    return stored()


def append_log(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(f"{folder}/import_log.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder all executors share (``spark.checkpoint.dir``); where that is unset and Spark runs in one process, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def first_row(rows: DataFrame):
    """The first row as a dict, or None."""
    found = rows.limit(1).collect()
    return found[0].asDict() if found else None
