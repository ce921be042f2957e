"""A vector index on disk: cells of near vectors, built once, found again by its manifest, searched exactly through few cells.

Vectors lie in the cell whose centre they are nearest to by angle, in a folder
for each batch and cell. A cell's radius is the largest angle of its vectors to
its centre; a query's similarity to any of them is at most the cosine of its
angle to the centre less that radius. The query's own cell is searched first, and
then those whose bound reaches what it has found, or the threshold: the answer is
that of a search of everything, and the other cells' files are not opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nearest import BLOCK, THRESHOLD, best_in_blocks, usable
from . import versions

#: Cells at most, vectors that centres are fitted on at most, rounds of the fit, its seed, blocks of a cell that meet a query in one task.
CELLS, SAMPLE, ROUNDS, SEED, SALTED = 4096, 20_000, 10, 5, 16
#: Rounding of angles and cosines that bounds allow for.
EPS = 1e-7


def _units(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Index:
    """An index as it was when it was opened; what is appended later, it does not see."""

    spark: SparkSession
    folder: str
    manifest: dict[str, Any]

    @property
    def carried(self) -> list[str]:
        return self.manifest["carried"]

    def items(self) -> DataFrame:
        """What the index holds: item_id, embedding, the carried columns and cell."""
        parts = [self.spark.read.parquet(f"{self.folder}/{path}") for name, path in self.manifest["tables"].items() if name.startswith("batch-")]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.select("item_id", "embedding", *self.carried, F.col("cell").cast("int").alias("cell"))

    def _cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, radii and numbers of vectors of the cells, CELLS at most."""
        centres = self.spark.read.parquet(f"{self.folder}/{self.manifest['tables']['centres']}").orderBy("cell").collect()
        stats = [self.spark.read.parquet(f"{self.folder}/{path}") for name, path in self.manifest["tables"].items() if name.startswith("stats-")]
        rows = stats[0]
        for part in stats[1:]:
            rows = rows.union(part)
        found = {r["cell"]: r for r in rows.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()}
        n = np.array([found[r["cell"]]["n"] if r["cell"] in found else 0 for r in centres])
        radius = np.array([found[r["cell"]]["radius"] if r["cell"] in found else 0.0 for r in centres])
        return np.array([r["centre"] for r in centres]).reshape(len(centres), -1), radius, n

    def append(self, items: DataFrame) -> Index:
        """The index with a batch more, as its next version; the cells' centres stay."""
        centres, _, _ = self._cells()
        tables = _write_batch(items, self.folder, centres, self.carried)
        found = {**self.manifest, "version": self.manifest["version"] + 1, "tables": {**self.manifest["tables"], **tables}}
        return replace(self, manifest=versions.commit(self.spark, self.folder, found))

    def search(self, queries: DataFrame, threshold: float = THRESHOLD, query_id: str = "query_id", vector: str = "embedding", apart: bool = False) -> DataFrame:
        """The nearest item of each query, as ``nearest_above`` gives it over all items: query_id, item_id, similarity.

        Ties go to the smaller id; null below the threshold. Queries that are null,
        zero, of another width or with a null or non-finite component are near
        nothing; ids are whole numbers, and a query id that occurs twice has two rows.
        """
        centres, radius, n = self._cells()
        asked = queries.select(F.col(query_id).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("vector"))
        asked = asked.where(F.col("query").isNotNull() & usable("vector") & (F.size("vector") == centres.shape[1])).distinct()
        first = self._nearest(_reached(asked, centres, radius, n, None, threshold), n, apart)
        seen = asked.join(first.select("query", F.col("_best.similarity").alias("least")), "query", "left")
        second = self._nearest(_reached(seen, centres, radius, n, "least", threshold), n, apart)
        best = first.union(second).groupBy(F.col("query").alias(query_id)).agg(F.max("_best").alias("_best"))
        hit = F.col("_best.similarity") >= threshold
        out = queries.select(query_id).join(best, query_id, "left")
        return out.select(query_id, F.when(hit, -F.col("_best.less")).alias("item_id"), F.when(hit, F.col("_best.similarity")).alias("similarity"))

    def _nearest(self, asked: DataFrame, n: np.ndarray, apart: bool) -> DataFrame:
        """The best item of (query, vector, cell) in those cells, whose files alone are read; large cells are dealt out by a salt."""
        cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # CELLS at most
        salts = {c: max(1, -(-int(n[c]) // (SALTED * BLOCK))) for c in cells}
        many = F.create_map(*[F.lit(x) for c in cells for x in (c, salts[c])])[F.col("cell")] if cells else F.lit(1)
        stored = self.items().where(F.col("cell").isin(cells)).select("cell", F.pmod(F.xxhash64("item_id"), many).cast("int").alias("salt"), F.col("item_id").alias("id"), F.col("embedding").alias("vector"))
        wanted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).select("cell", "salt", F.col("query").alias("id"), "vector")
        return best_in_blocks(_blocks(stored, "i").join(_blocks(wanted, "q"), ["cell", "salt"]), apart)


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Rows (cell, salt, id, vector) packed by cell and salt: cell, salt, {name}_ids, {name}_data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            for cell, salt in np.unique(key, axis=0).tolist():
                at = np.flatnonzero((key[:, 0] == cell) & (key[:, 1] == salt))
                for i in range(0, len(at), BLOCK):
                    part = batch.take(pa.array(at[i : i + BLOCK]))
                    ids, data = part.column(2).to_numpy().astype(np.int64), part.column(3).flatten().to_numpy().astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([salt], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["cell", "salt", f"{name}_ids", f"{name}_data"])

    return rows.repartition("cell", "salt").sortWithinPartitions("cell", "salt").mapInArrow(pack, f"cell int, salt int, {name}_ids binary, {name}_data binary")


def _reached(asked: DataFrame, centres: np.ndarray, radius: np.ndarray, n: np.ndarray, least: str | None, threshold: float) -> DataFrame:
    """(query, vector, cell): the nearest cell of each query, or with ``least`` all others that may hold a better item."""
    shared = asked.sparkSession.sparkContext.broadcast((centres, radius, n > 0))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, full = shared.value
        for batch in batches:
            angle = np.arccos(np.clip(_units(batch.column("vector")) @ centres.T, -1, 1))
            bound = np.where(full, np.cos(np.maximum(angle - radius - EPS, 0)), -np.inf)
            own = np.where(full, angle, np.inf).argmin(axis=1)
            if least is None:
                row, cell = np.arange(len(own)), own
                keep = bound[row, cell] >= threshold - EPS
            else:
                floor = np.maximum(np.nan_to_num(batch.column(least).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf), threshold)
                bound[np.arange(len(own)), own] = -np.inf
                row, cell = np.nonzero(bound >= floor[:, None] - EPS)
                keep = np.ones(len(row), bool)
            if keep.any():
                at = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays([batch.column("query").take(at), batch.column("vector").take(at), pa.array(cell[keep], pa.int32())], ["query", "vector", "cell"])

    return asked.mapInArrow(cells, "query long, vector array<double>, cell int")


def _write_batch(items: DataFrame, folder: str, centres: np.ndarray, carried: list[str]) -> dict[str, str]:
    """Writes the usable items into folders of their cells, and what each cell has got; returns the new tables' places."""
    spark, name = items.sparkSession, uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(centres)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"), *carried)
    rows = rows.where(F.col("item_id").isNotNull() & usable("embedding") & (F.size("embedding") == centres.shape[1]))
    schema = rows.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("angle")).schema

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _units(batch.column("embedding")) @ shared.value.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], schema.names)

    paths = {f"batch-{name}": f"data/batch-{name}", f"stats-{name}": f"data/stats-{name}"}
    rows.mapInArrow(placed, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/data/batch-{name}")
    written = spark.read.schema(schema).parquet(f"{folder}/data/batch-{name}")
    written.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).write.parquet(f"{folder}/data/stats-{name}")
    return paths


def open_index(spark: SparkSession, folder: str) -> Index:
    """The index of a folder, as its latest version."""
    found = versions.manifest(spark, folder)
    if found is None:
        raise ValueError(f"{folder} has no index")
    return Index(spark, folder, found)


def open_or_build(items: DataFrame, folder: str, carried: list[str] | None = None, cells: int | None = None) -> Index:
    """The folder's index; where it has none, one of the items (item_id, embedding and the ``carried`` columns) is built.

    Centres are fitted on SAMPLE items at most, drawn by their ids; every usable
    item is indexed: those without an id, null or zero, with a null or non-finite
    component or of another width than the first drawn are left out, as they are
    near nothing. Without a usable item there is no index, which is an error.
    """
    spark = items.sparkSession
    if versions.manifest(spark, folder) is not None:
        return open_index(spark, folder)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("item_id").isNotNull() & usable("vector"))
    order = [F.xxhash64("item_id"), F.col("item_id")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        raise ValueError("no item to build an index of")
    width = len(first[0]["vector"])
    total = rows.where(F.size("vector") == width).count()
    k = min(cells or int(total**0.5) or 1, CELLS, SAMPLE)
    sample = rows.where(F.size("vector") == width).orderBy(*order).limit(SAMPLE).select(array_to_vector("vector").alias("features"))
    fitted = KMeans(k=max(k, 2), distanceMeasure="cosine", initMode="random", maxIter=ROUNDS, seed=SEED).fit(sample) if total > 1 else None
    centres = np.array(fitted.clusterCenters() if fitted else [first[0]["vector"]], float)
    size = np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    centres = (centres / np.where(size > 0, size, 1))[size[:, 0] > 0]
    path = f"data/centres-{uuid.uuid4().hex}"
    spark.createDataFrame(list(enumerate(centres.tolist())), "cell int, centre array<double>").coalesce(1).write.parquet(f"{folder}/{path}")
    tables = {"centres": path, **_write_batch(items, folder, centres, carried or [])}
    found = versions.commit(spark, folder, {"version": 1, "width": width, "carried": carried or [], "tables": tables})
    return Index(spark, folder, found)
