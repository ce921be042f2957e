"""Ball k-means on whole-number vectors: exact Lloyd rounds that compare a vector only with centroids that could be nearer.

A cluster is a ball: its centroid, and a radius that no member is beyond. Another
centroid is its neighbour if it lies within twice the radius; no member can be
nearer to any other. The neighbours, sorted by distance, cut the ball into a
stable core, whose members are nearer to their centroid than half the way to the
nearest neighbour and stay without a comparison, and annuli: a member of the t-th
annulus is compared with the first t neighbours alone. All distances are squared
integers, so the assignments are those of a full search, ties included.

Vectors lie in blocks of a bucketed table. In each round the blocks stay where
they are; the members' clusters of the last round, a byte or two for each vector,
come to them, and each block returns new ones and its sums. Sums are added up by
component, so the driver gets numbers in proportion to the centroids only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, stage, unstage
from .vectors import columns_of, finite, in_reach, scaled_blocks

CLUSTERS, ROUNDS, WIDTH, SEED = 8, 10, 64, 3
#: Vectors of a block.
BLOCK = 4096


class Balls:
    """Centroids with their neighbours in ascending order of distance."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray):
        self.centres = centres
        gap = np.array([squared(centres, c) for c in centres]).reshape(len(centres), len(centres))
        self.near = []
        for j in range(len(centres)):
            order = np.lexsort((np.arange(len(centres)), gap[j]))
            reach = (2 * radius[j]) ** 2
            self.near.append([(int(i), int(gap[j, i])) for i in order if i != j and gap[j, i] <= reach])

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (a tie goes to the smaller number), its squared distance, and how many distances were taken."""
        cluster, distance, taken = own.astype(np.int64), np.zeros(len(x), np.int64), len(x)
        for j in np.unique(own):
            rows = np.flatnonzero(own == j)
            mine = squared(x[rows], self.centres[j])
            least, to = mine.copy(), np.full(len(rows), j)
            for i, gap in self.near[j]:
                ring = np.flatnonzero(mine >= -(-gap // 4))  # half the way to this neighbour or further out
                if not len(ring):
                    break
                other = squared(x[rows[ring]], self.centres[i])
                taken += len(ring)
                nearer = (other < least[ring]) | ((other == least[ring]) & (i < to[ring]))
                least[ring[nearer]], to[ring[nearer]] = other[nearer], i
            cluster[rows], distance[rows] = to, least
        return cluster, distance, taken


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to an integer point."""
    x = x - point
    return np.einsum("nd,nd->n", x, x)


def _long(total: int | None) -> int | None:
    return total if total is not None and total < 1 << 63 else None


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of ``width`` components, none null or non-finite, as
    floor(1024 * x). Centroids start as the k vectors with the smallest sha256 of
    ``seed:id`` (null ids last, then by the vector), and each is replaced, ``rounds``
    times, by the floored mean of its vectors; one without vectors stays. Repeated
    rows count each and may be several centroids, of which the smallest number takes
    all. Fewer than k kept vectors make fewer clusters; an empty table, or one
    without kept vectors, gives an empty result. A vector with a component of
    2 ** 20 / sqrt(width) or more, whose distances no long may hold, takes no part and
    has nulls beside its id. A sum that no long holds is null. Further columns are
    not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(finite("vector") & (F.size("vector") == width))
    far = rows.where(~in_reach("vector")).select(F.col("id").alias("vec_id"))
    rows = rows.where(in_reach("vector")).select("id", F.col("vector").cast("array<double>").alias("vector"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "vector").limit(k).collect()  # k vectors
    centres = np.floor(1024 * np.array([r["vector"] for r in first]).reshape(len(first), width)).astype(np.int64)
    k = len(centres)
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    beyond = far.select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")[1:]])
    if not k:
        return beyond
    name, path = f"larkspur_vectors_{uuid.uuid4().hex}", new_path(spark, "vectors")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    packed = scaled_blocks(rows, ["id"], block).withColumn("block", F.monotonically_increasing_id())
    packed.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    try:
        blocks, state = spark.table(name), None
        radius = np.full(k, np.inf)
        for step in range(rounds + 1):
            balls = Balls(centres, radius)
            last = step == rounds
            found = stage(_assigned(blocks, state, balls, last), "assigned")
            if state is not None:
                unstage(state)
            state, old = found, centres
            counts, inertia, sums, reach = _totals(state, k, width)
            centres = np.array([[s // n for s in sums[j]] if (n := counts[j]) else old[j].tolist() for j in range(k)], np.int64).reshape(k, width)
            moved = np.sqrt(((centres - old).astype(float) ** 2).sum(axis=1))
            radius = (np.sqrt(np.array(reach, float)) + moved) * (1 + 1e-9) + 1e-6
    finally:
        unstage(spark.table(name))
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in old.tolist()]
    of = spark.createDataFrame([(j, _long(inertia[j]), shas[j]) for j in range(k)], "cluster int, cluster_inertia long, centroid_sha256 string")
    members = state.select(F.explode("members").alias("m")).select(F.col("m.id").alias("vec_id"), "m.cluster", "m.distance")
    total = F.lit(_long(sum(inertia))).cast("long").alias("inertia")
    out = members.join(F.broadcast(of) if k <= 100_000 else of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total, "centroid_sha256")
    return out.union(beyond)


def _assigned(blocks: DataFrame, state: DataFrame | None, balls: Balls, last: bool) -> DataFrame:
    """Each block's clusters in the next round, with their sums; in the last one also its members."""
    k = len(balls.centres)
    if state is None:
        met = blocks.withColumn("clusters", F.lit(None).cast("binary"))
    else:  # blocks stay in their buckets; the clusters come to them
        met = blocks.join(state.select("block", "clusters").hint("shuffle_hash"), "block")
    small = next(t for t in (np.uint8, np.uint16, np.uint32) if k - 1 <= np.iinfo(t).max)
    shared = blocks.sparkSession.sparkContext.broadcast(balls)
    member = pa.list_(pa.struct([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                n, data, before = (batch.column(c)[i].as_py() for c in ("n", "data", "clusters"))
                x = np.ascontiguousarray(columns_of(data, n).T, np.int64)
                own = np.zeros(n, np.int64) if before is None else np.frombuffer(before, small).astype(np.int64)
                cluster, distance, taken = balls.assign(x, own)
                counts = np.bincount(cluster, minlength=k)
                inertia, radius, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
                np.add.at(inertia, cluster, distance)
                np.maximum.at(radius, cluster, distance)
                for j in np.flatnonzero(counts):
                    sums[j] = x[cluster == j].sum(axis=0)
                members = pa.nulls(1, member)
                if last:
                    ids = batch.column("id")[i].values
                    listed = pa.StructArray.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])
                    members = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), listed)
                tally = np.concatenate((counts, inertia, sums.ravel(), radius, [taken]))
                values = [batch.column("block").slice(i, 1), pa.array([cluster.astype(small).tobytes()], pa.binary()), pa.array([tally], pa.list_(pa.int64())), members]
                yield pa.RecordBatch.from_arrays(values, ["block", "clusters", "tally", "members"])

    inputs = ["block", "n", "data", "clusters", *(["id"] if last else [])]
    return met.select(*inputs).mapInArrow(run, "block long, clusters binary, tally array<long>, members array<struct<id:long,cluster:int,distance:long>>")


def _totals(state: DataFrame, k: int, width: int) -> tuple[list[int], list[int], list[list[int]], list[int]]:
    """Members, summed distances, summed vectors and the largest distance of each cluster: k * (width + 3) numbers."""
    each = state.select(F.posexplode("tally").alias("at", "x")).groupBy("at")
    tally = {r["at"]: (int(r["added"]), r["largest"]) for r in each.agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("added"), F.max("x").alias("largest")).collect()}
    t = [tally[i][0] for i in range(k * (width + 2))]
    return t[:k], t[k : 2 * k], [t[2 * k + j * width : 2 * k + (j + 1) * width] for j in range(k)], [tally[len(t) + j][1] for j in range(k)]
