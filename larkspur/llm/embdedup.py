"""Near-duplicate vectors by collision-counting projections.

Vectors of length 1 are projected on PROJECTIONS random directions, and sorted
along each. Two vectors collide on a direction if one lies in the window around
the other. The window is as wide as lets two vectors at the threshold collide
with chance HIT; the collisions of such a pair then follow a binomial law, and
the count that a pair has to reach is the largest that a pair at the threshold
misses with a chance of LOST at most (nearer pairs miss it still less). Pairs that
reach it are verified by their cosine in double precision.

Equal vectors are one class with a count. Classes sorted along the first direction
are cut into blocks, and only blocks whose ranges on it come within the distance
meet: first their numbers and ranges alone, then each pair of blocks fetches its
vectors. A task sorts and counts within two blocks, and returns how many links
each vector has and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, stage
from .vectors import blocks, matrix, unit_rows, usable

THRESHOLD, BLOCK, SEED = 0.93, 4096, 17
#: Directions, the chance that a pair at the threshold collides on one, and that it misses the count.
PROJECTIONS, HIT, LOST = 24, 0.972, 1e-6
#: Rounding of cosines and projections that windows and blocks' ranges allow for.
EPS = 1e-9


@lru_cache(8)
def directions(dim: int) -> np.ndarray:
    """Random directions of length 1 as columns, the same in every run."""
    x = np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))
    return x / np.linalg.norm(x, axis=0)


@lru_cache(8)
def reach_within(dim: int, chance: float) -> float:
    """What the size of a random direction's component is at most with the given chance: its arc sine has the density cos ** (dim - 2)."""
    if dim < 3:
        return 1.0 if dim < 2 else float(np.sin(chance * np.pi / 2))
    angle = np.linspace(0, np.pi / 2, 200_001)
    mass = np.cumsum(np.cos(angle) ** (dim - 2))
    return float(np.sin(angle[min(int(np.searchsorted(mass, chance * mass[-1])) + 1, len(angle) - 1)]))


@lru_cache(1)
def least_count() -> int:
    """The largest count that all but LOST of the pairs at the threshold reach."""
    below = [sum(comb(PROJECTIONS, k) * HIT**k * (1 - HIT) ** (PROJECTIONS - k) for k in range(c)) for c in range(PROJECTIONS + 1)]
    return max(c for c, missed in enumerate(below) if missed <= LOST)


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of x, j of y; i < j in the same block) with cosine at the threshold or above."""
    x, y = unit_rows(x), unit_rows(y)
    axes = directions(x.shape[1])
    px, py = x @ axes, y @ axes
    window = np.sqrt(max(2 - 2 * threshold, 0)) * reach_within(x.shape[1], HIT) + EPS
    order = np.argsort(py, axis=0, kind="stable")
    low, high = np.empty(px.shape, np.int64), np.empty(px.shape, np.int64)
    for t in range(PROJECTIONS):  # the window around each query in each sorted projection
        along = py[order[:, t], t]
        low[:, t], high[:, t] = np.searchsorted(along, px[:, t] - window), np.searchsorted(along, px[:, t] + window, "right")
    order, need = np.ascontiguousarray(order.T), least_count()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(x)):
        count = np.zeros(len(y), np.uint8)
        for t in range(PROJECTIONS):
            count[order[t, low[i, t] : high[i, t]]] += 1
        b = np.flatnonzero(count >= need)
        if same:
            b = b[b > i]
        b = b[(y[b] * x[i]).sum(axis=1) >= threshold]
        if len(b):
            found.append((np.full(len(b), i), b))
    empty = np.zeros(0, int)
    return np.concatenate([empty, *[f[0] for f in found]]), np.concatenate([empty, *[f[1] for f in found]])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    root, out = np.arange(len(nodes)), []
    a, b = ends[: len(a)], ends[len(a) :]
    while len(a):
        ra, rb = root[a], root[b]
        a, b = a[ra != rb], b[ra != rb]
        for i, j in zip(a[:256].tolist(), b[:256].tolist()):
            ri, rj = i, j
            while root[ri] != ri:
                ri = root[ri]
            while root[rj] != rj:
                rj = root[rj]
            if ri != rj:
                root[max(ri, rj)] = min(ri, rj)
                out.append((int(nodes[i]), int(nodes[j])))
        a, b = a[256:], b[256:]
        while not np.array_equal(up := root[root], root):
            root = up
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label link if their cosine is the threshold or above; n_links
    counts the other vectors linked directly, component_id is the least id
    reachable, kept tells whether it is the own one. Vectors without a label,
    null, empty or zero ones, and those with a null or non-finite component link
    with nothing. Vectors of different width never link. Repeated rows are
    vectors of their own that link with each other. Null ids are never least.
    An empty table gives an empty result; further columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("_used", usable("vector") & F.col("label").isNotNull())
    used = rows.where("_used")
    classes = used.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("width", F.size("vector")), "classes")

    @F.arrow_udf("double")
    def first_axis(rows_: pa.Array) -> pa.Array:
        out = np.zeros(len(rows_))
        widths = pc.list_value_length(rows_).to_numpy(zero_copy_only=False)
        for w in set(widths.tolist()):
            own = rows_.filter(pa.array(widths == w))
            out[widths == w] = unit_rows(own.flatten().to_numpy(zero_copy_only=False).reshape(-1, w)) @ directions(w)[:, 0]
        return pa.array(out)

    laid = classes.withColumn("at", first_axis("vector")).orderBy("label", "width", "at", "id")
    packed = stage(blocks(laid, block, "label").withColumn("block", F.monotonically_increasing_id()), "blocks")
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-6
    slim = packed.select("block", "key", "low", "high", "width")
    x, y = slim.alias("x"), slim.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.width") == F.col("y.width"))
    meet = meet & (F.col("x.low") - reach <= F.col("y.high")) & (F.col("y.low") - reach <= F.col("x.high"))
    pairs = x.join(y, meet).select(F.col("x.block").alias("one"), F.col("y.block").alias("two"))
    data = lambda end, to: packed.select(F.col("block").alias(end), *[F.col(c).alias(c + to) for c in ("ids", "times", "data")])
    met = pairs.where("one < two").join(data("one", ""), "one").join(data("two", "2"), "two")
    met = met.unionByName(pairs.where("one = two").join(data("one", ""), "one"), allowMissingColumns=True)  # a block against itself comes once
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small data but much work: not to be coalesced

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, *packed_ in zip(*(batch.column(c) for c in ("one", "two", "ids", "times", "data", "ids2", "times2", "data2"))):
                ids, times, data, ids2, times2, data2 = (v.as_py() for v in packed_)
                same = one == two
                if same:
                    ids2, times2, data2 = ids, times, data
                ids, times, ids2, times2 = (np.frombuffer(v, np.int64) for v in (ids, times, ids2, times2))
                a, b = near_pairs(matrix(data, len(ids)), matrix(data2, len(ids2)), threshold, same)
                edges = _forest(ids[a], ids2[b])
                nodes, place = np.unique(np.concatenate((ids[a], ids2[b])), return_inverse=True)
                near = np.bincount(place, np.concatenate((times2[b], times[a])), len(nodes)).astype(np.int64)
                columns = ([e[0] for e in edges] + nodes.tolist(), [e[1] for e in edges] + [None] * len(nodes), [None] * len(edges) + near.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "near"])

    found = stage(met.repartition(tasks, "one", "two").mapInArrow(compare, "a long, b long, near long"), "links")
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    near = found.where("near IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("near").alias("near"))
    member = classes.select("id", "label", "vector", "least", "times").join(near, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = member.join(least, "root").select("label", "vector", (F.coalesce("near", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = used.join(of, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("_used")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
