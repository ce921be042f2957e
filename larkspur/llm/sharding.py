"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are numbered in the order of their key and dealt into about sqrt(n) logical
partitions by a hash of that number, so that no key, however frequent, is hot.
The driver draws how many rows each partition sends to each shard: row by row a
multivariate hypergeometric draw from the shards' remaining places, which is the
law of those counts under a uniform permutation. Every partition permutes its
rows and cuts them at its counts, the rows are exchanged, and each shard permutes
what it got. Only partition counts and the matrix pass the driver: sqrt(n) times
the number of shards.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, unit

SEED = 20_231


def hypergeometric(good: int, total: int, draws: int, u: float) -> int:
    """Good ones among draws from total without replacement, by inverting the distribution at u.

    The log probabilities run outward from the mode. Places more than forty
    standard deviations away are left out; they weigh less than rounding does.
    """
    low, high = max(0, draws - (total - good)), min(draws, good)
    if low >= high:
        return low
    mean = draws * good / total
    sd = math.sqrt(max(mean * (1 - good / total) * (total - draws) / max(total - 1, 1), 0))
    low, high = max(low, int(mean - 40 * sd - 10)), min(high, int(mean + 40 * sd + 10))
    k = np.arange(low, high, dtype=float)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(total - good - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(weights, u * weights[-1], "right")), high - low)


def communication_matrix(counts: list[int], places: list[int], seed: int) -> np.ndarray:
    """matrix[p, s]: rows that partition p sends to shard s; rows sum to counts, columns to places."""
    left, rng = list(places), np.random.default_rng(seed)
    matrix = np.zeros((len(counts), len(places)), np.int64)
    for p, n in enumerate(counts):
        total = sum(left)
        for s in range(len(places)):
            k = hypergeometric(left[s], total, n, rng.random())
            total -= left[s]
            matrix[p, s], left[s], n = k, left[s] - k, n - k
    return matrix


def shuffle_rows(df: DataFrame, shards: int = 8, key: list[str] | None = None, seed: int = SEED, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 inside the shard) to every row.

    Shard sizes differ by one at most; which rows meet in a shard, and in which
    order, is a uniform permutation decided by ``seed`` and the rows' places in the
    order of the key columns (default: all) and then of all others, so reruns
    agree, but for rows that are equal, which may change places. Null keys count
    as a value, and come first. An empty table gives an empty result; values of
    any length pass through. Columns of df named like the two new ones are replaced.
    """
    kept = [c for c in df.columns if c not in (shard_col, slot_col)]
    by = [df[c].alias(f"_key{i}") for i, c in enumerate(key or [])]
    keyed = df.select(F.struct(*[df[c] for c in kept]).alias("_row"), *by, F.xxhash64(*[df[c] for c in kept]).alias("_hash"))
    placed = numbered(keyed, [*[F.col(f"_key{i}").asc_nulls_first() for i in range(len(by))], F.col("_hash"), F.monotonically_increasing_id()])
    n = placed.count()
    parts = math.isqrt(max(n - 1, 0)) + 1
    drawn = lambda k: unit(F.lit(seed + k), "n")
    rows = placed.select("_row", "n", F.floor(drawn(0) * parts).alias("_part"), drawn(1).alias("_u"), drawn(2).alias("_v"))
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], [n // shards + (s < n % shards) for s in range(shards)], seed)
    spark = df.sparkSession
    cuts = spark.createDataFrame(list(enumerate(np.cumsum(matrix, axis=1).tolist())), "_part long, _cuts array<long>")
    local = F.row_number().over(Window.partitionBy("_part").orderBy("_u", "n")) - 1
    dealt = rows.withColumn("_at", local).join(cuts, "_part")
    dealt = dealt.select("_row", "_v", "n", F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))).alias("_shard"))
    return _slots(dealt, parts, kept, shard_col, slot_col)


def _slots(dealt: DataFrame, buckets: int, kept: list[str], shard_col: str, slot_col: str) -> DataFrame:
    """Permutes each shard: rows are ordered by a random number, bucket by bucket, and numbered through."""
    dealt = dealt.withColumn("_bucket", F.floor(F.col("_v") * buckets))
    counts = dealt.groupBy("_shard", "_bucket").count()
    ahead = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_shard", "_bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    local: Column = F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy("_v", "n")) - 1
    placed = dealt.withColumn("_at", local).join(before, ["_shard", "_bucket"])
    return placed.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("_shard").cast("int").alias(shard_col), (F.col("_before") + F.col("_at")).alias(slot_col))
