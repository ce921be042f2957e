"""Nearest stored item with a threshold, and fallback by tiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.45
#: Vectors in a block; rounding of a matrix product that is looked at again.
BLOCK, NEAR = 4096, 1e-9


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Usable vectors (id, vector: doubles) in blocks of one width: width, {name}_ids, {name}_data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch.column(1))
            for w in pc.unique(widths).to_pylist():
                own = batch.filter(pc.equal(widths, w))
                for i in range(0, len(own), BLOCK):
                    part = own.slice(i, BLOCK)
                    ids = part.column(0).to_numpy().astype(np.int64).tobytes()
                    data = part.column(1).flatten().to_numpy().astype(np.float64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([ids], pa.binary()), pa.array([data], pa.binary())], ["width", f"{name}_ids", f"{name}_data"])

    return rows.where(F.col("id").isNotNull() & usable("vector")).mapInArrow(pack, f"width int, {name}_ids binary, {name}_data binary")


def _best(batches: Iterator[pa.RecordBatch], apart: bool) -> Iterator[pa.RecordBatch]:
    """The best item of each pair of blocks for each query (``apart``: but that with its id); products name the candidates, plain sums decide."""
    for batch in batches:
        for q_ids, q_data, i_ids, i_data in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_data", "i_ids", "i_data"))):
            ids, items = np.frombuffer(q_ids, np.int64), np.frombuffer(i_ids, np.int64)
            q, x = (np.frombuffer(d, np.float64).reshape(len(i), -1) for d, i in ((q_data, ids), (i_data, items)))
            q_size, x_size = (np.sqrt((v * v).sum(axis=1)) for v in (q, x))
            cos = (q / q_size[:, None]) @ (x / x_size[:, None]).T
            if apart:
                cos[ids[:, None] == items] = -np.inf
            out = []
            for k, best in enumerate(cos.max(axis=1)):
                if best == -np.inf:
                    continue
                at = np.flatnonzero(cos[k] >= best - NEAR)
                score = (x[at] * q[k]).sum(axis=1) / (q_size[k] * x_size[at])
                one = np.lexsort((items[at], -score))[0]
                out.append((ids[k], score[one], -items[at[one]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.int64()))], ["query", "similarity", "less"])


def nearest_above(queries: DataFrame, items: DataFrame, threshold: float = THRESHOLD, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding", apart: bool = False) -> DataFrame:
    """The stored item most similar to each query: query_id, item_id, similarity; null where it is below the threshold.

    Every query is held against all items of its width (``apart``: but that with
    its own id), block by block, one matrix product for each pair of blocks;
    blocks of items carry a salt, so that no task gathers them all. Ties go to the
    smaller id. Vectors that are null, zero or hold a null or non-finite component
    are near nothing. Ids are whole numbers; a query id that occurs twice has two rows.
    """
    salts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lambda d, i: d.select(F.col(i).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = _blocks(rows(queries, query_id), "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    stored = _blocks(rows(items, item_id), "i").withColumn("salt", F.pmod(F.xxhash64("i_ids"), F.lit(salts)).cast("int"))
    best = best_in_blocks(stored.join(asked, ["width", "salt"]), apart).withColumnRenamed("query", query_id)
    hit = F.col("_best.similarity") >= threshold
    out = queries.select(query_id).join(best, query_id, "left")
    return out.select(query_id, F.when(hit, -F.col("_best.less")).alias(item_id), F.when(hit, F.col("_best.similarity")).alias("similarity"))


def best_in_blocks(pairs: DataFrame, apart: bool = False) -> DataFrame:
    """The best item of each query over pairs of blocks (q_ids, q_data, i_ids, i_data): query, _best (similarity, less: the id, negative)."""
    found = pairs.mapInArrow(lambda batches: _best(batches, apart), "query long, similarity double, less long")
    return found.groupBy("query").agg(F.max(F.struct("similarity", "less")).alias("_best"))


def usable(vector: str):
    """Neither null nor zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def tiers(first: DataFrame, source: str, *later: tuple[str, Callable[[DataFrame], DataFrame]], key: str = "query_id", value: str = "answer") -> DataFrame:
    """For each key the value of the first tier that has one, and that tier's name.

    ``first`` has a row for every key. Each later tier is asked for those keys
    alone that no tier before has answered: its function takes them and returns
    (key, value). A key that none answers has nulls.
    """
    done = first.select(key, value, F.when(F.col(value).isNotNull(), source).alias("source"))
    for name, ask in later:
        missed = done.where(F.col(value).isNull()).select(key)
        answers = ask(missed.distinct()).where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
        asked = missed.join(answers, key, "left").select(key, value, F.when(F.col(value).isNotNull(), name).alias("source"))
        done = done.where(F.col(value).isNotNull()).union(asked)
    return done
