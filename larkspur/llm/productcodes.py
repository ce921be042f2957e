"""Product codes of vectors: a codebook for each part of a vector, learned in exact whole numbers.

Vectors lie in columnar blocks, a row of a block for each dimension. A round is
one ``treeAggregate`` over the blocks: squared distances of a slice of vectors to
a part's entries accumulate dimension by dimension, ``np.add.at`` adds each
vector's part to the int64 sums and counts of its nearest entry, and the tensors
of tasks merge through a tree. A tensor has as many numbers as the codebooks,
whatever the number of vectors, and no vector ever leaves its task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .shared import stage
from .vectors import columns_of, finite, in_reach, scaled_blocks

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors of a block, vectors whose distances to all entries are held at once, tensors that one node of the tree merges.
BLOCK, SLICE, FAN = 4096, 256, 32
#: Labels up to which their sums are broadcast.
LABELS = 100_000


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors in columns: the nearest entry (a tie goes to the lower index) and its squared distance."""
    n, bound = part.shape[1], int(np.abs(part).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.int32 if bound * bound * len(part) < 1 << 31 else np.int64
    part, book = part.astype(kind), book.astype(kind)
    codes, least = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(0, n, SLICE):
        x = part[:, i : i + SLICE, None]
        distance = np.zeros((x.shape[1], len(book)), kind)
        one = np.empty_like(distance)
        for d in range(len(part)):
            np.subtract(x[d], book[:, d], out=one)
            np.multiply(one, one, out=one)
            distance += one
        codes[i : i + SLICE] = distance.argmin(axis=1)
        least[i : i + SLICE] = distance.min(axis=1)
    return codes, least


def _halves(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return [x[len(x) // parts * p : len(x) // parts * (p + 1)] for p in range(parts)]


def train(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (part, entry, dimension) after so many rounds over the blocks (n, data)."""
    context, rdd = blocks.sparkSession.sparkContext, blocks.select("n", "data").rdd
    depth = max(2, math.ceil(math.log(max(rdd.getNumPartitions(), 2), FAN)))
    parts = len(books)
    for _ in range(rounds):
        shared = context.broadcast(books)

        def add(total: tuple[np.ndarray, np.ndarray] | None, block: Row) -> tuple[np.ndarray, np.ndarray]:
            books = shared.value  # noqa: B023
            sums, counts = total or (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
            for p, part in enumerate(_halves(columns_of(bytes(block["data"]), block["n"]), parts)):
                codes, _ = nearest(part, books[p])
                np.add.at(sums[p], codes, part.T)
                np.add.at(counts[p], codes, 1)
            return sums, counts

        def merge(a: tuple | None, b: tuple | None) -> tuple | None:
            return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

        sums, counts = rdd.treeAggregate(None, add, merge, depth)
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        shared.destroy()
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Kept are vectors that are not null and have no null or non-finite component,
    as floor(1024 * x). A codebook's first entries are the parts of the vectors
    with the ``entries`` (256 at most) smallest ids (null ids last, then by the
    vector), fewer if fewer are kept. Repeated rows count each; a part equal to
    several entries takes the lowest; an entry that none takes stays. The
    codebooks' width is that of the first kept vector; vectors of another width, of
    a width that does not fall into equal parts, empty ones, and those with a
    component of 2 ** 20 / sqrt(width) or more, whose distances no long may hold,
    are not learned from and have a null code and error beside their id. Equal
    labels, nulls together, share the sum of their errors, which is null where no
    long holds it. An empty table gives an empty result. Further columns are not
    read, whatever their names.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(finite("vector"))
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    able = in_reach("vector") & (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    first = rows.where(able).orderBy(F.col("id").asc_nulls_last(), "vector").limit(min(entries, 256)).select("vector").collect()
    width = len(first[0]["vector"]) if first else -1
    first = [r["vector"] for r in first if len(r["vector"]) == width]
    able &= F.size("vector") == width
    out = rows.where(~able).select(F.col("id").alias("vec_id"), "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    sha = None
    if first:
        books = np.stack(_halves(np.floor(1024 * np.array(first).T).astype(np.int64), parts)).transpose(0, 2, 1)
        blocks = stage(scaled_blocks(rows.where(able), ["id", "label"], block), "blocks")
        books = train(blocks, books, rounds)
        sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        out = stage(_coded(blocks, books), "codes").union(out)
    errors = stage(out.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"), "errors")
    few = errors.count() <= LABELS  # beyond that a shuffle, whose hot keys adaptive execution splits
    met = out.join(F.broadcast(errors) if few else errors, F.col("label").eqNullSafe(F.col("of")), "left")
    return met.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """The vectors' codes, two hex digits for each part, and what the nearest entries miss."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    schema = blocks.select(F.col("id")[0].alias("vec_id"), F.col("label")[0].alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, x = batch.column("n")[i].as_py(), batch.column("data")[i].as_py()
                found = [nearest(part, book) for part, book in zip(_halves(columns_of(x, n), len(shared.value)), shared.value)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                text = codes.tobytes().hex()
                digits = 2 * codes.shape[1]
                listed = [text[j : j + digits] for j in range(0, len(text), digits)]
                error = np.sum([e for _, e in found], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column("id")[i].values, batch.column("label")[i].values, pa.array(listed, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, schema)


def decoded(codes: str, books: np.ndarray) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([book[k] for k, book in zip(bytes.fromhex(codes), books)])
