"""What the vector operators share: usable vectors, and blocks of them as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(vector, lambda x: x != 0)
    return F.coalesce(~bad & ~zero, F.lit(False))


def stored(x: np.ndarray) -> bytes:
    """Vectors as bytes: in single precision, the first byte 4, if that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return b"\4" + single.tobytes() if np.array_equal(single.astype(np.float64), x) else b"\10" + x.tobytes()


def matrix(data: bytes, rows: int) -> np.ndarray:
    """A block's vectors in double precision."""
    return np.frombuffer(data, np.float32 if data[0] == 4 else np.float64, offset=1).astype(np.float64).reshape(rows, -1)


def blocks(sorted_rows: DataFrame, size: int, key: str) -> DataFrame:
    """Packs runs of at most ``size`` neighbouring rows (id, times long, key, at double, vector) with equal key and width.

    Returns rows (ids, times binary: longs, key, low, high: of ``at``, n, width, data
    binary: as ``stored``). ``sorted_rows`` is sorted inside its partitions.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids = np.array([r[0] for r in held], np.int64)
            data = np.array([r[3] for r in held], np.float64)
            times = np.array([r[4] for r in held], np.int64)
            values = (ids.tobytes(), times.tobytes(), held[0][1], held[0][2], held[-1][2], len(held), data.shape[1], stored(data))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names)

        names = ["ids", "times", "key", "low", "high", "n", "width", "data"]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == size or row[1] != held[0][1] or len(row[3]) != len(held[0][3])):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    rows = sorted_rows.select("id", F.col(key).cast("long").alias("key"), "at", "vector", "times")
    return rows.mapInArrow(pack, "ids binary, times binary, key long, low double, high double, n int, width int, data binary")


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


#: Components become floor(SCALE * x). Vectors of width w with a component of 2 ** 20 / sqrt(w) or more have squared distances that a long may not hold.
SCALE, MOST = 1024, float(1 << 20)


def finite(vector: str) -> Column:
    """Not null, and no component null or non-finite; the empty vector is."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def in_reach(vector: str) -> Column:
    """Whether all squared distances among such scaled vectors are longs."""
    return F.forall(vector, lambda x: F.abs(x) * F.sqrt(F.size(vector)) < MOST)


def scaled_blocks(rows: DataFrame, carried: list[str], size: int, vector: str = "vector") -> DataFrame:
    """Packs rows of finite vectors of one width, a run of at most ``size`` in each row.

    Returns the carried columns as arrays, n, and data: the scaled components, all
    vectors' first, then all their second ones, and so on, as ``columns_of`` reads them.
    """
    schema = rows.select(*[F.array(c).alias(c) for c in carried], F.lit(0).alias("n"), F.lit(b"").alias("data")).schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                x = part.column(len(carried)).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                x = np.floor(SCALE * x).astype(np.int64).T
                kind = next(k for k in (np.int16, np.int32, np.int64) if np.abs(x).max(initial=0) <= np.iinfo(k).max)
                data = bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(x, kind).tobytes()
                listed = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns[: len(carried)]]
                yield pa.RecordBatch.from_arrays([*listed, pa.array([part.num_rows], pa.int32()), pa.array([data], pa.binary())], [*carried, "n", "data"])

    return rows.select(*carried, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(pack, schema)


def columns_of(data: bytes, n: int) -> np.ndarray:
    """The components of a packed block: a row for each dimension."""
    return np.frombuffer(data, f"i{data[0]}", offset=1).reshape(-1, n) if n else np.zeros((0, 0), np.int16)
