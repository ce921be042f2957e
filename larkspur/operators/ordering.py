"""Places in a global order, neighbours in it, and draws that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch_path


def numbered(rows: DataFrame, order: list[Column], to: str = "n") -> DataFrame:
    """Adds each row's place from 0 in the global order (without one, that of the rows as they come), without gathering rows in one task.

    Rows are range-partitioned and sorted, then written with their partition's
    number to the folder all executors share; only one count for each partition
    is summed up across partitions. The order should tell all rows apart.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "numbered")
    laid = (rows.orderBy(*order) if order else rows).withColumn("_at", F.monotonically_increasing_id())
    laid.write.parquet(path)
    laid = spark.read.schema(laid.schema).parquet(path)
    laid = laid.withColumn("_part", F.shiftright("_at", 33)).withColumn("_local", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = laid.groupBy("_part").count()
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    return laid.join(before, "_part").withColumn(to, F.col("_before") + F.col("_local")).drop("_at", "_part", "_local", "_before")


def neighbours(rows: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """Adds the value of the row before and after it in the order, null at the ends of each ``by``.

    A row meets its neighbours by their places, so that few values of ``by``, or
    one that most rows have, make no large window. Rows whose ``by`` is null are
    one group.
    """
    placed = numbered(rows, [F.col(c).asc_nulls_first() for c in [*by, *order]], "_n")
    out = placed
    for name, step in ((f"previous_{column}", 1), (f"next_{column}", -1)):
        other = placed.select((F.col("_n") + step).alias("_n"), F.struct(*by).alias("_by"), F.col(column).alias(name))
        same = F.col("_by").isNotNull() & F.col("_by").eqNullSafe(F.struct(*by))
        out = out.join(other, "_n", "left").withColumn(name, F.when(same, F.col(name))).drop("_by")
    return out.drop("_n")


def draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that the keys' text and the seed decide: the first 32 bits of their MD5."""
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def sample_share(rows: DataFrame, share: float, key: str, seed: int = 7) -> DataFrame:
    """Rows that are drawn with the given chance, the same in every run however rows are dealt out."""
    return rows.where(draw(seed, key) < share)


def sample_rows(rows: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """n rows drawn without replacement."""
    return rows.orderBy(draw(seed, key), key).limit(n)
