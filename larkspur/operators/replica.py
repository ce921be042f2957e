"""A client's replica of server tables, refreshed whenever the client comes back online."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .events import edges_online

#: Seconds of the stretches by which versions find the client's next return.
STRETCH = 86_400


def returns(log: DataFrame, client: str, order: list[str], online: str) -> DataFrame:
    """(client, at): when each client was seen online after having been offline; ``order`` begins with the time."""
    return edges_online(log, client, order, online).select(client, F.col(order[0]).alias("at"))


def refreshed(edges: DataFrame, versions: DataFrame, client: str, key: str, time: str = "at", deleted: str = "deleted", stretch: int = STRETCH) -> DataFrame:
    """What each return changes in the client's replica: client, at, key and the other columns of the version that is put.

    A refresh asks for everything the server has at that time and puts it by key;
    what has vanished there stays in the replica, and so does what a client has
    edited. A key is put again where its newest version came since the return
    before, so these rows, the newest of each key winning, are the replica at any
    time. Of versions of one key at the same time the last in the order of their
    columns counts. Each version finds each client's next return: by the stretch
    of time it lies in, among that stretch's returns, else the first one later.
    """
    number = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / stretch)
    by_stretch = edges.select(client, F.col(time).alias("_edge")).distinct().groupBy(client, number("_edge").alias("_stretch")).agg(F.array_sort(F.collect_set("_edge")).alias("_edges"))
    later = F.lead(F.col("_edges")[0]).over(Window.partitionBy(client).orderBy("_stretch"))
    ahead = F.lead("_stretch").over(Window.partitionBy(client).orderBy("_stretch"))
    span = versions.agg(F.min(number(time)).alias("low")).first()["low"]
    if span is None:
        span = 0
    rows = by_stretch.withColumns({"_later": later, "_until": ahead, "_before": F.lag("_stretch").over(Window.partitionBy(client).orderBy("_stretch"))})
    own = rows.select(client, "_stretch", "_edges", "_later")
    # stretches without returns up to the first, and between two: their versions wait for the next return
    low = F.when(F.col("_before").isNull(), F.least(F.lit(span), F.col("_stretch"))).otherwise(F.col("_before") + 1)
    empty = rows.withColumn("_low", low).where(F.col("_low") <= F.col("_stretch") - 1)
    empty = empty.select(client, F.explode(F.sequence("_low", F.col("_stretch") - 1)).alias("_stretch"), F.array().cast(rows.schema["_edges"].dataType).alias("_edges"), F.col("_edges")[0].alias("_later"))
    found = versions.withColumn("_stretch", number(time)).join(own.union(empty), "_stretch")
    edge = F.coalesce(F.try_element_at(F.filter("_edges", lambda e: e >= F.col(time)), F.lit(1)), F.col("_later"))
    met = found.withColumn("_edge", edge).where("_edge IS NOT NULL")
    values = [c for c in versions.columns if c not in (key, time)]
    last = F.max(F.struct(F.col(time), *[F.col(c) for c in values])).alias("_v")
    newest = met.groupBy(client, "_edge", key).agg(last)
    out = newest.select(client, F.col("_edge").alias(time), key, *[F.col("_v")[c].alias(c) for c in values])
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def replica_at(changes: DataFrame, client: str, key: str, time: str = "at") -> DataFrame:
    """Each client's replica after all of its returns: the newest row of each key."""
    rest = [c for c in changes.columns if c not in (client, key)]
    return changes.groupBy(client, key).agg(F.max_by(F.struct(*rest), time).alias("_v")).select(client, key, "_v.*")
