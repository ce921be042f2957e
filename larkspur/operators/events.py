"""Logs and spans: sums, histograms, running meters, stage sequences, turns and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of histogram buckets, for counts, milliseconds and bytes alike; the last bucket is open.
EDGES = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)
#: The stages and what may follow each.
STAGES = {
    "choose_spouse": ("record_idea",),
    "record_idea": ("review_transcript",),
    "review_transcript": ("evaluating",),
    "evaluating": ("safe", "spouse_warning", "friend_intervention"),
    "safe": ("choose_spouse",),
    "spouse_warning": ("abort_success", "spouse_rage"),
    "friend_intervention": ("abort_success", "spouse_rage"),
    "spouse_rage": ("abort_success", "exile"),
    "abort_success": ("choose_spouse",),
    "exile": ("choose_spouse",),
}
#: User turns of a session by default, and the bounds of that number; days after which to review.
TURNS, FEWEST, MOST = 7, 5, 10
REVIEWS = (1, 7, 30)


def bucket(value: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """The number of the bucket, from 0: the first whose upper bound is not below the value."""
    out = F.when(value.isNull(), None)
    for i, edge in enumerate(edges):
        out = out.when(value <= edge, i)
    return out.otherwise(len(edges)).cast("int")


def histogram(rows: DataFrame, value: str, attributes: list[str], edges: tuple[float, ...] = EDGES) -> DataFrame:
    """count, total, least, most and a column for each bucket, by the attributes."""
    own = bucket(F.col(value), edges)
    aggs = [F.count(value).alias("count"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")]
    aggs += [F.count_if(own == i).alias(f"b{i}") for i in range(len(edges) + 1)]
    return rows.groupBy(*attributes).agg(*aggs)


def running_total(rows: DataFrame, by: str, order: list[str], value: str, to: str = "running") -> DataFrame:
    """The sum of a session's values up to and with each row."""
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.round(F.sum(value).over(upto), 4))


def check_sequence(rows: DataFrame, by: str, order: list[str], stage: str = "stage", edges: dict[str, tuple[str, ...]] = STAGES) -> DataFrame:
    """Adds the stage before and whether the step is allowed; a first row is."""
    allowed = F.create_map(*[x for a, b in edges.items() for x in (F.lit(a), F.array(*map(F.lit, b)))])
    before = F.lag(stage).over(Window.partitionBy(by).orderBy(*order))
    rows = rows.withColumn("before", before)
    return rows.withColumn("allowed", F.col("before").isNull() | F.coalesce(F.array_contains(allowed[F.col("before")], F.col(stage)), F.lit(False)))


def turns(rows: DataFrame, by: str, order: str, role: str = "role", limit: int = TURNS) -> DataFrame:
    """Numbers the user's rows of a conversation and tells which are the last but one, the last, and over the limit."""
    if not FEWEST <= limit <= MOST:
        raise ValueError(f"the limit is from {FEWEST} to {MOST}")
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    mine = rows.where(F.col(role) == "user").withColumn("turn_number", n)
    state = F.when(F.col("turn_number") == limit - 1, "warn").when(F.col("turn_number") == limit, "close").when(F.col("turn_number") > limit, "over").otherwise("open")
    return mine.withColumn("state", state)


def drift_levels(rows: DataFrame, by: str, order: list[str], drifted: Column) -> DataFrame:
    """Adds the drifts so far and what they call for: none, flag, second, pattern."""
    n = F.sum(drifted.cast("int")).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    level = F.when(F.col("drifts") == 0, "none").when(F.col("drifts") == 1, "flag").when(F.col("drifts") == 2, "second").otherwise("pattern")
    return rows.withColumn("drifts", n).withColumn("level", level)


def reviews(rows: DataFrame, day: str, after: tuple[int, ...] = REVIEWS) -> DataFrame:
    """A row for each day on which an item is due again."""
    return rows.withColumn("after_days", F.explode(F.array(*map(F.lit, after)))).withColumn("due", F.date_add(F.to_date(day), F.col("after_days")))


def carry_label(rows: DataFrame, by: str, order: list[str], starts: Column, label: str) -> DataFrame:
    """Adds ``section``, the label of the last row that starts a section (null before the first), and ``nth``, its number."""
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"section": F.last(F.when(starts, F.col(label)), ignorenulls=True).over(upto), "nth": F.count_if(starts).over(upto)})


def look_ahead(rows: DataFrame, by: str, order: list[str], counts: Column, value: str) -> DataFrame:
    """The rows that count, with ``following``: the value of the next one."""
    return rows.where(counts).withColumn("following", F.lead(value).over(Window.partitionBy(by).orderBy(*order)))


def last_attempt(rows: DataFrame, by: str, order: str, verified: str) -> DataFrame:
    """The first verified attempt of each key, else the last one."""
    rank = F.struct(F.coalesce(F.col(verified), F.lit(False)).cast("int").alias("ok"), F.when(F.col(verified), -F.col(order)).otherwise(F.col(order)).alias("at"))
    return rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), rank).alias("r")).select(by, "r.*")


def first_terminal(rows: DataFrame, by: str, order: str, terminal: Column, rounds: int) -> DataFrame:
    """Where each session ends: the first terminal row within ``rounds``; sessions without one have no row."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    ends = rows.withColumn("round", n).where(terminal & (F.col("round") <= rounds))
    return ends.groupBy(by).agg(F.min_by(F.struct(*[c for c in ends.columns if c != by]), "round").alias("r")).select(by, "r.*")


def negotiate(rows: DataFrame, by: str, order: str, item: str, verdict: str, ends: tuple[str, ...], rounds: int) -> DataFrame:
    """The rounds of each session: by, round (from 1), the row's columns, and the session's outcome.

    Rows are candidates in ``order``. One whose item was tried before takes no
    round. The session stops with the first verdict among ``ends``, or after
    ``rounds`` rounds; then its outcome is ``exhausted``. ``order`` is unique in a
    session. Items are reduced to their first rows before rows are ranked, and
    ranks above ``rounds`` are dropped before they move, so a busy session is never
    in one task.
    """
    rest = [c for c in rows.columns if c not in (by, order, item)]
    once = rows.groupBy(by, item).agg(F.min(F.struct(order, *rest)).alias("_r")).select(by, item, "_r.*")
    ranked = once.withColumn("round", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("round") <= rounds)
    last = F.min(F.when(F.col(verdict).isin(*ends), F.struct("round", F.col(verdict).alias("outcome")))).over(Window.partitionBy(by))
    found = ranked.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("round") <= F.col("_last")["round"]))
    return found.withColumn("outcome", F.coalesce(F.col("_last")["outcome"], F.lit("exhausted"))).drop("_last")


def rubric(rows: DataFrame, section: str, status: str, statuses: tuple[str, ...]) -> DataFrame:
    """How often each status occurs in a section; 0 where it doesn't."""
    return rows.groupBy(section).pivot(status, list(statuses)).count().na.fill(0)


def edges_online(rows: DataFrame, by: str, order: list[str], online: str) -> DataFrame:
    """Rows at which a client comes back online."""
    before = F.lag(online).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col(online) & ~F.col("_before")).drop("_before")
