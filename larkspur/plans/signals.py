"""Queries over events, spans, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.vectors import cosine
from ..operators import events as ev
from ..operators import nearest, replica
from ..sources.tables import read_table, scratch_path
from ..streaming import exporters, metrics, sessions
from .registry import query
from .stand_ins import events

_E = "e AS (SELECT *, (props::JSON ->> 'k')::INT AS k FROM events)"


_EDGES = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


def _buckets(value: str) -> str:
    bounds = ["'-inf'::DOUBLE", *_EDGES, "'inf'::DOUBLE"]
    return ", ".join(f"count(*) FILTER ({value} > {low} AND {value} <= {high}) AS b{i}" for i, (low, high) in enumerate(zip(bounds, bounds[1:])))


def _histogram(value: str, by: str) -> str:
    total = f"round(sum({value}), 4)" if value == "value" else f"sum({value})::BIGINT"
    return f"SELECT {by}, count({value}) AS count, {total} AS total, min({value}) AS least, max({value}) AS most, {_buckets(value)} FROM e GROUP BY {by}"


@query(f"WITH {_E} SELECT user_id, sum(k)::BIGINT AS input, sum(user_id % 7)::BIGINT AS output, sum(k + user_id % 7)::BIGINT AS total FROM e GROUP BY 1")
def agg_token_sum(spark, d):
    out = F.col("user_id") % 7
    return events(spark, d).groupBy("user_id").agg(F.sum("k").alias("input"), F.sum(out).alias("output"), F.sum(F.col("k") + out).alias("total"))


@query(f"WITH {_E} {_histogram('k', 'event_type')}")
def agg_hist_tokens(spark, d):
    return ev.histogram(events(spark, d), "k", ["event_type"])


@query(f"WITH {_E} {_histogram('value', 'event_type, user_id')}")
def agg_hist_duration(spark, d):
    return ev.histogram(events(spark, d), "value", ["event_type", "user_id"])


@query(f"WITH e AS (SELECT *, octet_length(encode(props)) AS size FROM events) {_histogram('size', 'user_id')}")
def agg_hist_bytes(spark, d):
    return ev.histogram(events(spark, d).withColumn("size", F.octet_length("props").cast("long")), "size", ["user_id"])


@query("SELECT quality, count(*) FILTER (toxic = 0) AS \"0\", count(*) FILTER (toxic = 1) AS \"1\", 0::BIGINT AS \"2\" FROM labels GROUP BY 1")
def agg_rubric_pivot(spark, d):
    return ev.rubric(read_table(spark, d, "labels"), "quality", "toxic", (0, 1, 2))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running FROM events")
def str_token_meter(spark, d):
    return ev.running_total(events(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", "running")


@query("SELECT user_id, count(*) AS spans, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def str_session_corr(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("spans"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def _arrivals(spark, d):
    """The events as they arrive in four files, every tenth one a file late, and a last file whose one row, of nobody and a year later, moves the watermark past all."""
    rows = events(spark, d).select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    quarter = F.least(F.lit(3), F.floor((F.unix_micros("ts") - (low or 0)) * 4 / ((high or 0) - (low or 0) + 1)))
    rows = rows.withColumn("file", F.least(F.lit(3), quarter + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)))
    late = f"{((high or 0) - (low or 0)) // 4_000_000 + 60} seconds"
    last = spark.createDataFrame([(-1, -1, "none", 0.0)], "event_id long, user_id long, event_type string, value double")
    last = last.select("event_id", F.col("user_id").cast(rows.schema["user_id"].dataType), "event_type", "value", F.timestamp_micros(F.lit((high or 0) + 366 * 86_400_000_000)).alias("ts"))
    files = [rows.where(F.col("file") == k).drop("file") for k in range(4)] + [last]
    return files, late


def _drained(spark, files, make, mode="append"):
    """What a stream over the files hands on that is stopped after the second and goes on from its checkpoint."""
    folder, out, offsets = (scratch_path(spark, n) for n in ("arrivals", "handed", "offsets"))
    for begin, end in ((0, 2), (2, len(files))):
        for k in range(begin, end):
            files[k].coalesce(1).write.mode("append").parquet(folder)
        stream = metrics.read_events(spark, folder, files[0].schema, pattern="part-*")
        metrics.drain(make(stream), metrics.files_sink(out), mode, offsets)
    return spark.read.parquet(out)


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running FROM events")
def str_token_meter_live(spark, d):
    """The meter on a stream with late rows and a restart: a row is handed on with its sum once nothing earlier can come."""
    files, late = _arrivals(spark, d)
    found = _drained(spark, files, lambda s: sessions.running_totals(s, "user_id", "ts", "event_id", "value", late, 20 * 366 * 86_400_000))
    return found.where("user_id >= 0").select("user_id", F.col("nth").alias("event_id"), F.round("running", 4).alias("running"))


@query("WITH g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '12 hours')::INT, 1) AS new FROM events)) SELECT user_id, count(*) AS spans, min(ts) AS first, max(ts) AS last FROM g GROUP BY user_id, nth")
def str_session_corr_live(spark, d):
    """Sessions of a stream with late rows and a restart, each handed on when it has been idle for twelve hours."""
    files, late = _arrivals(spark, d)
    found = _drained(spark, files, lambda s: sessions.session_summaries(s, "user_id", "ts", "event_id", 12 * 3_600_000, late))
    return found.where("user_id >= 0").select("user_id", "spans", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")])


@query("SELECT time_bucket(INTERVAL '15 seconds', ts) AS start, event_type, count(*) AS count, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str_metric_live(spark, d):
    """What each 15 seconds add, in update mode by a timed trigger, stopped and started again; of an interval's exports the last counts."""
    files, late = _arrivals(spark, d)
    folder, out, offsets = (scratch_path(spark, n) for n in ("arrivals", "handed", "offsets"))
    for begin, end in ((0, 2), (2, 4)):
        for k in range(begin, end):
            files[k].coalesce(1).write.mode("append").parquet(folder)
        stream = metrics.read_events(spark, folder, files[0].schema, pattern="part-*")
        running = metrics.export(metrics.interval_metrics(stream, "ts", "value", ["event_type"], late=late), metrics.files_sink(out), "update", "1 second", offsets)
        running.processAllAvailable()
        running.stop()
    last = spark.read.parquet(out).groupBy("window", "event_type").agg(F.max_by(F.struct("count", "total"), "batch").alias("v"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "v.count", F.round("v.total", 4).alias("total"))


@query("SELECT event_id, user_id::VARCHAR AS user_id, event_type AS name, epoch_ns(ts) AS start, round(value, 4) AS value FROM events")
def sink_otlp(spark, d):
    """Spans of a stream, written by executors as OTLP requests; a batch that comes again is there once."""
    files, _ = _arrivals(spark, d)
    folder, out, offsets = (scratch_path(spark, n) for n in ("arrivals", "spans", "offsets"))
    for k in range(4):
        files[k].coalesce(1).write.mode("append").parquet(folder)
    stream = metrics.read_events(spark, folder, files[0].schema, pattern="part-*")
    spans = stream.select(F.lower(F.lpad(F.hex("user_id"), 32, "0")).alias("trace_id"), F.lower(F.lpad(F.hex("event_id"), 16, "0")).alias("span_id"), F.col("event_type").alias("name"), (F.unix_micros("ts") * 1000).alias("start"), "event_id", F.col("user_id").cast("string").alias("user_id"), "value")
    options = exporters.chosen({exporters.ENDPOINT: out})
    exporters.export_spans(spans, offsets, options).trigger(availableNow=True).start().awaitTermination()
    # a new checkpoint hands on the same batches again
    exporters.export_spans(spans, scratch_path(spark, "offsets"), options).trigger(availableNow=True).start().awaitTermination()
    found = exporters.read_spans(spark, out)
    return found.select(F.col("attributes")["event_id"].cast("long").alias("event_id"), F.col("attributes")["user_id"].alias("user_id"), "name", "start", F.round(F.col("attributes")["value"].cast("double"), 4).alias("value"))


_NAMES = ("choose_spouse", "record_idea", "review_transcript", "evaluating", "safe", "spouse_warning", "friend_intervention", "spouse_rage", "abort_success", "exile")
_STEPS = """
  s AS (
    SELECT event_id, user_id, stage, lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
    FROM (SELECT *, ['choose_spouse', 'record_idea', 'review_transcript', 'evaluating', 'safe', 'spouse_warning', 'friend_intervention', 'spouse_rage', 'abort_success', 'exile'][(value * 100)::BIGINT % 10 + 1] AS stage FROM events)
  ), edge(a, b) AS (VALUES
    ('choose_spouse', 'record_idea'), ('record_idea', 'review_transcript'), ('review_transcript', 'evaluating'),
    ('evaluating', 'safe'), ('evaluating', 'spouse_warning'), ('evaluating', 'friend_intervention'), ('safe', 'choose_spouse'),
    ('spouse_warning', 'abort_success'), ('spouse_warning', 'spouse_rage'), ('friend_intervention', 'abort_success'), ('friend_intervention', 'spouse_rage'),
    ('spouse_rage', 'abort_success'), ('spouse_rage', 'exile'), ('abort_success', 'choose_spouse'), ('exile', 'choose_spouse')
  )"""


def with_stage(rows):
    return rows.withColumn("stage", F.element_at(F.array(*map(F.lit, _NAMES)), (F.round(F.col("value") * 100).cast("long") % 10 + 1).cast("int")))


@query(f"WITH {_STEPS} SELECT event_id, stage, before, before IS NULL OR (before, stage) IN (SELECT (a, b) FROM edge) AS allowed FROM s")
def str_stage_machine(spark, d):
    rows = ev.check_sequence(with_stage(events(spark, d)), "user_id", ["ts", "event_id"])
    return rows.select("event_id", "stage", "before", "allowed")


@query(f"WITH {_STEPS} SELECT user_id, before, stage AS now FROM s WHERE before IS NOT NULL AND (before, stage) NOT IN (SELECT (a, b) FROM edge)")
def str_stage_live(spark, d):
    """The same check on a stream that keeps each session's stage; every batch's findings go to a folder of its own."""
    stream = metrics.read_events(spark, d, read_table(spark, d, "events").schema, pattern="events.parquet")
    path = scratch_path(spark, "steps")
    metrics.drain(metrics.stage_stream(with_stage(stream.withColumn("ts", F.col("ts").cast("timestamp"))), "user_id", ["ts", "event_id"]), metrics.files_sink(path), "update", scratch_path(spark, "offsets"))
    return spark.read.parquet(path).select("user_id", "before", "now")


@query("WITH s AS (SELECT *, lag(value > 20) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id FROM s WHERE value > 20 AND NOT before")
def str_sync_on_reconnect(spark, d):
    rows = events(spark, d).withColumn("online", F.col("value") > 20)
    return ev.edges_online(rows, "user_id", ["ts", "event_id"], "online").select("event_id")


_VERSIONS = "versions AS (SELECT o_custkey AS key, o_orderdate::TIMESTAMP AS t, o_totalprice AS value, o_orderstatus = 'F' AS deleted, o_orderkey AS number FROM orders)"


def _server(spark, d):
    """The versions of customers' totals, which some orders delete, and when clients, one for each kind of event, came back online; as if the events had gone on through the orders' years."""
    first = read_table(spark, d, "orders").agg(F.min("o_orderdate")).first()[0]
    start = read_table(spark, d, "events").agg(F.min("ts")).first()[0]
    columns = [F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").alias("deleted"), F.col("o_orderkey").alias("number")]
    versions = read_table(spark, d, "orders").select(F.col("o_custkey").alias("key"), *columns)
    days = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / 3_600_000_000).cast("int")
    log = events(spark, d).select("event_type", "event_id", F.date_add(F.lit(first).cast("date"), days).cast("timestamp_ntz").alias("at"), (F.col("value") > 20).alias("online"))
    return replica.returns(log, "event_type", ["at", "event_id"], "online").distinct(), versions


@query(f"""
    WITH {_VERSIONS}, log AS (
      SELECT event_type, event_id, value > 20 AS online, (SELECT min(o_orderdate)::DATE FROM orders) + ((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000)::INT AS t FROM events
    ), edges AS (
      SELECT DISTINCT event_type, t::TIMESTAMP AS t FROM (SELECT *, lag(online) OVER (PARTITION BY event_type ORDER BY t, event_id) AS before FROM log) WHERE online AND NOT before
    ), met AS (
      SELECT v.*, c.event_type FROM versions v CROSS JOIN (SELECT DISTINCT event_type FROM edges) c
    ), found AS (
      SELECT m.event_type, m.key, m.value, m.deleted, m.number, m.t AS since, e.t FROM met m ASOF JOIN edges e ON m.event_type = e.event_type AND m.t <= e.t
    ), newest AS (
      SELECT *, row_number() OVER (PARTITION BY event_type, t, key ORDER BY since DESC, value DESC, deleted DESC, number DESC) AS n FROM found
    )
    SELECT event_type, t AS online_at, key, value, key % 50 = 0 AS dirty FROM newest WHERE n = 1 AND NOT deleted
""")
def str_sync_replica(spark, d):
    """What each return online puts into a client's replica; the ids that clients have edited stay listed."""
    edges, versions = _server(spark, d)
    edited = read_table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("key"), F.lit(True).alias("dirty"))
    found = replica.refreshed(edges, versions, "event_type", "key").join(edited, "key", "left")
    return found.select("event_type", F.col("at").alias("online_at"), "key", "value", F.coalesce("dirty", F.lit(False)).alias("dirty"))


@query("SELECT time_bucket(INTERVAL '15 seconds', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str_metric_interval(spark, d):
    return events(spark, d).groupBy(F.window("ts", "15 seconds").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_number FROM conversations WHERE role = 'user') SELECT conv_id, turn, turn_number::INT AS turn_number, CASE WHEN turn_number = 4 THEN 'warn' WHEN turn_number = 5 THEN 'close' WHEN turn_number > 5 THEN 'over' ELSE 'open' END AS state FROM t")
def seq_turn_counter(spark, d):
    return ev.turns(read_table(spark, d, "conversations"), "conv_id", "turn", limit=5).select("conv_id", "turn", "turn_number", "state")


@query("WITH t AS (SELECT *, sum((length(text) % 3 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS drifts FROM conversations) SELECT conv_id, turn, drifts::BIGINT AS drifts, CASE WHEN drifts = 0 THEN 'none' WHEN drifts = 1 THEN 'flag' WHEN drifts = 2 THEN 'second' ELSE 'pattern' END AS level FROM t")
def seq_drift_escalation(spark, d):
    return ev.drift_levels(read_table(spark, d, "conversations"), "conv_id", ["turn"], F.length("text") % 3 == 0).select("conv_id", "turn", "drifts", "level")


@query("SELECT event_id, unnest([1, 7, 30]) AS after_days, (ts::DATE + unnest([1, 7, 30])::INT)::DATE AS due FROM events")
def seq_retrieval(spark, d):
    return ev.reviews(events(spark, d).select("event_id", "ts"), "ts").select("event_id", "after_days", "due")


@query("SELECT event_id, ts FROM events")
def seq_newest_first(spark, d):
    return events(spark, d).select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id"))


@query("WITH r AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS change FROM events)) SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2")
def seq_runs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("int")
    runs = events(spark, d).withColumn("changed", changed).withColumn("run", F.sum("changed").over(w))
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


# Classes


@query(f"WITH {_E} SELECT event_id, CASE WHEN k % 11 <= 2 THEN 'safe' WHEN k % 11 <= 7 THEN 'spouse_warning' ELSE 'friend_intervention' END AS stage, CASE WHEN k % 11 <= 7 THEN 'calm but firm' ELSE 'absolutely furious and appalled' END AS tone FROM e")
def cls_route(spark, d):
    score = F.col("k") % 11
    return events(spark, d).select("event_id", scalars.route(score).alias("stage"), scalars.tone(score).alias("tone"))


@query(f"WITH {_E} SELECT event_id, CASE WHEN k > 100 OR k < 0 THEN NULL WHEN k >= 70 THEN 'bussin' WHEN k >= 35 THEN 'mid' ELSE 'unc' END AS verdict FROM e")
def cls_verdict(spark, d):
    return events(spark, d).select("event_id", scalars.verdict(F.col("k")).alias("verdict"))


@query("SELECT p_partkey, p_size > 25 OR p_retailprice > 1000 AS denied FROM part")
def cls_limit_rule(spark, d):
    return read_table(spark, d, "part").select("p_partkey", scalars.over_limit(F.col("p_size"), F.col("p_retailprice"), 25, 1000).alias("denied"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, CASE WHEN event_type = 'purchase' THEN -event_id ELSE event_id END DESC) AS n FROM events) SELECT user_id, event_id FROM r WHERE n = 1")
def cls_retry(spark, d):
    rows = events(spark, d).select("user_id", "event_id", (F.col("event_type") == "purchase").alias("ok"))
    return ev.last_attempt(rows, "user_id", "event_id", "ok").select("user_id", "event_id")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS round FROM events) SELECT user_id, min_by(event_id, round) AS event_id, min(round) AS round FROM r WHERE event_type IN ('purchase', 'error') AND round <= 4 GROUP BY 1")
def cls_negotiate(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "event_type")
    return ev.first_terminal(rows, "user_id", "event_id", F.col("event_type").isin("purchase", "error"), 4).select("user_id", "event_id", F.col("round").cast("long").alias("round"))


@query(f"""
    WITH RECURSIVE {_E}, c AS (
      SELECT user_id, event_id, k % 6 AS item, event_type AS verdict, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e
    ), s AS (
      SELECT DISTINCT user_id, 0 AS n, 0 AS round, []::INT[] AS tried, false AS done, NULL::BIGINT AS event_id, NULL::INT AS item, NULL::VARCHAR AS verdict FROM c
      UNION ALL
      SELECT c.user_id, c.n, CASE WHEN list_contains(s.tried, c.item) THEN s.round ELSE s.round + 1 END, list_append(s.tried, c.item),
        NOT list_contains(s.tried, c.item) AND c.verdict IN ('purchase', 'error'), CASE WHEN NOT list_contains(s.tried, c.item) THEN c.event_id END, c.item, c.verdict
      FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1 WHERE NOT s.done AND s.round < 4
    )
    SELECT user_id, round, event_id, item, verdict, coalesce(max(CASE WHEN done THEN verdict END) OVER (PARTITION BY user_id), 'exhausted') AS outcome FROM s WHERE event_id IS NOT NULL
""")
def cls_negotiate_rounds(spark, d):
    """Every round of each negotiation: an item tried before is passed over, an approval or a denial ends it."""
    rows = events(spark, d).select("user_id", "event_id", (F.col("k") % 6).alias("item"), F.col("event_type").alias("verdict"))
    return ev.negotiate(rows, "user_id", "event_id", "item", "verdict", ("purchase", "error"), 4)


# Vectors


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cosine(spark, d):
    v = read_table(spark, d, "embeddings")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


_BEST = "b AS (SELECT q.vec_id AS query_id, max_by(i.vec_id, [s, -i.vec_id]) AS item_id, max(s) AS similarity FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0 AND i.vec_id <> q.vec_id, LATERAL (SELECT list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s) GROUP BY 1)"


def _nearest(spark, d, threshold=nearest.THRESHOLD):
    v = read_table(spark, d, "embeddings")
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest.nearest_above(queries, v.select(F.col("vec_id").alias("item_id"), "embedding"), threshold, apart=True)


@query(f"WITH {_BEST} SELECT query_id, item_id, round(similarity, 6) AS similarity FROM b")
def join_knn(spark, d):
    """The nearest item of each query, however far."""
    return _nearest(spark, d, -1.0).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_BEST} SELECT query_id, CASE WHEN similarity >= 0.45 THEN item_id END AS item_id, CASE WHEN similarity >= 0.45 THEN round(similarity, 6) END AS similarity FROM b")
def vec_top1_threshold(spark, d):
    return _nearest(spark, d).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_BEST} SELECT query_id, CASE WHEN similarity >= 0.45 THEN item_id::VARCHAR WHEN query_id % 100 = 0 THEN 'page' ELSE 'guess' END AS answer, CASE WHEN similarity >= 0.45 THEN 'vector' WHEN query_id % 100 = 0 THEN 'web' ELSE 'model' END AS source FROM b")
def vec_tier_fallback(spark, d):
    found = _nearest(spark, d).select("query_id", F.col("item_id").cast("string").alias("answer"))
    pages = lambda missed: missed.select("query_id", F.when(F.col("query_id") % 100 == 0, "page").alias("answer"))
    guesses = lambda missed: missed.select("query_id", F.lit("guess").alias("answer"))
    return nearest.tiers(found, "vector", ("web", pages), ("model", guesses))
