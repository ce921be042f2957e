"""Queries over sources and sinks, streams, and the whole import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import charts, importer, mutations
from ..operators import events as ev
from ..operators.ordering import numbered
from ..sources import files, tables
from ..sources.tables import read_table
from ..streaming import metrics
from .registry import query
from .stand_ins import SONGS, events, songs

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format


# Sources and sinks: what is written is what is read back


@query("SELECT p_partkey, p_name AS description, p_retailprice AS cholesterol, coalesce(try_cast(p_type AS DOUBLE), 0) AS sugar FROM part")
def src_csv(spark, d):
    """A CSV file with untidy headers and columns that are no numbers."""
    path = tables.scratch_path(spark, "csv")
    rows = read_table(spark, d, "part").select(F.col("p_partkey").alias(" Id"), F.col("p_name").alias("Description "), F.col("p_retailprice").alias(" Cholesterol "), F.col("p_type").alias("Sugar"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    found = files.read_numbers_csv(spark, path, ["Cholesterol", "Sugar"])
    return found.select(F.col("Id").cast("long").alias("p_partkey"), F.col("Description").alias("description"), F.col("Cholesterol").alias("cholesterol"), F.col("Sugar").alias("sugar"))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def src_dir_walk(spark, d):
    """Files in folders below folders, but for temporary ones."""
    path = tables.scratch_path(spark, "walk")
    read_table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("value"), "role").write.partitionBy("role").text(path)
    found = files.find_files(spark, path, "*.txt")
    lines = found.select(F.regexp_extract("path", "role=([^/]+)/", 1).alias("role"), F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    return lines.where("line <> ''").groupBy("role").agg(F.count("*").alias("n"))


@query(f"WITH {SONGS} SELECT 1 AS version, 'songs' AS name, id, title AS value FROM songs UNION ALL SELECT 2, 'songs', id, upper(title) FROM songs WHERE id % 7 <> 0 UNION ALL SELECT 2, 'tags', row_number() OVER (ORDER BY genre), genre FROM (SELECT DISTINCT genre FROM songs WHERE genre IS NOT NULL)")
def sink_db_save(spark, d):
    """Two versions of a catalogue, and a third whose writing fails between its tables: a reader keeps the first, a new one gets the second whole."""
    path = tables.scratch_path(spark, "catalogue")
    as_table = lambda name, rows: tables.empty_table(spark, name).unionByName(rows, allowMissingColumns=True)
    first = as_table("songs", songs(spark, d).select("id", "title", "artist", "genre"))
    tables.write_snapshot({"songs": first}, path)
    early = tables.open_catalogue(spark, path)
    genres = numbered(first.where("genre IS NOT NULL").select(F.col("genre").alias("name")).distinct(), [F.col("name")], "id").withColumn("id", F.col("id") + 1)
    tables.write_snapshot({"songs": first.where("id % 7 <> 0").withColumn("title", F.upper("title")), "tags": as_table("tags", genres)}, path)
    broken = as_table("tags", first.select("id", F.when(F.col("id") >= 0, F.raise_error(F.lit("the disk is full"))).cast("string").alias("name")))
    try:
        tables.write_snapshot({"songs": first.limit(0), "tags": broken}, path)
    except Exception as e:
        if "the disk is full" not in str(e):
            raise
    now = tables.open_catalogue(spark, path)
    shown = lambda version, name, rows, value: rows.select(F.lit(version).alias("version"), F.lit(name).alias("name"), "id", F.col(value).alias("value"))
    return shown(1, "songs", early["songs"], "title").union(shown(2, "songs", now["songs"], "title")).union(shown(2, "tags", now["tags"], "name"))


@query(f"WITH {SONGS} SELECT id, title, {_FOLD('title')} AS title_key, genre AS tag, true AS refused FROM songs")
def src_idb(spark, d):
    """A store of the first schema, opened by a program that knows three; the program that knows one then refuses it."""

    def first(_):
        return {"songs": songs(spark, d).select("id", "title", "genre"), "meta": spark.createDataFrame([("last_synced", 0)], "key string, value long")}

    def with_keys(at):
        return {"songs": at["songs"].withColumn("title_key", text.ascii_fold(F.col("title")))}

    def with_tags(at):
        return {"tags": at["songs"].where("genre IS NOT NULL").select(F.col("id").alias("song_id"), F.col("genre").alias("tag")), "songs": at["songs"].drop("genre"), "meta": None}

    path = tables.scratch_path(spark, "store")
    tables.open_store(spark, path, [first])
    now = tables.open_store(spark, path, [first, with_keys, with_tags])
    try:
        tables.open_store(spark, path, [first])
        refused = False
    except ValueError:
        refused = True
    return now["songs"].join(now["tags"], F.col("id") == F.col("song_id"), "left").select("id", "title", "title_key", "tag", F.lit(refused and "meta" not in now).alias("refused"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status FROM events")
def sink_log_append(spark, d):
    """A log that grows by appended rows."""
    path = tables.scratch_path(spark, "log")
    rows = read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    log = tables.empty_table(spark, "import_log").unionByName(rows, allowMissingColumns=True)
    for part in (log.where("id % 2 = 0"), log.where("id % 2 = 1")):
        tables.append_log(part, path)
    return read_table(spark, path, "import_log").select("id", "status")


@query(f"WITH {SONGS} SELECT count(*) FILTER (id % 5 = 1) AS changed, count(*) FILTER (id % 5 = 2) AS removed, 1::BIGINT AS added FROM songs")
def sink_exec(spark, d):
    """How many rows a change has changed, removed and added."""
    old = songs(spark, d).select("id", "genre")
    grown = mutations.insert_rows(old, spark.createDataFrame([("Folk",)], "genre string"))
    at = F.col("id") % 5
    new = mutations.update_allowed(grown.where((at != 2) | (F.col("genre") == "Folk")), (at == 1) & ~F.col("genre").eqNullSafe(F.lit("Folk")), {"genre": "Jazz"})
    return mutations.changes(old, new, "id")


# Streams


@query("SELECT event_type, count(*) AS count, round(sum(value), 2) AS total FROM events GROUP BY 1")
def str_metric_export(spark, d):
    """Running totals, exported by every batch of a stream; the last export."""
    stream = metrics.read_events(spark, d, read_table(spark, d, "events").schema, pattern="events.parquet")
    path = tables.scratch_path(spark, "metrics")
    metrics.drain(metrics.cumulative_metrics(stream, "value", ["event_type"]), metrics.files_sink(path, "overwrite"), "complete", tables.scratch_path(spark, "offsets"))
    return spark.read.parquet(path).select("event_type", "count", F.round("total", 2).alias("total"))


@query("SELECT event_id, user_id, event_type FROM events")
def str_span_batch(spark, d):
    """Spans handed on batch by batch."""
    stream = metrics.read_events(spark, d, read_table(spark, d, "events").schema, pattern="events.parquet")
    path = tables.scratch_path(spark, "spans")
    metrics.drain(stream.select("event_id", "user_id", "event_type"), metrics.files_sink(path, "append"), "append", tables.scratch_path(spark, "offsets"))
    return spark.read.parquet(path).select("event_id", "user_id", "event_type")


# Sequences and labels


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS section, (count(*) FILTER (event_type = 'signup') OVER w)::BIGINT AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def seq_carry_label(spark, d):
    """The label of the section that each row belongs to."""
    rows = ev.carry_label(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", "event_id")
    return rows.select("event_id", "section", "nth")


@query("SELECT event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events WHERE event_type <> 'error'")
def seq_lookahead(spark, d):
    """The next row that counts."""
    rows = ev.look_ahead(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") != "error", "event_type")
    return rows.select("event_id", "following")


@query("SELECT p_partkey, CASE WHEN p_size <= 7 THEN 'calm but firm' ELSE 'absolutely furious and appalled' END AS tone FROM part")
def txt_tone(spark, d):
    return read_table(spark, d, "part").select("p_partkey", scalars.tone(F.col("p_size")).alias("tone"))


# The import, from texts to songs and log


def _texts(spark, d):
    """A text for each part: two charts, the second without a title for some, and notes before the first."""
    head = F.concat(F.lit("notes\n# "), "p_name", F.lit(" – G\t\t"), "p_brand", F.lit("\nVerse\nG  D\nla la"))
    tail = F.when(F.col("p_size") % 2 == 0, "\n# – G\nx").otherwise(F.concat(F.lit("\n# Song "), F.col("p_partkey").cast("string"), F.lit(" – Am\t\t"), "p_brand", F.lit("\nC")))
    text = F.when(F.col("p_partkey") % 10 != 0, F.concat(head, tail))
    return read_table(spark, d, "part").select(F.format_string("f%012d", "p_partkey").alias("path"), text.alias("text"))


_KNOWN = "p_partkey % 3 = 0"
_NEW = f"""
  t AS (SELECT * FROM part WHERE p_partkey % 10 <> 0),
  k AS (SELECT DISTINCT {_FOLD('p_name')} || '/' || {_FOLD('p_brand')} AS id FROM part WHERE {_KNOWN}),
  n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT {_FOLD('p_name')} || '/' || {_FOLD('p_brand')} AS id FROM t) u WHERE id NOT IN (SELECT id FROM k))
    + (SELECT count(*) FROM t WHERE p_size % 2 = 1) AS imported)
"""


@query(f"WITH {_NEW} SELECT imported::BIGINT AS imported, 2 * (SELECT count(*) FROM t) - imported AS skipped, (SELECT count(*) FROM part) - (SELECT count(*) FROM t) AS errors FROM n")
def imp_charts(spark, d):
    """How many charts of the texts are imported into a library, how many skipped, and how many texts failed."""
    known = read_table(spark, d, "part").where(_KNOWN).select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("title"), F.col("p_brand").alias("artist"))
    _, log = importer.import_charts(_texts(spark, d), known)
    return importer.totals(log)


@query(f"WITH {_NEW} SELECT (SELECT count(*) FROM part WHERE {_KNOWN}) + imported AS songs, imported::BIGINT AS keyed FROM n")
def imp_songs(spark, d):
    """The library after the import."""
    known = read_table(spark, d, "part").where(_KNOWN).select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("title"), F.col("p_brand").alias("artist"), F.lit(None).cast("string").alias("chart_written_key"))
    grown, _ = importer.import_charts(_texts(spark, d), known)
    return grown.agg(F.countDistinct("id").alias("songs"), F.count("chart_written_key").alias("keyed"))


@query("SELECT p_partkey AS id, unnest([0, 1]) AS nth, unnest(['chord_lyric', CASE WHEN p_size % 2 = 0 THEN 'lyric' ELSE 'chord_only' END]) AS items FROM part WHERE p_partkey % 10 <> 0")
def txt_sections_of_import(spark, d):
    """The sections of each text's charts."""
    found = charts.sections(charts.classified_lines(importer.split_charts(_texts(spark, d)), "id", "chart_content"))
    nth = F.substring_index("id", "#", -1).cast("int")
    return found.select(F.substring("id", 2, 12).cast("long").alias("id"), nth.alias("nth"), F.array_join(F.transform("lines", lambda x: x["type"]), ",").alias("items"))
