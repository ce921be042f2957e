"""The catalogue's notions over the star-schema tables, for the registered queries.

songs are parts, lists are orders, list entries are line items, tags are brands
that an order's parts carry, the log and the spans are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pitch import SHARPS
from ..sources.tables import read_table

#: SQL for the same rows.
SCALE = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
SONGS = f"""songs AS (
  SELECT p_partkey AS id, p_name AS title, p_brand AS artist, nullif(p_type, 'ECONOMY') AS genre,
    CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'shuffle' WHEN 2 THEN 'straight' ELSE 'waltz' END AS feel,
    CASE WHEN p_size <= 10 THEN '60s' WHEN p_size <= 20 THEN '70s' WHEN p_size <= 35 THEN '90s' ELSE '2000s' END AS era,
    p_size AS bpm, (p_partkey % 8)::INT AS default_capo, ({SCALE})[(p_partkey % 12)::INT + 1] AS chart_written_key FROM part)"""
LISTS = "lists AS (SELECT o_orderkey AS id, o_orderpriority AS name, o_orderdate AS gig_date FROM orders)"
ENTRIES = "entries AS (SELECT l_orderkey AS setlist_id, l_partkey AS song_id, l_linenumber AS position, l_quantity AS notes FROM lineitem)"
HELD = "held AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey))) AS held, CASE WHEN l_orderkey % 2 = 0 THEN min(l_partkey) ELSE l_orderkey % 200 + 1 END AS item FROM lineitem GROUP BY l_orderkey)"
LINKS = "links AS (SELECT DISTINCT l_orderkey AS song_id, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"


def songs(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    scale = F.array(*map(F.lit, SHARPS))
    return read_table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("genre"),
        F.when(size % 4 == 1, "shuffle").when(size % 4 == 2, "straight").when(size % 4 == 3, "waltz").alias("feel"),
        F.when(size <= 10, "60s").when(size <= 20, "70s").when(size <= 35, "90s").otherwise("2000s").alias("era"),
        size.alias("bpm"),
        (F.col("p_partkey") % 8).cast("int").alias("default_capo"),
        F.element_at(scale, (F.col("p_partkey") % 12).cast("int") + 1).alias("chart_written_key"),
    )


def lists(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("gig_date"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("setlist_id"), F.col("l_partkey").alias("song_id"), F.col("l_linenumber").alias("position"), F.col("l_quantity").alias("notes"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """(song_id, name): an order and a brand among its parts."""
    part = read_table(spark, d, "part").select("p_partkey", "p_brand")
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("song_id"), F.col("p_brand").alias("name")).distinct()


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def held(spark: SparkSession, d: str) -> DataFrame:
    """The set of an order's parts, and an item: for even orders one of the set."""
    item = F.when(F.col("l_orderkey") % 2 == 0, F.min("l_partkey")).otherwise(F.col("l_orderkey") % 200 + 1)
    rows = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("held"), item.alias("item"))
    return rows.withColumnRenamed("l_orderkey", "id")
