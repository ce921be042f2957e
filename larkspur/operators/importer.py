"""Batch import: texts to parsed charts, those that are new, and a log with a row for every outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, split_documents
from .charts import parse_charts
from .mutations import new_only, with_new_ids

UNKNOWN = "Unknown"


def split_charts(texts: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per chart of each text: path, nth, id (of path and nth) and chart_content.

    A text without a header gives no chart; a null text gives none either.
    """
    blocks = texts.select(F.col(path_col).alias("path"), F.posexplode(split_documents(F.col(text_col))).alias("nth", "chart_content"))
    return blocks.withColumn("id", F.concat_ws("#", "path", F.format_string("%09d", "nth")))


def import_charts(texts: DataFrame, songs: DataFrame, path_col: str = "path", text_col: str = "text", dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the songs with the new ones, a log of source_file, nth, song_id, status, message).

    Charts without a title are skipped, as are those whose title and artist,
    whatever their case, the library has or an earlier chart of this run brings.
    Charts that lack an artist are always new. A text that is null could not be
    read: it is logged as an error. song_id is the id that a new song got, or the
    one that was there (the least, if there are several). A dry run leaves the
    songs alone, and its new ones are logged as ``dryRun``.
    """
    blocks = split_charts(texts, path_col, text_col)
    parsed = parse_charts(blocks, "id", "chart_content").select("id", "title", "artist", F.col("written_key").alias("chart_written_key"), "sounding_key", "original_key", F.col("capo").alias("default_capo"), "bpm", F.col("structure").alias("beatbuddy_structure"))
    found = blocks.join(parsed, "id").withColumnRenamed("id", "_chart").withColumn("source_file", F.col("path"))
    fresh = with_new_ids(songs, new_only(found.where(F.col("title") != UNKNOWN), songs, ["title", "artist"], "_chart"), "id", "_chart")
    columns = [c for c in fresh.columns if c in songs.columns]
    grown = songs if dry_run else songs.unionByName(fresh.select(*columns), allowMissingColumns=True)
    taken = fresh.select("_chart", F.col("id").alias("_new"))
    fold = lambda c: ascii_fold(F.col(c)).alias(f"_{c}")
    known = songs.unionByName(fresh.select(*columns), allowMissingColumns=True).groupBy(fold("title"), fold("artist")).agg(F.min("id").alias("_old"))
    status = F.when(F.col("_new").isNull(), "skipped").otherwise("dryRun" if dry_run else "ok")
    why = F.when(F.col("_new").isNotNull(), F.lit(None)).when(F.col("title") == UNKNOWN, "no title").otherwise("already there")
    song = F.when(F.col("title") != UNKNOWN, F.coalesce(F.lit(None).cast("long") if dry_run else F.col("_new"), F.when(F.col("_new").isNull(), F.col("_old"))))
    judged = found.join(taken, "_chart", "left").withColumns({"_title": ascii_fold(F.col("title")), "_artist": ascii_fold(F.col("artist"))}).join(known, ["_title", "_artist"], "left")
    log = judged.select("source_file", "nth", song.alias("song_id"), status.alias("status"), why.alias("message"))
    null = F.lit(None).cast("long")
    broken = texts.where(F.col(text_col).isNull()).select(F.col(path_col).alias("source_file"), F.lit(0).alias("nth"), null.alias("song_id"), F.lit("error").alias("status"), F.lit("not readable").alias("message"))
    return grown, log.union(broken)


def totals(log: DataFrame) -> DataFrame:
    """One row: how many charts were imported (or would have been), skipped, and failed."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return log.agg(is_("ok", "dryRun").alias("imported"), is_("skipped").alias("skipped"), is_("error").alias("errors"))
