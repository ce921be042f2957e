"""Queries on keys and chords, made of part numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pitch
from ..functions.scalars import clamp_capo
from ..sources.tables import read_table
from .registry import query
from .stand_ins import SCALE

_FLATS = "['C','Db','D','Eb','E','F','Gb','G','Ab','A','Bb','B']"
_N, _M = "(p_partkey % 12)::INT", "(p_size % 12)::INT"


def _part(spark, d):
    n, m = (F.col("p_partkey") % 12).cast("int"), (F.col("p_size") % 12).cast("int")
    part = read_table(spark, d, "part")
    return part.select("p_partkey", n.alias("n"), m.alias("m"), pitch.root_name(n).alias("sharp"), pitch.root_name(n, True).alias("flat"))


@query(f"SELECT p_partkey, ({SCALE})[{_N} + 1] AS name FROM part")
def mus_norm(spark, d):
    return _part(spark, d).select("p_partkey", pitch.normal_root(F.col("flat")).alias("name"))


@query(f"SELECT p_partkey, {_N} AS index, NULL::INT AS unknown FROM part")
def mus_index(spark, d):
    return _part(spark, d).select("p_partkey", pitch.root_index(F.col("flat")).alias("index"), pitch.root_index(F.lit("H")).alias("unknown"))


@query(f"SELECT p_partkey, ({SCALE})[(({_N} - {_M} + 24) % 12) + 1] AS sharp, ({_FLATS})[(({_N} - {_M} + 24) % 12) + 1] AS flat FROM part")
def mus_name(spark, d):
    at = F.col("n") - F.col("m")
    return _part(spark, d).select("p_partkey", pitch.root_name(at).alias("sharp"), pitch.root_name(at, True).alias("flat"))


@query(f"SELECT p_partkey, list_contains(['F','Bb','Eb','Ab','Db','Gb'], ({_FLATS})[{_N} + 1]) AS flats FROM part")
def mus_prefer_flat(spark, d):
    return _part(spark, d).select("p_partkey", pitch.prefers_flats(F.col("flat")).alias("flats"))


@query(f"SELECT p_partkey, CASE WHEN ({_M} - {_N} + 12) % 12 > 6 THEN ({_M} - {_N} + 12) % 12 - 12 ELSE ({_M} - {_N} + 12) % 12 END AS delta FROM part")
def mus_delta(spark, d):
    return _part(spark, d).select("p_partkey", pitch.key_delta(F.concat("sharp", F.lit("m")), pitch.root_name(F.col("m"), True)).alias("delta"))


@query(f"SELECT p_partkey, CASE WHEN {_M} = 0 THEN ({SCALE})[{_N} + 1] ELSE ({_FLATS})[({_N} + {_M}) % 12 + 1] END AS flats FROM part")
def mus_sounding(spark, d):
    return _part(spark, d).select("p_partkey", pitch.sounding_key(F.col("sharp"), F.col("m")).alias("flats"))


@query(f"SELECT p_partkey, CASE WHEN {_M} = 0 THEN ({_FLATS})[{_N} + 1] ELSE ({SCALE})[({_N} + {_M}) % 12 + 1] END || 'm' AS key FROM part")
def mus_sounding_parse(spark, d):
    return _part(spark, d).select("p_partkey", pitch.sounding_key_in_sharps(F.concat("flat", F.lit("m")), F.col("m")).alias("key"))


@query(f"SELECT p_partkey, CASE WHEN {_M} = 0 OR ({_FLATS})[{_N} + 1] IN ('F','Bb','Eb','Ab','Db','Gb') THEN ({_FLATS})[(CASE WHEN {_M} = 0 THEN {_N} ELSE {_N} - {_M} + 12 END) % 12 + 1] ELSE ({SCALE})[({_N} - {_M} + 12) % 12 + 1] END AS key FROM part")
def mus_written(spark, d):
    return _part(spark, d).select("p_partkey", pitch.written_key(F.col("flat"), F.col("m")).alias("key"))


_MOVED = f"({SCALE})[({_N} + {_M}) % 12 + 1]"


@query(f"SELECT p_partkey, {_MOVED} || 'm7/' || ({SCALE})[({_M} + 7) % 12 + 1] AS chord, 'H7' AS other FROM part")
def mus_chord(spark, d):
    moved = pitch.transpose_chord(F.concat("sharp", F.lit("m7/G")), F.col("m"))
    return _part(spark, d).select("p_partkey", moved.alias("chord"), pitch.transpose_chord(F.lit("H7"), F.col("m")).alias("other"))


@query(f"SELECT p_partkey, '  ' || {_MOVED} || '   ' || {_MOVED} || 'sus4 | ' || ({SCALE})[({_M} + 6) % 12 + 1] AS line FROM part")
def mus_line(spark, d):
    line = F.concat(F.lit("  "), "sharp", F.lit("   "), "sharp", F.lit("sus4 | F#"))
    return _part(spark, d).select("p_partkey", pitch.transpose_line(line, F.col("m")).alias("line"))


@query(f"SELECT p_partkey, 'Oh {{' || {_MOVED} || '7}}my {{x}} dear' AS line FROM part")
def mus_inline(spark, d):
    line = F.concat(F.lit("Oh {"), "sharp", F.lit("7}my {x} dear"))
    return _part(spark, d).select("p_partkey", pitch.transpose_inline(line, F.col("m")).alias("line"))


@query(f"SELECT p_partkey, '[Intro A] ' || {_MOVED} || ' ' || {_MOVED} || 'dim' AS line FROM part")
def mus_section(spark, d):
    line = F.concat(F.lit("[Intro A] "), "sharp", F.lit(" "), "sharp", F.lit("dim"))
    return _part(spark, d).select("p_partkey", pitch.transpose_section(line, F.col("m")).alias("line"))


#: Lines, and whether each is a section with chords.
_LABELLED = {" [Solo] G": True, "[Chorus]": False, "[Solo] now": False, "[Verse 2]   Am7": True, "G [x]": False}


@query(f"SELECT p_partkey, p_size % 2 = 0 AS chords, {list(_LABELLED.values())}[p_size % {len(_LABELLED)} + 1] AS section FROM part")
def mus_is_chord_line(spark, d):
    line = F.when(F.col("p_size") % 2 == 0, "G D/F# Em7 C now").otherwise("A day in the life")
    labelled = F.element_at(F.array(*map(F.lit, _LABELLED)), F.col("p_size") % len(_LABELLED) + 1)
    return read_table(spark, d, "part").select("p_partkey", pitch.is_chord_line(line).alias("chords"), pitch.is_section_with_chords(labelled).alias("section"))


def _flat(at):
    return f"({_FLATS})[({at}) % 12 + 1]"


@query(
    f"SELECT p_partkey, CASE WHEN {_N} = 5 THEN '# A – F' || chr(10) || 'F C7' ELSE '# A – F' || chr(10) || "
    f"CASE WHEN {_flat(_N)} IN ('F','Bb','Eb','Ab','Db','Gb') THEN {_flat(_N)} || ' ' || {_flat(_N + ' + 7')} ELSE ({SCALE})[{_N} + 1] || ' ' || ({SCALE})[({_N} + 7) % 12 + 1] END || '7' END || chr(10) || 'A word' || chr(10) || 'e--5-3--|' AS chart FROM part"
)
def mus_chart(spark, d):
    chart = F.lit("# A – F\nF C7\nA word\ne--5-3--|")
    return _part(spark, d).select("p_partkey", pitch.transpose_chart_to(chart, F.lit("F"), F.col("flat")).alias("chart"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN -2 WHEN 2 THEN 2 ELSE 1 END AS step FROM part")
def mus_step(spark, d):
    kind = F.col("p_size") % 4
    label = F.when(kind == 0, "Half").when(kind == 1, "whole").when(kind == 2, "2").otherwise("other")
    return read_table(spark, d, "part").select("p_partkey", pitch.step_size(label, F.when(kind == 1, "down").otherwise("up")).alias("step"))


@query("SELECT p_partkey, greatest(0, least(11, p_size - 20)) AS capo FROM part")
def num_clamp(spark, d):
    return read_table(spark, d, "part").select("p_partkey", clamp_capo(F.col("p_size") - 20).alias("capo"))
