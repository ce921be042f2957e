"""Line-oriented chord charts: classification, header and meta lines, sections.

Classification is one CASE chain over each line of a document's array of lines,
so that no later filter evaluates it again; sections are windows over a document's
lines. Every document is parsed without a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pitch
from ..functions.text import bind, empty_to_null, full_trim, lines, words

# Fixed values.
TYPES = ("BLANK", "HEADER", "BB_META", "TAB", "MODULATION", "INLINE_CHORD_LYRIC", "SECTION_WITH_CHORDS", "SECTION_REF", "PLAIN_SECTION", "CHORD", "LYRIC")
TAB = r"^[eEbBgGdD][|\-][\-0-9|/\\hpbr()x ]{3,}"
INLINE = r"\{[A-G][^}]*\}"
REPEAT = r"\b(\d+)[Xx]\b|\(x\d+\)"
FILLERS = ("end", "on", "fade", "last", "piece")
SECTIONS = ("verse", "chorus", "bridge", "outro", "intro", "pre-?chorus", "interlude", "middle", "solo", "link", "tag", "hook", "refrain", "coda", "vamp", "breakdown")
LABELLED = r"^(\[.+?\])\s*(.+)\z"
SECTION_SHARE, CHORD_SHARE = 0.7, 0.8
HEADER_KEY = r"[–\-]\s*([A-G][b#]?m?)\s*(?:\(([A-G][b#]?m?)\))?"
STRUCTURE, CAPO, BPM = r"(?i)BB:\s*([^\t]+)", r"(?i)Capo\s+(\d+)", r"[A-Z]-(\d{2,3})\b"

#: The viewer's variant: fewer section words, no fillers, repeat marks in any case.
VIEWER_SECTIONS = tuple(s for s in SECTIONS if s not in ("middle", "refrain", "breakdown"))


def _played(rest: Column, viewer: bool) -> Column:
    """Tokens behind a label that are neither repeat marks nor fillers."""
    repeat = f"(?i){REPEAT}" if viewer else REPEAT
    keep = lambda t: ~t.rlike(repeat) if viewer else ~t.rlike(repeat) & ~F.lower(t).isin(*FILLERS)
    return F.filter(words(rest), keep)


def classify(line: Column, viewer: bool = False) -> Column:
    """The class of a line, one of TYPES; the first condition that holds decides. Null counts as blank."""
    return bind(full_trim(line), lambda s: _class(s, viewer))


def _share(tokens: Column, least: float, some: bool) -> Column:
    """Whether so many of the tokens are chords; ``some``: of no tokens none is enough."""
    return bind(tokens, lambda t: ((F.size(t) > 0) | F.lit(not some)) & (F.size(F.filter(t, pitch.is_chord)) >= least * F.size(t)))


def _class(s: Column, viewer: bool) -> Column:
    """The class of a trimmed line: cheap tests first, and tokens only where all others failed."""
    named = "|".join(VIEWER_SECTIONS if viewer else SECTIONS)
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "BLANK")
        .when(s.startswith("#"), "HEADER")
        .when(s.startswith("BB:"), "BB_META")
        .when(s.rlike(TAB), "TAB")
        .when(s.rlike(pitch.MODULATION), "MODULATION")
        .when(s.contains("{") & s.rlike(INLINE), "INLINE_CHORD_LYRIC")
        .when(s.startswith("[") & s.rlike(LABELLED) & _share(_played(F.regexp_extract(s, LABELLED, 2), viewer), SECTION_SHARE, True), "SECTION_WITH_CHORDS")
        .when(s.startswith("[") & s.rlike(r"^\[.+\]\z"), "SECTION_REF")
        .when(s.rlike(rf"(?i)^({named})(\s+\d+)?[:\s]*\z"), "PLAIN_SECTION")
        .when(_share(words(s), CHORD_SHARE, False), "CHORD")
        .otherwise("LYRIC")
    )


def section_chords(line: Column) -> Column:
    """label, chords, repeat and annotation of a section line with chords."""
    s = full_trim(line)
    rest = full_trim(F.regexp_extract(s, LABELLED, 2))
    return F.struct(
        F.regexp_extract(s, LABELLED, 1).alias("label"),
        F.array_join(F.filter(_played(rest, False), pitch.is_chord), " ").alias("chords"),
        empty_to_null(F.regexp_extract(rest, REPEAT, 0)).alias("repeat"),
        rest.alias("annotation"),
    )


def parse_header(line: Column) -> Column:
    """title, artist, written_key, sounding_key and original_key from the tab slots of a header line.

    The first dash before a key wins, even inside a title; a third slot is the
    original key only if it is a chord token.
    """
    slots = F.filter(F.transform(F.split(full_trim(F.regexp_replace(line, r"^#+\s*", "")), "\t"), full_trim), lambda t: t != "")
    first = F.coalesce(F.try_element_at(slots, F.lit(1)), F.lit(""))
    third = F.try_element_at(slots, F.lit(3))
    at = F.regexp_instr(first, F.lit(HEADER_KEY))
    return F.struct(
        F.when(at > 0, full_trim(F.substring(first, F.lit(1), at - 1))).otherwise(first).alias("title"),
        F.try_element_at(slots, F.lit(2)).alias("artist"),
        empty_to_null(F.regexp_extract(first, HEADER_KEY, 1)).alias("written_key"),
        empty_to_null(F.regexp_extract(first, HEADER_KEY, 2)).alias("sounding_key"),
        F.when(pitch.is_chord(third), third).alias("original_key"),
    )


def parse_meta(line: Column) -> Column:
    """capo (0 without), bpm and structure of a ``BB:`` line; the bpm needs a capital letter before its dash."""
    structure = F.regexp_extract(line, STRUCTURE, 1)
    return F.struct(
        F.coalesce(F.regexp_extract(line, CAPO, 1).try_cast("int"), F.lit(0)).alias("capo"),
        F.regexp_extract(line, BPM, 1).try_cast("int").alias("bpm"),
        empty_to_null(full_trim(F.regexp_replace(structure, r"[A-Z]-\d{2,3}", ""))).alias("structure"),
    )


def classified_lines(charts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: id, n (from 0), line, type."""
    classed = F.transform(F.transform(lines(F.col(text_col)), full_trim), lambda s: F.struct(s.alias("line"), _class(s, False).alias("type")))
    rows = charts.select(F.col(id_col).alias("id"), F.posexplode(classed).alias("n", "l"))
    return rows.select("id", "n", "l.line", "l.type")


def sections(classified: DataFrame) -> DataFrame:
    """One row per section: id, section, type, label, ref, text, chords, repeat, annotation, lines.

    Headers and meta lines are dropped first; neighbouring tablature lines fuse
    unless a blank stands between them. A chord line takes the next line that is
    not blank if that is a lyric. References, modulations and labelled chords
    stand alone and close what is open; a plain label closes and opens.
    """
    by = Window.partitionBy("id").orderBy("n")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = classified.where(~F.col("type").isin("HEADER", "BB_META"))
    fused = (F.col("type") == "TAB") & (F.lag("type").over(by) == "TAB")
    rows = rows.withColumns({"fused": fused, "island": F.sum(F.when(fused, 0).otherwise(1)).over(upto)})
    whole = Window.partitionBy("id", "island").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("tab", F.collect_list(F.when(F.col("type") == "TAB", F.col("line"))).over(whole))  # the first line of a tablature stands for it
    rows = rows.where("type <> 'BLANK' AND NOT coalesce(fused, false)")
    is_tab = F.col("type") == "TAB"
    rows = rows.select("id", "n", F.when(~is_tab, F.col("line")).alias("line"), "type", F.when(is_tab, F.col("tab")).alias("tab"))
    lyric, alone = ("LYRIC", "INLINE_CHORD_LYRIC"), ("SECTION_REF", "MODULATION", "SECTION_WITH_CHORDS")
    rows = rows.withColumns({"last": F.lag("type").over(by), "next": F.lead("type").over(by), "next_line": F.lead("line").over(by)})
    starts = F.col("type").isin(*alone, "PLAIN_SECTION") | F.coalesce(F.col("last").isin(*alone), F.lit(False))
    rows = rows.withColumn("section", F.sum(starts.cast("int")).over(upto))
    rows = rows.where(~(F.col("type").isin(*lyric) & F.coalesce(F.col("last") == "CHORD", F.lit(False))))
    pair = F.col("next").isin(*lyric)
    kind = F.when(F.col("type") == "TAB", "tab").when(F.col("type") == "CHORD", F.when(pair, "chord_lyric").otherwise("chord_only")).when(F.col("type").isin(*lyric), F.lower("type"))
    item = F.struct(
        F.col("n"),
        kind.alias("type"),
        F.when(F.col("type") == "CHORD", F.col("line")).alias("chords"),
        F.when((F.col("type") == "CHORD") & pair, F.col("next_line")).alias("lyric"),
        F.when((F.col("type") == "CHORD") & pair, F.col("next")).alias("lyric_type"),
        F.when(F.col("type").isin(*lyric), F.col("line")).alias("text"),
        F.col("tab").alias("lines"),
    )
    own = lambda t, x: F.max(F.when(F.col("type") == t, x))
    parts = section_chords(F.col("line"))
    grouped = rows.groupBy("id", "section").agg(
        F.max(F.when(F.col("type").isin(*alone), F.col("type"))).alias("alone"),
        F.coalesce(own("PLAIN_SECTION", F.col("line")), own("SECTION_WITH_CHORDS", parts["label"])).alias("label"),
        own("SECTION_REF", F.col("line")).alias("ref"),
        own("MODULATION", F.col("line")).alias("text"),
        own("SECTION_WITH_CHORDS", parts["chords"]).alias("chords"),
        own("SECTION_WITH_CHORDS", parts["repeat"]).alias("repeat"),
        own("SECTION_WITH_CHORDS", parts["annotation"]).alias("annotation"),
        F.array_sort(F.collect_list(F.when(kind.isNotNull(), item))).alias("lines"),
    )
    named = F.when(F.col("alone") == "SECTION_REF", "ref").when(F.col("alone") == "MODULATION", "modulation").when(F.col("alone") == "SECTION_WITH_CHORDS", "section_with_chords")
    return grouped.select("id", "section", named.alias("type"), "label", "ref", "text", "chords", "repeat", "annotation", F.transform("lines", lambda x: x.dropFields("n")).alias("lines"))


def parse_charts(charts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per chart: id, the header's and meta line's fields with their defaults, and its sections in order.

    The first header and the first meta line count. The sounding key is the
    header's, else computed from the capo; a missing title is ``Unknown``.
    """
    classified = classified_lines(charts, id_col, text_col)
    first = lambda t: F.min(F.when(F.col("type") == t, F.struct("n", "line")))["line"]
    heads = classified.groupBy("id").agg(first("HEADER").alias("header"), first("BB_META").alias("meta"))
    heads = heads.select("id", parse_header(F.coalesce("header", F.lit(""))).alias("h"), parse_meta(F.coalesce("meta", F.lit(""))).alias("m"))
    built = sections(classified)
    columns = [c for c in built.columns if c != "id"]
    nested = built.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("sections"))
    sounding = F.coalesce(F.col("h.sounding_key"), pitch.sounding_key_in_sharps(F.col("h.written_key"), F.col("m.capo")))
    return heads.join(nested, "id", "left").select(
        "id",
        F.coalesce(empty_to_null(F.col("h.title")), F.lit("Unknown")).alias("title"),
        F.col("h.artist").alias("artist"),
        F.col("h.written_key").alias("written_key"),
        sounding.alias("sounding_key"),
        F.col("h.original_key").alias("original_key"),
        F.col("m.capo").alias("capo"),
        F.col("m.bpm").alias("bpm"),
        F.col("m.structure").alias("structure"),
        F.coalesce("sections", F.array()).alias("sections"),
    )


def inline_rows(text: Column) -> Column:
    """chords and lyric of a line with chords in braces: the chords padded to where they stand above the cleaned words."""
    between = F.split(text, r"\{[^}]+\}", -1)
    found = F.regexp_extract_all(text, F.lit(r"\{([^}]+)\}"), F.lit(1))
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("chord"))
    start = F.struct(F.lit("").alias("row"), F.lit(0).alias("at"))

    def place(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p["gap"])
        pad = F.greatest(F.lit(0), at - F.length(s["row"]))
        return F.struct(F.concat(s["row"], F.repeat(F.lit(" "), pad), p["chord"]).alias("row"), at.alias("at"))

    row = F.aggregate(pairs, start, place)["row"]
    return F.struct(F.when(F.size(found) > 0, row).alias("chords"), F.array_join(between, "").alias("lyric"))


def display(charts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """What is shown of each chart, from top to bottom: id, at (from 0), kind, label, chords, lyric, repeat, text.

    Lines are classified as the viewer does it. Headers, meta lines and blank ones
    are not shown. Neighbouring tablature lines are one element, its lines in
    ``text``. A chord line takes the next line that is not blank if that has words;
    chords written into the words are padded to stand above them, and then
    ``chords`` has both rows. References and labels are shown without brackets.
    """
    lyric = ("LYRIC", "INLINE_CHORD_LYRIC")
    classed = F.transform(lines(F.col(text_col)), lambda x: F.struct(x.alias("raw"), bind(full_trim(x), lambda s: F.struct(s.alias("line"), _class(s, True).alias("type"))).alias("c")))
    rows = charts.select(F.col(id_col).alias("id"), F.posexplode(classed).alias("n", "l")).select("id", "n", "l.raw", "l.c.line", "l.c.type")
    by = Window.partitionBy("id").orderBy("n")
    rows = rows.withColumn("first", ~F.coalesce((F.col("type") == "TAB") & (F.lag("type").over(by) == "TAB"), F.lit(False)))
    rows = rows.withColumn("block", F.count_if("first").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("tab", F.array_join(F.collect_list("line").over(whole), "\n")).where("first AND type <> 'BLANK'")
    rows = rows.withColumns({"before": F.lag("type").over(by), "next": F.lead("type").over(by), "next_line": F.lead("line").over(by)})
    taken = F.col("type").isin(*lyric) & F.coalesce(F.col("before") == "CHORD", F.lit(False))
    rows = rows.where(~F.col("type").isin("HEADER", "BB_META") & ~taken)
    own, is_ = F.col("line"), lambda *types: F.col("type").isin(*types)
    pair = is_("CHORD") & F.coalesce(F.col("next").isin(*lyric), F.lit(False))
    words_of = F.when(pair, F.col("next_line")).when(is_(*lyric), own)
    inline = F.when(F.when(pair, F.col("next")).otherwise(F.col("type")) == "INLINE_CHORD_LYRIC", inline_rows(words_of))
    bare = lambda x: F.regexp_replace(x, r"^\[|\]\z", "")
    rest = full_trim(F.regexp_extract(own, LABELLED, 2))
    kind = F.when(is_("CHORD"), F.when(pair, "chord_lyric").otherwise("chord_only")).otherwise(F.lower("type"))
    label = F.when(is_("PLAIN_SECTION"), own).when(is_("SECTION_REF"), bare(own)).when(is_("SECTION_WITH_CHORDS"), bare(F.regexp_extract(own, LABELLED, 1)))
    chords = F.when(is_("SECTION_WITH_CHORDS"), F.array_join(F.filter(_played(rest, True), pitch.is_chord), " ")).otherwise(F.nullif(F.concat_ws("\n", F.when(is_("CHORD"), F.col("raw")), inline["chords"]), F.lit("")))
    repeat = F.when(is_("SECTION_WITH_CHORDS"), empty_to_null(F.regexp_extract(rest, f"(?i){REPEAT}", 0)))
    text = F.when(is_("TAB"), F.col("tab")).when(is_("MODULATION"), own)
    at = (F.row_number().over(by) - 1).alias("at")
    return rows.select("id", at, kind.alias("kind"), label.alias("label"), chords.alias("chords"), F.coalesce(inline["lyric"], words_of).alias("lyric"), repeat.alias("repeat"), text.alias("text"))
