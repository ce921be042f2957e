"""Chart parsing and transposition on small rows."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import pitch
from larkspur.operators import charts

CASES = [
    ("", "BLANK"), ("  \t", "BLANK"), (None, "BLANK"),
    ("# Song – G", "HEADER"), ("## x", "HEADER"),
    ("BB: VS / CH", "BB_META"), ("bb: x", "LYRIC"),
    ("e--5-2-0--|", "TAB"), ("B|--3--", "TAB"), ("A|--3--", "LYRIC"),
    ("Whole step up", "MODULATION"), ("1/2 steps DOWN", "MODULATION"), ("half step sideways", "LYRIC"),
    ("{D}Well she was", "INLINE_CHORD_LYRIC"), ("{x} no chord", "LYRIC"),
    ("[Intro] G D C  4X", "SECTION_WITH_CHORDS"), ("[Outro] G D fade on last", "SECTION_WITH_CHORDS"), ("[Intro] play it again", "LYRIC"),
    ("[CHORUS]", "SECTION_REF"), ("[A] [B]", "SECTION_REF"),
    ("Verse 1", "PLAIN_SECTION"), ("pre-chorus:", "PLAIN_SECTION"), ("Middle", "PLAIN_SECTION"), ("Verses", "LYRIC"),
    ("G D/F# Em7 C", "CHORD"), ("G, D. C", "CHORD"), ("A7sus4", "LYRIC"), ("F#m7b5", "LYRIC"), ("Cmaj9", "LYRIC"), ("C6/9", "LYRIC"), ("Cadd9", "CHORD"),
    ("G D C well A", "CHORD"), ("A day in the life", "LYRIC"),
]


def test_line_classes(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, line string")
    got = {r.i: r.t for r in df.select("i", charts.classify(F.col("line")).alias("t")).collect()}
    assert got == {i: c[1] for i, c in enumerate(CASES)}
    assert {t for _, t in CASES} == set(charts.TYPES)


def test_viewer_knows_fewer_sections(spark):
    df = spark.createDataFrame([("Middle",), ("Chorus 2",), ("[Out] G end",)], "line string")
    got = [r[0] for r in df.select(charts.classify(F.col("line"), viewer=True)).collect()]
    assert got == ["LYRIC", "PLAIN_SECTION", "LYRIC"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("# Blue Road – Am (Bm)\tThe Band", ("Blue Road", "The Band", "Am", "Bm", None)),
        ("# Old Song - G\t\tSomeone\tE", ("Old Song", "Someone", "G", None, "E")),
        ("# Up-Down – C\t38 Gates\tnot a key", ("Up", "38 Gates", "D", None, None)),
        ("# Up-down – C\t38 Gates\tnot a key", ("Up-down", "38 Gates", "C", None, None)),
        ("# A-B Side", ("A", None, "B", None, None)),
        ("# Plain", ("Plain", None, None, None, None)),
        ("#", ("", None, None, None, None)),
    ],
)
def test_headers(spark, line, want):
    row = spark.createDataFrame([(line,)], "x string").select(charts.parse_header(F.col("x")).alias("h")).first().h
    assert tuple(row) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("BB: Intro / VS-CH\tCapo 2", (2, None, "Intro / VS-CH")),
        ("BB: VS / BR / End\tD-114", (0, 114, "VS / BR / End")),
        ("BB: VS D-96", (0, 96, "VS")),
        ("BB: VS\tBb-114", (0, None, "VS")),
        ("BB:", (0, None, None)),
    ],
)
def test_meta_lines(spark, line, want):
    row = spark.createDataFrame([(line,)], "x string").select(charts.parse_meta(F.col("x")).alias("m")).first().m
    assert tuple(row) == want


DOC = "\n".join(["# Road – G (A)\tBand\tE", "BB: VS / CH\tCapo 2", "Verse 1", "G   D", "", "walking home", "Em C", "e--0--0--|", "B--1--1--|", "", "G--0--0--|", "[CHORUS]", "{D}sing {E7}it", "Whole step up", "[Solo] A D  4X (x4)", "Verse 2", "Outro", "the end"])


def test_whole_chart(spark):
    df = spark.createDataFrame([(1, DOC), (2, DOC.replace("\n", "\r\n")), (3, ""), (4, None)], "id long, text string")
    got = {r.id: r for r in charts.parse_charts(df).collect()}
    one = got[1]
    assert (one.title, one.artist, one.written_key, one.sounding_key, one.original_key, one.capo, one.bpm, one.structure) == ("Road", "Band", "G", "A", "E", 2, None, "VS / CH")
    shape = [(s.type, s.label, s.ref, s.text, s.chords, s.repeat, [x.type for x in s.lines]) for s in one.sections]
    assert shape == [
        (None, "Verse 1", None, None, None, None, ["chord_lyric", "chord_only", "tab", "tab"]),
        ("ref", None, "[CHORUS]", None, None, None, []),
        (None, None, None, None, None, None, ["inline_chord_lyric"]),
        ("modulation", None, None, "Whole step up", None, None, []),
        ("section_with_chords", "[Solo]", None, None, "A D", "4X", []),
        (None, "Verse 2", None, None, None, None, []),
        (None, "Outro", None, None, None, None, ["lyric"]),
    ]
    first = one.sections[0].lines
    assert (first[0].chords, first[0].lyric, first[0].lyric_type) == ("G   D", "walking home", "LYRIC")
    assert [x.lines for x in first[2:]] == [["e--0--0--|", "B--1--1--|"], ["G--0--0--|"]]
    assert got[2].sections == one.sections and got[3].title == "Unknown" and got[3].sections == []
    assert charts.parse_charts(df.limit(0)).count() == 0


def test_inline_rows(spark):
    df = spark.createDataFrame([("{D}Well she {E7}was",), ("none",), ("{Dmaj7}a{G}b",)], "x string")
    got = [tuple(r[0]) for r in df.select(charts.inline_rows(F.col("x"))).collect()]
    assert got == [("D        E7", "Well she was"), (None, "none"), ("Dmaj7G", "ab")]


def moved(spark, expr, *values):
    return spark.range(1).select(expr(*map(F.lit, values))).first()[0]


def test_keys(spark):
    assert [moved(spark, pitch.key_delta, a, b) for a, b in (("C", "G"), ("C", "F#"), ("Am", "Gm"), ("Bb", "A#"), ("H", "C"))] == [-5, 6, -2, 0, None]
    assert [moved(spark, pitch.sounding_key, k, c) for k, c in (("G", 3), ("C", 1), ("Am", 2), ("G", 0), ("E", 12))] == ["Bb", "Db", "Bm", "G", "E"]
    assert moved(spark, pitch.sounding_key_in_sharps, "G", 3) == "A#"
    assert [moved(spark, pitch.written_key, k, c) for k, c in (("Bb", 3), ("A", 2), ("Gm", 0))] == ["G", "G", "Gm"]
    index = {n: i for i, n in enumerate(pitch.SHARPS)}
    for k in pitch.SHARPS:
        for c in (1, 5, 11):
            back = moved(spark, pitch.written_key, moved(spark, pitch.sounding_key, k, c), c)
            assert index[pitch.ENHARMONIC.get(back, back)] == index[k]


def test_transposed_lines(spark):
    line = lambda x, n, flats=False: spark.range(1).select(pitch.transpose_line(F.lit(x), F.lit(n), flats)).first()[0]
    assert line("F#  G#m", 1) == "G  Am"
    assert line("G   D/F#  Em7", 2) == "A   E/G#  F#m7"
    assert line("G D", 3, True) == "Bb F"
    assert line("Hello G", 2) == "Hello A"
    assert line(line("C#m7  Asus4/E  Cadd9", 5), -5) == "C#m7  Asus4/E  Cadd9"
    chord = lambda x, n: spark.range(1).select(pitch.transpose_chord(F.lit(x), F.lit(n))).first()[0]
    assert [chord("Bbm7/F", 2), chord("word", 2), chord("C", -1), chord("B#", 1)] == ["Cm7/G", "word", "B", "C#"]


def test_transposed_chart(spark):
    chart = "# A – G\nBB: A / B\n[Intro] G D\n[A]\nG D Em\nA day in G\n{G}sing {D7}it\nG|--3--|\nWhole step up\nVerse"
    df = spark.createDataFrame([(chart,)], "x string")
    up = df.select(pitch.transpose_chart(F.col("x"), F.lit(2))).first()[0]
    assert up == "# A – G\nBB: A / B\n[Intro] A E\n[A]\nA E F#m\nA day in G\n{A}sing {E7}it\nG|--3--|\nWhole step up\nVerse"
    assert df.select(pitch.transpose_chart(F.col("x"), F.lit(0))).first()[0] == chart
    to = df.select(pitch.transpose_chart_to(F.col("x"), F.lit("G"), F.lit("Bb"))).first()[0]
    assert "[Intro] Bb F" in to and "{Bb}sing {F7}it" in to
    steps = [spark.range(1).select(pitch.step_size(F.lit(a), F.lit(b))).first()[0] for a, b in (("Whole", "up"), ("half", "down"), ("5", "up"))]
    assert steps == [2, -1, 1]
