"""Pitch and chord arithmetic modulo 12 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import full_trim, words

# Fixed values.
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
ENHARMONIC = {"Db": "C#", "Eb": "D#", "Fb": "E", "Gb": "F#", "Ab": "G#", "Bb": "A#", "Cb": "B", "E#": "F", "B#": "C"}
FLAT_KEYS = ("F", "Bb", "Eb", "Ab", "Db", "Gb", "Dm", "Gm", "Cm", "Fm", "Bbm", "Ebm")
QUALITY = r"(?:maj7?|min7?|m7?|M7?|dim7?|aug|sus[24]?|add[0-9]+|[0-9]+[a-z]*)?"
ROOT = "[A-G][b#]?"
CHORD = rf"^({ROOT})({QUALITY})(/({ROOT}))?\z"
#: A chord inside a line; unlike a word boundary, the ends keep a bare sharp together.
CHORD_IN_LINE = rf"(?<![A-Za-z0-9#/])({ROOT}{QUALITY}(?:/{ROOT})?)(?![A-Za-z0-9#/])"
MODULATION = r"(?i)^(whole|half|1/2|\d+)\s+steps?\s+(up|down)\z"
STEPS = {"half": 1, "1/2": 1, "whole": 2, "1": 1, "2": 2}
CHORD_SHARE = 0.8


def _scale(names: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, names))


def normal_root(root: Column) -> Column:
    """Flats as sharps; other names stay."""
    known = F.create_map(*[F.lit(x) for pair in ENHARMONIC.items() for x in pair])
    return F.coalesce(known[root], root)


def root_index(root: Column) -> Column:
    """0 for C to 11 for B; null for what is no root."""
    at = F.array_position(_scale(SHARPS), normal_root(root)).cast("int")
    return F.when(at > 0, at - 1)


def root_name(index: Column, flats: Column | bool = False) -> Column:
    """The name of an index of any size, in sharps or flats."""
    at = F.pmod(index, F.lit(12)).cast("int") + 1
    flats = F.lit(flats) if isinstance(flats, bool) else flats
    return F.when(flats, F.element_at(_scale(FLATS), at)).otherwise(F.element_at(_scale(SHARPS), at))


def key_root(key: Column) -> Column:
    return F.regexp_replace(key, r"m\z", "")


def prefers_flats(key: Column) -> Column:
    return F.coalesce(key.isin(*FLAT_KEYS) | key_root(key).isin(*FLAT_KEYS), F.lit(False))


def key_delta(start: Column, end: Column) -> Column:
    """The shortest way in semitones, from -5 to 6."""
    up = F.pmod(root_index(key_root(end)) - root_index(key_root(start)), F.lit(12))
    return F.when(up > 6, up - 12).otherwise(up)


def _minor(key: Column) -> Column:
    return F.when(key.endswith("m"), "m").otherwise("")


def sounding_key(written: Column, capo: Column) -> Column:
    """The key that sounds with a capo, spelled in flats where either spelling is a flat key."""
    index = root_index(key_root(written)) + capo
    minor = _minor(written)
    flats = prefers_flats(F.concat(root_name(index), minor)) | prefers_flats(F.concat(root_name(index, True), minor))
    return F.when((F.coalesce(capo, F.lit(0)) == 0) | index.isNull(), written).otherwise(F.concat(root_name(index, flats), minor))


def sounding_key_in_sharps(written: Column, capo: Column) -> Column:
    """As sounding_key, but always spelled in sharps."""
    index = root_index(key_root(written)) + capo
    return F.when((F.coalesce(capo, F.lit(0)) == 0) | index.isNull(), written).otherwise(F.concat(root_name(index), _minor(written)))


def written_key(sounding: Column, capo: Column) -> Column:
    """The key to write so that ``sounding`` sounds with the capo."""
    index = root_index(key_root(sounding)) - capo
    name = F.concat(root_name(index, prefers_flats(sounding)), _minor(sounding))
    return F.when((F.coalesce(capo, F.lit(0)) == 0) | index.isNull(), sounding).otherwise(name)


def is_chord(token: Column) -> Column:
    """A chord token; one comma or full stop behind it is allowed."""
    return token.rlike(CHORD.removesuffix(r"\z") + r"[,.]?\z")


def transpose_chord(chord: Column, by: Column, flats: Column | bool = False) -> Column:
    """Moves root and bass; what is no chord stays."""
    part = lambda g: F.regexp_extract(chord, CHORD, g)
    bass = F.when(part(4) != "", F.concat(F.lit("/"), root_name(root_index(part(4)) + by, flats))).otherwise("")
    return F.when(chord.rlike(CHORD), F.concat(root_name(root_index(part(1)) + by, flats), part(2), bass)).otherwise(chord)


def _replace_each(x: Column, pattern: str, what) -> Column:
    between = F.split(x, pattern, -1)
    moved = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), what)
    return F.concat_ws("", F.zip_with(between, moved, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))))


def transpose_line(line: Column, by: Column, flats: Column | bool = False) -> Column:
    """Moves all chords of a line and keeps what is between them."""
    return _replace_each(line, CHORD_IN_LINE, lambda c: transpose_chord(c, by, flats))


def transpose_inline(line: Column, by: Column, flats: Column | bool = False) -> Column:
    """Moves chords in braces."""
    pattern = r"(?<=\{)([A-G][b#]?[^}]*)(?=\})"
    return _replace_each(line, pattern, lambda c: transpose_chord(c, by, flats))


def transpose_section(line: Column, by: Column, flats: Column | bool = False) -> Column:
    """Moves the chords behind a label in brackets."""
    pattern = r"^(\s*\[.+?\]\s*)(.+)\z"
    moved = F.concat(F.regexp_extract(line, pattern, 1), transpose_line(F.regexp_extract(line, pattern, 2), by, flats))
    return F.when(line.rlike(pattern), moved).otherwise(line)


def is_chord_line(line: Column) -> Column:
    """At least CHORD_SHARE of the tokens are chords."""
    tokens = words(line)
    return (F.size(tokens) > 0) & (F.size(F.filter(tokens, lambda t: t.rlike(CHORD))) >= CHORD_SHARE * F.size(tokens))


def is_section_with_chords(line: Column) -> Column:
    return full_trim(line).rlike(r"^\[.+?\]\s+[A-G]")


def transpose_chart(text: Column, by: Column, flats: Column | bool = False) -> Column:
    """Moves a whole chart; headers, meta lines, tablature, modulations, bare labels and words stay."""

    def one(line: Column) -> Column:
        bare = full_trim(line)
        keep = bare.startswith("#") | bare.startswith("BB:") | bare.rlike(r"^[eEbBgGdD][|\-]") | bare.rlike(MODULATION) | bare.rlike(r"^\[.+\]\z")
        return (
            F.when(keep, line)
            .when(is_section_with_chords(line), transpose_section(line, by, flats))
            .when(line.rlike(r"\{[A-G][b#]?[^}]*\}"), transpose_inline(line, by, flats))
            .when(is_chord_line(line), transpose_line(line, by, flats))
            .otherwise(line)
        )

    return F.when(F.coalesce(by, F.lit(0)) == 0, text).otherwise(F.array_join(F.transform(F.split(text, "\n", -1), one), "\n"))


def transpose_chart_to(text: Column, start: Column, end: Column) -> Column:
    """From one key to another, spelled as the key that is aimed at."""
    return transpose_chart(text, key_delta(start, end), prefers_flats(end))


def step_size(label: Column, direction: Column) -> Column:
    """Semitones of a step's name, 1 for an unknown one; negative unless up."""
    known = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])
    size = F.coalesce(known[F.lower(label)], F.lit(1))
    return F.when(direction == "up", size).otherwise(-size)
