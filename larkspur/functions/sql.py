"""Functions of the library under names that SQL can call: scalar and table functions, and a table function in Python over ordered partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import pitch, text

_TRIM = "regexp_replace(regexp_replace({0}, r'^[{1}]+', ''), r'[{1}]+\\z', '')"  # in table functions SQL takes no function of its own
_MARK = r"#[ \t]+\S"

#: name(parameters) -> the body of CREATE TEMPORARY FUNCTION.
FUNCTIONS = {
    "full_trim(x STRING)": f"RETURNS STRING RETURN {_TRIM.format('x', text.SPACE)}",
    "ascii_fold(x STRING)": "RETURNS STRING RETURN translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    "is_chord(x STRING)": rf"RETURNS BOOLEAN RETURN rlike(x, r'{pitch.CHORD.removesuffix(chr(92) + 'z')}[,.]?\z')",
    "text_lines(x STRING)": r"RETURNS TABLE(n INT, line STRING) RETURN SELECT pos, col FROM (SELECT posexplode(split(regexp_replace(x, r'\r\n?', '\n'), '\n', -1)))",
    "split_documents(x STRING)": rf"RETURNS TABLE(n INT, block STRING) RETURN SELECT pos, col FROM (SELECT posexplode(filter(transform(split(concat('\n', x), r'\n(?={_MARK})', -1), b -> {_TRIM.format('b', text.SPACE)}), b -> rlike(b, r'^{_MARK}'))))",
}


@udtf(returnType="id long, section long, type string, label string, items string")
class ChartSections:
    """Sections of one chart's classified lines (id: a whole number, n, line, type), as ``charts.sections`` gives them: TABLE(...) PARTITION BY id ORDER BY n.

    Only the section under way is held, not the chart.
    """

    def __init__(self) -> None:
        self.section, self.kind, self.label, self.items = 0, None, None, []
        self.open, self.after, self.chord, self.tab, self.id = False, False, False, False, None

    def _close(self) -> Iterator[tuple]:
        if self.open:
            yield self.id, self.section, self.kind, self.label, ",".join(self.items)
        self.open, self.items = False, []

    def eval(self, row: Row) -> Iterator[tuple]:
        kind, line, self.id = row["type"], row["line"], row["id"]
        if kind in ("HEADER", "BB_META"):
            return
        if kind == "BLANK":
            self.tab = False
            return
        alone = {"SECTION_REF": "ref", "MODULATION": "modulation", "SECTION_WITH_CHORDS": "section_with_chords"}.get(kind)
        if alone or kind == "PLAIN_SECTION" or self.after:
            yield from self._close()
            self.section += 1
            self.kind, self.label = alone, None
        fused = kind == "TAB" and self.tab
        if alone == "section_with_chords":
            self.label = line[: line.index("]") + 1]
        elif kind == "PLAIN_SECTION":
            self.label = line
        elif kind in ("LYRIC", "INLINE_CHORD_LYRIC") and self.chord:
            self.items[-1] = "chord_lyric"
        elif not alone and not fused:
            self.items.append({"TAB": "tab", "CHORD": "chord_only"}.get(kind, kind.lower()))
        self.open, self.after, self.chord, self.tab = True, alone is not None, kind == "CHORD", kind == "TAB"

    def terminate(self) -> Iterator[tuple]:
        yield from self._close()


def register(spark: SparkSession) -> None:
    """Makes all of them known to the session: scalars anywhere in SQL, tables in FROM and LATERAL."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {body}")
    spark.udtf.register("chart_sections", ChartSections)
