"""Text as column expressions: trimming, folding, HTML to plain lines, splitting, tolerant JSON.

Everything here stays in the JVM; nothing is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of ECMAScript, as a regex class body.
SPACE = r"\t\n\x0B\f\r " + "".join(rf"\x{{{c:X}}}" for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entities in the order in which they are decoded; ``&amp;lt;`` thus decodes twice.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def full_trim(x: Column) -> Column:
    """Drops white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(x, f"^[{SPACE}]+", ""), rf"[{SPACE}]+\z", "")


def ascii_fold(x: Column) -> Column:
    """Lower case for ASCII letters only, so that É and é stay different."""
    return F.translate(x, _UPPER, _LOWER)


def contains_fold(x: Column, part: str) -> Column:
    """LIKE '%part%' whatever the case of ASCII letters, in which % and _ of ``part`` are wildcards and nothing escapes."""
    return F.like(ascii_fold(x), F.lit(f"%{part.translate(str.maketrans(_UPPER, _LOWER))}%"), F.lit("\u0001"))


def empty_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def words(x: Column) -> Column:
    """The tokens between white space."""
    return F.filter(F.split(x, f"[{SPACE}]+"), lambda t: t != "")


def comma_list(x: Column) -> Column:
    """A comma-separated list, trimmed, without empty items."""
    return F.filter(F.transform(F.split(x, ","), full_trim), lambda t: t != "")


def lines(x: Column) -> Column:
    """The lines of a text; CRLF and lone CR count as line ends."""
    return F.split(F.regexp_replace(x, r"\r\n?", "\n"), "\n", -1)


def strip_tags(x: Column) -> Column:
    return full_trim(F.regexp_replace(x, "<[^>]+>", ""))


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f mentions it."""
    return F.transform(F.array(x), f)[0]


def replace_each(x: Column, pattern: str, group: int, what) -> Column:
    """Replaces every match by ``what`` (its group), where a replacement string cannot say it.

    The text between the matches and the rewritten matches are put together
    again alternately.
    """

    def put(v: Column) -> Column:
        found = F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(group)), what)
        return F.array_join(F.zip_with(F.split(v, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return bind(x, put)


def html_to_text(html: Column) -> Column:
    """HTML as lines: cells of tables from left to right, ``# `` before first headings, a line for each paragraph.

    Tags inside headings, paragraphs and cells are dropped before line breaks
    are looked at, so a br inside one of those leaves nothing. The p pattern
    takes any tag that begins with p.
    """
    # The patterns, in the order in which they apply.
    whole_table, cell = r"(?is)<table.*?</table>", r"(?is)<td.*?>(.*?)</td>"
    first_heading, heading = r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<h[23][^>]*>(.*?)</h[23]>"
    paragraph, line_break, tag = r"(?is)<p[^>]*>(.*?)</p>", r"(?i)<br\s*/?>", "<[^>]+>"
    table = lambda t: F.concat(F.array_join(F.transform(F.regexp_extract_all(t, F.lit(cell), F.lit(1)), strip_tags), "\n"), F.lit("\n"))
    x = replace_each(html, whole_table, 0, table)
    x = replace_each(x, first_heading, 1, lambda t: F.concat(F.lit("\n# "), strip_tags(t), F.lit("\n")))
    x = replace_each(x, heading, 1, lambda t: F.concat(F.lit("\n"), strip_tags(t), F.lit("\n")))
    x = replace_each(x, paragraph, 1, lambda t: F.concat(strip_tags(t), F.lit("\n")))
    x = F.regexp_replace(F.regexp_replace(x, line_break, "\n"), tag, "")
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.when(html.isNotNull(), full_trim(F.regexp_replace(x, "\n{3,}", "\n\n")))


def split_documents(text: Column, marker: str = r"#[ \t]+\S") -> Column:
    """Blocks that each begin at a header line; what stands before the first header is dropped."""
    blocks = F.split(F.concat(F.lit("\n"), text), rf"\n(?={marker})", -1)
    return F.filter(F.transform(blocks, full_trim), lambda b: b.rlike(f"^{marker}"))


# Model replies


def strip_thoughts(x: Column) -> Column:
    """Without <think> blocks."""
    return full_trim(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""))


def strip_fences(x: Column) -> Column:
    """Without a Markdown fence around the text."""
    return full_trim(F.regexp_replace(F.regexp_replace(full_trim(x), r"^```(?:json)?\s*", ""), r"\s*```\z", ""))


def outer_braces(x: Column) -> Column:
    """From the first brace to the last, or null."""
    return empty_to_null(F.regexp_extract(x, r"(?s)\{.*\}", 0))


def tolerant_json(x: Column) -> Column:
    """The JSON object of a reply as a string: strictly, else without thoughts and fences, else between the outer braces; null if there is none."""
    clean = strip_fences(strip_thoughts(x))
    tries = [x, clean, outer_braces(clean)]
    valid = [F.when(F.get_json_object(t, "$").isNotNull() & full_trim(t).startswith("{") & F.try_parse_json(t).isNotNull(), t) for t in tries]
    return F.coalesce(*valid)


def handoff_fields(text: Column, tag: str) -> Column:
    """Bold-labelled fields (``**name:** value``) of a tagged block, as a map; null without the block."""
    block = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    field = r"\*\*([^*:]+):?\*\*:?[ \t]*([^\n]*)"
    names = F.transform(F.regexp_extract_all(block, F.lit(field), F.lit(1)), full_trim)
    values = F.transform(F.regexp_extract_all(block, F.lit(field), F.lit(2)), full_trim)
    return F.when(text.rlike(rf"(?s)<{tag}>.*?</{tag}>"), F.map_from_arrays(names, values))


def any_keyword(text: Column, keywords: Column) -> Column:
    """Whether any of the keywords occurs, whatever its case."""
    return F.exists(keywords, lambda k: F.lower(text).contains(F.lower(k)))
