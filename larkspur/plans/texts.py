"""Queries over documents, pages and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pitch, sql, text
from ..operators import charts, keywords
from ..sources.tables import read_table
from .registry import query

# SQL that rewrites each match, as replace_each does: text between the matches, then the rewritten match.
_STRIP = "regexp_replace({}, '<[^>]+>', '', 'g')"
_EACH = "list_aggregate(list_transform(list_zip(regexp_split_to_array({x}, '{p}'), regexp_extract_all({x}, '{p}', {g})), lambda p: p[1] || coalesce({w}, '')), 'string_agg', '')"


def _each(x: str, p: str, w: str, g: int = 1) -> str:
    return _EACH.format(x=x, p=p, g=g, w=w)


_WS = r"[\s\x{00A0}\x{FEFF}]+"


def _trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_WS}', ''), '{_WS}$', '')"


_INNER = _trim(_STRIP.format("p[2]"))
_CELL = r"(?i)<td[\s\S]*?>([\s\S]*?)</td>"
_TABLE = f"list_aggregate(list_transform(regexp_extract_all(p[2], '{_CELL}', 1), lambda c: {_trim(_STRIP.format('c'))}), 'string_agg', chr(10)) || chr(10)"
HTML_SQL = f"""
  WITH t0 AS (SELECT page_id, html AS x FROM pages),
  t1 AS (SELECT page_id, {_each('x', r'(?i)<table[\s\S]*?</table>', _TABLE, 0)} AS x FROM t0),
  t2 AS (SELECT page_id, {_each('x', r'(?i)<h1[^>]*>([\s\S]*?)</h1>', f"CASE WHEN p[2] IS NOT NULL THEN chr(10) || '# ' || {_INNER} || chr(10) END")} AS x FROM t1),
  t3 AS (SELECT page_id, {_each('x', r'(?i)<h[23][^>]*>([\s\S]*?)</h[23]>', f"CASE WHEN p[2] IS NOT NULL THEN chr(10) || {_INNER} || chr(10) END")} AS x FROM t2),
  t4 AS (SELECT page_id, {_each('x', r'(?i)<p[^>]*>([\s\S]*?)</p>', f"CASE WHEN p[2] IS NOT NULL THEN {_INNER} || chr(10) END")} AS x FROM t3),
  t5 AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS x FROM t4),
  t6 AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' ') AS x FROM t5)
  SELECT page_id, {_trim("regexp_replace(x, '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM t6
"""


@query(HTML_SQL)
def txt_html_to_text(spark, d):
    return read_table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {_trim(_STRIP.format('html'))} AS text FROM pages")
def txt_strip_tags(spark, d):
    return read_table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


_HEADED = "'before' || chr(10) || '# one' || chr(10) || text || chr(10) || '#two' || chr(10) || '# three' || chr(10) || lang"


@query(f"SELECT doc_id, unnest(['# one' || chr(10) || {_trim('text')} || chr(10) || '#two', '# three' || chr(10) || lang]) AS block FROM documents")
def txt_split_docs(spark, d):
    docs = read_table(spark, d, "documents")
    whole = F.concat_ws("\n", F.lit("before\n# one"), text.full_trim(F.col("text")), F.lit("#two\n# three"), F.col("lang"))
    return docs.select("doc_id", F.explode(text.split_documents(whole)).alias("block"))


#: Chart lines made of a part's number, so that SQL can make the same ones.
_LINES = "list_value(p_name, '# ' || p_name, 'BB: ' || p_brand, 'G  D/F# Em7 C', '[Intro] G D  4X', '[CHORUS]', 'Verse ' || p_size, 'e--3--0--2--|', '1/2 step up', '{D}Well ' || p_name, '', 'G D ' || p_name)"
_KINDS = "['LYRIC', 'HEADER', 'BB_META', 'CHORD', 'SECTION_WITH_CHORDS', 'SECTION_REF', 'PLAIN_SECTION', 'TAB', 'MODULATION', 'INLINE_CHORD_LYRIC', 'BLANK', 'LYRIC']"


def _chart(part):
    parts = [F.col("p_name"), F.concat(F.lit("# "), "p_name"), F.concat(F.lit("BB: "), "p_brand"), *map(F.lit, ("G  D/F# Em7 C", "[Intro] G D  4X", "[CHORUS]"))]
    parts += [F.concat(F.lit("Verse "), F.col("p_size").cast("string")), F.lit("e--3--0--2--|"), F.lit("1/2 step up"), F.concat(F.lit("{D}Well "), "p_name"), F.lit(""), F.concat(F.lit("G D "), "p_name")]
    return part.select("p_partkey", F.concat_ws("\n", *parts).alias("chart"))


@query(f"SELECT p_partkey AS id, unnest(range(12))::INT AS n, unnest({_LINES}) AS line, unnest({_KINDS}) AS type FROM part")
def txt_classify(spark, d):
    return charts.classified_lines(_chart(read_table(spark, d, "part")), "p_partkey", "chart").select("id", "n", "line", "type")


def _class_sql(s: str, viewer: bool = False) -> str:
    """SQL for the class of a trimmed line: the whole chain of conditions."""
    split = lambda x: f"list_filter(string_split_regex({x}, '[{text.SPACE}]+'), lambda t: t <> '')"
    chord = rf"regexp_matches(t, '{pitch.CHORD.removesuffix(chr(92) + 'z')}[,.]?\z')"
    repeat = f"regexp_matches(t, '{'(?i)' if viewer else ''}{charts.REPEAT}')"
    filler = "" if viewer else f" AND lower(t) NOT IN {charts.FILLERS}"
    rest = f"regexp_extract({s}, '{charts.LABELLED}', 2)"
    played = f"list_filter({split(rest)}, lambda t: NOT {repeat}{filler})"
    share = lambda tokens, least: f"len(list_filter({tokens}, lambda t: {chord})) >= {least} * len({tokens})"
    named = "|".join(charts.VIEWER_SECTIONS if viewer else charts.SECTIONS)
    return rf"""CASE WHEN coalesce({s}, '') = '' THEN 'BLANK' WHEN starts_with({s}, '#') THEN 'HEADER' WHEN starts_with({s}, 'BB:') THEN 'BB_META'
      WHEN regexp_matches({s}, '{charts.TAB}') THEN 'TAB' WHEN regexp_matches({s}, '{pitch.MODULATION}') THEN 'MODULATION'
      WHEN regexp_matches({s}, '{charts.INLINE}') THEN 'INLINE_CHORD_LYRIC'
      WHEN regexp_matches({s}, '{charts.LABELLED}') AND len({played}) > 0 AND {share(played, charts.SECTION_SHARE)} THEN 'SECTION_WITH_CHORDS'
      WHEN regexp_matches({s}, '^\[.+\]\z') THEN 'SECTION_REF' WHEN regexp_matches({s}, '(?i)^({named})(\s+\d+)?[:\s]*\z') THEN 'PLAIN_SECTION'
      WHEN {share(split(s), charts.CHORD_SHARE)} THEN 'CHORD' ELSE 'LYRIC' END"""


def _trimmed(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{text.SPACE}]+', ''), '[{text.SPACE}]+\z', '')"


def _lines_sql(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '\r\n?', chr(10), 'g'), chr(10))"


@query(f"SELECT {_class_sql('line')} AS type, count(*) AS n FROM (SELECT {_trimmed('line')} AS line FROM (SELECT unnest({_lines_sql('text')}) AS line FROM documents)) GROUP BY 1")
def txt_classify_documents(spark, d):
    found = charts.classified_lines(read_table(spark, d, "documents"), "doc_id", "text")
    return found.groupBy("type").agg(F.count("*").alias("n"))


#: A chart of every kind of element, from a part's columns.
_SHOWN = ("'# ' || p_name", "'BB: x'", "'Verse ' || p_size", "'  G   D'", "''", "p_name", "'Em7 C'", "'{D}Well ' || p_name || ' {E7} oh'", "'e--3--0--2--|'", "'B--1--1--1--|'", "''", "'G--1--1--1--|'", "'[CHORUS]'", "'1/2 step up'", "'[Intro] G D  4x'", "'G D'", "'Outro'", "p_brand", "'oh {G}my {C}' || p_brand", "'C  G'", "'[Solo ' || p_size || ']'", "'D'")
_INLINE_SQL = r"""list_reduce(list_transform(range(1, len(found) + 1), lambda i: {'row': found[i], 'at': list_sum(list_transform(gaps[1:i], lambda g: length(g)))::INT}),
  lambda a, b: {'row': rpad(a.row, greatest(b.at, length(a.row))::INT, ' ') || b.row, 'at': b.at}, {'row': '', 'at': 0}).row"""


@query(rf"""
    WITH l AS (
      SELECT p_partkey AS id, unnest(range({len(_SHOWN)})) AS n, unnest(list_value({', '.join(_SHOWN)})) AS raw FROM part
    ), c AS (
      SELECT *, {_class_sql('line', True)} AS type FROM (SELECT *, {_trimmed('raw')} AS line FROM l)
    ), t AS (
      SELECT *, NOT coalesce(type = 'TAB' AND lag(type) OVER (PARTITION BY id ORDER BY n) = 'TAB', false) AS first FROM c
    ), k AS (
      SELECT *, count(*) FILTER (first) OVER (PARTITION BY id ORDER BY n) AS block FROM t
    ), b AS (
      SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY id, block ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tab FROM k
    ), w AS (
      SELECT *, lag(type) OVER o AS before, lead(type) OVER o AS follows, lead(line) OVER o AS next_line FROM b WHERE first AND type <> 'BLANK' WINDOW o AS (PARTITION BY id ORDER BY n)
    ), s AS (
      SELECT *, type = 'CHORD' AND coalesce(follows IN ('LYRIC', 'INLINE_CHORD_LYRIC'), false) AS pair FROM w
      WHERE type NOT IN ('HEADER', 'BB_META') AND NOT coalesce(type IN ('LYRIC', 'INLINE_CHORD_LYRIC') AND before = 'CHORD', false)
    ), v AS (
      SELECT *, CASE WHEN pair THEN next_line WHEN type IN ('LYRIC', 'INLINE_CHORD_LYRIC') THEN line END AS words, CASE WHEN pair THEN follows ELSE type END = 'INLINE_CHORD_LYRIC' AS inline FROM s
    ), x AS (
      SELECT *, string_split_regex(words, '\{{[^}}]+\}}') AS gaps, regexp_extract_all(words, '\{{([^}}]+)\}}', 1) AS found, trim(regexp_extract(line, '{charts.LABELLED}', 2)) AS rest FROM v
    )
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS at_, CASE WHEN pair THEN 'chord_lyric' WHEN type = 'CHORD' THEN 'chord_only' ELSE lower(type) END AS kind,
      CASE type WHEN 'PLAIN_SECTION' THEN line WHEN 'SECTION_REF' THEN line[2:-2] WHEN 'SECTION_WITH_CHORDS' THEN regexp_extract(line, '^\[(.+?)\]', 1) END AS label,
      CASE WHEN type = 'SECTION_WITH_CHORDS' THEN regexp_extract(rest, '^(.*?)\s+4x', 1) WHEN type = 'CHORD' AND inline THEN raw || chr(10) || {_INLINE_SQL} WHEN type = 'CHORD' THEN raw WHEN inline THEN {_INLINE_SQL} END AS chords,
      CASE WHEN inline THEN array_to_string(gaps, '') ELSE words END AS lyric, CASE WHEN type = 'SECTION_WITH_CHORDS' THEN '4x' END AS repeat, CASE type WHEN 'TAB' THEN tab WHEN 'MODULATION' THEN line END AS text
    FROM x
""")
def txt_display(spark, d):
    """Everything that is shown of a chart, in order."""
    chart = F.concat_ws("\n", *[F.expr(x) for x in _SHOWN])
    found = charts.display(read_table(spark, d, "part").select("p_partkey", chart.alias("chart")), "p_partkey", "chart")
    return found.withColumnRenamed("at", "at_")


@query(rf"""
    SELECT doc_id, n - 1 AS n, length(line) AS length, regexp_matches(line, '{pitch.CHORD.removesuffix(chr(92) + 'z')}[,.]?\z') AS chord FROM (
      SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, {_trimmed('unnest(l)')} AS line FROM (SELECT doc_id, {_lines_sql('text')} AS l FROM documents WHERE text IS NOT NULL))
""")
def sql_text_lines(spark, d):
    """Lines of all documents by a table function in LATERAL, trimmed and looked at by SQL functions."""
    sql.register(spark)
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, n, length(line) AS length, is_chord(line) AS chord FROM (SELECT doc_id, n, full_trim(raw) AS line FROM {docs}, LATERAL text_lines(text) AS l(n, raw))", docs=docs)


@query(f"SELECT doc_id, unnest([0, 1])::INT AS n, unnest(['# one' || chr(10) || {_trim('text')} || chr(10) || '#two', '# three' || chr(10) || lang]) AS block FROM documents")
def sql_split_documents(spark, d):
    """The same blocks as from the column function, by a table function in LATERAL."""
    sql.register(spark)
    whole = read_table(spark, d, "documents").selectExpr("doc_id", "concat_ws('\\n', 'before\\n# one', full_trim(text), '#two\\n# three', lang) AS whole")
    return spark.sql("SELECT doc_id, n, block FROM {docs}, LATERAL split_documents(whole) AS b(n, block)", docs=whole)


@query("SELECT p_partkey, p_name AS title, p_brand AS artist, ['C', 'F#', 'Bb', 'Am'][(p_partkey % 4)::INT + 1] AS written_key, CASE WHEN p_size % 2 = 0 THEN 'D' END AS sounding_key, CASE WHEN p_size % 3 = 0 THEN 'E' END AS original_key FROM part")
def txt_header(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("C", "F#", "Bb", "Am"))), (F.col("p_partkey") % 4).cast("int") + 1)
    line = F.concat(F.lit("# "), "p_name", F.lit(" – "), key, F.when(F.col("p_size") % 2 == 0, " (D)").otherwise(""), F.lit("\t\t"), "p_brand", F.when(F.col("p_size") % 3 == 0, "\tE").otherwise("\tno key"))
    return read_table(spark, d, "part").select("p_partkey", charts.parse_header(line).alias("h")).select("p_partkey", "h.*")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS capo, CASE WHEN p_size % 2 = 1 THEN 60 + p_size END AS bpm, 'VS / ' || p_type AS structure FROM part")
def txt_meta(spark, d):
    size = F.col("p_size")
    tail = F.when(size % 2 == 0, F.concat(F.lit("Capo "), size.cast("string"))).otherwise(F.concat(F.lit("D-"), (size + 60).cast("string")))
    line = F.concat(F.lit("BB: VS / "), "p_type", F.lit("\t"), tail)
    return read_table(spark, d, "part").select("p_partkey", charts.parse_meta(line).alias("m")).select("p_partkey", "m.*")


#: What the chart of _chart is parsed into: the words before the first standing label; a section for every line from there on that stands alone.
_SECTIONS = """
  SELECT p_partkey AS id, u.type, u.label, u.items FROM part, (VALUES
    (NULL, NULL, 'lyric,chord_only'), ('section_with_chords', '[Intro]', ''), ('ref', NULL, ''), (NULL, 'Verse', 'tab'), ('modulation', NULL, ''), (NULL, NULL, 'inline_chord_lyric,lyric')
  ) u(type, label, items)
"""


@query(_SECTIONS)
def txt_sections(spark, d):
    found = charts.sections(charts.classified_lines(_chart(read_table(spark, d, "part")), "p_partkey", "chart"))
    return found.select("id", "type", F.regexp_replace("label", r"\s\d+$", "").alias("label"), F.array_join(F.transform("lines", lambda x: x["type"]), ",").alias("items"))


@query(_SECTIONS)
def sql_chart_sections(spark, d):
    """The same sections by a table function over each chart's lines in order."""
    sql.register(spark)
    lines = charts.classified_lines(_chart(read_table(spark, d, "part")), "p_partkey", "chart")
    return spark.sql("SELECT id, type, regexp_replace(label, r'\\s\\d+$', '') AS label, items FROM chart_sections(TABLE(SELECT id, n, line, type FROM {lines}) PARTITION BY id ORDER BY n)", lines=lines)


@query(f"SELECT s.*, p_name AS title, p_brand AS structure FROM ({_SECTIONS}) s JOIN part ON p_partkey = s.id")
def txt_parse_doc(spark, d):
    """A row for each section of the parsed charts."""
    found = charts.parse_charts(_chart(read_table(spark, d, "part")), "p_partkey", "chart")
    found = found.select("id", "title", "structure", F.explode("sections").alias("s"))
    return found.select("id", "title", "structure", "s.type", F.regexp_replace("s.label", r"\s\d+$", "").alias("label"), F.array_join(F.transform("s.lines", lambda x: x["type"]), ",").alias("items"))


@query("SELECT p_partkey, '   D' || repeat(' ', length(p_name) - 1) || 'E7' AS chords, 'Oh ' || p_name || ' yeah' AS lyric FROM part")
def txt_inline_rows(spark, d):
    line = F.concat(F.lit("Oh {D}"), "p_name", F.lit("{E7} yeah"))
    return read_table(spark, d, "part").select("p_partkey", charts.inline_rows(line).alias("r")).select("p_partkey", "r.*")


@query("SELECT event_id, event_type AS answer FROM events")
def txt_think_strip(spark, d):
    reply = F.concat(F.lit("<think>first\n"), "props", F.lit("</think>\n<think>x</think> "), "event_type")
    return read_table(spark, d, "events").select("event_id", text.strip_thoughts(reply).alias("answer"))


@query("SELECT conv_id, turn, contains(lower(text), 'tion') OR contains(lower(text), 'wh of') AS hit FROM conversations")
def txt_keyword_any(spark, d):
    keywords = F.array(F.lit("TION"), F.lit("wh Of"))
    return read_table(spark, d, "conversations").select("conv_id", "turn", text.any_keyword(F.col("text"), keywords).alias("hit"))


@query("SELECT c.conv_id, c.turn, b.item_id FROM conversations c JOIN benchmark b ON contains(lower(c.text), lower(string_split(b.text, ' ')[1]))")
def join_keyword(spark, d):
    first = F.lower(F.split("text", " ")[0])
    words = read_table(spark, d, "benchmark").select("item_id", first.alias("word"))
    found = keywords.keyword_hits(read_table(spark, d, "conversations").select("conv_id", "turn", "text"), words, "text", "word")
    return found.select("conv_id", "turn", "item_id")


@query("SELECT doc_id, left(text, 200) AS head FROM documents")
def txt_trunc(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.left("text", F.lit(200)).alias("head"))


@query("SELECT event_id, event_type AS learned, CASE WHEN event_id % 2 = 0 THEN 'k' || user_id END AS next FROM events")
def txt_handoff(spark, d):
    block = F.concat(F.lit("talk <handoff>\n- **learned:** "), "event_type", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\n- **next**: k"), F.col("user_id").cast("string"))).otherwise(""), F.lit("\n</handoff> end"))
    fields = text.handoff_fields(block, "handoff")
    return read_table(spark, d, "events").select("event_id", fields["learned"].alias("learned"), fields["next"].alias("next"))


# Model replies: the clean object, thoughts, fences, prose around braces, and a broken one.


def _replies(spark, d):
    kind, clean = F.col("event_id") % 5, F.col("props")
    reply = F.when(kind == 0, clean).when(kind == 1, F.concat(F.lit("<think>{</think>\n"), clean)).when(kind == 2, F.concat(F.lit("```json\n"), clean, F.lit("\n```"))).when(kind == 3, F.concat(F.lit("Sure: "), clean, F.lit(" - done")))
    return read_table(spark, d, "events").withColumn("reply", reply.otherwise(F.concat(F.lit("{"), clean)))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN (props::JSON ->> 'k')::INT END AS k FROM events")
def json_outer(spark, d):
    return _replies(spark, d).select("event_id", F.get_json_object(text.tolerant_json(F.col("reply")), "$.k").cast("int").alias("k"))


@query("SELECT event_id, CASE event_id % 5 WHEN 1 THEN '<think>{</think>' || chr(10) || props WHEN 3 THEN 'Sure: ' || props || ' - done' WHEN 4 THEN '{' || props ELSE props END AS props FROM events")
def json_fenced(spark, d):
    return _replies(spark, d).select("event_id", text.strip_fences(F.col("reply")).alias("props"))


@query("SELECT event_id, CASE event_id % 5 WHEN 1 THEN '{</think>' || chr(10) || props WHEN 4 THEN '{' || props ELSE props END AS props FROM events")
def json_first_block(spark, d):
    return _replies(spark, d).select("event_id", text.outer_braces(F.col("reply")).alias("props"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS genre, coalesce(CASE WHEN event_id % 3 = 0 THEN 2 END, 0) AS tags, CASE WHEN event_id % 5 = 0 THEN 0.5::DOUBLE END AS confidence FROM events")
def json_typed(spark, d):
    n = F.col("event_id")
    genre = F.when(n % 2 == 0, F.concat(F.lit('"genre": "'), "event_type", F.lit('", '))).otherwise("")
    tags = F.when(n % 3 == 0, '["a", "b"]').otherwise('"none"')
    sure = F.when(n % 5 == 0, "0.5").otherwise('"high"')
    reply = F.parse_json(F.concat(F.lit("{"), genre, F.lit('"tags": '), tags, F.lit(', "confidence": '), sure, F.lit("}")))
    is_list = F.schema_of_variant(F.try_variant_get(reply, "$.tags", "variant")).startswith("ARRAY")
    number = F.schema_of_variant(F.try_variant_get(reply, "$.confidence", "variant")) != "STRING"
    size = F.when(is_list, F.size(F.try_variant_get(reply, "$.tags", "array<string>"))).otherwise(0)
    return read_table(spark, d, "events").select("event_id", F.try_variant_get(reply, "$.genre", "string").alias("genre"), size.alias("tags"), F.when(number, F.try_variant_get(reply, "$.confidence", "double")).alias("confidence"))


@query("SELECT event_id, 'mid' AS verdict, coalesce((props::JSON ->> 'score')::INT, 50) AS score, '' AS summary FROM events")
def json_defaults(spark, d):
    got = lambda k: F.get_json_object("props", f"$.{k}")
    return read_table(spark, d, "events").select("event_id", F.coalesce(got("verdict"), F.lit("mid")).alias("verdict"), F.coalesce(got("score").cast("int"), F.lit(50)).alias("score"), F.coalesce(got("summary"), F.lit("")).alias("summary"))
