"""Queries for the smaller operators: orders, single changes, dates, arrays, maps, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import pitch, scalars, text
from ..operators import cache, charts, importer, library, mutations
from ..operators.ordering import numbered
from ..sources import files, vector_index
from ..sources.tables import empty_table, first_row, open_catalogue, read_table, scratch_path, write_snapshot
from .registry import query
from .stand_ins import ENTRIES, HELD, LINKS, LISTS, SCALE, SONGS, entries, events, held, links, lists, songs

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format


# Sources


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'F'")
def src_cursor(spark, d):
    """A statement with bound parameters."""
    return spark.sql("SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate >= :since AND o_orderstatus = :status", args={"since": "1998-01-01", "status": "F"}, orders=read_table(spark, d, "orders"))


@query("SELECT min(p_partkey) AS p_partkey FROM part WHERE p_brand = 'Brand#3'")
def src_first(spark, d):
    found = first_row(read_table(spark, d, "part").where("p_brand = 'Brand#3'").orderBy("p_partkey").select("p_partkey"))
    return spark.createDataFrame([(found["p_partkey"] if found else None,)], "p_partkey long")


@query("SELECT 'songs' AS name, 23 AS columns, count(*) AS rows FROM part UNION ALL VALUES ('tags', 4, 0), ('song_tags', 2, 0), ('setlists', 6, 0), ('setlist_songs', 8, 0), ('import_log', 6, 0)")
def src_db_open(spark, d):
    """A catalogue is written and opened; its tables, their columns and rows."""
    path = scratch_path(spark, "opened")
    write_snapshot({"songs": empty_table(spark, "songs").unionByName(songs(spark, d), allowMissingColumns=True)}, path)
    counts = [t.agg(F.lit(name).alias("name"), F.lit(len(t.columns)).alias("columns"), F.count("*").alias("rows")) for name, t in open_catalogue(spark, path).items()]
    return reduce(lambda a, b: a.union(b), counts)


_ABOUT = "trim(CASE WHEN label % 3 = 0 THEN ' ' ELSE 'about ' || label END) <> ''"


def _described(spark, d):
    """Vectors with a description that is not blank."""
    about = F.when(F.col("label") % 3 == 0, " ").otherwise(F.concat(F.lit("about "), F.col("label").cast("string")))
    return read_table(spark, d, "embeddings").withColumn("about", about).where(F.trim("about") != "")


def _stored_index(spark, d):
    """An index that is built of a part of the described vectors, opened again, and grows by the rest in two batches."""
    path = scratch_path(spark, "index")
    rows = _described(spark, d).select(F.col("vec_id").alias("item_id"), "embedding", "label")
    vector_index.open_or_build(rows.where("item_id % 3 = 0"), path, carried=["label"])
    index = vector_index.open_or_build(rows.limit(0), path, carried=["label"])  # is there, so nothing is built
    for k in (1, 2):
        index = index.append(rows.where(F.col("item_id") % 3 == k))
    return vector_index.open_index(spark, path)


@query(f"SELECT vec_id, label FROM embeddings WHERE {_ABOUT}")
def src_vector_build(spark, d):
    """What a stored index of the vectors with a description holds."""
    return _stored_index(spark, d).items().select(F.col("item_id").alias("vec_id"), "label")


@query(f"WITH b AS (SELECT q.vec_id AS query_id, max_by(i.vec_id, [s, -i.vec_id]) AS item_id, max(s) AS similarity FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0 AND i.vec_id <> q.vec_id AND {_ABOUT.replace('label', 'i.label')}, LATERAL (SELECT list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s) GROUP BY 1) SELECT query_id, CASE WHEN similarity >= 0.45 THEN item_id END AS item_id, CASE WHEN similarity >= 0.45 THEN round(similarity, 6) END AS similarity FROM b")
def vec_index_search(spark, d):
    """The nearest described vector of each query, from the cells of a stored index that can hold it."""
    queries = read_table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = _stored_index(spark, d).search(queries, apart=True)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'asks' WHEN 'assistant' THEN 'replies' END AS content FROM conversations")
def src_file_by_key(spark, d):
    """What a file named like the lower-cased label holds, else null."""
    path = scratch_path(spark, "named")
    files.write_files(spark, path, {"user.gif": b"asks", "assistant.gif": b"replies", "other.gif": b"x"})
    rows = read_table(spark, d, "conversations").withColumn("label", F.upper("role"))
    found = files.content_by_label(rows, files.find_files(spark, path, "*.gif"), "label")
    return found.select("conv_id", "turn", F.col("file_content").cast("string").alias("content"))


_DOCX_TEXT = "'# ' || n_name || ' – G' || chr(9) || chr(9) || 'Region ' || n_regionkey || chr(10) || chr(10) || 'Verse & ' || n_regionkey || chr(10) || 'G  D' || chr(10) || 'words of ' || n_name || chr(10) || 'left ' || n_nationkey || chr(10) || 'right <' || n_name || '>' || chr(10) || 'end'"


@query(f"SELECT n_nationkey, CASE WHEN n_nationkey % 7 <> 3 THEN {_DOCX_TEXT} END AS text, CASE WHEN n_nationkey % 7 = 3 THEN 'not a word-processor file: BadZipFile' WHEN n_nationkey % 4 = 1 THEN 'no style is known as Fancy' ELSE '' END AS warnings FROM nation")
def src_docx(spark, d):
    """A word-processor file for each nation, with headings of two levels and a table, some of them broken, read back through HTML."""
    path = scratch_path(spark, "docx")
    made = {}
    for r in read_table(spark, d, "nation").collect():  # 25 rows at every size
        table = [[f"left {r.n_nationkey}", f"right <{r.n_name}>"]]
        page = files.docx([(f"{r.n_name} – G\t\tRegion {r.n_regionkey}", "Heading1"), (f"Verse & {r.n_regionkey}", "Heading2"), ("G  D", None), (f"words of {r.n_name}", "Fancy" if r.n_nationkey % 4 == 1 else None), table, ("end", None)])
        made[f"{r.n_nationkey}.docx"] = page if r.n_nationkey % 7 != 3 else b"broken"
    files.write_files(spark, path, made | {"~$1.docx": b"lock"})
    return files.read_docx(spark, path).select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("int").alias("n_nationkey"), "text", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 3 THEN 'error' WHEN n_nationkey % 5 = 0 THEN 'skipped' ELSE 'dryRun' END AS status, CASE WHEN n_nationkey % 7 <> 3 AND n_nationkey % 5 = 0 THEN n_nationkey::BIGINT END AS song_id FROM nation")
def imp_docx_dry(spark, d):
    """A dry run of the import from word-processor files: what would be taken, and which songs are there already."""
    path = scratch_path(spark, "docx")
    nations = read_table(spark, d, "nation")
    page = lambda r: files.docx([(f"{r.n_name} – G\t\tRegion {r.n_regionkey}", "Heading1"), ("words", None)])
    files.write_files(spark, path, {f"{r.n_nationkey}.docx": page(r) if r.n_nationkey % 7 != 3 else b"broken" for r in nations.collect()})  # 25 rows at every size
    known = nations.where("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("title"), F.concat(F.lit("REGION "), F.col("n_regionkey").cast("string")).alias("artist"))
    _, log = importer.import_charts(files.read_docx(spark, path), known, dry_run=True)
    return log.select(F.regexp_extract("source_file", r"(\d+)\.docx$", 1).cast("int").alias("n_nationkey"), "status", "song_id")


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size = 7")
def flt_empty_params(spark, d):
    rows = read_table(spark, d, "part")
    for column, value in cache.given(p_type="PROMO", p_brand="", p_name=None, p_size=7).items():
        rows = rows.where(F.col(column) == value)
    return rows.select("p_partkey")


# Orders


@query(f"WITH {SONGS} SELECT id, {_FOLD('artist')} AS key, row_number() OVER (ORDER BY {_FOLD('artist')} NULLS FIRST, id) - 1 AS rank FROM songs")
def sort_artist(spark, d):
    return numbered(library.search(songs(spark, d), sort="artist").select("id", text.ascii_fold(F.col("artist")).alias("key")), [], "rank")


@query(f"WITH {LINKS} SELECT name, n, category, row_number() OVER (ORDER BY category NULLS LAST, n DESC, name) - 1 AS rank FROM (SELECT name, count(*) AS n, CASE WHEN length(name) = 7 THEN NULL ELSE 'two' END AS category FROM links GROUP BY 1)")
def sort_multi_tags(spark, d):
    counts = links(spark, d).groupBy("name").agg(F.count("*").alias("n")).withColumn("category", F.when(F.length("name") != 7, "two"))
    return numbered(counts, [F.col("category").asc_nulls_last(), F.desc("n"), text.ascii_fold(F.col("name"))], "rank")


@query(f"WITH {LINKS} SELECT song_id, name, category, row_number() OVER (ORDER BY song_id, category NULLS LAST, name) - 1 AS rank FROM (SELECT *, CASE WHEN name IN ('Brand#2', 'Brand#4') THEN 'style' WHEN name <> 'Brand#1' THEN 'mood' END AS category FROM links)")
def sort_song_tags(spark, d):
    """A song's tags by category, those without one last, then by name."""
    category = F.when(F.col("name").isin("Brand#2", "Brand#4"), "style").when(F.col("name") != "Brand#1", "mood")
    return numbered(links(spark, d).withColumn("category", category), [F.col("song_id"), F.col("category").asc_nulls_last(), text.ascii_fold(F.col("name"))], "rank")


@query(f"WITH {ENTRIES} SELECT setlist_id, position, song_id, row_number() OVER (ORDER BY setlist_id, position, song_id) - 1 AS rank FROM entries")
def sort_position(spark, d):
    return numbered(entries(spark, d).select("setlist_id", "position", "song_id"), [F.col(c) for c in ("setlist_id", "position", "song_id")], "rank")


@query(f"WITH {LINKS} SELECT name, count(*) AS n FROM links GROUP BY 1")
def agg_child_count(spark, d):
    return links(spark, d).groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {SONGS} SELECT count(*) AS n FROM songs WHERE title ILIKE '%ring%' OR artist ILIKE '%ring%'")
def agg_result_len(spark, d):
    return library.search(songs(spark, d), query="ring").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS errors FROM events")
def agg_tag_totals(spark, d):
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    return read_table(spark, d, "events").agg(is_("purchase").alias("ok"), is_("view").alias("skipped"), is_("error").alias("errors"))


# Changes


@query("SELECT p_partkey, CASE WHEN p_partkey = 5 THEN 'new words' ELSE p_name END AS content, p_partkey = 5 AS synced FROM part")
def mut_update_content(spark, d):
    hit = F.col("p_partkey") == 5
    rows = read_table(spark, d, "part").select("p_partkey", F.col("p_name").alias("content"), F.lit(False).alias("synced"))
    return mutations.update_allowed(rows, hit, {"content": "new words", "synced": True}, ("content", "synced"))


@query(f"WITH {LINKS} SELECT name, CASE WHEN name = 'Brand#4' THEN 'Feel' END AS category FROM (SELECT DISTINCT name FROM links)")
def mut_tag_category(spark, d):
    tags = links(spark, d).select("name", F.lit(None).cast("string").alias("category")).distinct()
    return mutations.update_allowed(tags, F.col("name") == "Brand#4", {"category": "Feel"}, ("category",))


@query(f"WITH {LISTS} SELECT id, name, gig_date FROM lists UNION ALL SELECT (SELECT max(id) FROM lists) + row_number() OVER (ORDER BY c_name), c_name, NULL FROM customer")
def mut_setlist_create(spark, d):
    new = read_table(spark, d, "customer").select(F.col("c_name").alias("name"))
    return mutations.insert_rows(lists(spark, d), new, order="name").select("id", "name", "gig_date")


@query(f"WITH {LISTS} SELECT id, CASE WHEN id = 3 THEN 'renamed' ELSE name END AS name, id = 3 AS touched FROM lists")
def mut_setlist_update(spark, d):
    rows = lists(spark, d).select("id", "name").withColumn("touched", F.lit(False))
    return mutations.update_allowed(rows, F.col("id") == 3, {"name": "renamed", "touched": True, "id": 9}, ("name", "gig_date", "notes", "touched"))


@query(f"""
    WITH {HELD} SELECT id, array_to_string(list_sort(list_distinct(list_append(held, item))), ',') AS marked, array_to_string(list_filter(held, lambda x: x <> item), ',') AS cleared,
      CASE WHEN list_contains(held, item) THEN array_to_string(list_filter(held, lambda x: x <> item), ',') ELSE array_to_string(list_sort(list_append(held, item)), ',') END AS toggled, '' AS emptied FROM held""")
def mut_dirty_add(spark, d):
    edited, item = F.col("held"), F.col("item")
    sets = {"marked": cache.mark(edited, item), "cleared": cache.clear(edited, item), "toggled": cache.toggle(edited, item), "emptied": cache.clear_all(cache.mark(edited, item))}
    return held(spark, d).select("id", *[F.array_join(F.array_sort(x), ",").alias(n) for n, x in sets.items()])


@query("SELECT event_type AS key, max_by(value, [epoch_us(ts), event_id]) AS value FROM events GROUP BY 1")
def mut_kv_put(spark, d):
    rows = events(spark, d).select(F.col("event_type").alias("key"), "value", F.struct("ts", "event_id").alias("updated_at"))
    return cache.put_settings(rows.where("value < 0"), rows).select("key", "value")


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'Me' ELSE p_brand END AS artist FROM part")
def prj_backfill(spark, d):
    """New content is parsed again; what the request names wins over what was parsed."""
    part = read_table(spark, d, "part")
    parsed = part.select("p_partkey", charts.parse_header(F.concat(F.lit("# "), "p_name", F.lit(" – G\t"), "p_brand")).alias("h")).select("p_partkey", "h.title", "h.artist")
    body = part.where("p_size % 2 = 0").select("p_partkey", F.create_map(F.lit("artist"), F.lit("Me")).alias("fields"))
    return mutations.override(parsed, body, "p_partkey")


# Text and chords


@query("SELECT p_partkey, p_size % 3 <> 2 AS chord FROM part")
def txt_is_chord(spark, d):
    kind = F.col("p_size") % 3
    token = F.when(kind == 0, "Em7,").when(kind == 1, "Bb/F.").otherwise("A7sus4")
    return read_table(spark, d, "part").select("p_partkey", pitch.is_chord(token).alias("chord"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'LYRIC' WHEN 1 THEN 'PLAIN_SECTION' ELSE 'SECTION_WITH_CHORDS' END AS type FROM part")
def txt_classify_ui(spark, d):
    kind = F.col("p_size") % 3
    line = F.when(kind == 0, "Refrain").when(kind == 1, "Chorus 2:").otherwise("[Solo] G D (X4) 2X")
    return read_table(spark, d, "part").select("p_partkey", charts.classify(line, viewer=True).alias("type"))


@query("SELECT p_partkey, unnest([0, 1, 2])::INT AS at, unnest(['label', 'chords', 'lyric']) AS kind, unnest(['Verse', 'G  D', p_name]) AS shown FROM part")
def txt_render(spark, d):
    """What is shown of a chart, line by line: labels, then chords above the words they belong to."""
    chart = F.concat(F.lit("Verse\nG  D\n"), "p_name")
    found = charts.sections(charts.classified_lines(read_table(spark, d, "part").select("p_partkey", chart.alias("chart")), "p_partkey", "chart"))
    line = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("shown"))
    pairs = F.flatten(F.transform("lines", lambda x: F.array(line("chords", x["chords"]), line("lyric", F.coalesce(x["lyric"], x["text"])))))
    shown = F.filter(F.concat(F.array(line("label", F.col("label"))), pairs), lambda x: x["shown"].isNotNull())
    return found.select(F.col("id").alias("p_partkey"), F.posexplode(shown).alias("at", "x")).select("p_partkey", "at", "x.kind", "x.shown")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'nova' ELSE 'alloy' END AS voice FROM part")
def txt_voice(spark, d):
    """A label's voice from a table, with a default."""
    voices = F.create_map(F.lit("even"), F.lit("nova"))
    return read_table(spark, d, "part").select("p_partkey", F.coalesce(voices[F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")], F.lit("alloy")).alias("voice"))


@query(f"SELECT p_partkey, ({SCALE})[((p_partkey + p_size) % 12)::INT + 1] || 'm' AS key FROM part")
def mus_key_ui(spark, d):
    key = F.concat(pitch.root_name((F.col("p_partkey") % 12).cast("int")), F.lit("m"))
    return read_table(spark, d, "part").select("p_partkey", pitch.transpose_chord(key, F.col("p_size")).alias("key"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) > 100 AS long FROM documents")
def arr_filter_map(spark, d):
    return read_table(spark, d, "documents").select("doc_id", (F.size(text.words(F.col("text"))) > 100).alias("long"))


@query("SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 = 0 AS every, p_size % 2 = 0 OR p_size % 3 = 0 AS some, CASE WHEN p_size % 2 = 0 THEN 2 WHEN p_size % 3 = 0 THEN 3 END AS first FROM part")
def arr_every(spark, d):
    divisors, hit = F.array(F.lit(2), F.lit(3)), lambda n: F.col("p_size") % n == 0
    return read_table(spark, d, "part").select("p_partkey", F.forall(divisors, hit).alias("every"), F.exists(divisors, hit).alias("some"), F.try_element_at(F.filter(divisors, hit), F.lit(1)).alias("first"))


@query("SELECT doc_id, replace(text, chr(10), ' / ') AS joined FROM documents")
def arr_join(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.array_join(F.split("text", "\n", -1), " / ").alias("joined"))


@query("SELECT event_id, 2 + (user_id % 2 = 0)::INT + (value > 50)::INT AS n, CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR END AS conversation FROM events")
def map_set_attr(spark, d):
    """Attributes, of which those without a value are left out."""
    optional = F.create_map(F.lit("conversation"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")), F.lit("temperature"), F.when(F.col("value") > 50, "0.7"))
    attributes = F.map_concat(F.create_map(F.lit("system"), F.lit("x"), F.lit("operation"), F.col("event_type")), F.map_filter(optional, lambda _, v: v.isNotNull()))
    return read_table(spark, d, "events").select("event_id", F.size(attributes).alias("n"), attributes["conversation"].alias("conversation"))


# Model replies


@query("SELECT event_id, props FROM events")
def json_fence_split(spark, d):
    reply = F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))
    part = F.split(reply, "```")[1]
    return read_table(spark, d, "events").select("event_id", text.full_trim(F.regexp_replace(part, "^json", "")).alias("props"))


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def json_fence_js(spark, d):
    reply = F.concat(F.lit("```json\n"), "props", F.lit("\n```  "))
    return read_table(spark, d, "events").select("event_id", F.get_json_object(text.strip_fences(reply), "$.k").cast("int").alias("k"))


@query("SELECT event_id, value > 30 AS same FROM events")
def json_object_eq(spark, d):
    """Equality by serialized form; fields without a value do not count."""
    a = F.to_json(F.struct(F.col("user_id").alias("u"), F.lit(None).cast("string").alias("none")))
    b = F.to_json(F.struct(F.when(F.col("value") > 30, F.col("user_id")).otherwise(-1).alias("u")))
    return read_table(spark, d, "events").select("event_id", (a == b).alias("same"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%a, %b %-d, %Y') AS shown FROM orders")
def date_fmt_gig(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "EEE, MMM d, yyyy").alias("shown"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def date_clock(spark, d):
    return read_table(spark, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"))


@query("SELECT o_orderkey, (o_orderdate + INTERVAL 360 MONTH)::DATE <= current_date AS due FROM orders")
def date_now(spark, d):
    """Whether an order's thirtieth anniversary has come."""
    return read_table(spark, d, "orders").select("o_orderkey", (F.add_months("o_orderdate", 360) <= F.current_date()).alias("due"))


# Numbers and labels


@query("SELECT p_partkey, coalesce(try_cast(CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_type END AS DOUBLE), 0) AS number FROM part")
def num_coerce(spark, d):
    return read_table(spark, d, "part").select("p_partkey", scalars.number_or_zero(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type"))).alias("number"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 0 AND 11 AND p_size + 60 BETWEEN 40 AND 300")
def num_bounds(spark, d):
    return read_table(spark, d, "part").where("p_size BETWEEN 0 AND 11 AND p_size + 60 BETWEEN 40 AND 300").select("p_partkey")


@query("SELECT p_partkey, p_size + p_retailprice AS score FROM part")
def num_score(spark, d):
    return read_table(spark, d, "part").select("p_partkey", (F.col("p_size") + F.col("p_retailprice")).alias("score"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 3) AS rounded FROM lineitem")
def num_round3(spark, d):
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 3).alias("rounded"))


@query("SELECT p_partkey, round(p_size * 100 / 50.0, 1)::DOUBLE AS pct, format('{:,}', p_partkey * 1000) AS shown FROM part")
def num_pct(spark, d):
    return read_table(spark, d, "part").select("p_partkey", scalars.percent(F.col("p_size").cast("double"), F.lit(50.0)).alias("pct"), F.format_number(F.col("p_partkey") * 1000, 0).alias("shown"))


@query("WITH e AS (SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events) SELECT event_id, CASE WHEN k >= 70 THEN '#4ade80' WHEN k >= 35 THEN '#fbbf24' ELSE '#f87171' END AS colour FROM e")
def cls_verdict_style(spark, d):
    """A verdict's colour; anything unknown looks like the middle one."""
    colours = F.create_map(F.lit("bussin"), F.lit("#4ade80"), F.lit("unc"), F.lit("#f87171"))
    return events(spark, d).select("event_id", F.coalesce(colours[scalars.verdict(F.col("k"))], F.lit("#fbbf24")).alias("colour"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase'")
def cls_prescreen(spark, d):
    """Only items that an outside classifier calls food go on."""
    category = F.when(F.col("event_type") == "purchase", "food").otherwise("other")
    return read_table(spark, d, "events").withColumn("category", category).where("category = 'food'").select("event_id")
