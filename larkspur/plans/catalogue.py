"""Queries over the catalogue: search, joins, counts, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import first_filled, join_filled, number_or_zero
from ..functions.text import ascii_fold, comma_list, empty_to_null
from ..operators import cache, library, mutations
from ..operators.ordering import neighbours, numbered, sample_rows, sample_share
from ..sources.tables import read_table
from .registry import query
from .stand_ins import ENTRIES, HELD, LINKS, LISTS, SONGS, entries, held, links, lists, songs

BRANDS = ["Brand#1", "Brand#2", "Brand#3"]
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format


@query(f"WITH {LISTS}, {LINKS} SELECT id, name, gig_date FROM lists l WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('Brand#1'), ('Brand#2')) w(t) WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.song_id = l.id AND k.name = w.t))")
def join_division(spark, d):
    return library.with_all_tags(lists(spark, d), links(spark, d), ["Brand#1", "Brand#2", "Brand#1"])


@query(f"WITH {SONGS} SELECT * FROM songs WHERE (title ILIKE '%RING%' OR artist ILIKE '%RING%') AND genre = 'PROMO' AND era = '2000s' AND artist ILIKE '%brand#1%'")
def flt_search(spark, d):
    return library.search(songs(spark, d), query="RING", genre="PROMO", era="2000s", artist="brand#1", sort="artist")


@query(f"WITH {SONGS}, {LINKS} SELECT s.* FROM songs s WHERE title ILIKE '%gear%' AND id IN (SELECT song_id FROM links WHERE name IN ('Brand#4', 'Brand#9') GROUP BY 1 HAVING count(*) = 2)")
def flt_search_tags(spark, d):
    return library.search(songs(spark, d), links(spark, d), query="gear", tags=["Brand#9", "Brand#4"])


@query(f"WITH {SONGS} SELECT id, title, artist, genre, feel, era, bpm FROM songs WHERE (title ILIKE '%o_d w%')")
def prj_search(spark, d):
    return library.search(songs(spark, d).withColumn("chart_content", F.lit("x")), query="o_d w").select("id", "title", "artist", "genre", "feel", "era", "bpm")


@query("SELECT * FROM part WHERE p_partkey = 17")
def flt_pk(spark, d):
    return read_table(spark, d, "part").where(F.col("p_partkey") == 17)


@query(f"WITH {SONGS} SELECT id, title, artist FROM songs WHERE {_FOLD('title')} = 'cold widget' AND {_FOLD('artist')} = 'brand#13'")
def flt_nocase_pair(spark, d):
    return songs(spark, d).where(library.same_fold(F.col("title"), "Cold WIDGET") & library.same_fold(F.col("artist"), "BRAND#13")).select("id", "title", "artist")


@query(f"WITH {SONGS} SELECT id, genre FROM songs WHERE genre IS NOT NULL")
def flt_not_null(spark, d):
    return songs(spark, d).where(F.col("genre").isNotNull()).select("id", "genre")


@query(f"WITH {SONGS} SELECT id, title FROM songs WHERE coalesce(genre, '') = ''")
def flt_untagged(spark, d):
    return songs(spark, d).where(F.coalesce("genre", F.lit("")) == "").select("id", "title")


@query(f"WITH {SONGS} SELECT id, title FROM songs WHERE coalesce(genre, '') = '' ORDER BY id LIMIT 25")
def flt_limit_slice(spark, d):
    return flt_untagged(spark, d).orderBy("id").limit(25)


@query(f"WITH {SONGS} SELECT id, title FROM songs WHERE (contains(lower(title), 'ring') OR contains(lower(artist), 'ring')) AND era = '90s' AND list_contains([lower(artist), lower(genre)], 'promo')")
def flt_offline(spark, d):
    rows = songs(spark, d).withColumn("tags", F.array("artist", "genre"))
    return library.search_offline(rows, query="RING", era="90s", tags=["Promo"]).select("id", "title")


@query("SELECT p_partkey, p_name FROM part WHERE trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_name END) <> ''")
def flt_blank_desc(spark, d):
    text = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_name"))
    return read_table(spark, d, "part").where(F.trim(text) != "").select("p_partkey", "p_name")


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_name || ' , ,' || p_brand || ',', ','), lambda x: trim(x)), lambda x: x <> '')[1] AS first, len(list_filter(list_transform(string_split(p_name || ' , ,' || p_brand || ',', ','), lambda x: trim(x)), lambda x: x <> '')) AS n FROM part")
def prj_csv_list(spark, d):
    items = comma_list(F.concat("p_name", F.lit(" , ,"), "p_brand", F.lit(",")))
    return read_table(spark, d, "part").select("p_partkey", items[0].alias("first"), F.size(items).cast("long").alias("n"))


@query("SELECT p_partkey, p_name AS description, p_retailprice AS cholesterol, p_retailprice AS fat, coalesce(try_cast(p_type AS DOUBLE), 0) AS sugar, '100 g' AS serving FROM part")
def prj_nutrition(spark, d):
    return read_table(spark, d, "part").select("p_partkey", F.col("p_name").alias("description"), F.col("p_retailprice").alias("cholesterol"), F.col("p_retailprice").alias("fat"), number_or_zero(F.col("p_type")).alias("sugar"), F.lit("100 g").alias("serving"))


@query("SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), nullif(o_orderpriority, '5-LOW'), '?') AS shown FROM orders")
def prj_coalesce_key(spark, d):
    first = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus"))
    second = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return read_table(spark, d, "orders").select("o_orderkey", first_filled(first, second, default="?").alias("shown"))


@query(f"WITH {SONGS} SELECT id, concat_ws(' · ', artist, genre, nullif(feel, 'waltz')) AS line FROM songs")
def prj_concat_ws(spark, d):
    feel = F.when(F.col("feel") == "waltz", "").otherwise(F.col("feel"))
    return songs(spark, d).select("id", join_filled(" · ", F.col("artist"), F.col("genre"), feel).alias("line"))


@query(f"WITH {SONGS} SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE artist END AS artist, CASE WHEN id % 3 = 0 THEN 99 ELSE bpm END AS bpm FROM songs")
def prj_override_merge(spark, d):
    rows = songs(spark, d).select("id", "artist", "bpm")
    body = rows.where("id % 3 = 0").select("id", F.create_map(F.lit("artist"), F.lit(None).cast("string"), F.lit("bpm"), F.lit("99")).alias("fields"))
    return mutations.override(rows, body, "id")


# Joins


@query(f"WITH {LINKS} SELECT o_orderkey, name FROM orders JOIN links ON song_id = o_orderkey WHERE o_orderkey = 7")
def join_inner_bridge(spark, d):
    orders = read_table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey")
    return orders.join(links(spark, d), F.col("o_orderkey") == F.col("song_id")).select("o_orderkey", "name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_inner_ordered(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey").orderBy("l_orderkey", "l_linenumber")


@query(f"WITH {LINKS} SELECT b.name, count(k.song_id) AS n FROM (SELECT DISTINCT p_brand AS name FROM part UNION ALL SELECT 'unused') b LEFT JOIN links k ON k.name = b.name GROUP BY 1")
def join_left_count(spark, d):
    tags = read_table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct().union(spark.createDataFrame([("unused",)], "name string"))
    return library.count_children(tags, links(spark, d), "name", "name").orderBy(F.desc("n"), ascii_fold(F.col("name")))


@query(f"WITH {LISTS}, {ENTRIES} SELECT id, name, gig_date, count(e.setlist_id) AS n FROM lists l LEFT JOIN entries e ON e.setlist_id = l.id GROUP BY 1, 2, 3")
def join_left_count2(spark, d):
    return library.count_children(lists(spark, d), entries(spark, d), "id", "setlist_id")


@query(f"WITH {LISTS}, {ENTRIES} SELECT l.id, coalesce((SELECT string_agg(position || ':' || song_id, ',' ORDER BY position, song_id) FROM entries e WHERE e.setlist_id = l.id), '') AS items FROM lists l")
def join_nest(spark, d):
    nested = library.nest_children(lists(spark, d), entries(spark, d), "id", "setlist_id", ["position", "song_id"], [])
    return nested.select("id", F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["position"].cast("string"), c["song_id"].cast("string"))), ",").alias("items"))


@query(f"WITH {LISTS}, {LINKS} SELECT l.id, coalesce((SELECT string_agg(k.name, ',' ORDER BY k.name) FROM links k WHERE k.song_id = l.id), '') AS tags FROM lists l")
def join_nest_tags(spark, d):
    nested = library.nest_children(lists(spark, d), links(spark, d), "id", "song_id", ["name"], [])
    return nested.select("id", F.array_join(F.transform("children", lambda c: c["name"]), ",").alias("tags"))


@query(f"WITH {SONGS} SELECT min(id) AS id, min(title) AS title FROM songs s WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM songs k WHERE k.id % 10 = 0 AND {_FOLD('k.title')} = {_FOLD('s.title')} AND k.artist = s.artist) GROUP BY {_FOLD('title')}, {_FOLD('artist')}")
def join_anti_dup(spark, d):
    rows = songs(spark, d).select("id", "title", "artist")
    return mutations.new_only(rows.where("id % 2 = 1"), rows.where("id % 10 = 0").withColumn("title", F.upper("title")), ["title", "artist"], "id").select("id", "title")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join_semi_exists(spark, d):
    back = read_table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return read_table(spark, d, "orders").join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


# Counts


@query("SELECT (SELECT count(*) FROM part) AS songs, (SELECT count(DISTINCT p_brand) FROM part) AS tags, (SELECT count(*) FROM orders) AS setlists")
def agg_count_all(spark, d):
    tags = read_table(spark, d, "part").select("p_brand").distinct()
    return library.statistics(songs(spark, d), tags, lists(spark, d)).select("songs", "tags", "setlists")


def _by(column):
    return f"WITH {SONGS} SELECT {column}, count(*) AS n FROM songs WHERE {column} IS NOT NULL GROUP BY 1"


@query(_by("genre"))
def agg_by_genre(spark, d):
    return library.counts_by(songs(spark, d), "genre")


@query(_by("era"))
def agg_by_era(spark, d):
    return library.counts_by(songs(spark, d), "era", by_name=True)


@query(_by("feel"))
def agg_by_feel(spark, d):
    return library.counts_by(songs(spark, d), "feel")


@query(f"WITH {SONGS}, c AS (SELECT genre, count(*) AS n FROM songs WHERE genre IS NOT NULL GROUP BY 1) SELECT (SELECT count(*) FROM songs) AS songs, (SELECT string_agg(genre || '=' || n, ',' ORDER BY n DESC, genre) FROM c) AS genres")
def agg_stats(spark, d):
    stats = library.statistics(songs(spark, d), lists(spark, d), lists(spark, d))
    return stats.select("songs", F.array_join(F.transform("by_genre", lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), ",").alias("genres"))


@query(f"WITH {LINKS} SELECT song_id, count(DISTINCT name) AS n FROM links WHERE name IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1")
def agg_count_distinct(spark, d):
    return links(spark, d).where(F.col("name").isin(BRANDS)).groupBy("song_id").agg(F.countDistinct("name").alias("n"))


@query(f"WITH {LISTS}, {ENTRIES} SELECT id, coalesce(max(position), 0) + 1 AS next_position FROM lists LEFT JOIN entries ON setlist_id = id GROUP BY 1")
def agg_max_plus_one(spark, d):
    return mutations.next_positions(lists(spark, d), entries(spark, d))


@query("SELECT coalesce(nullif(CASE p_size % 5 WHEN 0 THEN 'Era' WHEN 1 THEN 'Genre' WHEN 2 THEN '' WHEN 3 THEN 'Mine' END, ''), 'Other') AS category, count(DISTINCT p_name || CASE p_size % 5 WHEN 2 THEN '/' ELSE '' END) AS n, CASE category WHEN 'Genre' THEN 1 WHEN 'Era' THEN 2 ELSE 6 END AS rank FROM part GROUP BY 1")
def agg_group_list(spark, d):
    size = F.col("p_size") % 5
    category = F.when(size == 0, "Era").when(size == 1, "Genre").when(size == 2, "").when(size == 3, "Mine")
    tags = read_table(spark, d, "part").select(F.col("p_name").alias("name"), category.alias("category")).distinct()
    return library.group_tags(tags).select("category", F.size("names").cast("long").alias("n"), "rank")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_import_totals(spark, d):
    return read_table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


# Orders and the tops of them


@query(f"WITH {SONGS} SELECT id, {_FOLD('title')} AS key, row_number() OVER (ORDER BY {_FOLD('title')} NULLS FIRST, id) - 1 AS rank FROM songs")
def sort_title(spark, d):
    return numbered(songs(spark, d).select("id", ascii_fold(F.col("title")).alias("key")), [F.col("key").asc_nulls_first(), F.col("id")], "rank")


@query(f"WITH {SONGS} SELECT id, era, row_number() OVER (ORDER BY era, id) - 1 AS rank FROM songs")
def sort_era(spark, d):
    return numbered(songs(spark, d).select("id", "era"), [F.col("era"), F.col("id")], "rank")


@query("SELECT *, row_number() OVER (ORDER BY gig_date DESC NULLS LAST, o_orderkey) - 1 AS rank FROM (SELECT o_orderkey, nullif(o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS gig_date FROM orders)")
def sort_setlists(spark, d):
    orders = read_table(spark, d, "orders")
    newest = orders.agg(F.max("o_orderdate").alias("newest"))
    rows = orders.crossJoin(F.broadcast(newest)).select("o_orderkey", F.nullif(F.col("o_orderdate"), F.col("newest")).alias("gig_date"))  # one row
    return numbered(rows, [F.col("gig_date").desc_nulls_last(), F.col("o_orderkey")], "rank")


#: Beginnings of names in the order of the root locale, which is not that of their code points: letters first, then marks over them, then capitals.
_NAMES = ("a", "A", "á", "Á", "b", "e", "é", "É", "f", "ñ", "o", "ö", "ß", "z", "Z", "ž")


@query(f"SELECT p_partkey, name, row_number() OVER (ORDER BY first, p_partkey) - 1 AS rank FROM (SELECT p_partkey, {list(_NAMES)}[(p_partkey * 7 % {len(_NAMES)})::INT + 1] AS name, p_partkey * 7 % {len(_NAMES)} AS first FROM part)")
def sort_locale(spark, d):
    """In the order of the root locale, held against a list of names in that order."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") * 7 % len(_NAMES)).cast("int") + 1)
    return numbered(read_table(spark, d, "part").select("p_partkey", name.alias("name")), [F.collate("name", "UNICODE"), F.col("p_partkey")], "rank")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def topk_log(spark, d):
    return library.newest(read_table(spark, d, "events"), "ts", "event_id").select("event_id", "ts", "event_type")


@query("SELECT p_partkey, p_size + p_retailprice AS score FROM part ORDER BY score DESC, p_partkey LIMIT 20")
def topk_score(spark, d):
    return read_table(spark, d, "part").select("p_partkey", (F.col("p_size") + F.col("p_retailprice")).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


@query("WITH t AS (SELECT p_partkey, p_size + p_retailprice AS score FROM part ORDER BY score DESC, p_partkey LIMIT 20) SELECT * FROM t ORDER BY ('0x' || left(md5(p_partkey || ':7'), 8))::BIGINT, p_partkey LIMIT 1")
def sample_one(spark, d):
    return sample_rows(topk_score(spark, d), 1, "p_partkey")


@query("SELECT event_id FROM events WHERE ('0x' || left(md5(event_id || ':7'), 8))::BIGINT < 0.35 * 4294967296")
def sample_bernoulli(spark, d):
    return sample_share(read_table(spark, d, "events"), 0.35, "event_id").select("event_id")


@query(f"WITH {SONGS} SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM songs WINDOW w AS (PARTITION BY artist ORDER BY title, id)")
def seq_prev_next(spark, d):
    return neighbours(songs(spark, d), ["artist"], ["title", "id"], "id").select("id", "previous_id", "next_id")


# Sets


@query("SELECT DISTINCT p_type, p_brand FROM part")
def set_distinct(spark, d):
    return read_table(spark, d, "part").select("p_type", "p_brand").distinct()


_SET = f"WITH {HELD} SELECT id, array_to_string({{}}, ',') AS items FROM held"


def _joined(items):
    return F.array_join(F.array_sort(items), ",").alias("items")


@query(_SET.format("list_sort(list_distinct(list_append(held, item)))"))
def set_add_once(spark, d):
    return held(spark, d).select("id", _joined(cache.mark(F.col("held"), F.col("item"))))


@query(_SET.format("list_filter(held, lambda x: x <> item AND x <> held[-1])"))
def set_minus(spark, d):
    return held(spark, d).select("id", _joined(F.array_except("held", F.array("item", F.element_at("held", -1)))))


@query(_SET.format("CASE WHEN list_contains(held, item) THEN list_filter(held, lambda x: x <> item) ELSE list_sort(list_append(held, item)) END"))
def set_toggle(spark, d):
    return held(spark, d).select("id", _joined(cache.toggle(F.col("held"), F.col("item"))))


@query("SELECT p_partkey FROM part WHERE lower(p_name) NOT IN ('cold widget', 'hot rod')")
def set_not_tried(spark, d):
    tried = F.transform(F.array(F.lit("Cold Widget"), F.lit("HOT ROD")), F.lower)
    return read_table(spark, d, "part").where(~F.array_contains(tried, F.lower("p_name"))).select("p_partkey")


# Changes


@query(f"WITH {SONGS} SELECT count(*) AS n, count(DISTINCT id) AS ids, count(genre) AS genres, min(CASE WHEN title = 'new' THEN id END) - (SELECT max(id) FROM songs) AS first, max(id) - (SELECT max(id) FROM songs) AS last FROM (SELECT id, title, genre FROM songs UNION ALL SELECT (SELECT max(id) FROM songs) + row_number() OVER (ORDER BY id), 'new', NULL FROM songs WHERE id % 2 = 0)")
def mut_insert_song(spark, d):
    rows = songs(spark, d).select("id", "title", "genre")
    new = rows.where("id % 2 = 0").select(F.lit("new").alias("title"))
    out = mutations.insert_rows(rows, new)
    top = rows.agg(F.max("id").alias("top"))
    counts = out.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count("genre").alias("genres"), F.min(F.when(F.col("title") == "new", F.col("id"))).alias("least"), F.max("id").alias("most"))
    return counts.crossJoin(top).select("n", "ids", "genres", (F.col("least") - F.col("top")).alias("first"), (F.col("most") - F.col("top")).alias("last"))  # one row each


@query(f"WITH {SONGS} SELECT id, title, CASE WHEN id = 3 THEN NULL ELSE genre END AS genre, CASE WHEN id = 3 THEN 77 ELSE bpm END AS bpm FROM songs")
def mut_update_allow(spark, d):
    return mutations.update_allowed(songs(spark, d), F.col("id") == 3, {"bpm": 77, "genre": None, "id": 5, "source_file": "x"}).select("id", "title", "genre", "bpm")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey % 7 <> 0")
def mut_delete_cascade(spark, d):
    orders, lines = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    out = mutations.delete_cascade(orders, orders.where("o_orderkey % 7 = 0"), "o_orderkey", {"lines": (lines, "l_orderkey")})
    return out["lines"].select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS song_id FROM part")
def mut_delete_nulls_log(spark, d):
    part = read_table(spark, d, "part").select("p_partkey")
    log = part.withColumn("song_id", F.col("p_partkey"))
    return mutations.delete_cascade(part, part.where("p_partkey % 7 = 0"), "p_partkey", {}, {"log": (log, "song_id")})["log"]


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 2 = 0 UNION SELECT upper(p_name) FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0)")
def mut_upsert_tag(spark, d):
    part = read_table(spark, d, "part")
    tags = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("name"), F.lit("old").alias("category")).distinct()
    new = part.select(F.upper("p_name").alias("name"), F.lit("new").alias("category"), "p_partkey")
    return mutations.upsert_tags(tags, new, "p_partkey").select("name")


@query("SELECT DISTINCT l_orderkey AS song_id, l_partkey AS tag_id FROM lineitem")
def mut_link_ignore(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song_id"), F.col("l_partkey").alias("tag_id"))
    return mutations.add_links(rows.where("tag_id % 2 = 0").distinct(), rows)


@query(f"WITH {LINKS} SELECT song_id, name FROM links WHERE name <> 'Brand#7'")
def mut_unlink(spark, d):
    gone = spark.createDataFrame([("Brand#7",)], "name string")
    return mutations.remove_links(links(spark, d), gone, ["name"])


@query("""
    WITH tags AS (SELECT DISTINCT p_brand AS name FROM part),
    asked AS (SELECT name, CASE replace(name, 'Brand#', '')::INT % 4 WHEN 0 THEN upper(name) WHEN 1 THEN 'brand#2' WHEN 2 THEN 'Style' ELSE 'Tag ' || replace(name, 'Brand#', '') END AS new_name FROM tags),
    told AS (SELECT name, new_name, EXISTS (SELECT 1 FROM tags t WHERE lower(t.name) = lower(a.new_name) AND t.name <> a.name) OR EXISTS (SELECT 1 FROM asked b WHERE b.new_name = a.new_name AND b.name < a.name) AS refused FROM asked a)
    SELECT name AS old_name, CASE WHEN refused THEN name ELSE new_name END AS name, refused FROM told""")
def mut_rename_tag(spark, d):
    """Every tag asks for a new name: its own in capitals, one that another has, one that many ask for, or a free one."""
    tags = read_table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct()
    number = F.regexp_extract("name", r"\d+", 0)
    wish = F.when(number % 4 == 0, F.upper("name")).when(number % 4 == 1, "brand#2").when(number % 4 == 2, "Style").otherwise(F.concat(F.lit("Tag "), number))
    return mutations.rename(tags.withColumn("old_name", F.col("name")), tags.select("name", wish.alias("new_name")))


_PLACED = """
    WITH old AS (SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) WHERE n = 1 AND l_linenumber <> 3),
    new AS (SELECT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 2 END AS place, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 = 0 ORDER BY l_partkey, l_suppkey, l_extendedprice) AS nth, l_suppkey, l_extendedprice FROM lineitem WHERE l_linenumber = 3),
    put AS (SELECT l_orderkey, 2 AS l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY nth DESC) AS last FROM new WHERE place IS NOT NULL) WHERE last = 1),
    kept AS (SELECT * FROM old WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM put) UNION ALL SELECT * FROM put),
    added AS (SELECT l_orderkey, coalesce((SELECT max(l_linenumber) FROM kept k WHERE k.l_orderkey = new.l_orderkey), 0) + nth AS l_linenumber, l_partkey FROM new WHERE place IS NULL)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM kept UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM added
"""


@query(_PLACED)
def mut_place(spark, d):
    """Third lines placed anew among the others: at the second place, or, without a place, behind the last."""
    rows = read_table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice")
    first = rows.withColumn("_order", F.struct("l_extendedprice", "l_partkey", "l_suppkey"))
    keys = ("l_orderkey", "l_linenumber")
    old = mutations.place(first.limit(0), first.where("l_linenumber <> 3"), "_order", keys).drop("_order")
    new = rows.where("l_linenumber = 3").withColumn("_order", F.struct("l_partkey", "l_suppkey", "l_extendedprice"))
    new = new.withColumn("l_linenumber", F.when(F.col("l_partkey") % 3 != 0, F.lit(2)).cast("long"))
    return mutations.place(old, new, "_order", keys).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey = 7 AND l_linenumber = 2)")
def mut_remove_at(spark, d):
    return read_table(spark, d, "lineitem").where("NOT (l_orderkey = 7 AND l_linenumber = 2)").select("l_orderkey", "l_linenumber")


@query(f"WITH e AS (SELECT l_orderkey AS setlist_id, l_partkey AS song_id, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2), o AS (SELECT setlist_id, song_id, row_number() OVER (PARTITION BY setlist_id ORDER BY song_id DESC) AS at FROM e WHERE song_id % 3 > 0) SELECT e.setlist_id, e.song_id, coalesce(o.at, e.position)::INT AS position FROM e LEFT JOIN o USING (setlist_id, song_id)")
def mut_reorder(spark, d):
    rows = entries(spark, d).groupBy("setlist_id", "song_id").agg(F.min("position").alias("position"))
    wanted = rows.where("song_id % 3 > 0").groupBy("setlist_id").agg(F.sort_array(F.collect_list("song_id"), asc=False).alias("items"))
    return mutations.reorder(rows, wanted)


@query(f"WITH {SONGS} SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 4 = 0 THEN 'jazz' END ELSE genre END AS genre, CASE WHEN id % 4 = 2 THEN 120 ELSE bpm END AS bpm FROM songs")
def mut_tag_enrich(spark, d):
    rows = songs(spark, d).select("id", "genre", "bpm")
    found = rows.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "jazz").alias("genre"), F.when(F.col("id") % 4 == 2, 120).otherwise(0).alias("bpm"))
    return mutations.enrich(rows, found)


@query(f"WITH {SONGS} SELECT id, CASE WHEN id % 3 = 0 THEN 'fresh' ELSE title END AS title FROM songs WHERE id % 2 = 0 OR id % 3 = 0")
def mut_cache_upsert(spark, d):
    rows = songs(spark, d).select("id", "title")
    return mutations.put_all(rows.where("id % 2 = 0"), rows.where("id % 3 = 0").withColumn("title", F.lit("fresh")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def chk_unique(spark, d):
    return mutations.duplicates(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def chk_foreign_key(spark, d):
    parents = read_table(spark, d, "orders").where("o_orderstatus = 'F'")
    return mutations.orphans(read_table(spark, d, "lineitem"), "l_orderkey", parents, "o_orderkey").select("l_orderkey", "l_partkey")


@query("SELECT p_partkey, nullif(p_type, 'PROMO') AS kept FROM part")
def num_empty_to_null(spark, d):
    return read_table(spark, d, "part").select("p_partkey", empty_to_null(F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type"))).alias("kept"))
