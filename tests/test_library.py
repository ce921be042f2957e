"""Search, changes, sequences and streams on small rows."""

import time

import pytest
from pyspark.sql import functions as F

from larkspur.operators import cache, events, keywords, library, mutations, nearest
from larkspur.streaming import metrics

SONG = "id long, title string, artist string, genre string, feel string, era string"


@pytest.fixture(scope="module")
def songs(spark):
    return spark.createDataFrame([(1, "Élan", None, None, "shuffle", "60s"), (2, "blue", "Ann", "Rock", None, "2000s"), (3, "Azure", "bob", "", None, None), (4, "50% off", "Ann", "Rock", "waltz", "60s")], SONG)


@pytest.fixture(scope="module")
def tagged(spark):
    return spark.createDataFrame([(1, "Rock"), (2, "Rock"), (2, "rock"), (2, "Slow"), (4, "Slow"), (4, "Rock")], "song_id long, name string")


def ids(df):
    return [r.id for r in df.collect()]


def test_search(songs, tagged):
    assert ids(library.search(songs)) == [4, 3, 2, 1]
    assert ids(library.search(songs, query="BLU")) == [2]
    assert ids(library.search(songs, query="élan")) == [] and ids(library.search(songs, query="LAN")) == [1]
    assert ids(library.search(songs, artist="ANN", era="60s", genre="")) == [4]
    assert ids(library.search(songs, tagged, artist="ann", tags=["Rock", "Slow", "Rock"])) == [4, 2]
    assert ids(library.search(songs, tagged, tags=["Rock", "None"])) == []
    assert sorted(ids(library.with_all_tags(songs, tagged, ["ROCK", "rock"], fold=True))) == [1, 2, 4]
    assert ids(library.search(songs, sort="artist")) == [1, 2, 4, 3] and ids(library.search(songs, sort="odd")) == [4, 3, 2, 1]


def test_offline_search(spark, songs):
    rows = songs.withColumn("tags", F.when(F.col("id") == 1, F.array(F.lit("Live"), F.lit("Old"))).otherwise(F.array()))
    assert ids(library.search_offline(rows, query="ÉL", tags=["live", "OLD"])) == [1]
    assert ids(library.search_offline(rows, tags=["live", "new"])) == []


def test_nesting_and_counts(spark, songs):
    lists = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    entries = spark.createDataFrame([(1, 3, 30), (1, 1, 10), (9, 1, 1)], "setlist_id long, position int, song_id long")
    nested = {r.id: [(c.position, c.song_id) for c in r.children] for r in library.nest_children(lists, entries, "id", "setlist_id", ["position"], ["song_id"]).collect()}
    assert nested == {1: [(1, 10), (3, 30)], 2: []}
    assert {r.id: r.n for r in library.count_children(lists, entries, "id", "setlist_id").collect()} == {1: 2, 2: 0}
    assert {r.id: r.next_position for r in mutations.next_positions(lists, entries).collect()} == {1: 4, 2: 1}
    stats = library.statistics(songs, lists, lists).first()
    assert (stats.songs, stats.tags, [tuple(x) for x in stats.by_era]) == (4, 2, [("2000s", 1), ("60s", 2)])
    tags = spark.createDataFrame([("x", "Zeta"), ("y", "Era"), ("z", None), ("w", ""), ("v", "Genre")], "name string, category string")
    assert [(r.category, r.names) for r in library.group_tags(tags).collect()] == [("Genre", ["v"]), ("Era", ["y"]), ("Other", ["w", "z"]), ("Zeta", ["x"])]
    assert mutations.orphans(entries, "setlist_id", lists, "id").count() == 1


def test_reorder_swaps_at_once(spark):
    entries = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3), (2, 10, 1)], "setlist_id long, song_id long, position int")
    orders = spark.createDataFrame([(1, [20, 10, 20])], "setlist_id long, items array<long>")
    out = mutations.reorder(entries, orders)
    assert {(r.setlist_id, r.song_id): r.position for r in out.collect()} == {(1, 20): 1, (1, 10): 2, (1, 30): 3, (2, 10): 1}
    assert mutations.duplicates(out, ["setlist_id", "position"]).count() == 0


def test_changes(spark):
    old = spark.createDataFrame([(1, "Rock", "g"), (2, "Slow", None)], "id long, name string, category string")
    new = spark.createDataFrame([("ROCK", "x", 1), ("Fast", "t", 2), ("fast", "u", 3)], "name string, category string, at int")
    assert sorted(r.name for r in mutations.upsert_tags(old, new, "at").collect()) == ["Fast", "Rock", "Slow"]
    placed = mutations.place(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "setlist_id long, position int, v string"), spark.createDataFrame([(1, 2, "c"), (1, 2, "d"), (1, 3, "e")], "setlist_id long, position int, v string"), "v")
    assert sorted(r.v for r in placed.collect()) == ["a", "d", "e"]
    songs = spark.createDataFrame([(1, "r", 100), (2, "s", 90)], "id long, genre string, bpm int")
    found = spark.createDataFrame([(1, None, 0)], "id long, genre string, bpm int")
    assert sorted(tuple(r) for r in mutations.enrich(songs, found).collect()) == sorted([(1, None, 100), (2, "s", 90)], key=lambda t: t[0])
    body = spark.createDataFrame([(1, {"genre": None, "bpm": "7"})], "id long, fields map<string,string>")
    assert {r.id: (r.genre, r.bpm) for r in mutations.override(songs, body, "id").collect()} == {1: (None, 7), 2: ("s", 90)}
    assert {r.id: r.genre for r in mutations.update_allowed(songs, F.col("id") == 2, {"genre": None, "id": 9}).collect()} == {1: "r", 2: None}
    candidates = spark.createDataFrame([(1, "A", "x"), (2, "a", "X"), (3, "b", None), (4, "b", None), (5, "Known", "k")], "id long, title string, artist string")
    known = spark.createDataFrame([("KNOWN", "K")], "title string, artist string")
    assert sorted(r.id for r in mutations.new_only(candidates, known, ["title", "artist"], "id").collect()) == [1, 3, 4]
    grown = mutations.insert_rows(songs, spark.createDataFrame([("n",), ("m",)], "genre string")).collect()
    assert len({r.id for r in grown}) == 4 and sum(r.bpm is None for r in grown) == 2
    out = mutations.delete_cascade(songs, songs.where("id = 1"), "id", {"kids": (old, "id")}, {"log": (songs.select(F.col("id").alias("song_id")), "song_id")})
    assert [out[k].count() for k in ("parents", "kids", "log")] == [1, 1, 2] and out["log"].where("song_id IS NULL").count() == 1
    assert sorted((r.id, r.genre) for r in mutations.put_all(songs, songs.where("id = 2").withColumn("genre", F.lit("new"))).collect()) == [(1, "r"), (2, "new")]


def test_sequences(spark):
    rows = spark.createDataFrame([("a", i, s, v) for i, (s, v) in enumerate([("choose_spouse", 1), ("record_idea", 2), ("safe", 3), ("choose_spouse", 4)])], "session string, seq int, stage string, v int")
    assert [r.allowed for r in events.check_sequence(rows, "session", ["seq"]).orderBy("seq").collect()] == [True, True, False, True]
    assert [r.running for r in events.running_total(rows, "session", ["seq"], "v").orderBy("seq").collect()] == [1, 3, 6, 10]
    attempts = spark.createDataFrame([("x", 1, False), ("x", 2, True), ("x", 3, True), ("y", 1, False), ("y", 2, None)], "k string, at int, ok boolean")
    assert {r.k: r.at for r in events.last_attempt(attempts, "k", "at", "ok").collect()} == {"x": 2, "y": 2}
    with pytest.raises(ValueError):
        events.turns(rows, "session", "seq", limit=11)
    online = spark.createDataFrame([("a", i, o) for i, o in enumerate([False, True, True, False, True])], "s string, i int, online boolean")
    assert sorted(r.i for r in events.edges_online(online, "s", ["i"], "online").collect()) == [1, 4]


def test_nearest(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "item_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [3.0, 0.1]), (8, [-1.0, -1.0]), (9, [0.0, 0.0]), (10, [0.45, (1 - 0.45**2) ** 0.5 * -1])], "query_id long, embedding array<double>")
    got = {r.query_id: (r.item_id, r.similarity) for r in nearest.nearest_above(queries, items).collect()}
    assert got[7][0] == 1 and got[8] == (None, None) and got[9] == (None, None) and got[10][0] == 1


def test_streams_equal_their_batches(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = metrics.read_events(spark, str(tmp_path / "in"), batch.schema)
    seen = {}

    def sink(rows, _):
        seen.update({r.event_type: (r["count"], round(r.total, 3)) for r in rows.collect()})

    q = metrics.export(metrics.cumulative_metrics(stream, "value", ["event_type"]), sink, interval="0 seconds")
    q.processAllAvailable()
    q.stop()
    want = {r.event_type: (r["count"], round(r.total, 3)) for r in events.histogram(batch, "value", ["event_type"]).collect()}
    assert seen == {k: (n, pytest.approx(t, abs=0.01)) for k, (n, t) in want.items()}
    q = metrics.interval_metrics(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"], late="60 days").writeStream.outputMode("complete").format("memory").queryName("per_interval").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("per_interval").agg(F.sum("count")).first()[0] == batch.count()


def test_stage_stream(spark, tmp_path):
    schema = "session string, ts timestamp, stage string"
    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:01', 'choose_spouse'), ('a', timestamp'2024-01-01 00:00:02', 'safe'), ('b', timestamp'2024-01-01 00:00:01', 'record_idea') t(session, ts, stage)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = []
    q = metrics.stage_stream(metrics.read_events(spark, str(tmp_path / "in"), schema), "session", "ts").writeStream.outputMode("update").foreachBatch(lambda df, _: found.extend(tuple(r) for r in df.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert found == [("a", "choose_spouse", "safe")]


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    sink, path = metrics.files_sink(str(tmp_path / "out")), str(tmp_path / "out")
    for batch, ids in ((0, [1, 2]), (1, [3]), (1, [3])):
        sink(spark.createDataFrame([(i,) for i in ids], "id long"), batch)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_known_sessions_pass_the_stage_check(spark):
    session = ["choose_spouse", "record_idea", "review_transcript", "evaluating", "friend_intervention", "spouse_rage", "exile", "choose_spouse"]
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate(session)], "session string, seq int, stage string")
    assert all(r.allowed for r in events.check_sequence(rows, "session", ["seq"]).collect())


def test_rename_refuses_names_that_are_taken(spark):
    tags = spark.createDataFrame([("Slow", "tempo"), ("Fast", "tempo"), ("Live", None), ("Solo", None), ("Old", None), ("Kept", None)], "name string, category string")
    wishes = [("Slow", "SLOW"), ("Fast", "live"), ("Live", "Stage"), ("Solo", "stage"), ("Old", None), ("Nobody", "Else")]
    got = {(r.name, r.category): r.refused for r in mutations.rename(tags, spark.createDataFrame(wishes, "name string, new_name string")).collect()}
    assert got == {("SLOW", "tempo"): False, ("Fast", "tempo"): True, ("Stage", None): False, ("Solo", None): True, ("Old", None): False, ("Kept", None): False}
    assert mutations.rename(tags.limit(0), tags.select("name", F.col("category").alias("new_name"))).count() == 0


def test_an_emptied_set_keeps_its_type(spark):
    row = spark.range(1).select(cache.clear_all(cache.mark(F.array("id"), F.lit(7).cast("long"))).alias("x"))
    assert row.schema["x"].dataType.elementType.simpleString() == "bigint" and row.first().x == []


def test_keyword_hits_equal_brute_force(spark):
    words = ["", "a", "É", "éa", "the", "the", "The", "hen", "n the", "\u00a0x", "öüß", "ß", "\U0001d11ex", "\U0001d11e", "abcd", "abcdefgh", "abcdx", "zzzzz", "bcde", None]
    texts = [None, "", " ", "a", "É", "éA", "when the hen", "WHEN THE", "th e", "abcdefg", "abcdefgh", "xABCDxabcde", "A\u00a0X", "ÖÜSS öüß", "\U0001d11e", "\U0001d11eX", "\n".join(["abc"] * 9), "the" * 200_000 + "zzzzz", "the", "the"]
    asked = spark.createDataFrame(list(enumerate(words)), "item int, word string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.item) for r in keywords.keyword_hits(rows, asked, "text", "word").collect())
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, w in enumerate(words) if t is not None and w is not None and w.lower() in t.lower())
    assert keywords.keyword_hits(rows, asked.where("word IS NULL"), "text", "word").count() == 0
    assert keywords.keyword_hits(rows.limit(0), asked, "text", "word").count() == 0


def test_keywords_are_found_in_time_that_grows_with_the_text(spark):
    rows = spark.createDataFrame([(0, "x " * 250_000 + "needle")], "id int, text string")
    asked = spark.createDataFrame([("needle",), ("and",), ("x",)], "word string")
    began = time.time()
    assert sorted(r.word for r in keywords.keyword_hits(rows, asked, "text", "word").collect()) == ["needle", "x"]
    assert time.time() - began < 40
