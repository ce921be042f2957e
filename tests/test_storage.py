"""Snapshots, the self-upgrading store, the vector index, sources and sinks."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import nearest
from larkspur.sources import files, tables, vector_index, versions
from larkspur.streaming import exporters


def songs_of(spark, titles):
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    return tables.empty_table(spark, "songs").unionByName(rows, allowMissingColumns=True)


def titles(opened):
    return sorted(r.title for r in opened["songs"].select("title").collect())


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    folder = f"file://{tmp_path}/catalogue"
    assert titles(tables.open_catalogue(spark, folder)) == []
    assert tables.write_snapshot({"songs": songs_of(spark, ["a"])}, folder) == 1
    early = tables.open_catalogue(spark, folder)
    broken = tables.empty_table(spark, "tags").unionByName(spark.range(1).select("id", F.raise_error(F.lit("full")).cast("string").alias("name")), allowMissingColumns=True)
    with pytest.raises(Exception, match="full"):
        tables.write_snapshot({"songs": songs_of(spark, ["x"]), "tags": broken}, folder)
    assert titles(tables.open_catalogue(spark, folder)) == ["a"] and versions.numbers(spark, folder) == [1]
    assert tables.write_snapshot({"songs": songs_of(spark, ["b", "c"])}, folder) == 2
    assert titles(early) == ["a"] and titles(tables.open_catalogue(spark, folder)) == ["b", "c"]
    assert titles(tables.open_catalogue(spark, folder, 1)) == ["a"]
    with pytest.raises(ValueError):
        tables.open_catalogue(spark, folder, 9)


def test_versions_expire_and_never_overwrite_each_other(spark, tmp_path):
    folder = f"file://{tmp_path}/catalogue"
    for t in "abc":
        tables.write_snapshot({"songs": songs_of(spark, [t])}, folder)
    found = versions.manifest(spark, folder)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, folder, found)
    (tmp_path / "catalogue" / "data" / "songs-left").mkdir()
    assert versions.expire(spark, folder, keep=1) == [1, 2]
    assert len([p for p in (tmp_path / "catalogue" / "data").iterdir() if p.is_dir()]) == 2  # the kept one, and one that may be under way
    versions.expire(spark, folder, keep=1, unnamed_after=-10)
    assert len([p for p in (tmp_path / "catalogue" / "data").iterdir() if p.is_dir()]) == 1
    assert titles(tables.open_catalogue(spark, folder)) == ["c"]


def test_a_store_takes_the_steps_it_lacks(spark, tmp_path):
    folder, taken = f"file://{tmp_path}/store", []

    def step(n, make):
        def run(at):
            taken.append(n)
            return make(at)

        return run

    steps = [
        step(1, lambda at: {"songs": spark.createDataFrame([(1, "É")], "id long, title string"), "meta": spark.range(1)}),
        step(2, lambda at: {"songs": at["songs"].withColumn("key", text.ascii_fold(F.col("title")))}),
        step(3, lambda at: {"meta": None}),
    ]
    tables.open_store(spark, folder, steps[:1])
    tables.open_store(spark, folder, steps[:1])
    assert taken == [1]
    found = tables.open_store(spark, folder, steps)
    assert taken == [1, 2, 3] and set(found) == {"songs"} and found["songs"].first()["key"] == "É"
    with pytest.raises(ValueError, match="newer"):
        tables.open_store(spark, folder, steps[:2])


def clustered(seed, n, width=6):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    return [(i, [m + rng.gauss(0, 0.03) for m in middle[i % 8]], f"x{i % 3}") for i in range(n)]


def test_index_search_equals_a_full_search_and_reads_few_cells(spark, tmp_path):
    rows = clustered(3, 400) + [(900, None, "y"), (901, [0.0] * 6, "y"), (902, [1.0], "y"), (903, [float("nan")] * 6, "y"), (None, [1.0] * 6, "y")]
    rows += [(910, rows[5][1], "tie"), (911, rows[5][1], "tie")]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>, label string")
    folder = f"file://{tmp_path}/index"
    index = vector_index.open_or_build(items.where("item_id < 200 OR item_id IS NULL"), folder, carried=["label"], cells=16)
    assert vector_index.open_or_build(items, folder).manifest == index.manifest  # is there, so nothing is built
    index = index.append(items.where("item_id >= 200"))
    assert vector_index.open_index(spark, folder).manifest["version"] == 2
    held = {r.item_id: r.label for r in index.items().collect()}
    assert held == {i: label for i, v, label in rows if i is not None and i not in range(900, 904)}
    queries = [(i, v) for i, v, _ in clustered(3, 40)] + [(5, rows[5][1]), (500, None), (501, [0.0] * 6), (502, [1.0] * 4), (503, [-x for x in rows[0][1]])]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    for apart in (False, True):
        got = sorted(map(tuple, index.search(asked, apart=apart).collect()), key=str)
        want = sorted(map(tuple, nearest.nearest_above(asked, index.items(), apart=apart).collect()), key=str)
        assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) == len(queries)
        assert all(g[2] == w[2] or abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))
    centres, radius, n = index._cells()
    near = asked.select(F.col("query_id").alias("query"), F.col("embedding").alias("vector")).where("query_id = 1").limit(1)
    first = vector_index._reached(near, centres, radius, n, None, 0.45)
    assert first.count() == 1
    second = vector_index._reached(near.withColumn("least", F.lit(0.999)), centres, radius, n, "least", 0.45)
    assert second.count() < (n > 0).sum() / 2
    with pytest.raises(ValueError):
        vector_index.open_or_build(items.limit(0), f"file://{tmp_path}/none")


def test_word_processor_files_become_html(spark):
    page = files.docx([("Title – G\tX", "Heading1"), ("Part", "Heading2"), ("a & <b>", None), ("odd", "Fancy"), ("", None), [["l1", "r1"], ["l2", "r2"]]])
    got, warnings = files.docx_html(page)
    assert got.replace("<p></p>", "") == "<h1>Title – G\tX</h1><h2>Part</h2><p>a &amp; &lt;b&gt;</p><p>odd</p><table><tr><td><p>l1</p></td><td><p>r1</p></td></tr><tr><td><p>l2</p></td><td><p>r2</p></td></tr></table>"
    assert warnings == ["no style is known as Fancy"]
    shown = spark.createDataFrame([(got,)], "html string").select(text.html_to_text(F.col("html")).alias("t")).first()["t"]
    assert shown.split("\n")[:4] == ["# Title – G\tX", "", "Part", "a & <b>"] and shown.endswith("l1\nr1\nl2\nr2")
    assert files.docx_html(b"no zip")[0] is None and files.docx_html(b"")[1]


def test_exporters_are_chosen_and_replayed_batches_replace_themselves(spark, tmp_path):
    assert exporters.chosen({}) == {"exporter": "console"}
    folder = f"file://{tmp_path}/spans"
    assert exporters.chosen({exporters.ENDPOINT: folder}) == {"exporter": "otlp", "path": folder}
    writer = exporters._Folder(folder)
    row = spark.createDataFrame([("t", "s", "n", 5, True, 1.5, None)], "trace_id string, span_id string, name string, start long, ok boolean, v double, gone string").collect()
    for _ in range(2):
        writer.commit([writer.write(iter(row)), writer.write(iter([])), None], 7)
    got = exporters.read_spans(spark, folder).collect()
    assert [(r.batch, r.trace_id, r.start, r.end, r.attributes) for r in got] == [(7, "t", 5, None, {"ok": "true", "v": "1.5"})]
    writer.abort([writer.write(iter(row))], 8)
    assert exporters.read_spans(spark, folder).count() == 1
    with pytest.raises(ValueError):
        exporters.SpanSource({"exporter": "smoke"}).streamWriter(None, False)


def test_tiers_are_asked_for_misses_only(spark):
    first = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "query_id long, answer string")
    asked = []

    def web(missed):
        asked.append(sorted(r.query_id for r in missed.collect()))
        return missed.where("query_id = 2").withColumn("answer", F.lit("w"))

    got = {tuple(r) for r in nearest.tiers(first, "vector", ("web", web)).collect()}
    assert asked == [[2, 3]] and got == {(1, "a", "vector"), (2, "w", "web"), (3, None, None)}
