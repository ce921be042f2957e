"""The registered numbered queries themselves: their SQL, and columns that SQL does not give."""

import zlib
from collections import Counter

import duckdb
import pytest

from larkspur.llm import queries

from ..test_queries import TABLES, plain
from .test_small import plain_fingerprint


@pytest.mark.parametrize("name", ["op4_collision_counting", "op8_digest_array_urls", "op10_warc_segments", "op11_ball_kmeans", "op12_product_codes"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rel = con.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_columns_of_shards_and_fingerprints(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_hypergeometric_shards(spark, sf).collect()
    data = {i: (t or "").encode() for i, t in texts.items()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(b) + 1, zlib.crc32(b)) for i, b in data.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(n)) for k, n in counts.items())
    found = {r.doc_id: r.fingerprint for r in queries.op3_simhash_pigeonring(spark, sf).collect()}
    assert found == {i: f"{plain_fingerprint(t):016x}" for i, t in texts.items()}


def test_token_counts_of_all_documents(spark, sf):
    rows = queries.op13_prefix_counts(spark, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
