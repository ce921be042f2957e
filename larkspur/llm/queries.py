"""The numbered queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ballkmeans, embdedup, langid, lmscore, mixing, packing, prefixcounts, productcodes, sharding, simhash, urlfilter, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    found = lmscore.score(_documents(spark, sf_dir), members=good)
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = _documents(spark, sf_dir).select("doc_id", (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"))
    out = sharding.shuffle_rows(docs, 8, key=["doc_id"])
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("copies")


def op7_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op4_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op8_digest_array_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.judge_urls(pages, urlfilter.rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("broken")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballkmeans.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return productcodes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixcounts.count_tokens(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cross_entropy_difference,
        op2_hypergeometric_shards,
        op3_simhash_pigeonring,
        op4_collision_counting,
        op5_pivotal_mix,
        op6_multi_index_hashing,
        op7_hierarchical_language,
        op8_digest_array_urls,
        op9_harmonic_packing,
        op10_warc_segments,
        op11_ball_kmeans,
        op12_product_codes,
        op13_prefix_counts,
    )
}

#: Vectors without null or non-finite components, in whole numbers.
_KEPT = """
          SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
#: Squared distance of two lists of whole numbers, exact as long as they stay below 2 ** 53, and an exact floor of s / n.
_SQUARED = "(list_inner_product({0}, {0}) - 2 * list_inner_product({0}, {1}) + list_inner_product({1}, {1}))::BIGINT"
_MEAN = "((s - (s % n + n) % n) // n)::DOUBLE"


def _kmeans_sql(k: int, rounds: int, width: int, seed: int) -> str:
    """SQL of op11: a round after the other, each a full search."""
    name = f"sha256('{seed}:' || vec_id)"
    parts = [
        f"WITH kept AS MATERIALIZED ({_KEPT} AND len(embedding) = {width})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {name}) - 1 AS k, v AS c FROM (SELECT * FROM kept ORDER BY {name} LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({_SQUARED.format('v', 'c')} * {k} + k) AS m FROM kept, c{r} GROUP BY vec_id)")
        if r < rounds:
            sums = f"SELECT k, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT m % {k} AS k, unnest(v) AS x, unnest(range({width})) AS i FROM a{r}) GROUP BY k, i"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(w.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT k, list({_MEAN} ORDER BY i) AS c FROM ({sums}) GROUP BY k) w USING (k))")
    return ", ".join(parts) + f"""
        SELECT vec_id, (m % {k})::INT AS cluster, m // {k} AS distance, (sum(m // {k}) OVER (PARTITION BY m % {k}))::BIGINT AS cluster_inertia,
          (sum(m // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON k = m % {k}"""


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """SQL of op12: a round after the other, each a full search."""
    steps = [
        f"WITH kept AS MATERIALIZED ({_KEPT})",
        f"part AS MATERIALIZED (SELECT vec_id, label, p, v[(p * len(v) // {parts} + 1)::INT:((p + 1) * len(v) // {parts})::INT] AS x FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, k, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM part) WHERE k < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min({_SQUARED.format('x', 'c')} * {entries} + k) AS m FROM part JOIN b{r} USING (p) GROUP BY vec_id, p)")
        if r < rounds:
            sums = f"SELECT p, k, i, sum(y)::HUGEINT AS s, count(*) AS n FROM (SELECT p, m % {entries} AS k, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{r}) GROUP BY p, k, i"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT o.p, o.k, coalesce(w.c, o.c) AS c FROM b{r} o LEFT JOIN (SELECT p, k, list({_MEAN} ORDER BY i) AS c FROM ({sums}) GROUP BY p, k) w USING (p, k))")
    return ", ".join(steps) + f""",
        coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(m % {entries}), 2, '0')), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        named AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, named"""


ORACLE_SQL: dict[str, str] = {
    "op11_ball_kmeans": _kmeans_sql(ballkmeans.CLUSTERS, ballkmeans.ROUNDS, ballkmeans.WIDTH, ballkmeans.SEED),
    "op12_product_codes": _codes_sql(productcodes.PARTS, productcodes.ENTRIES, productcodes.ROUNDS),
    "op1_cross_entropy_difference": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS own,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
          FROM documents
        ), tokens AS (
          SELECT r, own, unnest(words) AS w, unnest(['' ] || words[:-2]) AS h FROM d WHERE len(words) > 0
        ), pair AS (
          SELECT r, own, h, w, count(*) AS n FROM tokens GROUP BY ALL
        ), bigram AS (
          SELECT h, w, sum(n) AS b, coalesce(sum(n) FILTER (own), 0) AS t FROM pair GROUP BY ALL
        ), followed AS (
          SELECT h, sum(b) AS b_all, count(*) AS b_kinds, sum(t) AS t_all, count(*) FILTER (t > 0) AS t_kinds FROM bigram GROUP BY h
        ), single AS (
          SELECT w, sum(b) AS b_one, sum(t) AS t_one FROM bigram GROUP BY w
        ), total AS (
          SELECT count(*) + 1 AS size, sum(b_one) AS b_sum, count(*) AS b_sorts, sum(t_one) AS t_sum, count(*) FILTER (t_one > 0) AS t_sorts FROM single
        ), met AS (
          SELECT p.*, b, t, b_all, b_kinds, t_all, t_kinds, b_one, t_one,
            sum(n) OVER (PARTITION BY r, h) AS own_all, count(*) FILTER (t = n) OVER (PARTITION BY r, h) AS own_kinds,
            sum(n) OVER (PARTITION BY r, w) AS own_one, sum(n) OVER (PARTITION BY r) AS own_sum
          FROM pair p JOIN bigram USING (h, w) JOIN followed USING (h) JOIN single USING (w)
        ), sorts AS (
          SELECT r, count(*) AS own_sorts FROM (SELECT DISTINCT r, w FROM met WHERE own AND own_one = t_one) GROUP BY r
        ), c AS (
          SELECT r, n, size, b, b_all, b_kinds, b_one, b_sum, b_sorts,
            if(own, t - n, t) AS t, if(own, t_all - own_all, t_all) AS t_all, if(own, t_kinds - own_kinds, t_kinds) AS t_kinds,
            if(own, t_one - own_one, t_one) AS t_one, if(own, t_sum - own_sum, t_sum) AS t_sum, if(own, t_sorts - coalesce(own_sorts, 0), t_sorts) AS t_sorts
          FROM met LEFT JOIN sorts USING (r), total
        ), base AS (
          SELECT *, (b_one + b_sorts / size) / (b_sum + b_sorts) AS b_base, if(t_sorts > 0, (t_one + t_sorts / size) / (t_sum + t_sorts), 1 / size) AS t_base FROM c
        ), loss AS (
          SELECT r, sum(n) AS n, sum(n * -log2((b + b_kinds * b_base) / (b_all + b_kinds))) AS b_loss,
            sum(n * -log2(if(t_kinds > 0, (t + t_kinds * t_base) / (t_all + t_kinds), t_base))) AS t_loss
          FROM base GROUP BY r
        )
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(t_loss / n, 6) AS target_loss, round(b_loss / n, 6) AS background_loss, round(t_loss / n - b_loss / n, 6) AS score
        FROM d LEFT JOIN loss USING (r)
    """,
    "op4_collision_counting": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach(a, b) AS (
          SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        )
        SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links,
          (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS component_id,
          e.vec_id = (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS kept
        FROM embeddings e
    """,
    "op8_digest_array_urls": """
        WITH rules(verdict, host, path) AS (VALUES
          ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), p AS (
          SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages
        ), fit AS (
          SELECT p.page_id, r.host || r.path AS rule, r.verdict,
            row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
          FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        )
        SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
        FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND fit.n = 1
    """,
    "op10_warc_segments": """
        WITH p AS (
          SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
          SELECT page_id, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS first,
            list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
              (('0x' || h[(i * 5 // 4 + 1)::INT:(i * 5 // 4 + 2)::INT])::INT >> (3 - i * 5 % 4)::INT) % 32 + 1]), 'string_agg', '') AS digest
          FROM p
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """,
}
