"""Ball k-means, product codes and prefix counts against brute force, and their defined results for odd rows."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import ballkmeans, prefixcounts, productcodes

VEC = "vec_id long, embedding array<float>, label int"
ODD = [None, [], [1.0], [math.nan] * 8, [math.inf] + [0.0] * 7, [None] * 8, [0.0] * 8]


def vectors_of(seed, n, width=8, centres=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    x = (middle[rng.integers(0, centres, n)] + 0.2 * rng.normal(size=(n, width))).astype(np.float32)
    return [(int(i), v.tolist(), int(i) % 3) for i, v in zip(rng.permutation(n * 3)[:n], x)]


def whole(v):
    return [math.floor(1024 * float(x)) for x in v]


def lloyd(points, centres, rounds):
    """Plain Lloyd rounds in Python integers: the last assignments with distances, and the centroids they refer to."""

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centres)) for p in points]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [p for p, (_, i) in zip(points, found) if i == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return assign(), centres


# 11: ball k-means


def plain_clusters(rows, k, rounds, width):
    kept = [(i, whole(v)) for i, v, *_ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    found, centres = lloyd([v for _, v in kept], [list(v) for _, v in order[:k]], rounds)
    inertia = {j: sum(d for d, i in found if i == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((-1 if i is None else i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, found))


@pytest.mark.parametrize("n, k, rounds", [(300, 8, 10), (40, 12, 3), (3, 8, 2), (60, 1, 2)])
def test_clusters_equal_lloyd(spark, n, k, rounds):
    rows = vectors_of(n, n)
    rows += [(5000 + i, v, 1) for i, v in enumerate(ODD)] + rows[:3] + [(None, rows[1][1], 0), (7000, rows[0][1], 0)]
    df = spark.createDataFrame(rows, VEC).withColumns({c: F.lit("x") for c in ("id", "block", "clusters", "n", "cluster", "vector")}).repartition(3)
    found = ballkmeans.cluster(df, k=k, rounds=rounds, width=8, block=50).collect()
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found)
    assert got == plain_clusters(rows, k, rounds, 8)


def test_clusters_of_nothing_and_of_vectors_out_of_reach(spark):
    assert ballkmeans.cluster(spark.createDataFrame([], VEC)).count() == 0
    assert ballkmeans.cluster(spark.createDataFrame([(1, [1.0] * 8, 0)], VEC)).count() == 0
    rows = [(1, [1e30] + [0.0] * 63, 0), (2, [1.0] * 64, 0), (3, [1.5] * 64, 0)]
    got = {r.vec_id: r for r in ballkmeans.cluster(spark.createDataFrame(rows, VEC)).collect()}
    assert got[1].cluster is None and got[1].inertia is None and got[2].distance == got[3].distance == 0
    assert "larkspur_vectors" not in " ".join(t.name for t in spark.catalog.listTables())


def test_balls_compare_few_of_well_separated_clusters():
    rng = np.random.default_rng(4)
    centres = rng.integers(-20_000, 20_000, (16, 8))
    of = rng.integers(0, 16, 4000)
    x = centres[of] + rng.integers(-300, 300, (4000, 8))
    full = ballkmeans.Balls(centres, np.full(16, np.inf))
    cluster, distance, taken = full.assign(x, np.zeros(4000, np.int64))
    assert np.array_equal(cluster, of) and taken > 8 * 4000
    radius = np.sqrt([distance[cluster == j].max() for j in range(16)])
    again = ballkmeans.Balls(centres, radius).assign(x, cluster)
    assert np.array_equal(again[0], cluster) and np.array_equal(again[1], distance)
    assert again[2] == 4000  # all lie in the stable cores


def test_ties_go_to_the_smaller_number():
    balls = ballkmeans.Balls(np.array([[10, 0], [0, 0], [-10, 0], [10, 0]]), np.full(4, np.inf))
    cluster, distance, _ = balls.assign(np.array([[5, 0], [-5, 3], [10, 0]]), np.array([2, 2, 3]))
    assert cluster.tolist() == [0, 1, 0] and distance.tolist() == [25, 34, 0]


def test_blocks_stay_in_their_buckets(spark):
    df = spark.createDataFrame(vectors_of(9, 500), VEC).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    packed = ballkmeans.scaled_blocks(df, ["id"], 50).withColumn("block", F.monotonically_increasing_id())
    packed.write.bucketBy(4, "block").saveAsTable("larkspur_plan")
    try:
        state = spark.range(10).select(F.col("id").alias("block"), F.lit(bytes(50)).alias("clusters"))
        plan = ballkmeans._assigned(spark.table("larkspur_plan"), state, ballkmeans.Balls(np.zeros((2, 8), int), np.ones(2)), False)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and plan.count("Exchange") == 1
    finally:
        spark.sql("DROP TABLE larkspur_plan")


# 12: product codes


def plain_codes(rows, parts, entries, rounds, width):
    kept = [(i, whole(v), label) for i, v, label in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        cut = slice(width // parts * p, width // parts * (p + 1))
        found, book = lloyd([v[cut] for _, v, _ in kept], [v[cut] for _, v, _ in order], rounds)
        books += [x for c in book for x in c]
        for i, (d, j) in enumerate(found):
            codes[i] += f"{j:02x}"
            errors[i] += d
    of = {}
    for (_, _, label), e in zip(kept, errors):
        of[label] = of.get(label, 0) + e
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted((-1 if i is None else i, c, e, of[label], sha) for (i, _, label), c, e in zip(kept, codes, errors))


@pytest.mark.parametrize("n, entries", [(400, 256), (90, 16), (5, 256)])
def test_codes_equal_lloyd(spark, n, entries):
    rows = vectors_of(n + 1, n)
    rows += rows[:2] + [(None, rows[0][1], None), (9000, rows[1][1], None)]
    bad = [(8000 + i, v, 7) for i, v in enumerate(ODD[3:6])] + [(8100, None, 7)]
    other = [(8200, [], 7), (8201, [1.0], None), (8202, [1e30] * 8, 7), (8203, [1.0] * 12, 8)]
    df = spark.createDataFrame(rows + bad + other, VEC).withColumns({c: F.lit("x") for c in ("id", "vector", "of", "code", "n")}).repartition(3)
    found = productcodes.encode(df, entries=entries, block=64).collect()
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found if r.code)
    assert got == plain_codes(rows, 4, entries, 4, 8)
    assert {(r.vec_id, r.error) for r in found if not r.code} == {(i, None) for i, *_ in other}


def test_codes_of_nothing(spark):
    assert productcodes.encode(spark.createDataFrame([], VEC)).count() == 0
    got = productcodes.encode(spark.createDataFrame([(1, None, 1), (2, [1.0, 2.0, 3.0], 1)], VEC)).collect()
    assert [(r.vec_id, r.code, r.label_error, r.codebooks_sha256) for r in got] == [(2, None, None, None)]


def test_slices_and_kinds_of_numbers_agree(monkeypatch):
    rng = np.random.default_rng(2)
    part, book = rng.integers(-2000, 2000, (4, 700)), rng.integers(-2000, 2000, (9, 4))
    small = productcodes.nearest(part, book)
    monkeypatch.setattr(productcodes, "SLICE", 13)
    large = productcodes.nearest(part * 60_000, book * 60_000)
    assert np.array_equal(small[0], large[0]) and np.array_equal(small[1] * 3_600_000_000, large[1])


def test_a_code_is_decoded():
    books = np.arange(24).reshape(2, 4, 3)
    assert productcodes.decoded("0301", books).tolist() == [9, 10, 11, 15, 16, 17]


# 13: token counts at every prefix


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(prefixcounts.TOKENIZER))


def plain_counts(tokenizer, text):
    return [len(tokenizer.encode(text[:i], add_special_tokens=False)) for i in range(len(text) + 1)]


def steps_of(prefixes, text):
    return [0, *np.cumsum(np.frombuffer(prefixes.steps(text), np.int8), dtype=int).tolist()]


PIECES = " |  |\n|\t|\xa0|\x85|\x1c|a|the|'re|'s|'|'ll|!|..|1|23|<|endoftext|>|<|endo|é|日本|😀|　|re|'v|​|́|﻿|\r\n|ing| word|Straße"


def test_counts_at_every_prefix_equal_the_tokenizer(tokenizer, monkeypatch):
    rng = random.Random(6)
    pieces = [*PIECES.split("|"), "<|endoftext|>", "|", "|>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1200)]
    for cut in (1 << 20, 3):
        monkeypatch.setattr(prefixcounts, "SLICE", cut)
        prefixes = prefixcounts.Prefixes(public_tokenizers.path(prefixcounts.TOKENIZER))
        for text in texts:
            assert steps_of(prefixes, text) == plain_counts(tokenizer, text), repr(text)


def test_long_runs_and_forgotten_ones(tokenizer, monkeypatch):
    rng = random.Random(8)
    for name in ("REMEMBERED", "PAIRS"):
        monkeypatch.setattr(prefixcounts, name, 40)
    prefixes = prefixcounts.Prefixes(public_tokenizers.path(prefixcounts.TOKENIZER))
    for letters in ("a", "ab", "abcdefgh12.'", "日本語", "-", " ", "xyź"):
        text = "".join(rng.choice(letters) for _ in range(700))
        assert steps_of(prefixes, text) == plain_counts(tokenizer, text)
    many = "".join(rng.choice("abc =") for _ in range(200_000))
    assert steps_of(prefixes, many)[-1] == len(tokenizer.encode(many, add_special_tokens=False))


def test_documents_and_budgets(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None), (5, ""), (5, " \n "), (9001, "don't  <|endoftext|> stop " * 400), (9001, "don't  <|endoftext|> stop " * 400), (9002, "x" * 5000)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    docs = docs.withColumns({c: F.lit("x") for c in ("_text", "steps", "n_bytes", "n_tokens")})
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in prefixcounts.count_tokens(docs).collect())
    want = []
    for r in docs.collect():
        text = r.text or ""
        n = len(tokenizer.encode(text, add_special_tokens=False))
        kept = len(text)
        if n > 1024:
            offsets = tokenizer.encode(text, add_special_tokens=False).offsets
            near = offsets[1023][1]
            some = [i for i in range(max(0, near - 40), min(len(text), near + 40)) if len(tokenizer.encode(text[:i], add_special_tokens=False)) <= 1024]
            kept = max(some)
        want.append((-1 if r.doc_id is None else r.doc_id, len(text.encode()), n, n > 1024, kept))
    assert got == sorted(want)


def test_stored_counts_answer_any_prefix(spark, tokenizer):
    text = "We're here, <|endoftext|> aren't   we? Größe 123 日本語 " * 3
    docs = spark.createDataFrame([(i, text) for i in range(-1, len(text) + 3)] + [(None, text), (2, None)], "n int, text string")
    stored = prefixcounts.with_steps(docs.withColumn("kept", F.col("text")), "text")
    assert stored.columns == ["n", "kept", "steps"] and stored.schema["n"].dataType.simpleString() == "int"
    got = stored.select("n", F.col("kept").isNull().alias("none"), prefixcounts.tokens_within("steps", "n").alias("t"), prefixcounts.chars_within("steps", 7).alias("c"), F.octet_length("steps").alias("size")).collect()
    plain = plain_counts(tokenizer, text)
    for r in got:
        n = min(max(r.n or 0, 0), len(text))
        assert (r.t, r.c, r["size"]) == ((0, 0, 0) if r.none else (plain[n], max(i for i, x in enumerate(plain) if x <= 7), len(text)))
    assert prefixcounts.count_tokens(docs.limit(0), "n").count() == 0
