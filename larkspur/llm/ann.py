"""Nearest neighbours by multi-index hashing.

Rotations are learned on a sample of at most SAMPLE vectors (principal axes,
then iterative quantisation towards the signs), and every vector gets the signs
of its coordinates under them as one binary code of BITS bits. The different
vectors are dealt into shards, and in each the code is cut into substrings of
about log2(rows) bits, each with an index of its own. A query wants all codes
within a Hamming radius; by the pigeonhole principle such a code differs in at
most its share of the radius in one of the substrings, so all values within that
share are looked up there. What was met is held to the radius by the whole code,
and what remains is ranked by the cosine of the original vectors in double
precision.

The radius is set so that TARGET of the true neighbours of TRIED of the queries,
found by brute force, are retrieved; these queries are not among the vectors that
the rotations are learned on. A query that retrieves fewer than k rows is held
against all rows instead, so none comes out short.

Equal vectors are one entry with their k + 1 least ids, and equal queries are asked
once. A task holds one shard's entries and reads the queries past them, so its memory is
bounded by the shard whatever the input: pairs are met, filtered and ranked where
they are, and no list of them is kept, sent or written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, unit
from .vectors import unit_rows, usable

#: Vectors that rotations are fitted on at most, rows the recall is tried on at most, recall aimed at, seed.
SAMPLE, TRIED, TARGET, SEED = 2000, 200, 0.95, 5
#: Bits of a code, fewest bits of a substring, steps of fitting a rotation.
BITS, LEAST, STEPS = 256, 8, 2
#: Entries of a shard at most, components that they have at most, queries that a task asks it at most.
GROUP, HELD, ASKED = 1 << 20, 1 << 23, 1 << 18
#: Pairs from which more shards are made than memory asks for, up to so many for each core; most tasks.
PAIRS, SPREAD, TASKS = 1 << 22, 4, 1 << 15
#: Entries that can be compared at the cost of a lookup; pairs at once: compared, met, marked; rows turned at once.
LOOKUP, COMPARED, MET, MARKED, TURNED = 32, 1 << 18, 1 << 18, 1 << 22, 1 << 12


class Codes:
    """The learned rotations and the radius."""

    def __init__(self, sample: np.ndarray):
        dim = sample.shape[1]
        rng = np.random.default_rng(SEED)
        axes = np.linalg.svd(sample - sample.mean(0), full_matrices=False)[2] if len(sample) > dim else np.eye(dim)
        turns = []
        for _ in range(-(-BITS // dim)):
            turn = axes.T @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            for _ in range(STEPS if len(sample) > dim else 0):
                u, _, v = np.linalg.svd(sample.T @ np.sign(sample @ turn))
                turn = u @ v
            turns.append(turn)
        self.axes, self.radius = np.concatenate(turns, axis=1)[:, :BITS], -1

    def of(self, x: np.ndarray) -> np.ndarray:
        """The bits of the codes of rows of length 1."""
        return x @ self.axes > 0

    def calibrate(self, one: np.ndarray, two: np.ndarray) -> None:
        """Sets the radius that TARGET of the pairs of rows keep to."""
        differ = np.sort((self.of(one) != self.of(two)).sum(axis=1))
        self.radius = int(differ[math.ceil(TARGET * len(differ)) - 1]) if len(differ) else -1


def cuts(rows: int) -> list[int]:
    """Where the substrings of about log2(rows) bits begin, and the last ends."""
    parts = max(1, BITS // max(LEAST, (rows - 1).bit_length()))
    return [BITS * j // parts for j in range(parts + 1)]


def shares(radius: int, parts: int) -> list[int]:
    """How many bits may differ in each substring: a code beyond all of them differs in more than ``radius``. Where it is -1, none need be looked up."""
    whole, rest = divmod(radius, parts)
    return [whole - (j > rest) for j in range(parts)]


def _values(bits: np.ndarray) -> np.ndarray:
    """Each row's bits as a number."""
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64))


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


def _by_width(vectors: pa.Array) -> Iterator[tuple[pa.Array | None, np.ndarray]]:
    """For each width: which of the vectors have it (null: all), and they in rows."""
    widths = pc.list_value_length(vectors)
    found = pc.unique(widths).to_pylist()
    for w in found:
        kept = pc.equal(widths, w) if len(found) > 1 else None
        own = vectors if kept is None else vectors.filter(kept)
        yield kept, own.flatten().to_numpy(zero_copy_only=False).reshape(-1, w)


def _nearest_of(classes: DataFrame, tried: dict[int, np.ndarray], k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width: the tried rows, each repeated, and their k nearest rows of other direction among all rows."""
    shared = classes.sparkSession.sparkContext.broadcast(tried)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in _by_width(batch.column(0)):
                if (w := own.shape[1]) in shared.value:
                    x = unit_rows(own.astype(np.float64))
                    cos = shared.value[w] @ x.T
                    cos[cos > 1 - 1e-12] = -2
                    near = np.argpartition(-cos, min(k, len(x)) - 1, axis=1)[:, :k]
                    q = np.repeat(np.arange(len(cos)), near.shape[1])
                    score = np.take_along_axis(cos, near, 1).ravel()
                    kept = score > -2
                    found = pa.array([x[i].tobytes() for i in near.ravel()[kept]], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.sum(), w), pa.int32()), pa.array(q[kept]), pa.array(score[kept]), found], ["width", "q", "score", "vector"])

    found = classes.select("vector").mapInArrow(best, "width int, q long, score double, vector binary")
    place = F.row_number().over(Window.partitionBy("width", "q").orderBy(F.desc("score")))
    got = found.withColumn("place", place).where(F.col("place") <= k).toArrow()  # TRIED * k rows at most for each sampled width
    out = {}
    for w, x in tried.items():
        own = got.filter(pc.equal(got["width"], w))
        two = np.frombuffer(b"".join(own["vector"].to_pylist()), np.float64).reshape(-1, w)
        out[w] = (x[own["q"].to_numpy()], two)
    return out


def fit(classes: DataFrame, asked: DataFrame, k: int, sample: int = SAMPLE) -> dict[int, Codes]:
    """Codes for each width of the sampled vectors that some of the queries tried have neighbours in."""

    def drawn(rows: DataFrame, most: int, without: set[bytes]) -> dict[int, np.ndarray]:
        found = rows.select(unit(F.lit(SEED), F.col("ids")[0]).alias("u"), "vector").orderBy("u").limit(most).toArrow()["vector"].to_pylist()
        found = [x for x in map(np.array, found) if x.tobytes() not in without]
        return {w: np.array([x for x in found if len(x) == w]) for w in {len(x) for x in found}}

    tried = drawn(asked, TRIED, set())
    models = {w: Codes(unit_rows(x)) for w, x in drawn(classes, sample, {v.tobytes() for x in tried.values() for v in x}).items()}
    for w, pairs in _nearest_of(classes, {w: unit_rows(x) for w, x in tried.items() if w in models}, k).items():
        models[w].calibrate(*pairs)
    return {w: m for w, m in models.items() if m.radius >= 0}


def _masks(bits: int, most: int, least: int = 0) -> list[int]:
    """All numbers of ``bits`` bits of which least to most are set."""
    return [sum(1 << b for b in f) for n in range(least, min(most, bits) + 1) for f in combinations(range(bits), n)]


def _dense(entries: int, bits: int, near: int) -> bool:
    """Whether it costs less to compare all entries than to look up all values within ``near``."""
    return LOOKUP * sum(math.comb(bits, i) for i in range(min(near, bits) + 1)) >= entries


def _within(index: np.ndarray, asked: np.ndarray, bits: int, near: int, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of pairs (place in asked, place in index) of numbers of ``bits`` bits that differ in at most ``near``, each once; order: that of the index, if it is sorted already."""
    if _dense(len(index), bits, near):
        step = max(1, COMPARED // max(1, len(index)))
        for i in range(0, len(asked), step):
            q, at = np.nonzero(np.bitwise_count(asked[i : i + step, None] ^ index) <= near)
            yield q + i, at
        return
    if order is None:
        order = np.argsort(index, kind="stable")
        index = index[order]
    probes = np.array(_masks(bits, near), index.dtype)
    step = max(1, COMPARED // len(probes))
    for i in range(0, len(asked), step):
        probed = (asked[i : i + step, None] ^ probes).ravel()
        first = np.searchsorted(index, probed, "left")
        n = np.searchsorted(index, probed, "right") - first
        who = np.repeat(np.arange(i, min(i + step, len(asked))), len(probes))
        ends, a = np.cumsum(n), 0
        while a < len(n):  # values that many entries share come in several runs
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MET, "right")))
            m = n[a:b]
            yield np.repeat(who[a:b], m), order[np.arange(m.sum()) + np.repeat(first[a:b] - np.cumsum(m) + m, m)]
            a = b


class Shard:
    """Entries of one width with an index for each substring, in one task."""

    def __init__(self, ids: list[pa.Array], parts: list[np.ndarray], model: Codes | None):
        listed = pa.concat_arrays(ids)
        self.counts = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids, self.starts = listed.flatten().to_numpy(zero_copy_only=False), np.cumsum(self.counts) - self.counts
        self.x = np.concatenate(parts)
        self.most, self.length, self.model = np.empty((len(self.x), 1)), np.empty((len(self.x), 1)), model
        words = []
        for i in range(0, len(self.x), TURNED):
            x = self.x[i : i + TURNED].astype(np.float64)
            self.most[i : i + TURNED] = np.abs(x).max(axis=1, keepdims=True)
            x /= self.most[i : i + TURNED]
            self.length[i : i + TURNED] = np.sqrt((x * x).sum(axis=1, keepdims=True))
            if model:
                words.append(_words(model.of(x / self.length[i : i + TURNED])))
        if model:
            self.words, at = np.concatenate(words), cuts(len(self.x))
            self.substrings = []
            for a, b, near in zip(at, at[1:], shares(model.radius, len(at) - 1)):
                if near >= 0:
                    value = self.cut(self.words, a, b)
                    dense = _dense(len(value), b - a, near)
                    order = None if dense else np.argsort(value, kind="stable").astype(np.int32)
                    self.substrings.append((a, b, near, value if dense else value[order], order))

    @staticmethod
    def cut(words: np.ndarray, a: int, b: int) -> np.ndarray:
        """Each row's bits a to b as a number of as few bytes as hold it."""
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if b - a <= 8 * np.dtype(k).itemsize)
        out = np.empty(len(words), kind)
        for i in range(0, len(words), TURNED):
            out[i : i + TURNED] = _values(np.unpackbits(words[i : i + TURNED].view(np.uint8), axis=1)[:, a:b])
        return out

    def met(self, words: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
        """Which entries some substring retrieves for each query and the whole code keeps."""
        hit, compared = np.zeros((len(words), len(self.x)), bool), False
        for (a, b, near, index, order), asked in zip(self.substrings, values):
            if order is not None:
                for q, at in _within(index, asked, b - a, near, order):
                    kept = np.bitwise_count(self.words[at] ^ words[q]).sum(axis=1, dtype=np.int64) <= self.model.radius
                    hit[q[kept], at[kept]] = True
        dense = [(near, index, asked) for (_, _, near, index, order), asked in zip(self.substrings, values) if order is None]
        step = max(1, COMPARED // len(self.x))
        for i in range(0, len(words) if dense else 0, step):
            own, far = np.zeros_like(hit[i : i + step]), np.zeros(hit[i : i + step].shape, np.uint16)
            for near, index, asked in dense:
                own |= np.bitwise_count(asked[i : i + step, None] ^ index) <= near
            for c in range(self.words.shape[1]):
                far += np.bitwise_count(words[i : i + step, None, c] ^ self.words[:, c])
            hit[i : i + step] |= own & (far <= self.model.radius)
        return hit

    def best(self, rows: np.ndarray, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k + 1 nearest ids of these entries, an id as often as it comes before the next."""
        score = np.concatenate([(self.x[r].astype(np.float64) / self.most[r] / self.length[r] * q).sum(axis=1) for r in (rows[i : i + TURNED] for i in range(0, len(rows), TURNED))])
        if len(rows) > 8 * (k + 1):  # ties with the last one stay
            kept = score >= np.partition(score, len(rows) - k - 1)[len(rows) - k - 1]
            rows, score = rows[kept], score[kept]
        first = np.lexsort((self.ids[self.starts[rows]], -score))[: k + 1]
        own = sorted((-s, v) for r, s in zip(rows[first].tolist(), score[first].tolist()) for v in self.ids[self.starts[r] : self.starts[r] + self.counts[r]].tolist())
        known: set[int] = set()
        for i, (_, v) in enumerate(own):
            if v not in known and len(known) == k + 1:
                return own[:i]
            known.add(v)
        return own

    def answers(self, keys: np.ndarray, x: np.ndarray, k: int, every: bool) -> Iterator[tuple[int, int, float, int]]:
        """For each query: its best ids with their scores, and how many entries were ranked, in its first row."""
        step = max(1, MARKED // len(self.x))
        for i in range(0, len(x), step):
            q = unit_rows(x[i : i + step].astype(np.float64))
            if not every:
                words = _words(self.model.of(q))
                hit = self.met(words, [self.cut(words, a, b) for a, b, *_ in self.substrings])
            for j, key in enumerate(keys[i : i + step].tolist()):
                rows = np.arange(len(self.x)) if every else np.flatnonzero(hit[j])
                if len(rows):
                    yield from ((key, v, -s, 0 if t else len(rows)) for t, (s, v) in enumerate(self.best(rows, q[j], k)))


def _spread(classes: DataFrame, wanted: DataFrame) -> tuple[int, int]:
    """Shards of the entries, and slices of the queries: one of each is a task."""
    n, components = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    m = wanted.count()
    cores = classes.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // GROUP), -(-components // HELD), min(SPREAD * cores, n * m // PAIRS)), max(1, -(-m // ASKED))


def _nearest(classes: DataFrame, wanted: DataFrame, models: dict[int, Codes], k: int, every: bool = False) -> DataFrame:
    """Rows (key, vec_id, score, seen): each shard's k + 1 nearest ids for each of ``wanted`` (key, vector), of those within the radius or of every entry."""
    shards, slices = _spread(classes, wanted)
    shared = classes.sparkSession.sparkContext.broadcast({} if every else models)
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = classes.select(of(F.col("ids")[0], shards).alias("shard"), each(slices).alias("slice"), F.lit(0).alias("asks"), "ids", "vector")
    asked = wanted.select(each(shards).alias("shard"), of("key", slices).alias("slice"), F.lit(1).alias("asks"), F.array("key").alias("ids"), "vector")
    rows = index.union(asked).select((F.col("shard").cast("long") * slices + F.col("slice")).alias("task"), "asks", "ids", "vector")
    tasks = min(shards * slices, TASKS)
    dealt = rows.repartitionById(tasks, (F.col("task") % tasks).cast("int")).sortWithinPartitions("task", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, built = None, {}, {}
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (0, 1)], axis=1)
            ends = [0, *(np.flatnonzero(np.any(marks[1:] != marks[:-1], axis=1)) + 1).tolist(), len(marks)]
            for i, j in zip(ends, ends[1:]):
                if i == j:
                    continue
                if marks[i, 0] != task:
                    task, held, built = marks[i, 0], {}, {}
                ids, vectors = (batch.column(c).slice(i, j - i) for c in (2, 3))
                for kept, x in _by_width(vectors):
                    own, w = ids if kept is None else ids.filter(kept), x.shape[1]
                    if not marks[i, 1]:
                        if every or w in shared.value:
                            both = held.setdefault(w, ([], []))
                            both[0].append(own)
                            both[1].append(x)
                        continue
                    if w in held:
                        built[w] = Shard(*held.pop(w), shared.value.get(w))
                    if w in built:
                        keys = own.flatten().to_numpy(zero_copy_only=False)
                        for a in range(0, len(keys), 1000):
                            found = list(zip(*built[w].answers(keys[a : a + 1000], x[a : a + 1000], k, every)))
                            if found:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], ["key", "vec_id", "score", "seen"])

    return dealt.mapInArrow(search, "key long, vec_id long, score double, seen long")


def _ranked(found: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """What was found for the keys as the k nearest of each of their ids, the id itself left out."""
    of = Window.partitionBy("key")
    order = (F.desc("score"), "vec_id")
    first = F.row_number().over(Window.partitionBy("key", "vec_id").orderBy(F.desc("score"))) == 1
    firsts = F.sum(F.col("first").cast("int")).over(of.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    best = found.withColumn("retrieved", F.sum("seen").over(of)).withColumn("first", first).withColumn("firsts", firsts).where(F.col("firsts") <= k + 1)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")
    got = best.join(ids, "key").where("vec_id <> query_id").withColumn("rank", rank)
    return got.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "retrieved")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """The k nearest rows of ``vectors`` found, by cosine, for each row of ``queries``: query_id, rank, vec_id, score, retrieved.

    ``retrieved`` counts the different vectors that were ranked for the query. A
    query is no candidate of its own: rows with its id are left out. Ties go to
    the smaller id. Vectors that are null, empty, zero, or hold a null or
    non-finite component take no part, nor do null ids; vectors of another width
    than the query are no candidates. Of repeated query ids one is asked;
    repeated candidates count each. Empty tables give an empty result; further
    columns are not read.
    """
    kinds = {dict(d.dtypes)[vector_col] for d in (vectors, queries)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    rows, own = [d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector")).where(usable("vector") & F.col("id").isNotNull()) for d in (vectors, queries)]
    alike = Window.partitionBy("vector").orderBy("id")
    least = rows.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1)  # filtered before it is shuffled, so no group is large
    listed = least.withColumn("ids", F.collect_list("id").over(alike.rowsBetween(0, k)))  # dealt and sorted already
    classes = stage(listed.where("place = 1").select("ids", "vector"), "classes")
    own = stage(own.dropDuplicates(["id"]), "asked")
    wanted = stage(own.groupBy("vector").agg(F.min("id").alias("key")), "wanted")
    ids = stage(own.join(wanted, "vector").select(F.col("id").alias("query_id"), "key"), "ids")

    models = fit(classes, wanted.select(F.array("key").alias("ids"), "vector"), k, sample)
    ranked = stage(_ranked(stage(_nearest(classes, wanted, models, k), "found"), ids, k), "ranked")
    got = ids.join(ranked.groupBy("query_id").count(), "query_id", "left")
    short = stage(got.where(F.coalesce("count", F.lit(0)) < k).select("key").distinct(), "short")
    if short.isEmpty():
        return ranked
    few = ids.join(short, "key", "left_semi")  # these are held against all rows of their width
    again = _ranked(stage(_nearest(classes, wanted.join(short, "key", "left_semi"), models, k, every=True), "found"), few, k)
    return ranked.join(few, "query_id", "left_anti").select(ranked.columns).union(again)
