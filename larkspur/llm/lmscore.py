"""Scoring documents by cross-entropy difference.

Two bigram models, one of the target documents and one of all documents, share
one vocabulary, order and smoothing (by the number of different followers of
each word: Witten and Bell). A document's score is the mean over its tokens of
the target model's loss minus the background model's: the lower, the more like
the target.

Every word and every bigram has counts of its own, so what is gathered grows
with the corpus; words go by 64-bit hashes, of which a billion words share one
with a chance of 1 in 37. The documents are cut into chunks of about 8 MB,
stored as the chunk's words and a number for each token. A chunk asks for the
counts of its different words and bigrams: it sends them, with how often it has
them itself, to parts that own a range of words each; a part adds up what all
chunks sent, and answers each chunk in the order in which it asked. With these
answers a chunk scores its documents by itself. The followers of frequent words,
which a list of at most HOT words names, are spread over all parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import coded_words, new_path, packed, stage, unpacked, unstage

#: Tokens of a part, most words whose followers are spread.
PART, HOT = 1 << 20, 1 << 20
#: Bits of documents' roles: counted in the background and scored; counted in the target; scored without their own counts there.
SCORED, TARGET = 1, 2


_TOKENS = "ids array<bigint>, tokens bigint, lengths binary, words binary, codes binary"


def tokenize(docs: DataFrame) -> DataFrame:
    """Chunks of documents (id, text): their ids, number of tokens, tokens of each document, hashes of the words, and a word's place among them for each token."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, at, offsets in coded_words(batch.column(1)):
                ids = pa.array([batch.column(0).slice(first, len(offsets) - 1)], pa.list_(pa.int64()))
                blobs = [pa.array([packed(x)], pa.binary()) for x in (np.diff(offsets), words, at)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(at)], pa.int64()), *blobs], ["ids", "tokens", "lengths", "words", "codes"])

    return docs.mapInArrow(cut, _TOKENS)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Words (their sorted hashes, 0 in front: what stands before a text) and bigrams of a chunk, as both passes see them."""

    def __init__(self, words: bytes, codes: bytes, lengths: bytes):
        hashes = unpacked(words)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(1, len(order) + 1, dtype=np.uint64)
        self.words = np.concatenate((np.zeros(1, np.uint64), hashes[order]))
        self.after = rank[unpacked(codes).astype(np.int64)]
        self.lengths = unpacked(lengths).astype(np.int64)
        before = np.concatenate((np.zeros(1, np.uint64), self.after))[:-1]
        starts = np.cumsum(self.lengths) - self.lengths
        before[starts[self.lengths > 0]] = 0
        self.keys = before << np.uint64(32) | self.after

    def count(self, sorted_keys: np.ndarray) -> None:
        new = np.ones(len(sorted_keys), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        self.starts = np.flatnonzero(new)
        self.bigrams = sorted_keys[self.starts]
        self.times = np.diff(np.append(self.starts, len(sorted_keys)))

    def lay_out(self, hot: np.ndarray, bits: int) -> None:
        """Which bigrams are asked of which part: ``cold`` ones by their first word, the others by both."""
        one, two = (self.bigrams >> np.uint64(32)).astype(np.int64), (self.bigrams & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.one, self.two = one, two
        place = np.minimum(np.searchsorted(hot, self.words), len(hot) - 1)
        self.hot_place = np.where(hot[place] == self.words, place, -1)
        spread = self.hot_place[one] >= 0
        self.cold, other = np.flatnonzero(~spread), np.flatnonzero(spread)
        mixed = _mix(self.words[one[other]], self.words[two[other]])
        order = np.argsort(mixed)
        self.spread, mixed = other[order], mixed[order]
        bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
        ends = lambda x: np.concatenate(([0], np.searchsorted(x, bounds), [len(x)]))
        self.word_cuts, self.cold_cuts, self.spread_cuts = ends(self.words[1:]) + 1, ends(self.words[one[self.cold]]), ends(mixed)


def _roles(chunk: Chunk, kind: int, own: list[int] | None) -> np.ndarray:
    """The role of each document."""
    roles = np.full(len(chunk.lengths), kind, np.uint8)
    roles[own or []] |= TARGET
    return roles


def _requests(chunks: DataFrame, hot: np.ndarray, bits: int) -> DataFrame:
    """Rows (part, chunk, data): what a chunk asks of a part."""
    shared = chunks.sparkSession.sparkContext.broadcast(hot)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, kind, own, lengths, words, codes in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "own", "lengths", "words", "codes"))):
                c = Chunk(words, codes, lengths)
                roles = np.repeat(_roles(c, kind, own), c.lengths)
                c.count(np.sort(c.keys))
                c.lay_out(shared.value, bits)
                counts = []
                for role in (SCORED, TARGET):
                    has = (roles & role) > 0
                    if has.all():
                        n = c.times
                    else:
                        n, some = np.zeros(len(c.bigrams), np.int64), Chunk.__new__(Chunk)
                        some.count(np.sort(c.keys[has]))
                        n[np.searchsorted(c.bigrams, some.bigrams)] = some.times
                    counts.append((np.bincount(c.two, n, len(c.words)).astype(np.int64), n))
                followers = np.bincount(c.one[c.cold], minlength=len(c.words))
                for p in range(1 << bits):
                    w, cold, spread = (slice(x[p], x[p + 1]) for x in (c.word_cuts, c.cold_cuts, c.spread_cuts))
                    if w.start == w.stop and spread.start == spread.stop:
                        continue
                    i, j = c.cold[cold], c.spread[spread]
                    data = [c.words[w], followers[w], *[n[w] for n, _ in counts], c.words[c.two[i]], *[n[i] for _, n in counts]]
                    data += [c.hot_place[c.one[j]], c.words[c.two[j]], *[n[j] for _, n in counts]]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([number], pa.int64()), pa.array([[packed(x) for x in data]], pa.list_(pa.binary()))], ["part", "chunk", "data"])

    return chunks.mapInArrow(ask, "part int, chunk bigint, data array<binary>")


def _groups(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each pair's group of equal pairs, and a first member of each group."""
    key = _mix(one.astype(np.uint64), two)
    order = np.argsort(key)
    differs = lambda o: (one[o][1:] != one[o][:-1]) | (two[o][1:] != two[o][:-1])
    differ = differs(order)
    if not np.array_equal(differ, key[order][1:] != key[order][:-1]):  # two pairs have one hash
        order = np.lexsort((two, one))
        differ = differs(order)
    new = np.concatenate((np.ones(min(len(order), 1), bool), differ))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _sums(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights, n).astype(np.int64)


_ANSWERS = "part int, chunk bigint, data array<binary>, hot array<struct<i:int,b_all:bigint,b_kinds:bigint,t_all:bigint,t_kinds:bigint>>, totals array<bigint>"


def _answer(table: pa.Table) -> pa.Table:
    """What a part answers: for a chunk's words once, all and kinds in both models, for its bigrams the counts; a row without a chunk has sums over the part."""
    asked = [[unpacked(x) for x in data] for data in table["data"].to_pylist()]
    words, followers, b, t, after, b2, t2, place, after3, b3, t3 = (np.concatenate(x) for x in zip(*asked))
    known, word = np.unique(words, return_inverse=True)
    once = [_sums(word, n, len(known)) for n in (b, t)]
    followers = followers.astype(np.int64)
    before = np.repeat(word, followers)
    pair, first = _groups(before, after)
    counts = [_sums(pair, n, len(first)) for n in (b2, t2)]
    stats = [once[0], once[1]]
    for n in counts:
        stats += [_sums(before[first], n, len(known)), _sums(before[first], n > 0, len(known))]
    pair3, first3 = _groups(place, after3)
    counts3 = [_sums(pair3, n, len(first3)) for n in (b3, t3)]
    hot = [{}] * 0
    if len(first3):
        own, i = np.unique(place[first3].astype(np.int64), return_inverse=True)
        columns = [f(i, n, len(own)) for n in counts3 for f in (_sums, lambda i, n, k: _sums(i, n > 0, k))]
        hot = [dict(zip(("i", "b_all", "b_kinds", "t_all", "t_kinds"), r)) for r in zip(own.tolist(), *(x.tolist() for x in columns))]
    totals = [len(known), *[int(x) for n in once for x in (n.sum(), (n > 0).sum())]]
    data, at = [], [0, 0, 0]
    for x in asked:
        w, i, j = (slice(a, a + len(x[k])) for a, k in zip(at, (0, 4, 7)))
        data.append([packed(y) for y in (*[s[word[w]] for s in stats], *[n[pair[i]] for n in counts], *[n[pair3[j]] for n in counts3])])
        at = [w.stop, i.stop, j.stop]
    part = table["part"].to_pylist()
    rows = {"part": [*part, part[0]], "chunk": [*table["chunk"].to_pylist(), None], "data": [*data, None], "hot": [*[None] * len(data), hot], "totals": [*[None] * len(data), totals]}
    pairs = pa.list_(pa.struct([("i", pa.int32()), *[(k, pa.int64()) for k in ("b_all", "b_kinds", "t_all", "t_kinds")]]))
    return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(rows.items(), (pa.int32(), pa.int64(), pa.list_(pa.binary()), pairs, pa.list_(pa.int64())))})


def _loss(c: np.ndarray, whole: np.ndarray, kinds: np.ndarray, once: np.ndarray, total: np.ndarray | int, sorts: np.ndarray | int, size: int) -> np.ndarray:
    """Bits of a bigram that occurs c times, whose first word has ``whole`` followers of ``kinds`` kinds and whose second word occurs ``once`` times."""
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(np.asarray(sorts) > 0, (once + sorts / size) / (total + sorts), 1 / size)
        return -np.log2(np.where(kinds > 0, (c + kinds * base) / (whole + kinds), base))


def _lookup(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the place of each key among them, and sums of the weights."""
    different, at = np.unique(keys, return_inverse=True)
    return different, at, _sums(at, np.ones(len(keys)) if weights is None else weights, len(different))


def _without_own(c: Chunk, of: np.ndarray, document: np.ndarray, counts: np.ndarray, stats: list[np.ndarray], total: int, sorts: int, size: int) -> np.ndarray:
    """Target losses, by document, of tokens (bigram ``of``, ``document``) when each document's own counts are taken off."""
    once, whole, kinds = stats
    key, _, n = _lookup(document * len(c.bigrams) + of)
    d, u = np.divmod(key, len(c.bigrams))
    width = len(c.words)
    words, word, own_once = _lookup(d * width + c.two[u], n)
    _, first, own_all = _lookup(d * width + c.one[u], n)
    own_kinds = _sums(first, counts[u] == n, len(own_all))
    owner, second = np.divmod(words, width)
    docs = len(c.lengths)
    own_total, own_sorts = _sums(owner, own_once, docs), _sums(owner, once[second] == own_once, docs)
    loss = _loss(counts[u] - n, whole[c.one[u]] - own_all[first], kinds[c.one[u]] - own_kinds[first], once[c.two[u]] - own_once[word], total - own_total[d], sorts - own_sorts[d], size)
    return np.bincount(d, loss * n, docs)


def score(docs: DataFrame, target: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", members: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score (their difference), losses in bits a token.

    ``target`` are documents like ``docs`` (null texts and repeated rows count as
    they are), whether or not they are also among ``docs``. ``members`` has ids of
    documents in ``docs`` that are the target too, and that are scored by a
    target model without their own counts; null ids name none, ids that occur
    several times name all their rows. A text that is null, empty or blank has no
    tokens, and null losses and score; a text of any length is scored whole.
    Without target documents the target model is uniform. An empty table gives an
    empty result; further columns are not read.
    """
    spark = docs.sparkSession
    texts = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = tokenize(texts(docs)).withColumn("kind", F.lit(SCORED))
    if target is not None:
        chunks = chunks.union(tokenize(texts(target)).withColumn("kind", F.lit(TARGET)))
    # bucketed, so that chunks stay where they are and only the small sides of joins move
    name, path = f"larkspur_chunks_{uuid.uuid4().hex}", new_path(spark, "chunks")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    chunks.withColumn("chunk", F.monotonically_increasing_id()).write.bucketBy(buckets, "chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    chunks = spark.table(name)
    own = chunks.where(F.lit(False)).select("chunk", F.array().cast("array<int>").alias("own"))
    if members is not None:
        named = members.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
        own = chunks.where(F.col("kind") == SCORED).select("chunk", F.posexplode("ids").alias("pos", "id")).join(named, "id", "left_semi").groupBy("chunk").agg(F.array_sort(F.collect_list("pos")).alias("own"))
        own = stage(own, "own")

    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(0, -(-tokens // PART) - 1).bit_length()
    limit = min(4 << bits, HOT)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, codes in zip(batch.column(0), batch.column(1)):
                hashes = unpacked(words.as_py())
                n = np.bincount(unpacked(codes.as_py()).astype(np.int64), minlength=len(hashes))
                much = n * limit >= n.sum()
                yield pa.RecordBatch.from_arrays([pa.array(hashes[much].view(np.int64)), pa.array(n[much])], ["word", "n"])

    often = chunks.select("words", "codes").mapInArrow(frequent, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * limit >= tokens)
    hot = np.sort(np.append(np.array([r["word"] for r in often.collect()], np.int64).view(np.uint64), np.uint64(0)))  # ``limit`` words at most
    asked = _requests(chunks.join(own, "chunk", "left"), hot, bits)
    answers = stage(asked.groupBy("part").applyInArrow(_answer, _ANSWERS), "answers")

    sums = answers.where("chunk IS NULL")
    size, *totals = (r or 0 for r in sums.agg(*[F.sum(F.col("totals")[k]) for k in range(5)]).first())
    size += 1
    rows = sums.select(F.explode("hot").alias("h")).select("h.*").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("b_all", "b_kinds", "t_all", "t_kinds")]).toArrow()
    spread = np.zeros((4, len(hot)), np.int64)
    spread[:, rows["i"].to_numpy()] = [rows[c].to_numpy() for c in ("b_all", "b_kinds", "t_all", "t_kinds")]
    shared = spark.sparkContext.broadcast((hot, spread))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        hot, spread = shared.value
        row = {k: left[k][0].as_py() for k in ("lengths", "words", "codes")}
        c = Chunk(row["words"], row["codes"], row["lengths"])
        order = np.argsort(c.keys)
        c.count(c.keys[order])
        c.lay_out(hot, bits)
        of = np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(c.bigrams)), c.times)
        document = np.repeat(np.arange(len(c.lengths)), c.lengths)
        parts = sorted((p, [unpacked(x) for x in data]) for p, data in zip(right["part"].to_pylist(), right["data"].to_pylist()))
        got = [np.concatenate([np.zeros(0, np.uint64), *[data[k] for _, data in parts]]).astype(np.int64) for k in range(10)]
        stats = [np.concatenate(([0], x)) for x in got[:6]]  # once in both, then all and kinds in the background and the target
        for x, own_ in zip(stats[2:], spread):
            x[c.hot_place >= 0] = own_[c.hot_place[c.hot_place >= 0]]
        counts = np.empty((2, len(c.bigrams)), np.int64)
        counts[:, c.cold], counts[:, c.spread] = got[6:8], got[8:10]
        n = np.maximum(c.lengths, 1)
        loss = []
        for k in range(2):
            once, whole, kinds = stats[k], stats[2 + 2 * k], stats[3 + 2 * k]
            each = _loss(counts[k], whole[c.one], kinds[c.one], once[c.two], totals[2 * k], totals[2 * k + 1], size)
            loss.append(np.bincount(document, each[of], len(n)) / n)
        mine = left["own"][0].as_py()
        if mine:
            some = np.isin(document, mine)
            without = _without_own(c, of[some], document[some], counts[1], [stats[1], stats[4], stats[5]], totals[2], totals[3], size) / n
            loss[1][mine] = without[mine]
        none = c.lengths == 0
        columns = [left["ids"][0].values, pa.array(c.lengths), *[pa.array(x, mask=none) for x in (loss[1], loss[0], loss[1] - loss[0])]]
        return pa.Table.from_arrays(columns, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[(x, pa.float64()) for x in ("target_loss", "background_loss", "score")]])
    left = chunks.where(F.col("kind") == SCORED).join(own, "chunk", "left").groupBy("chunk")
    right = answers.where("chunk IS NOT NULL").select("chunk", "part", "data").groupBy("chunk")
    found = stage(left.cogroup(right).applyInArrow(judge, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"), "scores")
    for read in (chunks, answers, *([own] if members is not None else [])):
        unstage(read)
    spark.sql(f"DROP TABLE {name}")
    return found
