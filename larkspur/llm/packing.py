"""Harmonic packing of tokenized documents into sequences of at most CAPACITY tokens.

Lengths fall into reciprocal classes: a piece of class k is at most
CAPACITY // k tokens long, and a bin of that class holds exactly k pieces. A
piece's bin follows from its place in its class alone, so every worker numbers
its own pieces and fills bins without knowing the others; only one count for
each worker and class is added up between them. A document is cut where its end
would leave much of its place unused: whole sequences first, then pieces that
fill a place of their class exactly. What does not make up a whole bin of its
class, at most sum(k - 1) pieces however large the input, is packed by first fit
of decreasing lengths.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .shared import stage

CAPACITY, END = 2048, 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces up to this length are never cut; longer ones are if they leave more than this part of their place unused.
WHOLE, SLACK = 128, 1 / 32
#: Places in a bin, beyond every count up to 16.
FINER = (18, 20, 22, 24, 27, 30, 34, 38, 44, 52, 64, 80, 102, 128, 170, 256, 409, 682, 1024, 2048)
#: Bytes of text that are split into words at once, and words whose ids a worker remembers.
SLICE, REMEMBERED = 4 << 20, 150_000

#: Letters of Latin-1 that normalisation leaves alone, then marks that begin no contraction and no special token.
_STEM = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:;=-@\[-`{-~]*)")


class Encoder:
    """Ids of whole texts. Every token lies within a run of non-white characters, so each distinct run is encoded once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, list[int]] = {}
        self.stems: dict[str, list[int]] = {}
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def word(self, word: str) -> list[int]:
        """The ids of one run; letters with marks behind them are remembered in lower case and apart from the marks."""
        m = _STEM.fullmatch(word)
        if not m:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        stem, marks = m.groups()
        stem = stem.lower()
        if (ids := self.stems.get(stem)) is None:
            if len(self.stems) >= REMEMBERED:
                self.stems.clear()
            shown = stem if stem.isascii() else stem.translate(self.letters)
            ids = self.stems[stem] = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return ids + self.word_marks(marks) if marks else ids

    def word_marks(self, marks: str) -> list[int]:
        if (ids := self.stems.get(marks)) is None:
            ids = self.stems[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids
        return ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin and end (one more than texts)."""
        split = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(split.flatten())
        ids, known = [], self.words
        for w in coded.dictionary.to_pylist():
            if (got := known.get(w)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = known[w] = self.word(w) if w else []
            ids.append(got)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, lengths.sum())
        words = coded.indices.to_numpy()
        n = lengths[words]
        ends = np.concatenate(([0], np.cumsum(n)))
        begin = (np.cumsum(lengths) - lengths)[words]
        at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return flat[at], ends[offsets]


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(4)
def classes(capacity: int) -> list[int]:
    """The numbers of places in a bin, each the most that its longest piece allows."""
    return sorted({capacity // (capacity // k) for k in (*range(1, 17), *FINER) if k <= capacity})


@lru_cache(4)
def cuts(capacity: int) -> list[list[int]]:
    """For each length up to capacity: the lengths of the pieces it is cut into."""
    bounds = [capacity // k for k in classes(capacity)]
    out: list[list[int]] = [[]]
    for n in range(1, capacity + 1):
        place = min(b for b in bounds if b >= n)
        piece = n if n <= min(WHOLE, capacity) or place - n <= SLACK * place else max(b for b in bounds if b <= n)
        out.append([piece, *out[n - piece]])
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of SLICE bytes, or single longer texts, each with its first index."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE, "right")))
        yield i, texts.slice(i, j - i)
        i = j


def cut_documents(docs: DataFrame, capacity: int, path: str | None, ids: bool) -> DataFrame:
    """Pieces of (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, k, part, nth[, ids]."""
    path = path or public_tokenizers.path(TOKENIZER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        bounds = [(k, capacity // k) for k in classes(capacity)]
        place = [0] + [max(k for k, b in bounds if b >= n) for n in range(1, capacity + 1)]
        nth = dict.fromkeys(classes(capacity), 0)
        for batch in batches:
            for first, texts in _slices(pc.fill_null(batch.column(1), "")):
                rows: list[tuple] = []
                flat, ends = encoder(texts)
                for i, doc_id in enumerate(batch.column(0).slice(first, len(texts)).to_pylist()):
                    own = np.append(flat[ends[i] : ends[i + 1]], np.uint32(END))
                    whole, rest = divmod(len(own), capacity)
                    start = 0
                    for n in [*[capacity] * whole, *cuts(capacity)[rest]]:
                        k, piece = place[n], own[start : start + n]
                        rows.append((doc_id, start, n, zlib.crc32(piece.astype("<u4").tobytes()), len(own), k, part, nth[k], *([piece.astype(np.int32)] if ids else [])))
                        nth[k] += 1
                        start += n
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "part", "nth", *["ids"] * ids]
    kinds = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * ids]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, part int, nth long" + ", ids array<int>" * ids
    return docs.mapInArrow(cut, schema)


def _first_fit(capacity: int):
    def fit(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "part", "k", "nth"], ascending=[False, True, True, True], ignore_index=True)
        free, held, bins, slots = np.full(len(pieces), capacity), np.zeros(len(pieces), int), [], []
        for n in pieces["length"]:
            b = int(np.argmax(free >= n))
            bins.append(b)
            slots.append(held[b])
            free[b] -= n
            held[b] += 1
        return pieces[["part", "k", "nth"]].assign(bin=bins, slot=slots)

    return fit


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A document's ids are those of its whole text and the id END behind them, so
    a null, empty or blank text is a document of one id. Pieces of a document
    are disjoint and cover it. sequence_id runs from 0 without gaps, offset is
    where the piece begins in its sequence, without gaps either. Repeated rows
    and null ids are packed like others, each row for itself. An empty table
    gives an empty result. Further columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stage(cut_documents(docs, capacity, path, ids), "pieces")
    counts = pieces.groupBy("part", "k").count()
    ahead = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "k", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    totals = {r["k"]: r["sum(count)"] for r in counts.groupBy("k").agg(F.sum("count")).collect()}  # a row for each class
    base, bins = {}, 0
    for k in sorted(totals):
        base[k], bins = bins, bins + totals[k] // k
    known = docs.sparkSession.createDataFrame([(k, base[k], n // k * k) for k, n in totals.items()], "k int, base long, whole long")
    placed = pieces.join(before, ["part", "k"]).join(F.broadcast(known), "k").withColumn("place", F.col("before") + F.col("nth"))
    full = placed.where("place < whole").withColumn("sequence_id", F.col("base") + F.floor(F.col("place") / F.col("k"))).withColumn("slot", (F.col("place") % F.col("k")).cast("long"))
    rest = placed.where("place >= whole")
    fitted = rest.select("part", "k", "nth", "length").groupBy().applyInPandas(_first_fit(capacity), "part int, k int, nth long, bin long, slot long")
    rest = rest.join(fitted, ["part", "k", "nth"]).withColumn("sequence_id", F.col("bin") + bins)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot", *["ids"] * ids]
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    both = full.select(*out).union(rest.select(*out))
    return both.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("slot")
