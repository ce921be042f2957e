"""Exact token counts at every prefix of a text, by dynamic programming, stored beside the text.

A sequence of byte-pair tokens is what the tokenizer gives exactly if it gives
every two neighbours as those two. So for each prefix of a piece just one token
can be the last: one that ends the prefix and agrees with the last token of the
prefix before it. One pass over the prefixes finds these tokens, and a prefix
has one token more than the prefix before its last one. Where a cut makes the
tokenizer divide the text into other pieces (in a contraction, behind a blank,
inside a special string), the pieces of that prefix are looked up as they are.

White space always begins a new piece behind other characters, so runs of white
space and what follows are independent: the counts of a run are found once and
remembered. What is stored is the step from each prefix's count to the next
one's, a byte for each character; a text's steps are its runs' in a row. From
them the count of the whole text or of any prefix, and the longest prefix within
a budget, are read without encoding anything again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
#: Characters of a text that are divided into runs at once, characters of runs and pairs of tokens that a worker remembers, characters of a run that is.
SLICE, REMEMBERED, PAIRS, LONG = 1 << 20, 6 << 20, 1 << 20, 256
#: Bytes of steps that are returned at once.
HELD = 4 << 20

#: The characters that Unicode counts as white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: A word of Latin-1 letters, which is a piece, and ASCII marks but the apostrophe, which are another.
_PLAIN = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
_EDGE = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
#: Characters of a piece's beginning that may be divided otherwise than the piece: a blank, an apostrophe and a letter.
_UNSURE = 2


class Prefixes:
    """The counts of a byte-level BPE tokenizer's prefixes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        self.names = {i: t for t, i in ids.items()}
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        letters: dict[str, int] = {}  # the tokenizer's letter for each byte that texts have
        for c in (*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x1000)):
            letters |= zip(as_bytes.pre_tokenize_str(chr(c))[0][0], chr(c).encode())
        #: A tree of the tokens' bytes: what follows each byte, and the token that ends with it.
        self.tree: dict[int, list] = {}
        self.longest = max(map(len, ids))
        for token, i in ids.items():
            at = self.tree
            codes = [letters.get(c) for c in token]
            if None in codes:  # of bytes that are in no text
                continue
            for c in codes[:-1]:
                at = at.setdefault(c, [{}, None])[0]
            at.setdefault(codes[-1], [{}, None])[1] = i
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.agree: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.runs: dict[str, bytes] = {}
        self.remembered = 0

    def _agrees(self, one: int, two: int) -> bool:
        """Whether the tokenizer gives the bytes of two tokens as those two."""
        if len(self.agree) >= PAIRS:
            self.agree.clear()
        found = [t.id for t in self.tokenizer.model.tokenize(self.names[one] + self.names[two])] == [one, two]
        self.agree[one << 32 | two] = found
        return found

    def _piece(self, piece: str) -> list[int]:
        """Counts at every prefix of a piece."""
        if (known := self.pieces.get(piece)) is not None:
            return known
        data = piece.encode()
        size, tree, agree = len(data), self.tree, self.agree
        count, last = [0] * (size + 1), [-1] * (size + 1)
        for begin in range(size):  # tokens from here, as long as any token goes on like that
            before, n, at, end = last[begin], count[begin] + 1, tree, begin
            for c in data[begin : begin + self.longest]:
                end += 1
                if (found := at.get(c)) is None:
                    break
                at, token = found
                if token is not None and last[end] < 0:
                    if begin and (fits := agree.get(before << 32 | token)) is not True and (fits is False or not self._agrees(before, token)):
                        continue
                    last[end], count[end] = token, n
        del count[0]
        if size > len(piece):  # where characters end
            count = [n for n, c in zip(count, (*data[1:], 0)) if c & 0xC0 != 0x80]
        if len(piece) <= LONG:
            if len(self.pieces) >= PAIRS // 4:
                self.pieces.clear()
            self.pieces[piece] = count
        return count

    def _cuts(self, text: str) -> list[tuple[int, int]]:
        """Where the pieces of a text begin and end."""
        if m := _PLAIN.fullmatch(text):
            cut = m.end(1)
            return [(0, cut), (cut, len(text))] if cut < len(text) else [(0, cut)]
        return [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _ordinary(self, text: str) -> int:
        """Tokens of a text without special strings."""
        return sum(self._piece(text[a:b])[-1] for a, b in self._cuts(text))

    def _stretch(self, text: str) -> list[int]:
        """Counts at every prefix of a run, or of a part of one, without special strings."""
        out, base, before, space = [], 0, (0, 0), False  # before: where the piece before begins, and the count up to there; space: whether it is white
        for begin, end in self._cuts(text):
            own = text[begin:end]
            counts = self._piece(own)
            out += [base + n for n in counts] if base else counts
            if space or own[0] == "'":
                for i in range(1, min(_UNSURE, len(own), len(text) - begin - 1) + 1):
                    out[begin + i - 1] = before[1] + self._ordinary(text[before[0] : begin + i])
            before, base, space = (begin, base), base + counts[-1], own.isspace()
        return out

    def counts(self, run: str) -> list[int]:
        """Counts at every prefix of a run of white space and other characters."""
        if self.special is None or not self.special.search(run):
            return self._stretch(run)
        out, base, at = [], 0, 0
        for m in self.special.finditer(run):
            out += [base + n for n in self._stretch(run[at : m.start()])]
            for i in range(1, m.end() - m.start()):  # a special string cut short is ordinary text
                out.append(base + self._ordinary(run[at : m.start() + i]))
            base = (out[m.start() - 1] if m.start() > at else base) + 1
            out.append(base)
            at = m.end()
        return out + [base + n for n in self._stretch(run[at:])]

    def _remember(self, run: str) -> bytes:
        counts = self.counts(run)
        steps = array("b", map(sub, counts, [0, *counts])).tobytes()
        if len(run) <= LONG:
            if self.remembered >= REMEMBERED:
                self.runs.clear()
                self.remembered = 0
            self.remembered += len(run)
            self.runs[run] = steps
        return steps

    def steps(self, text: str) -> bytes:
        """The steps between the counts at neighbouring prefixes, a signed byte for each character."""
        out, at, known = [], 0, self.runs
        while at < len(text):
            edge = _EDGE.search(text, at + SLICE)
            end = edge.start() if edge else len(text)
            out.append(b"".join([known.get(r) or self._remember(r) for r in _RUN.findall(text, at, end)]))
            at = end
        return b"".join(out)


@lru_cache(2)
def _prefixes(path: str) -> Prefixes:
    return Prefixes(path)


def with_steps(docs: DataFrame, text_col: str = "text", to: str = "steps", path: str | None = None) -> DataFrame:
    """The rows with the stored steps of a text column instead of the text: a byte for each character.

    A null text is an empty one and has no steps; a text of any length is read
    whole, a slice at a time; bytes that are no UTF-8 count as U+FFFD. Rows that
    are equal stay so many; an empty table stays empty; other columns pass through,
    and one named like ``to`` is replaced.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    kept = [c for c in docs.columns if c not in (text_col, to)]
    schema = docs.select(*kept, F.lit(b"").alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = _prefixes(path)

        def some(first: int, steps: list[bytes], batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(c.slice(first, len(steps)) for c in batch.columns[:-1]), pa.array(steps, pa.binary())], [*kept, to])

        for batch in batches:
            texts, first, steps, size = batch.column(len(kept)), 0, [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                steps.append(prefixes.steps(text.decode(errors="replace")) if text else b"")
                size += len(steps[-1])
                if size >= HELD:
                    yield some(first, steps, batch)
                    first, steps, size = i + 1, [], 0
            if steps:
                yield some(first, steps, batch)

    data = F.col(text_col).cast("string").cast("binary").alias("_text")
    return docs.select(*kept, data).mapInArrow(run, schema)


def _counts(steps: pa.Scalar) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps.as_py() or b"", np.int8), dtype=np.int32)


def n_tokens(steps: Column | str) -> Column:
    """Tokens of the whole text, from its steps."""

    @F.arrow_udf("long")
    def of(rows: pa.Array) -> pa.Array:
        return pa.array([int(np.frombuffer(x.as_py() or b"", np.int8).sum(dtype=np.int64)) for x in rows], pa.int64())

    return of(steps)


def tokens_within(steps: Column | str, chars: Column | str) -> Column:
    """Tokens of the text's first characters, from its steps: none for a number below 1 or null, all for one beyond the text's end."""

    @F.arrow_udf("long")
    def of(rows: pa.Array, chars: pa.Array) -> pa.Array:
        return pa.array([int(np.frombuffer(x.as_py() or b"", np.int8)[: max(0, n.as_py() or 0)].sum(dtype=np.int64)) for x, n in zip(rows, chars)], pa.int64())

    return of(steps, F.col(chars).cast("long") if isinstance(chars, str) else chars.cast("long"))


def chars_within(steps: Column | str, budget: int) -> Column:
    """Characters of the text's longest prefix with so many tokens at most, from its steps."""

    @F.arrow_udf("long")
    def of(rows: pa.Array) -> pa.Array:
        return pa.array([int(np.append(np.flatnonzero(_counts(x) <= budget), -1).max()) + 1 for x in rows], pa.int64())

    return of(steps)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, kept_chars.

    All but n_bytes is read from the stored counts: n_tokens is the count at the
    last prefix, kept_chars the length in characters of the longest prefix of at
    most ``limit`` tokens. A null or empty text has 0 of each; null ids, repeated
    rows and empty tables as in ``with_steps``; further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    stored = with_steps(rows, "text", "steps", path)
    found = stored.select("doc_id", "n_bytes", n_tokens("steps").alias("n_tokens"), chars_within("steps", limit).alias("kept_chars"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "kept_chars")
