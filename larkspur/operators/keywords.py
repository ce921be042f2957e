"""Which keywords occur in which texts, as an equi-join on grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a gram in UTF-8, at most 4; shorter keywords are grams of their own length.
GRAM = 4
#: Slots (a prime) in which grams of one length are told to begin some keyword or none.
SLOTS = 262_139
#: Bytes of text that are looked at at once.
CHUNK = 1 << 18


def first_gram(word: Column) -> Column:
    """A word's first bytes as a number, with how many they are above 32 bits; 0 for the empty word."""
    head = F.substring(F.encode(word, "UTF-8"), 1, GRAM)
    return F.conv(F.concat(F.octet_length(head).cast("string"), F.lpad(F.hex(head), 2 * GRAM, "0")), 16, 10).cast("long")


def _grams(texts: pa.Array, begins: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of texts (none null) with their grams, each pair once. begins: for each length of a gram, whether those of a slot are looked for."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    found = [np.arange(len(texts) if 0 in begins else 0) << 35]
    for start in range(ends[0], ends[-1], CHUNK):
        at = np.arange(start, min(start + CHUNK, ends[-1]))
        row = np.searchsorted(ends, at, "right") - 1
        room, gram = ends[row + 1] - at, np.zeros(len(at), np.int64)
        for n in range(1, max(begins, default=0) + 1):
            gram = gram << 8 | data[np.minimum(at + n - 1, ends[-1] - 1)]
            if n in begins:
                tagged = gram | n << 32
                keep = begins[n][tagged % SLOTS] & (room >= n)
                found.append(np.unique(row[keep] << 35 | tagged[keep]))
    pairs = np.unique(np.concatenate(found))
    return pairs >> 35, pairs & (1 << 35) - 1


def keyword_hits(texts: DataFrame, keywords: DataFrame, text: str, word: str) -> DataFrame:
    """The rows of ``texts`` with each row of ``keywords`` whose ``word`` occurs in ``text``, whatever the case.

    A keyword meets the texts that hold its first GRAM bytes, and only there is
    looked for; it may stand inside a word. A text's grams are read in one pass
    over its bytes, and most that begin no keyword stay behind: the driver gets
    which SLOTS are taken, whatever the number of keywords. An empty keyword is in
    every text; null texts and keywords hit nothing. The column names of the two
    must differ.
    """
    asked = keywords.select(word).where(F.col(word).isNotNull()).distinct().withColumn("_gram", first_gram(F.lower(word)))
    taken = asked.select(F.shiftright("_gram", 32).alias("n"), F.pmod("_gram", F.lit(SLOTS)).alias("slot")).distinct().toArrow()
    lengths, slots = (taken[c].to_numpy().astype(np.int64) for c in ("n", "slot"))
    packed = {int(n): np.packbits(np.bincount(slots[lengths == n], minlength=SLOTS) > 0) for n in np.unique(lengths)}

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = {n: np.unpackbits(bits).view(bool) for n, bits in packed.items()}
        for batch in batches:
            rows, found = _grams(batch.column(1), begins)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[rows]), pa.array(found)], ["_row", "_gram"])

    lower = texts.withColumn("_lower", F.lower(text))
    keyed = lower.withColumn("_row", F.xxhash64("_lower"))
    # grams go with the text's hash alone; the texts themselves move once, to the keywords they have met
    pairs = keyed.select("_row", "_lower").where(F.col("_lower").isNotNull()).mapInArrow(grams, "_row long, _gram long").distinct()
    met = pairs.join(asked, "_gram").select("_row", word)
    # merged, as Spark knows the texts' compressed size only and would broadcast them
    hits = keyed.hint("merge").join(met, "_row").where(F.contains("_lower", F.lower(word))).drop("_row", "_lower")
    return hits.join(keywords, word).select(*texts.columns, *keywords.columns)
