"""Hierarchical language identification.

A linear classifier over hashed byte n-grams of the whole text names the
language family; inside a family with several languages, one linear support
vector machine for each pair of them votes. All are fitted on a sample of
labelled rows of at most SAMPLE documents, drawn by a hash of id and text, each
text once, and dealt evenly over the LANGUAGES most frequent languages.
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, unit

#: Documents that the classifiers are fitted on at most, n-gram buckets, longest n-gram in bytes, folds, seed.
SAMPLE, WIDTH, LONGEST, FOLDS, SEED = 4000, 4096, 3, 5, 99
UNKNOWN = "und"
#: Bytes of text for which the least likeness to a learned language is calibrated, labelled texts each needs at least.
LENGTHS, ENOUGH = (8, 16, 32, 64, 128, 256, 512, 1024, 2048), 20
#: The calibrated likeness is this share of what all but STRANGE of the labelled texts reach.
SLACK, STRANGE = 0.85, 0.001
#: Labelled texts are also held against the learned languages but their own, as texts of an unknown language would be. Where all but ODD of them are more like their own language, by MARGIN, than FOREIGN of them are like any other, a text must be as like its language as that, or prefer it to the next one by more than FOREIGN of them do.
FOREIGN, ODD, MARGIN = 0.97, 0.05, 1.05
#: Languages that are learned at most.
LANGUAGES = 200
#: Bytes of a text whose n-grams are counted at once.
CHUNK = 1 << 20
#: Families of languages that are often taken for each other. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur", "as", "or"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue", "wuu"),
    "malayic": ("id", "ms", "jv", "su", "tl"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def features(text: str) -> np.ndarray:
    """Square roots of the hashed n-gram counts of the lower-cased whole text, at length 1."""
    data = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)
    counts = np.zeros(WIDTH)
    for i in range(0, len(data), CHUNK):
        piece = data[i : i + CHUNK + LONGEST - 1].astype(np.uint32)
        gram = np.zeros(len(piece), np.uint32)
        for n in range(1, LONGEST + 1):
            gram = gram[: len(piece) - n + 1] * np.uint32(257) + piece[n - 1 :] + np.uint32(n)
            whole = gram[:CHUNK] if i + CHUNK < len(data) else gram
            counts += np.bincount((whole * np.uint32(2654435761)) >> np.uint32(32 - (WIDTH.bit_length() - 1)), minlength=WIDTH)
    x = np.sqrt(counts)
    return (x / max(np.linalg.norm(x), 1e-9)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels nothing may be learned from. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % FOLDS == 0


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150, c: float = 30.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by accelerated gradient descent; y is -1 or 1."""
    w, v, b, u = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype), 0.0, 0.0
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + u)) * weight * y * c
        rate, last, last_b = 1 / (1 + 4 * c), w, b
        w, b = v - rate * (v - 2 * slack @ x), u + rate * 2 * float(slack.sum())
        v, u = w + t / (t + 3) * (w - last), b + t / (t + 3) * (b - last_b)
    return w, b


def _two_best(like: np.ndarray) -> tuple[float, float]:
    """The largest likeness, and how far the next one is behind it."""
    best = np.sort(like)[::-1]
    return float(best[0]), float(best[0] - best[1]) if len(best) > 1 else float(best[0])


class Model:
    """Families one against the rest, and pairs of languages inside each family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray, heads: list[bytes] | None = None):
        self.langs = sorted(set(langs.tolist()))
        self.families: dict[str, list[str]] = {}
        for lang in self.langs:
            self.families.setdefault(_FAMILY.get(lang, lang), []).append(lang)
        of = np.array([_FAMILY.get(lang, lang) for lang in langs])
        self.names = list(self.families)
        self.pairs = [p for own in self.families.values() for p in combinations(own, 2)]
        fits = [_svm(x, np.where(of == f, 1, -1).astype(x.dtype)) for f in self.names] if len(self.names) > 1 else []
        for a, b in self.pairs:
            rows = (langs == a) | (langs == b)
            fits.append(_svm(x[rows], np.where(langs[rows] == a, 1, -1).astype(x.dtype)))
        self.w = np.array([w for w, _ in fits], np.float32).reshape(len(fits), WIDTH)
        self.b = np.array([b for _, b in fits], np.float32)
        sums = np.array([x[langs == lang].sum(0, dtype=float) for lang in self.langs]).reshape(len(self.langs), WIDTH)
        self.centres = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.least = self._calibrate(x, langs, sums, heads or [])

    def _calibrate(self, x: np.ndarray, langs: np.ndarray, sums: np.ndarray, heads: list[bytes]) -> list[tuple[float, float, float]]:
        """For each of LENGTHS the likeness to ask for, from beginnings of labelled texts held against the other texts of their language and of others."""
        least, low, asked, apart = [], 0.0, 0.0, 0.0
        for n in LENGTHS:
            like, unlike = [], []
            for head, own, lang in zip(heads, x, langs):
                if len(head) >= n and has_letter(text := head[:n].decode(errors="ignore")):
                    at = self.langs.index(lang)
                    others, seen = sums[at] - own, features(text)
                    like.append(float(others @ seen) / max(float(np.linalg.norm(others)), 1e-9))
                    unlike += [_two_best(np.delete(self.centres, at, axis=0) @ seen)] if len(self.langs) > 2 else []
            if len(like) >= ENOUGH:
                low = max(low, SLACK * float(np.quantile(like, STRANGE)))
                strange = np.quantile(unlike, FOREIGN, axis=0).tolist() if unlike else [1.0, 1.0]
                if np.quantile(like, ODD) >= MARGIN * strange[0]:
                    asked, apart = max(asked, strange[0]), strange[1]
            least.append((low, asked, apart))
        return least

    def belongs(self, text: str | None, x: np.ndarray | None = None) -> bool:
        """Whether a text with letters is as like a learned language as clean texts of its length; True where none was learned."""
        if not has_letter(text):
            return False
        known = [bounds for n, bounds in zip(LENGTHS, self.least) if n <= len(text.encode(errors="replace"))]
        if not self.langs or not known:
            return True
        like, apart = _two_best(self.centres @ (features(text) if x is None else x))
        low, asked, far = known[-1]
        return like >= low and (like >= asked or apart > far)

    def predict(self, text: str | None, x: np.ndarray | None = None) -> tuple[str, float]:
        """The language and how sure it is: the family's share times the mean of its won comparisons."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text) if x is None else x
        margin = (self.w @ x + self.b).astype(float) if len(self.w) else np.zeros(0)
        sure, n = 1.0, 0
        family = self.names[0]
        if len(self.names) > 1:
            n = len(self.names)
            odds = np.exp(4 * np.clip(margin[:n], -50, 50))
            family, sure = self.names[int(np.argmax(margin[:n]))], float(odds.max() / odds.sum())
        own = self.families[family]
        won = {lang: [0, 0.0] for lang in own}
        for (a, b), m in zip(self.pairs, margin[n:]):
            if a in won:
                p = 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
                for lang, q in ((a, p), (b, 1 - p)):
                    won[lang][0] += q > 0.5
                    won[lang][1] += q
        lang = max(own, key=lambda x: (*won[x], x))
        return lang, sure * (won[lang][1] / (len(own) - 1) if len(own) > 1 else 1.0)


def _train(sample: pd.DataFrame) -> pd.DataFrame:
    """The model of a sample (u, lang, features, head: the texts' first bytes), in the order of u."""
    sample = sample.sort_values(["u", "lang"], ignore_index=True)
    x = np.empty((len(sample), WIDTH), np.float32)
    for i, v in enumerate(sample["features"]):
        x[i] = np.frombuffer(v, np.float16)
    return pd.DataFrame({"model": [pickle.dumps(Model(x, sample["lang"].to_numpy(str), list(sample["head"])))]})


def fit(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on a sample of the rows with text and language, in one task that the sample's size bounds; the driver gets the weights.

    A row is drawn by its id and text, so rows without an id, or sharing one, are
    learned from as others are. Copies of a text count once.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.col("count").desc(), lang_col).limit(LANGUAGES).collect()}
    if not counts:
        return Model(np.zeros((0, WIDTH), np.float32), np.array([], str))
    share = sample / len(counts)
    chance = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, share / n))])
    u = unit(F.lit(SEED), F.col(id_col), F.col(text_col))

    @F.arrow_udf("binary")
    def vector(texts: pa.Array) -> pa.Array:
        return pa.array([features(t).astype(np.float16).tobytes() for t in texts.to_pylist()], pa.binary())

    place = u / chance[F.col(lang_col)]  # from 0 to 1 for what is drawn, in every language
    drawn = rows.where(place < 1).select(place.alias("u"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    drawn = drawn.groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.min("u").alias("u"), F.min("text").alias("text"))  # copies teach no more than one
    drawn = drawn.select("u", "lang", vector("text").alias("features"), F.substring(F.encode("text", "UTF-8"), 1, LENGTHS[-1]).alias("head"))
    found = drawn.orderBy("u").limit(sample).groupBy().applyInPandas(_train, "model binary").first()
    return pickle.loads(found["model"]) if found else Model(np.zeros((0, WIDTH), np.float32), np.array([], str))


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", belongs_col: str | None = None) -> DataFrame:
    """Adds the predicted language and a score from 0 to 1 to every row, from its text alone.

    A null text or one without letters gets ``und`` and score 0, as does every
    text if the model has learned no language. A text of any length is read whole,
    a piece at a time; of languages with equal votes the later name wins; repeated
    rows are judged each; an empty table stays empty. Columns named like the new
    ones are replaced. ``belongs_col`` adds whether the text has letters and is in a
    learned language at all, as far as its length lets one tell.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, belongs boolean")
    def predict(texts: pa.Array) -> pa.Array:
        got = []
        for t in texts.to_pylist():
            x = features(t) if has_letter(t) else None
            got.append((*shared.value.predict(t, x), shared.value.belongs(t, x)))
        return pa.StructArray.from_arrays([pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))], ["lang", "score", "belongs"])

    kept = [c for c in docs.columns if c not in (lang_col, score_col, belongs_col)]
    at = fresh(docs, "_found")
    found = docs.select(*kept, predict(F.col(text_col)).alias(at))
    return found.select(*kept, F.col(at)["lang"].alias(lang_col), F.col(at)["score"].alias(score_col), *([F.col(at)["belongs"].alias(belongs_col)] if belongs_col else []))
