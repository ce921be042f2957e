"""URL rules in a sorted digest array.

The rules' strings (host and path) are hashed to 64 bits with xxhash and sorted.
Three files hold the digests, the strings' offsets and verdicts, and the strings;
Spark ships them to the executors, whose workers map them into memory: only the
pages that are touched are loaded, and the workers of a machine share them. A
URL's candidates are each parent domain of its host with each rule-long beginning
of its path; their digests come from one pass over the path for each domain, are
probed together by vectorised binary search, and a hit counts only if the stored
string is equal.

The files are bounded by LIMIT bytes, which is checked before they are made;
larger rule tables are joined with the candidate strings instead, by Spark, with
the same result.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, new_path

#: Bytes of rules that are shipped to every executor at most.
LIMIT = 1 << 30
DEFAULT = "allow"
#: Digests that are probed at once.
PROBES = 1 << 16
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, ASCII-lower-cased, and path; both empty for null and where ``://`` is missing."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for i, c in enumerate(rest):
        if c in "/?#":
            break
    else:
        i = len(rest)
    path = rest[i:] if rest[i : i + 1] == "/" else ""
    return rest[:i].translate(_LOWER), path.partition("?")[0].partition("#")[0]


def domains(host: str) -> list[str]:
    """The host and its parent domains, but for empty ones."""
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return [h for h in out if h]


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Strings that a fitting rule has, the longest first; of equal length, the longer host first."""
    return sorted((h + path[:n] for h in domains(host) for n in lengths if n <= len(path)), key=len, reverse=True)


def digests_of(host: str, path: str, lengths: list[int]) -> Iterator[tuple[int, str, int]]:
    """(digest, domain, length of the path's beginning) of the same strings; ``lengths`` ascend."""
    for h in domains(host):
        x, at = xxhash.xxh64(h.encode(errors="surrogatepass")), 0
        for n in lengths:
            if n > len(path):
                break
            x.update(path[at:n].encode(errors="surrogatepass"))
            at = n
            yield x.intdigest(), h, n


def _rules(rules: DataFrame) -> DataFrame:
    """Rules as (digest, key, allow, size of the path); without a host there is no rule. Of equal rules, block wins."""

    @F.arrow_udf("long")
    def digest(keys: pa.Array) -> pa.Array:
        return pa.array(np.array([xxhash.xxh64_intdigest(k.encode()) for k in keys.to_pylist()], np.uint64).view(np.int64))

    host, path = F.translate("host", "".join(map(chr, _LOWER)), "".join(map(chr, _LOWER.values()))), F.coalesce("path", F.lit(""))
    known = rules.where("host <> '' AND verdict IN ('allow', 'block')").select(F.concat(host, path).alias("key"), F.length(path).alias("n"), (F.col("verdict") == "allow").cast("int").alias("allow"))
    known = known.groupBy("key").agg(F.min("n").alias("n"), F.min("allow").alias("allow"))
    return known.withColumn("digest", digest("key"))


def ship(rules: DataFrame) -> list[str]:
    """Writes the sorted array into the shared folder and adds its files to the session; their names."""
    spark = rules.sparkSession
    rows = rules.orderBy(F.col("digest").bitwiseXOR(F.lit(-(1 << 63))), "key").select("digest", "allow", "key").toLocalIterator(prefetchPartitions=True)
    folder, name = new_path(spark, "rules"), f"rules-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f"{name}.{kind}" for kind in ("digests", "offsets", "strings")]
    files = [fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")) for n in names]
    parts, at = [bytearray(), bytearray(), bytearray()], 0

    def flush() -> None:
        for file, part in zip(files, parts):
            file.write(part)
            part.clear()

    for row in rows:
        key = row["key"].encode()
        parts[0] += (row["digest"] & (1 << 64) - 1).to_bytes(8, "little")
        parts[1] += (at << 1 | row["allow"]).to_bytes(8, "little")  # the last bit is the verdict
        parts[2] += key
        at += len(key)
        if len(parts[2]) > 1 << 20:
            flush()
    parts[1] += (at << 1).to_bytes(8, "little")
    flush()
    for file, n in zip(files, names):
        file.close()
        spark.sparkContext.addFile(f"{folder}/{n}")
    return names


class DigestArray:
    """The mapped files."""

    def __init__(self, names: tuple[str, ...]):
        opened = []
        for n in names:
            with open(SparkFiles.get(n), "rb") as file:
                opened.append(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
        self.digests, self.offsets = (np.frombuffer(m, np.uint64) for m in opened[:2])
        self.strings = opened[2]

    def find(self, keys: list[str]) -> list[int]:
        """The place of each key; -1 if it is not stored."""
        found = [-1] * len(keys)
        want = np.array([xxhash.xxh64_intdigest(k.encode(errors="surrogatepass")) for k in keys], np.uint64)
        for i, at in self.hits(want, lambda i: keys[i]):
            found[i] = at
        return found

    def hits(self, want: np.ndarray, key: Callable[[int], str]) -> Iterator[tuple[int, int]]:
        """(which digest, place) where the stored string is that digest's key."""
        low, high = np.searchsorted(self.digests, want, "left"), np.searchsorted(self.digests, want, "right")
        for i in np.flatnonzero(high > low).tolist():
            data = key(i).encode(errors="surrogatepass")
            for at in range(low[i], high[i]):
                if self.strings[int(self.offsets[at]) >> 1 : int(self.offsets[at + 1]) >> 1] == data:
                    yield i, at

    def allows(self, at: int) -> bool:
        return bool(int(self.offsets[at]) & 1)


@lru_cache(4)
def _array(names: tuple[str, ...]) -> DigestArray:
    return DigestArray(names)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT, limit: int = LIMIT) -> DataFrame:
    """Adds host, path, rule and verdict to every row; rules have host, path and verdict.

    A rule fits its host and all subdomains if the path begins with the rule's;
    the longest fitting rule gives the verdict, without one it is ``default``. A
    null url, or one without ``://``, has an empty host and path and fits no
    rule. Rules with a null or empty host, or another verdict, are ignored; a
    null path counts as empty. Columns of pages named like the new ones are
    replaced; repeated rows are judged each.
    """
    known = _rules(rules)
    size = known.agg(F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0)), F.collect_set("n")).first()
    lengths = sorted(size[1], reverse=True)
    ascending = lengths[::-1]
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if not size[0]:
        names: tuple[str, ...] = ()
    elif size[0] <= limit:
        names = tuple(ship(known))
    else:
        return _joined(pages, known, lengths, url_col, kept, default)

    @F.arrow_udf("host string, path string, rule string, verdict string")
    def judge(urls: pa.Array) -> pa.Array:
        parts = [split_url(u) for u in urls.to_pylist()]
        rule, verdict = [None] * len(parts), [default] * len(parts)
        best = [(0, 0)] * len(parts)  # lengths of the rule and of its host
        held: list[tuple[int, int, str, int]] = []

        def probe() -> None:
            array = _array(names)
            key = lambda k: held[k][2] + parts[held[k][0]][1][: held[k][3]]
            for k, place in array.hits(np.array([d for _, d, _, _ in held], np.uint64), key):
                i, _, h, n = held[k]
                if (len(h) + n, len(h)) > best[i]:
                    best[i], rule[i], verdict[i] = (len(h) + n, len(h)), key(k), "allow" if array.allows(place) else "block"
            held.clear()

        for i, (h, p) in enumerate(parts if names else []):
            held += [(i, *x) for x in digests_of(h, p, ascending)]
            if len(held) >= PROBES:
                probe()
        if held:
            probe()
        return pa.StructArray.from_arrays([pa.array(list(c), pa.string()) for c in ([h for h, _ in parts], [p for _, p in parts], rule, verdict)], ["host", "path", "rule", "verdict"])

    at = fresh(pages, "_judged")
    judged = pages.select(*kept, judge(F.col(url_col)).alias(at))
    return judged.select(*kept, *[F.col(at)[c].alias(c) for c in ("host", "path", "rule", "verdict")])


def _joined(pages: DataFrame, rules: DataFrame, lengths: list[int], url_col: str, kept: list[str], default: str) -> DataFrame:
    """The way for rules of any size: distinct hosts' and paths' candidates meet the rules in an equi-join."""

    @F.arrow_udf("host string, path string, keys array<string>")
    def parts(urls: pa.Array) -> pa.Array:
        got = [split_url(u) for u in urls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([h for h, _ in got], pa.string()), pa.array([p for _, p in got], pa.string()), pa.array([candidates(h, p, lengths) for h, p in got], pa.list_(pa.string()))], ["host", "path", "keys"])

    urls = pages.select(F.col(url_col).alias("_url")).distinct().withColumn("_p", parts("_url"))
    met = urls.select("_url", F.posexplode("_p.keys").alias("_nth", "key")).join(rules.select("key", "allow"), "key")
    best = met.groupBy("_url").agg(F.min_by(F.struct("key", "allow"), "_nth").alias("_best"))
    found = urls.select("_url", "_p.host", "_p.path").join(best, "_url", "left")
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).when(F.col("_best.allow") == 1, "allow").otherwise("block")
    out = found.select("_url", "host", "path", F.col("_best.key").alias("rule"), verdict.alias("verdict"))
    left = pages.select(*kept, pages[url_col].alias(seen := fresh(pages, "_seen")))
    return left.join(out, left[seen].eqNullSafe(out["_url"])).select(*[left[c] for c in kept], *[out[c] for c in ("host", "path", "rule", "verdict")])


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")
