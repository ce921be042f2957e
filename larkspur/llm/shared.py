"""Helpers that several operators share: staged tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are split into words at once.
CHUNK = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset and Spark runs in one process, a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them back.

    This cuts the lineage: a lost executor costs no more than the tasks that
    were reading the table, and values that depend on how rows were dealt out
    (partition numbers, sampled range bounds) are fixed once.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/larkspur-" in path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows don't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def unit(*cols: Column | str) -> Column:
    """A number in (0, 1) that the values of the columns decide."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + 0.5) / float(1 << 52)


def numbered(df: DataFrame, order: list[Column], name: str = "rows") -> DataFrame:
    """Adds ``n``, each row's place from 0 in the global order, without gathering rows in one task."""
    return ordering.numbered(df, order, "n")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a long, b long): rows (node, root), root the least node.

    Each round hooks every node to its least neighbour, follows the hooks to
    their ends by pointer jumping, and contracts the edges to those ends; the
    number of nodes with edges falls at least by half. Degrees never meet in one
    task: minima are combined before they are shuffled, and the joins are plain
    equi-joins whose hot keys adaptive execution splits. Every round's edges are
    written to the shared folder, so neither lineage nor lost executors hurt.
    Nodes without edges have no row; null ends are ignored.
    """
    ends = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stage(ends(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("child"), F.col("a").alias("parent"))
        hooks = stage(both.groupBy("child").agg(F.min("parent").alias("parent")), "hooks")
        while True:
            up = hooks.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
            jumped = stage(hooks.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "hooks")
            moved = not jumped.where("moved").isEmpty()
            unstage(hooks)
            hooks = jumped.drop("moved")
            if not moved:
                break
        rounds.append(hooks)
        to = lambda end: hooks.select(F.col("child").alias(end), F.col("parent").alias(f"{end}_to"))  # noqa: B023, E731
        met = edges.join(to("a"), "a", "left").join(to("b"), "b", "left")
        contracted = stage(ends(met.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))), "edges")
        unstage(edges)
        edges = contracted
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    for hooks in reversed(rounds):
        later = roots.select(F.col("node").alias("parent"), F.col("root").alias("above"))
        hooked = hooks.join(later, "parent", "left").select(F.col("child").alias("node"), F.coalesce("above", "parent").alias("root"))
        roots = stage(hooked.union(roots), "roots")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def slices(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of ``chunk`` bytes, or single longer ones: the first's index, and the lower-cased words."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + chunk, "right")))
        yield i, pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(i, j - i), "")))
        i = j


def coded_words(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the first's index, hashes of the different words, each token's place among them, and where each text begins and the last ends."""
    for first, split in slices(texts, chunk):
        coded = pc.dictionary_encode(split.flatten())
        known = coded.dictionary.to_pylist()
        words = np.array([xxhash.xxh64_intdigest(w, 42) or 1 for w in known], np.uint64)
        at = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int32)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        if "" in known:  # the empty strings at a text's ends are no words
            none = known.index("")
            full = at != none
            offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
            at, words = at[full], np.delete(words, none)
            at = at - (at > none)
        yield first, words, at, offsets


def token_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first's index, all tokens' hashes, and where each text begins and the last ends."""
    for first, words, at, offsets in coded_words(texts, CHUNK // 4):
        yield first, words[at], offsets


def packed(x: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, without planes that are zero throughout: these compress well."""
    x = np.ascontiguousarray(x, np.uint64)
    k = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([k]) + x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, : data[0]] = planes.T
    return x.view(np.uint64).ravel()


def signed(x: int) -> int:
    """The 64 bits of x as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x
