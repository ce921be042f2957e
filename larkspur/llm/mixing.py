"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

A source's target over its size is the copies each of its documents should
get. The whole part is certain; the fractional part is a probability. Pairs of
documents exchange mass (size times probability) at random, without changing
either expectation or their sum, until one of the two probabilities is 0 or 1;
the other one goes on to the next partner. A bucket of documents leaves one
fractional rest, the rests of a bucket of buckets again leave one, and so on up
a tree, so what is rounded in the end is one document of a source. Long
documents go first, in WAVES by size: the later ones' probabilities make up for
what the rounding of longer ones has left over or taken too much, so a source
misses its target by a short document's size. They make up for all of it, or, if
that could drive a probability out of 0 to 1, for a share that is fixed before
the longer ones are rounded: no document's expected copies change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, fresh, numbered, stage, unit

#: Units that one node of the reduction tree combines, on average; most copies of one document.
FAN, MOST, SEED = 32, 3, 7_411
#: Sizes, as multiples of a source's mean, above which documents belong to the first wave, the second, and so on.
WAVES = (4.0, 1.0, 0.25)
#: Sources, and eighties of bytes of their names, up to which their few numbers are broadcast; more are joined by a shuffle, whose hot keys adaptive execution splits.
SOURCES = 100_000

_UNIT = "struct<id:bigint,a:bigint,x:double>"
#: Folds units (u, id, a: size, x: probability) into the one still fractional (a = 0: none) and those decided.
_FOLD = """
aggregate(
  units,
  named_struct('id', 0L, 'a', 0L, 'x', 0D, 'done', cast(array() AS array<struct<id:bigint,a:bigint,copy:int>>)),
  (s, e) -> CASE WHEN s.a = 0 THEN named_struct('id', e.id, 'a', e.a, 'x', e.x, 'done', s.done) ELSE
    transform(transform(
      array(named_struct('up', least(s.a * (1 - s.x), e.a * e.x), 'down', least(s.a * s.x, e.a * (1 - e.x)))),
      m -> CASE
        WHEN {draw} * (m.up + m.down) < m.down THEN
          CASE WHEN s.a * (1 - s.x) <= e.a * e.x
            THEN named_struct('id', e.id, 'a', e.a, 'x', e.x - m.up / e.a, 'out', named_struct('id', s.id, 'a', s.a, 'copy', 1))
            ELSE named_struct('id', s.id, 'a', s.a, 'x', s.x + m.up / s.a, 'out', named_struct('id', e.id, 'a', e.a, 'copy', 0)) END
        ELSE
          CASE WHEN s.a * s.x <= e.a * (1 - e.x)
            THEN named_struct('id', e.id, 'a', e.a, 'x', e.x + m.down / e.a, 'out', named_struct('id', s.id, 'a', s.a, 'copy', 0))
            ELSE named_struct('id', s.id, 'a', s.a, 'x', s.x - m.down / s.a, 'out', named_struct('id', e.id, 'a', e.a, 'copy', 1)) END
      END),
      r -> CASE WHEN r.x > 1e-12D AND r.x < 1 - 1e-12D
        THEN named_struct('id', r.id, 'a', r.a, 'x', r.x, 'done', concat(s.done, array(r.out)))
        ELSE named_struct('id', 0L, 'a', 0L, 'x', 0D, 'done', concat(s.done, array(r.out, named_struct('id', r.id, 'a', r.a, 'copy', cast(round(r.x) AS int))))) END
    )[0] END
)
"""


def _uniform(*cols: str) -> str:
    """SQL for a number in (0, 1) that the columns decide, as shared.unit."""
    return f"((cast(shiftrightunsigned(xxhash64({', '.join(cols)}), 12) AS double) + 0.5D) / 4503599627370496D)"


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source of (source, size): n, source, source_size, docs, target, copies.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum of
    all sizes. Targets stop at MOST times the source's size; what is above is
    shared again by weight. That level is found by a few sums over the sources.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    each = numbered(each, [F.col("source").asc_nulls_last()], "sources").withColumn("weight", F.col("n") % 3 + 1)
    total = each.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * MOST <= F.col("weight") * level
        got = each.agg(F.sum(F.when(full, F.col("source_size") * MOST)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if got[2] == capped or not got[1]:
            break
        level, capped = (total - (got[0] or 0)) / got[1], got[2]
    full = F.col("source_size") * MOST <= F.col("weight") * level
    target = F.when(full, (F.col("source_size") * MOST).cast("double")).otherwise(F.col("weight") * level)
    copies = F.when(full, F.lit(float(MOST))).otherwise(target / F.col("source_size"))
    return each.select("n", "source", "source_size", "docs", target.alias("target"), copies.alias("copies"))


def _shifted(units: DataFrame, sums: DataFrame, decided: DataFrame | None, wave: int, beside: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The wave's probabilities, moved evenly by what its source's longer documents took beyond their share.

    Rounding a wave misses its sum by its longest document at most, so what is
    to be made up for has a bound that no draw changes, and expectation 0.
    """
    if decided is None:
        return units
    before = F.col("wave") < wave
    aggs = [F.sum(F.when(~before, F.col("sum"))).alias("rest"), F.sum(F.when(before, F.col("sum") * F.col("x"))).alias("due"), F.sum(F.when(before, F.col("longest"))).alias("most")]
    rest = sums.groupBy("n").agg(*aggs, F.first("x").alias("x"))
    got = decided.groupBy("n").agg(F.sum(F.col("a") * F.col("copy")).alias("got"))
    share = F.least(F.lit(1.0), F.least("x", 1 - F.col("x")) * F.col("rest") / F.col("most"))
    over = F.coalesce(share * (F.col("got") - F.col("due")) / F.col("rest"), F.lit(0.0))
    moves = rest.join(got, "n", "left").select("n", over.alias("over"))
    return units.join(beside(moves), "n").withColumn("x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x") - F.col("over")))).drop("over")


def _round(units: DataFrame, most: int, seed: int) -> DataFrame:
    """Decides units (n: source, id, a, x, docs: units of the source, ``most`` at most) by the reduction tree: n, id, a, copy."""
    bucket = F.floor(unit(F.lit(seed), "id") * F.ceil(F.col("docs") / FAN)).alias("bucket")
    units = units.select("n", bucket, "id", "a", "x")
    fold = _FOLD.format(draw=_uniform(f"{seed + 1}L", "s.id", "e.id"))
    decided, width = None, 1
    while True:
        listed = units.repartition("n", "bucket").groupBy("n", "bucket").agg(F.array_sort(F.collect_list(F.struct(unit(F.lit(seed + 2), "id").alias("u"), "id", "a", "x"))).alias("units"))
        folded = stage(listed.select("n", "bucket", F.expr(fold).alias("f")).select("n", "bucket", "f.*"), "rounded")
        done = folded.select("n", F.explode("done").alias("d")).select("n", "d.*")
        decided = done if decided is None else decided.union(done)
        units = folded.where("a > 0").select("n", F.floor(F.col("bucket") / FAN).alias("bucket"), "id", "a", "x")
        width *= FAN
        if width >= most:
            return decided.union(units.select("n", "id", "a", (F.expr(_uniform(f"{seed + 3}L", "id")) < F.col("x")).cast("int").alias("copy")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    size counts words (null text: 0), copies is 0 to 3, taken is size times
    copies. Documents without words get the certain copies of their source only
    and take nothing. Null ids and repeated rows are documents of their own. The
    draws go by a row's place in the order of ids and texts, so reruns agree
    however the rows are dealt out (rows that are equal may change places), and
    no id, however frequent, is a key. A text of any length is read whole. An
    empty table gives an empty result; further columns are not read.
    """
    words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), F.xxhash64(text_col).alias("hash"))
    sizes = stage(sizes, "sizes")
    sources = stage(source_targets(sizes), "targets")
    n, names = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    beside = F.broadcast if n <= SOURCES and names <= 80 * SOURCES else lambda d: d
    order = [F.col("doc_id").asc_nulls_last(), "hash", F.col("source").asc_nulls_last(), F.monotonically_increasing_id()]
    rows = numbered(sizes, order, "rows").withColumnRenamed("n", "id").alias("d").join(beside(sources.alias("s")), F.col("d.source").eqNullSafe(F.col("s.source")))
    part = F.col("copies") - F.floor("copies")
    mean = F.try_divide("source_size", "docs")
    wave = F.lit(len(WAVES))
    for k, times in reversed(list(enumerate(WAVES))):
        wave = F.when(F.col("size") > mean * times, k).otherwise(wave)
    rows = stage(rows.select("doc_id", "id", "size", "n", part.alias("x"), wave.alias("wave")), "units")
    units = rows.where((F.col("size") > 0) & (F.col("x") > 0)).select("n", "wave", "id", F.col("size").alias("a"), "x")
    sums = stage(units.groupBy("n", "wave").agg(F.count("*").alias("docs"), F.sum("a").alias("sum"), F.max("a").alias("longest"), F.first("x").alias("x")), "waves")
    decided: DataFrame | None = None
    for k in range(len(WAVES) + 1):
        here = sums.where(F.col("wave") == k).select("n", "docs")
        most = here.agg(F.max("docs")).first()[0]
        if most:
            done = _round(_shifted(units.where(F.col("wave") == k).drop("wave"), sums, decided, k, beside).join(beside(here), "n"), most, seed + 10 * k)
            decided = done if decided is None else decided.union(done)
    out = rows.withColumn("copy", F.lit(0)) if decided is None else rows.join(decided.select("id", "copy"), "id", "left")
    out = out.join(beside(sources.select("n", "source_size", "target", F.floor("copies").cast("int").alias("whole"))), "n")
    copies = F.coalesce(F.col("whole") + F.coalesce("copy", F.lit(0)), F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", unique: bool = False) -> DataFrame:
    """The documents as often as the mix takes them.

    Rows sharing an id are copies of one document, null ids are left out; where
    ids are missing or shared by different texts, mix and join on a key of the
    rows that is ``unique``. An empty table stays empty; other columns pass
    through, whatever their names.
    """
    key, times, copy = (fresh(docs, name) for name in ("_key", "_times", "_copy"))
    taken = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").cast("int").alias(times)).where(F.col(times) > 0)
    one = docs if unique else docs.dropDuplicates([id_col])
    return one.join(taken, F.col(id_col) == F.col(key)).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
