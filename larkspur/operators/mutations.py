"""Changes to tables as functions from old rows to new rows, and the constraints that stores would check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_fold
from .ordering import numbered

#: The columns of a song that may be set.
SETTABLE = ("title", "artist", "chart_written_key", "sounding_key", "original_key", "preferred_key", "default_capo", "bpm", "genre", "feel", "era", "tempo_feel", "beatbuddy_structure", "ai_confidence", "user_edited_at", "edited_offline")


def insert_rows(old: DataFrame, new: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """Adds rows with the ids that follow the largest, without gaps; columns that the new rows lack are null."""
    return old.unionByName(with_new_ids(old, new, id_col, order), allowMissingColumns=True)


def with_new_ids(old: DataFrame, new: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """The new rows with the ids that they get; new rows never meet in one task."""
    top = old.agg(F.max(id_col)).first()[0] or 0
    return numbered(new, [F.col(order)] if order else [], id_col).withColumn(id_col, F.col(id_col) + top + 1)


def update_allowed(old: DataFrame, where: Column, values: dict[str, object], allowed: tuple[str, ...] = SETTABLE) -> DataFrame:
    """Sets the allowed columns where the condition holds; others are ignored. An explicit null is set."""
    new = {c: F.when(F.coalesce(where, F.lit(False)), F.lit(v).cast(old.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items() if c in allowed and c in old.columns}
    return old.withColumns(new) if new else old


def override(parsed: DataFrame, body: DataFrame, key: str) -> DataFrame:
    """Fields of ``body`` win over the parsed ones where its map ``fields`` has them, even as null."""
    given = body.select(F.col(key), F.col("fields").alias("_fields"))
    joined = parsed.join(given, key, "left")
    has = lambda c: F.coalesce(F.map_contains_key("_fields", F.lit(c)), F.lit(False))
    kinds = {f.name: f.dataType for f in parsed.schema}
    return joined.select(*[c if c == key else F.when(has(c), F.col("_fields")[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in parsed.columns])


def delete_cascade(parents: DataFrame, doomed: DataFrame, id_col: str, children: dict[str, tuple[DataFrame, str]], nulled: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """Removes the doomed ids from the parents and all children, and sets the references of ``nulled`` tables to null."""
    ids = doomed.select(F.col(id_col).alias("_doomed")).distinct()
    out = {"parents": parents.join(ids, parents[id_col] == ids["_doomed"], "left_anti")}
    for name, (rows, key) in children.items():
        out[name] = rows.join(ids, rows[key] == ids["_doomed"], "left_anti")
    for name, (rows, key) in (nulled or {}).items():
        joined = rows.join(ids, rows[key] == ids["_doomed"], "left")
        out[name] = joined.select(*[F.when(F.col("_doomed").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in rows.columns])
    return out


def first_of(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert_tags(tags: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Adds tags whose name, whatever its case, is not there; the first spelling and category win."""
    fresh = first_of(new.withColumn("_fold", ascii_fold(F.col("name"))), [F.col("_fold")], [F.col(order)])
    known = tags.select(ascii_fold(F.col("name")).alias("_fold"))
    return tags.unionByName(fresh.join(known, "_fold", "left_anti").select("name", "category"), allowMissingColumns=True)


def rename(tags: DataFrame, renames: DataFrame, key: str = "name") -> DataFrame:
    """The tags with the names that ``renames`` (name, new_name) asks for, and ``refused`` where a tag had to keep its own.

    Refused is a name that another tag has, whatever its case, also if that tag
    is itself renamed; of several tags that ask for one name, the first by name
    gets it. A tag may change the case of its own name. A null new name, and a
    name that no tag has, ask for nothing; of several wishes for a tag, the first by
    name counts.
    """
    fold = lambda c: ascii_fold(F.col(c))
    asked = renames.where("new_name IS NOT NULL").groupBy(F.col("name").alias("_old")).agg(F.min("new_name").alias("_new"))
    known = tags.groupBy(fold(key).alias("_fold")).agg(F.count("*").alias("_holders"))
    rows = tags.join(asked, F.col(key) == F.col("_old"), "left").withColumn("_wish", fold("_new"))
    rows = rows.join(known, F.col("_wish") == F.col("_fold"), "left")
    rows = rows.withColumn("_taken", F.coalesce("_holders", F.lit(0)) > F.coalesce((fold(key) == F.col("_wish")).cast("int"), F.lit(0)))
    first = rows.where("_wish IS NOT NULL AND NOT _taken").groupBy(F.col("_wish").alias("_won")).agg(F.min(key).alias("_first"))
    rows = rows.join(first, F.col("_wish") == F.col("_won"), "left")
    refused = F.col("_wish").isNotNull() & (F.col("_taken") | (F.col(key) != F.coalesce("_first", key)))
    name = F.when(refused | F.col("_new").isNull(), F.col(key)).otherwise(F.col("_new")).alias(key)
    return rows.select(*[name if c == key else F.col(c) for c in tags.columns], refused.alias("refused"))


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the links that are not there."""
    return links.unionByName(new.select(*links.columns)).dropDuplicates()


def remove_links(links: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return links.join(gone.select(*keys).distinct(), keys, "left_anti")


def new_only(candidates: DataFrame, known: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Candidates that are neither known nor repeated among themselves, whatever the case of their keys.

    Only rows with all keys are held against others; a row that lacks one is
    always new.
    """
    folds = [ascii_fold(F.col(k)).alias(f"_{k}") for k in keys]
    names = [f"_{k}" for k in keys]
    rows = candidates.select("*", *folds)
    whole = rows.dropna(subset=names)
    lacking = rows.where(" OR ".join(f"`{n}` IS NULL" for n in names))
    fresh = first_of(whole.join(known.select(*folds), names, "left_anti"), [F.col(n) for n in names], [F.col(order)])
    return fresh.unionByName(lacking).drop(*names)


def place(old: DataFrame, new: DataFrame, order: str, keys: tuple[str, str] = ("setlist_id", "position")) -> DataFrame:
    """Insert or replace at a place of a list: of rows at the same place, the newest wins. ``order`` tells new rows apart.

    New rows without a position go behind the last one of their list, in their order.
    """
    listed, position = keys
    both = old.withColumn("_age", F.lit(0)).unionByName(new.where(F.col(position).isNotNull()).withColumn("_age", F.lit(1)), allowMissingColumns=True)
    kept = first_of(both, [F.col(k) for k in keys], [F.desc("_age"), F.desc(order)]).drop("_age")
    most = kept.groupBy(F.col(listed).alias("_list")).agg(F.max(position).alias("_most"))
    nth = F.row_number().over(Window.partitionBy(listed).orderBy(order))
    added = new.where(F.col(position).isNull()).withColumn("_nth", nth).join(most, F.col(listed) == F.col("_list"), "left")
    kind = old.schema[position].dataType
    added = added.withColumn(position, (F.coalesce("_most", F.lit(0)) + F.col("_nth")).cast(kind)).drop("_list", "_most", "_nth")
    return kept.unionByName(added, allowMissingColumns=True)


def next_positions(lists: DataFrame, entries: DataFrame, list_id: str = "id", key: str = "setlist_id") -> DataFrame:
    """The next free position of each list: the largest plus 1, or 1."""
    most = entries.groupBy(F.col(key).alias("_list")).agg(F.max("position").alias("_most"))
    return lists.join(most, lists[list_id] == most["_list"], "left").select(lists[list_id], (F.coalesce("_most", F.lit(0)) + 1).alias("next_position"))


def reorder(entries: DataFrame, orders: DataFrame, key: str = "setlist_id", item: str = "song_id") -> DataFrame:
    """Sets positions at once from ``orders`` (list, array of items); items not listed keep theirs.

    An item listed twice takes its first place.
    """
    wanted = orders.select(key, F.posexplode(F.array_distinct("items")).alias("_at", item))
    joined = entries.join(wanted, [key, item], "left")
    return joined.select(*[F.coalesce(F.col("_at") + 1, F.col("position")).cast("int").alias(c) if c == "position" else F.col(c) for c in entries.columns])


def enrich(songs: DataFrame, found: DataFrame, kept_if_missing: tuple[str, ...] = ("original_key", "bpm"), key: str = "id") -> DataFrame:
    """Writes found metadata over songs. Missing (null, empty, 0) values leave ``kept_if_missing`` alone; others are overwritten even with null."""
    joined = songs.join(found.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in found.columns if c != key], F.lit(True).alias("_hit")), key, "left")

    def value(c: str) -> Column:
        if c == key or c not in found.columns:
            return F.col(c)
        new = F.col(f"_{c}")
        if c in kept_if_missing:
            blank = F.lit("") if dict(found.dtypes)[c] == "string" else F.lit(0)
            return F.coalesce(F.nullif(new, blank), F.col(c)).alias(c)
        return F.when(F.col("_hit"), new).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in songs.columns])


def put_all(cache: DataFrame, fetched: DataFrame, key: str = "id", at: str | None = None) -> DataFrame:
    """Replaces cached rows by fetched ones with their key; rows that are no longer fetched stay."""
    both = cache.withColumn("_age", F.lit(0)).unionByName(fetched.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return first_of(both, [F.col(key)], [F.desc("_age"), *([F.desc(at)] if at else [])]).drop("_age")


def changes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many keys were changed, removed and added. Both tables have the same columns and unique keys."""
    columns = [c for c in old.columns if c != key]
    before, after = (d.select(F.col(key).alias("_key"), F.struct(F.lit(True), *columns).alias(name)) for d, name in ((old, "_old"), (new, "_new")))
    both = before.join(after, "_key", "full")
    gone, fresh = F.col("_new").isNull(), F.col("_old").isNull()
    return both.agg(F.count_if(~gone & ~fresh & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"), F.count_if(gone).alias("removed"), F.count_if(fresh).alias("added"))


def duplicates(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Keys that occur more than once: rows that a unique index would refuse."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, key: str, parents: DataFrame, parent_id: str) -> DataFrame:
    """Children whose parent does not exist."""
    return children.where(F.col(key).isNotNull()).join(parents, children[key] == parents[parent_id], "left_anti")
