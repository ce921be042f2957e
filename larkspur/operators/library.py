"""A catalogue of items with tags, ordered lists and a log: search, nesting, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, contains_fold

#: Tag categories in the order in which they are shown.
CATEGORIES = ("Genre", "Era", "Feel", "Tempo", "Vibe")
OTHER = "Other"


def with_all_tags(items: DataFrame, links: DataFrame, tags: list[str], item_id: str = "id", link_id: str = "song_id", tag_col: str = "name", fold: bool = False) -> DataFrame:
    """Relational division: the items that carry every requested tag.

    ``links`` has a row for each item and tag name. A tag asked for twice counts
    once; names match exactly unless ``fold``. No tags ask for nothing.
    """
    asked = sorted({t.lower() if fold else t for t in tags})
    if not asked:
        return items
    name = ascii_fold(F.col(tag_col)) if fold else F.col(tag_col)
    carriers = links.where(name.isin(*asked)).groupBy(F.col(link_id).alias("_carrier")).agg(F.countDistinct(name).alias("_n")).where(F.col("_n") == len(asked))
    return items.join(carriers, items[item_id] == carriers["_carrier"], "left_semi")


def search(songs: DataFrame, links: DataFrame | None = None, query: str | None = None, genre: str | None = None, feel: str | None = None, era: str | None = None, artist: str | None = None, tags: list[str] | None = None, sort: str = "title") -> DataFrame:
    """All conditions that are given must hold; null and empty ones ask for nothing.

    ``query`` is a part of title or artist, ``artist`` a part of the artist,
    whatever the case of ASCII letters; genre, feel and era are equal. The long
    text column is left out. Sorted by title, artist or era; anything else sorts
    by title.
    """
    conditions: list[Column] = []
    if query:
        conditions.append(contains_fold(F.col("title"), query) | contains_fold(F.col("artist"), query))
    conditions += [F.col(c) == v for c, v in (("genre", genre), ("feel", feel), ("era", era)) if v]
    if artist:
        conditions.append(contains_fold(F.col("artist"), artist))
    found = songs.drop("chart_content")
    if conditions:
        found = found.where(reduce(lambda a, b: a & b, conditions))
    if tags:
        found = with_all_tags(found, links, tags)
    order = {"artist": ascii_fold(F.col("artist")), "era": F.col("era")}.get(sort, ascii_fold(F.col("title")))
    return found.orderBy(order.asc_nulls_first(), "id")


def search_offline(songs: DataFrame, query: str | None = None, genre: str | None = None, feel: str | None = None, era: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """The search over cached rows with an embedded array of tag names: Unicode case is folded, every tag must be there."""
    found = songs
    if query:
        q = F.lower(F.lit(query))
        found = found.where(F.contains(F.lower("title"), q) | F.coalesce(F.contains(F.lower("artist"), q), F.lit(False)))
    for c, v in (("genre", genre), ("feel", feel), ("era", era)):
        if v:
            found = found.where(F.col(c) == v)
    if tags:
        names = F.transform("tags", F.lower)
        found = found.where(F.forall(F.array(*[F.lit(t.lower()) for t in tags]), lambda t: F.array_contains(names, t)))
    return found


def same_fold(a: Column, b: Column | str) -> Column:
    """Equality whatever the case of ASCII letters."""
    return ascii_fold(a) == ascii_fold(b if isinstance(b, Column) else F.lit(b))


def count_children(parents: DataFrame, children: DataFrame, parent_id: str, child_key: str, name: str = "n") -> DataFrame:
    """Parents with the number of their children, 0 where there are none. Children are counted before they are joined."""
    counts = children.groupBy(F.col(child_key).alias("_parent")).agg(F.count("*").alias("_n"))
    joined = parents.join(counts, parents[parent_id] == counts["_parent"], "left")
    return joined.select(*parents.columns, F.coalesce("_n", F.lit(0)).alias(name))


def nest_children(parents: DataFrame, children: DataFrame, parent_id: str, child_key: str, order: list[str], fields: list[str], name: str = "children") -> DataFrame:
    """Parents with an ordered array of their children, empty where there are none."""
    item = F.struct(*order, *[f for f in fields if f not in order])
    lists = children.groupBy(F.col(child_key).alias("_parent")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    joined = parents.join(lists, parents[parent_id] == lists["_parent"], "left")
    return joined.select(*parents.columns, F.coalesce("_items", F.array()).alias(name))


def counts_by(rows: DataFrame, column: str, by_name: bool = False) -> DataFrame:
    """Rows by value, nulls left out: the most frequent first, or by name."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(column) if by_name else counts.orderBy(F.desc("n"), column)


def statistics(songs: DataFrame, tags: DataFrame, lists: DataFrame) -> DataFrame:
    """One row: how many songs, tags and lists there are, and arrays of (value, n) by genre, era and feel."""
    def one(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count("*").alias(name))

    def array_of(column: str, by_name: bool) -> DataFrame:
        counts = songs.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        order = F.struct(F.col(column).alias("value"), "n") if by_name else F.struct((-F.col("n")).alias("less"), F.col(column).alias("value"), "n")
        return counts.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["value"], x["n"])).alias(f"by_{column}"))

    parts = [one(songs, "songs"), one(tags, "tags"), one(lists, "setlists"), array_of("genre", False), array_of("era", True), array_of("feel", False)]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # each part is one row


def group_tags(tags: DataFrame) -> DataFrame:
    """Tag names by category: known categories in their order, then the others by name; without one, Other."""
    category = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit(OTHER))
    known = F.array(*map(F.lit, CATEGORIES))
    lists = tags.groupBy(category.alias("category")).agg(F.array_sort(F.collect_list("name")).alias("names"))
    at = F.array_position(known, F.col("category"))
    return lists.withColumn("rank", F.when(at > 0, at).otherwise(len(CATEGORIES) + 1).cast("int")).orderBy("rank", "category")


def newest(log: DataFrame, time: str, key: str, n: int = 100) -> DataFrame:
    """The newest n entries; entries of the same time by the larger key."""
    return log.orderBy(F.desc(time), F.desc(key)).limit(n or 100)

