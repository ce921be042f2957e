"""A replica's bookkeeping: edited ids, key-value settings, arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mutations import put_all


def mark(held: Column, item: Column) -> Column:
    """The set with the item; once."""
    return F.array_union(held, F.array(item))


def clear(held: Column, item: Column) -> Column:
    """The set without the item."""
    return F.array_except(held, F.array(item))


def clear_all(held: Column) -> Column:
    """The set without any item."""
    return F.filter(held, lambda _: F.lit(False))


def toggle(held: Column, item: Column) -> Column:
    """Without the item if it is there, else with it."""
    return F.when(F.array_contains(held, item), clear(held, item)).otherwise(mark(held, item))


def put_settings(settings: DataFrame, new: DataFrame) -> DataFrame:
    """Sets (key, value, updated_at): the newest value of each key."""
    return put_all(settings, new, key="key", at="updated_at")


def given(**arguments: object) -> dict[str, object]:
    """The arguments that are neither None nor empty."""
    return {k: v for k, v in arguments.items() if v is not None and v != ""}
