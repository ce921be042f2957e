"""Small scalar rules: coercion, bounds, bands and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import empty_to_null

#: Lower bounds of the verdict bands, score limits of the stages, the capo's last fret.
VERDICTS = ((70, "bussin"), (35, "mid"), (0, "unc"))
SAFE, WARNING, LAST_FRET = 2, 7, 11


def number_or_zero(x: Column) -> Column:
    """A number; 0 where there is none."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def clamp_capo(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(LAST_FRET), x))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part * 100 / F.nullif(whole, F.lit(0)), digits)


def first_filled(*parts: Column, default: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*map(empty_to_null, parts), F.lit(default))


def join_filled(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *map(empty_to_null, parts))


def route(score: Column) -> Column:
    return F.when(score <= SAFE, "safe").when(score <= WARNING, "spouse_warning").otherwise("friend_intervention")


#: The phrases for a voice's tone.
CALM, FURIOUS = "calm but firm", "absolutely furious and appalled"


def tone(score: Column) -> Column:
    return F.when(score <= WARNING, CALM).otherwise(FURIOUS)


def verdict(score: Column) -> Column:
    """The band of a score from 0 to 100; null outside."""
    out = F.when(~score.between(0, 100), None)
    for least, name in VERDICTS:
        out = out.when(score >= least, name)
    return out


def over_limit(sugar: Column, fat: Column, most_sugar: float, most_fat: float) -> Column:
    return (sugar > most_sugar) | (fat > most_fat)
