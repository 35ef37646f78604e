"""Scores and ratings.  Those that end in whole stars are computed in FLOAT from end to end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _f(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high).cast("float")), F.lit(low).cast("float"))


def stars(overall: Column) -> Column:
    """Whole stars from 1 to 5 of a score from 0 to 1."""
    return F.greatest(F.lit(1), F.least(F.lit(5), (_f(overall) * _f(5)).cast("int")))


def heuristic_sharpness(iso: Column) -> Column:
    return clamp(_f(1) - (_f(F.coalesce(iso, F.lit(200))) / _f(6400)).cast("float"), 0.3, 0.9)


def heuristic_overall(iso: Column) -> Column:
    return (heuristic_sharpness(iso) * _f(0.5) + _f(0.5) * _f(0.7)).cast("float")


def heuristic_flag(overall: Column) -> Column:
    return F.when(_f(overall) > _f(0.75), "PICK").otherwise("NONE")


def strict_overall(overall: Column, strictness: float) -> Column:
    """The score after a penalty that grows with strictness from -1 (lenient) to 1."""
    penalty = (_f(strictness) - _f(0.5)) * _f(2)
    return clamp(_f(overall) - _f(0.15) * penalty, 0.0, 1.0)


def strict_flag(overall: Column, strictness: float) -> Column:
    """The flag of a score that :func:`strict_overall` gave."""
    penalty = (_f(strictness) - _f(0.5)) * _f(2)
    return F.when(_f(overall) > _f(0.75) - _f(0.1) * penalty, "PICK").when(_f(overall) < _f(0.3), "REJECT").otherwise("NONE")


def capped_sum(base: float, parts: list[tuple[Column, float]]) -> Column:
    """``base`` and the parts whose condition holds, at most 1."""
    return F.least(reduce(lambda total, part: total + F.when(part[0], part[1]).otherwise(0.0), parts, F.lit(base)), F.lit(1.0))


def filter_match(iso: Column, aperture: Column, focal: Column, camera: Column, lens: Column) -> Column:
    """How well a row fits a query's hints: 0.5, 0.3 for each number and 0.4 for each name that agrees."""
    return capped_sum(0.5, [(iso, 0.3), (aperture, 0.3), (focal, 0.3), (camera, 0.4), (lens, 0.4)])


def rubric(mean: Column, deviation: Column, sharpness: Column) -> tuple[Column, Column]:
    """Stars from 1 to 5 and joined notes: three, and one more or less for each of exposure (distance of the mean from middle grey), contrast and sharpness."""
    apart, dark = F.abs(mean - 0.18), mean < 0.18
    by_side = lambda low, high: F.when(dark, low).otherwise(high)
    scale = lambda v, good, bad: F.when(v > good, 1).when(v < bad, -1).otherwise(0)
    rating = F.lit(3) + F.when(apart < 0.06, 1).when(apart > 0.30, -1).otherwise(0) + scale(deviation, 0.20, 0.03) + scale(sharpness, 0.25, 0.02)
    notes = F.concat_ws(
        "; ",
        F.when(apart < 0.06, "good exposure").when(apart > 0.30, by_side("underexposed", "overexposed")).when(apart > 0.18, by_side("slightly dark", "slightly bright")).otherwise("acceptable exposure"),
        F.when(deviation > 0.20, "strong contrast").when(deviation < 0.03, "flat / low contrast").when(deviation < 0.08, "soft contrast").otherwise("balanced contrast"),
        F.when(sharpness > 0.25, "sharp detail").when(sharpness < 0.02, "soft / blurry").when(sharpness < 0.08, "moderate detail").otherwise("good detail"),
    )
    return F.greatest(F.lit(1), F.least(F.lit(5), rating)), notes


def remaining_time(elapsed: Column, completed: Column, total: Column) -> Column:
    """Expected time left; null before anything is done or when nothing is left."""
    left = total - completed
    return F.when((completed > 0) & (left > 0), elapsed / completed * left)
