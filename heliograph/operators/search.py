"""Search: what a query string asks for, vector similarity, and the merge of both."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.functions.vectors import cosine

#: Shares of the two scores: both found, only by meaning, only by filter.
BOTH, ONLY_MEANING, ONLY_FILTER = (0.7, 0.5), 0.7, 0.4
#: Elements of a query vector at most; the vector goes into the plan as literals.
MOST_DIMENSIONS = 4096


@dataclass
class Query:
    """What a query string asks for; ``semantic`` is the rest."""

    semantic: str | None = None
    iso: int | None = None
    aperture: float | None = None
    focal_length: float | None = None
    rating_min: int | None = None
    rating_max: int | None = None
    camera: str | None = None
    lens: str | None = None
    rest: list[str] = field(default_factory=list)


def classify(text: str | None) -> Query:
    """Words of the forms ``iso800``, ``f/2.8``, ``50mm``, ``4stars``, ``3-5``, ``camera:x`` and ``lens:x`` (values in lower case); all others are the semantic part."""
    out = Query()
    for word in (text or "").split():
        low = word.lower()
        if m := re.fullmatch(r"iso=?:?(\d{1,9})", low):
            out.iso = int(m[1])
        elif (m := re.fullmatch(r"f/?(\d+(?:\.\d+)?)", low)) is not None:
            out.aperture = float(m[1])
        elif m := re.fullmatch(r"(\d+)mm", low):
            out.focal_length = float(m[1])
        elif m := re.fullmatch(r"([1-5])stars?", low):
            out.rating_min = out.rating_max = int(m[1])
        elif m := re.fullmatch(r"([1-5])-([1-5])", low):
            out.rating_min, out.rating_max = int(m[1]), int(m[2])
        elif low.startswith("camera:"):
            out.camera = low[7:]
        elif low.startswith("lens:"):
            out.lens = low[5:]
        else:
            out.rest.append(word)
    out.semantic = " ".join(out.rest) or None
    return out


#: Forms of words of a query, in lower case, with the digits that count in the first group.
_FORMS = {"iso": r"^iso=?:?(\d{1,9})$", "aperture": r"^f/?(\d+(?:\.\d+)?)$", "focal_length": r"^(\d+)mm$", "rating": r"^([1-5])(?:stars?|-([1-5]))$", "camera": r"^camera:(.*)$", "lens": r"^lens:(.*)$"}


def classified(text: Column) -> Column:
    """:func:`classify` for a column of logged query strings: of several words of one form the last counts."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "")
    low = F.transform(words, F.lower)
    last = lambda form: F.try_element_at(F.filter(low, lambda w: w.rlike(_FORMS[form])), F.lit(-1))
    part = lambda form, group=1: F.regexp_extract(last(form), _FORMS[form], group)
    first, second = part("rating"), part("rating", 2)
    rest = F.array_join(F.filter(words, lambda w: ~F.lower(w).rlike("|".join(_FORMS.values()))), " ")
    return F.struct(
        F.when(rest != "", rest).alias("semantic"), part("iso").cast("int").alias("iso"), part("aperture").cast("double").alias("aperture"), part("focal_length").cast("double").alias("focal_length"),
        first.cast("int").alias("rating_min"), F.when(second != "", second).otherwise(first).cast("int").alias("rating_max"), part("camera").alias("camera"), part("lens").alias("lens"),
    )


def query_kind(text: Column) -> Column:
    """DATE, EXIF, RATING, SEMANTIC or TEXT by what a query string holds, in that order; UNKNOWN if it is empty."""
    low = F.lower(text)
    has = lambda *words: F.greatest(*(low.contains(w).cast("int") for w in words), F.lit(0)) == 1
    # fixed values: the words that tell the kinds
    return (
        F.when(F.coalesce(low, F.lit("")) == "", "UNKNOWN").when(has("date", "time", "year", "month"), "DATE")
        .when(has("camera", "lens", "iso", "aperture", "focal", "shutter"), "EXIF").when(has("rating", "star", "rated"), "RATING")
        .when(has("tag:", "semantic:", "label:"), "SEMANTIC").otherwise("TEXT")
    )


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The ``k`` rows most like the query by cosine, ties by id; rows of another length are left out.

    One pass: each task keeps its best ``k``.
    """
    if len(query) > MOST_DIMENSIONS:
        raise ValueError("the query vector is too long")
    score = cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query)))
    return vectors.select(id_col, score.alias("score")).where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def merged(semantic: DataFrame, filtered: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Scores of both searches as one: weighted sum where both found a row, a share of its own score where one did."""
    a = semantic.select(key, F.col("score").alias("__a"))
    b = filtered.select(key, F.col("score").alias("__b"))
    score = (
        F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.col("__a") * BOTH[0] + F.col("__b") * BOTH[1])
        .when(F.col("__a").isNotNull(), F.col("__a") * ONLY_MEANING)
        .otherwise(F.col("__b") * ONLY_FILTER)
    )
    out = a.join(b, key, "full_outer").select(key, score.alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit is not None else out


def text_matches(rows: DataFrame, text: str, *columns: str, ignore_case: bool = True) -> DataFrame:
    """Rows that hold the text, taken literally, in one of the columns."""
    found = F.lit(False)
    for c in columns:
        own, wanted = (F.lower(c), text.lower()) if ignore_case else (F.col(c), text)
        found = found | F.coalesce(own.contains(F.lit(wanted)), F.lit(False))
    return rows.where(found)
