"""Path algebra on string columns; the root is ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(path: Column) -> Column:
    """Trimmed, with a leading slash, single slashes, and none at the end but for the root; blank is the root."""
    whole = F.regexp_replace(F.concat(F.lit("/"), F.trim(F.coalesce(path, F.lit("")))), "/+", "/")
    return F.when(whole == "/", whole).otherwise(F.regexp_replace(whole, "/$", ""))


def parent(path: Column) -> Column:
    """The path above; the root's parent is the root."""
    own = normalised(path)
    above = F.regexp_replace(own, "/[^/]*$", "")
    return F.when(above == "", "/").otherwise(above)


def name(path: Column) -> Column:
    return F.substring_index(normalised(path), "/", -1)


def joined(path: Column, child: Column) -> Column:
    return normalised(F.concat(path, F.lit("/"), child))


def components(path: Column) -> Column:
    """The names on the way from the root."""
    return F.filter(F.split(normalised(path), "/"), lambda part: part != "")


def depth(path: Column) -> Column:
    return F.size(components(path))


def is_descendant(ancestor: Column, path: Column) -> Column:
    """Whether ``path`` is ``ancestor`` or lies below it."""
    return (normalised(ancestor) == normalised(path)) | is_below(ancestor, path)


def is_below(ancestor: Column, path: Column) -> Column:
    """Whether ``path`` lies strictly below ``ancestor``."""
    above, own = normalised(ancestor), normalised(path)
    return (own != above) & own.startswith(F.when(above == "/", "/").otherwise(F.concat(above, F.lit("/"))))


def relative(ancestor: Column, path: Column) -> Column:
    """``path`` as seen from ``ancestor``: null if unrelated, empty if equal."""
    above, own = normalised(ancestor), normalised(path)
    skip = F.when(above == "/", 2).otherwise(F.length(above) + 2)
    return F.when(above == own, F.lit("")).when(is_below(ancestor, path), F.substr(own, skip))


def moved(path: Column, source: str, target: str) -> Column:
    """``path`` after ``source`` has become ``target``; paths elsewhere stay."""
    below = F.concat(F.lit(target), F.substr(normalised(path), F.lit(len(source) + 1)))
    return F.when(is_descendant(F.lit(source), path), below).otherwise(normalised(path))
