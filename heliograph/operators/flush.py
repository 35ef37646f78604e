"""Flushing what has changed since the last save: one merge by key that also counts references and drops garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators.catalog import latest

KINDS = ("insert", "update", "delete")


def flushed(elements: DataFrame, changes: DataFrame, links: DataFrame, key: str, order: list[str], counter: str = "ref_count", flag: str = "deleted") -> DataFrame:
    """``elements`` after a flush.

    ``changes`` has ``kind`` (insert, update, delete), the ``order`` that says which
    change of a key is the last, and the columns of an element; ``links`` has the
    key and ``step``, by how much a folder's content adds to its references.

    * An insert or update puts the change's columns; it also brings a deleted element back.  A null column of an update keeps what was there.
    * A delete marks the element (``flag``); it stays as long as folders refer to it.
    * References are what was counted plus the steps, never below 0.
    * What is marked and has no references is dropped, and so is an unmarked row that no one ever stored.

    One aggregation of the links and one full join, all by the key: with both sides
    dealt by it once, nothing else is moved.
    """
    columns = [c for c in elements.columns if c not in (key, counter, flag)]
    last = latest(changes.where(F.col("kind").isin(*KINDS) & F.col(key).isNotNull()), [key], order).select(key, "kind", *(F.col(c).alias(f"__{c}") for c in columns))
    steps = links.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("step").alias("__step"))
    rows = elements.withColumn("__stored", F.lit(True)).join(last, key, "full").join(steps, key, "left")
    kind, stored = F.col("kind"), F.col("__stored").isNotNull()
    put = kind.isin("insert", "update")
    new = {c: F.when(kind == "insert", F.col(f"__{c}")).when(kind == "update", F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in columns}
    new[counter] = F.greatest(F.lit(0), F.coalesce(counter, F.lit(0)) + F.coalesce("__step", F.lit(0))).cast(elements.schema[counter].dataType)
    new[flag] = F.when(kind == "delete", True).when(put, False).otherwise(F.coalesce(flag, F.lit(False)))
    return rows.where(stored | put).withColumns(new).where(~F.col(flag) | (F.col(counter) > 0)).select(*elements.columns)
