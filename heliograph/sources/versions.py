"""Versions of a store: data under folders that are never written again, and a manifest of each version, written last.

A reader goes by the newest manifest, so it never sees a version that is half
written, and older versions can be read on.  Two writers of the same version
conflict: the second one's manifest is refused.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"version": T.LongType(), "rows": T.LongType()}
MANIFEST = T.StructType([T.StructField(name, _KINDS.get(name, T.StringType())) for name in ("version", "name", "path", "rows", "checksum", "schema", "note")])


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all manifests; none where nothing has been published."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/manifest/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def published(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, list[dict]]:
    """A version's number and manifest rows, of the newest one if none is named; version 0 has no rows."""
    every = manifests(spark, root)
    number = (every.agg(F.max("version")).first()[0] or 0) if version is None else version
    rows = [r.asDict() for r in every.where(F.col("version") == number).orderBy("name").collect()]
    if version and not rows:
        raise ValueError(f"version {version} was not published")
    return number, rows


def publish(spark: SparkSession, root: str, version: int, rows: list[dict]) -> None:
    """Write a version's manifest; an error if there is one."""
    full = [tuple(version if f.name == "version" else row.get(f.name) for f in MANIFEST) for row in rows]
    spark.createDataFrame(full, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{root.rstrip('/')}/manifest/{version}")


def new_folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/data/{name}/{uuid.uuid4().hex}"
