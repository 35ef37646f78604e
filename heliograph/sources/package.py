"""Project packages: sections of JSON lines, each with its schema, and a manifest with a header.

A package is a folder in a store that Spark writes to.  Saving writes every
section into a folder of its own and the manifest last (:mod:`.versions`), so a save
that dies half-way is never opened and the version before stays as it was.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.sources.versions import new_folder, publish, published

HEADER = "header"
#: Fixed value: what marks the header of a package.
MAGIC = "ALCD"
#: Entries that a package has besides one for each image's edits.
OTHER_ENTRIES = 4


def checksum(df: DataFrame) -> Column:
    """The sum of the rows' hashes, whatever their order."""
    return F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")), F.lit(0)).cast("string")


def _written(df: DataFrame, path: str, name: str) -> dict:
    """Write a section; its manifest row is worked out in the same pass."""
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), checksum(df).alias("checksum")).write.json(path)
    return {"name": name, "path": path, "schema": df.schema.json(), **seen.get}


def save(spark: SparkSession, root: str, project: str, images: DataFrame, sections: dict[str, DataFrame], now: int, created: int | None = None) -> int:
    """Save a package and give its version.

    ``images`` has ``id`` and ``thumbnailPath``; it becomes the section ``images``,
    its thumbnails that are there the section ``thumbnails``.  ``sections`` may hold
    any others; rows of ``edits`` belong to an image by ``imageId``.
    """
    clash = {HEADER, "images", "thumbnails"} & sections.keys()
    if clash:
        raise ValueError(f"sections of a package have other names: {sorted(clash)}")
    before, old = published(spark, root)
    thumbnails = images.where(F.col("thumbnailPath").isNotNull()).select(F.col("id").alias("imageId"), F.col("thumbnailPath").alias("path"))
    rows = [_written(df, new_folder(root, name), name) for name, df in {**sections, "images": images, "thumbnails": thumbnails}.items()]
    by_name = {r["name"]: r for r in rows}
    edited = section(spark, by_name["edits"]).agg(F.countDistinct("imageId")).first()[0] if "edits" in by_name else 0
    born = created if created is not None else next((json.loads(r["note"])["createdAt"] for r in old if r["name"] == HEADER), now)
    header = {"magic": MAGIC, "name": project, "createdAt": born, "modifiedAt": now, "imageCount": by_name["images"]["rows"], "entryCount": edited + OTHER_ENTRIES}
    publish(spark, root, before + 1, [*rows, {"name": HEADER, "note": json.dumps(header)}])
    return before + 1


def section(spark: SparkSession, row: dict) -> DataFrame:
    """The section of a manifest row."""
    return spark.read.schema(T.StructType.fromJson(json.loads(row["schema"]))).json(row["path"])


def opened(spark: SparkSession, root: str, version: int | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """The header and the sections of a package, the newest version if none is named; an error if it is none."""
    _, rows = published(spark, root, version)
    header = next((json.loads(r["note"]) for r in rows if r["name"] == HEADER), {})
    if header.get("magic") != MAGIC:
        raise ValueError("not a project package")
    return header, {r["name"]: section(spark, r) for r in rows if r["name"] != HEADER}


def damaged(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    """The sections whose rows are not those that were saved."""
    found = []
    for row in published(spark, root, version)[1]:
        if row["name"] != HEADER:
            df = section(spark, row)
            now = df.agg(F.count(F.lit(1)).alias("rows"), checksum(df).alias("checksum")).first()
            if (now["rows"], now["checksum"]) != (row["rows"], row["checksum"]):
                found.append(row["name"])
    return found


def entries(spark: SparkSession, root: str, version: int | None = None) -> list[tuple[str, int | None]]:
    """Names and rows of what a package holds."""
    return [(r["name"], r["rows"]) for r in published(spark, root, version)[1]]
