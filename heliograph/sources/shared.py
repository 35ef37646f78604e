"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``.  Where that is unset, only a local session (tests) gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='heliograph-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back, so that its rows stay as they are."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_view(df: DataFrame) -> str:
    """The name of a new view of ``df``, for statements that take tables by name; each call gives another."""
    name = f"heliograph_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name
