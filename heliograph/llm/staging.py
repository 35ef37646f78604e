"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.sources.shared import shared_path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    What follows reads the files, so a lost executor costs a re-read and not a
    re-run, and several consumers do not compute ``df`` several times.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch between the JVM and a Python worker, at most (a longer row is a batch of its own).
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound batches by bytes, for rows with whole texts: executor and worker both hold a task's batch going in and one coming out.  A bound that the session has set itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's own default
        spark.conf.set(name, str(BATCH_BYTES))


def hash_bound(most: int, rows: int) -> int:
    """A signed 64-bit hash below which thrice ``most`` of ``rows`` lie on the average (all, if there are fewer).

    Rows above it can't be among the first ``most`` by hash, so a sorted limit
    after this filter moves about ``3 * most`` rows instead of ``most`` from each task.
    """
    return min((1 << 63) - 1, int(-(1 << 63) + 3 * most * (1 << 64) // max(rows, 1)))


#: Bits of :func:`hash_filter`, whatever the input.
FILTER_BITS = 25


def hash_filter(ids: DataFrame, column: str) -> Callable[[int], bool]:
    """Whether a long may be among those of a column: always true for its values, true by chance for few others (more, if it has many millions).

    A bitmap of ``1 << FILTER_BITS`` bits, made in Spark and sent to every task: it
    spares the shuffle of rows that an exact join, which must follow, would drop.
    """
    mask = (1 << FILTER_BITS) - 1
    low = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS).bitwiseAND(mask)
    marked = ids.select(low.alias("bit")).groupBy(F.shiftright("bit", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND((1 << 15) - 1)).alias("bits"))
    held = ids.sparkSession.sparkContext.broadcast({r["block"]: bytes(r["bits"]) for r in marked.collect()})  # 2 ** 10 blocks of 4 KB at most

    def inside(value: int) -> bool:
        bit = (value & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)
        bits = held.value.get(bit >> 15)
        return bits is not None and bool(bits[(bit & 0x7FFF) >> 3] >> (bit & 7) & 1)

    return inside


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the largest counts, about ``most`` and never more: all of at least a count that a histogram picks."""
    level = F.floor(F.log2(F.col(column).cast("double")) * 8).cast("int")
    least, reached = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 8 * 64 rows
        if reached + r["count"] > most:
            break
        least, reached = r["level"], reached + r["count"]
    return counts.where(F.lit(False) if least is None else level >= least)
