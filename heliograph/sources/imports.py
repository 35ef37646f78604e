"""Import tasks: files taken in order until they are through or cancelled, as rows, refusals and a log of progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.sources.tables import import_batch


def imported(files: DataFrame, cancels: DataFrame, folder: str, name_col: str = "name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to add, rows refused with their reason, and the events of :mod:`heliograph.streaming.tasks` that the tasks make.

    ``files``: ``task``, ``number`` (the order of its files) and ``at`` (when each is
    through), besides the name; ``cancels``: ``task`` and ``at``, the first of which
    counts.  A file that is through after its task was cancelled is neither added nor
    refused.  A refused file counts as done, as an added one does; its reason goes
    with the progress.  A task ends with ``complete`` once all files are through.
    Files without a task or a time belong to no task and are left out.
    """
    first = cancels.where(F.col("task").isNotNull()).groupBy("task").agg(F.min("at").alias("__cancelled"))
    known = files.where(F.col("task").isNotNull() & F.col("at").isNotNull()).join(first, "task", "left")
    by_task = Window.partitionBy("task").orderBy("at", "number")
    whole = Window.partitionBy("task")
    known = known.withColumns({"__done": F.row_number().over(by_task).cast("long"), "__total": F.count(F.lit(1)).over(whole), "__begin": F.min("at").over(whole)})
    through = known.where(F.col("__cancelled").isNull() | (F.col("at") <= F.col("__cancelled")))
    good, bad = import_batch(through, folder, name_col)
    event = lambda rows, at, kind, done, error=None: rows.select("task", at.alias("at"), F.lit(kind).alias("kind"), done.cast("long").alias("completed"), F.col("__total").alias("total"), (F.lit(None) if error is None else error).cast("string").alias("error"))  # noqa: E731, E501
    tasks = known.groupBy("task").agg(F.max("__total").alias("__total"), F.min("__begin").alias("__begin"), F.max("at").alias("__end"), F.max("__cancelled").alias("__cancelled"))
    ended = tasks.where(F.col("__cancelled").isNull() | (F.col("__end") <= F.col("__cancelled")))
    log = event(tasks, F.col("__begin"), "start", F.lit(0)).unionByName(event(good.select("task", "at", "__done", "__total"), F.col("at"), "update", F.col("__done")))
    log = log.unionByName(event(bad, F.col("at"), "update", F.col("__done"), F.col("error")))
    log = log.unionByName(event(ended, F.col("__end"), "complete", F.col("__total"))).unionByName(event(tasks.where(F.col("__cancelled") < F.col("__end")), F.col("__cancelled"), "cancel", F.lit(0)))
    # of one time: start, updates in order, then the end
    place = F.when(F.col("kind") == "start", F.lit(0)).when(F.col("kind") == "update", F.col("completed")).otherwise(F.col("total") + 1)
    plain = lambda df: df.drop("__done", "__total", "__begin", "__cancelled")
    return plain(good), plain(bad), log.withColumn("place", place)
