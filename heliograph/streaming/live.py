"""Live queries as Structured Streaming: latest state, debounce and progress, with watermarks that bound what is kept."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.sources.shared import shared_path


def latest_by_key(rows: DataFrame, key: str, time: str, *columns: str) -> DataFrame:
    """The last row of each key; batch or stream (output mode ``update`` or ``complete``)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(time, *columns), F.struct(time, *columns)).alias("last")).select(key, "last.*")


def debounced(rows: DataFrame, key: str, time: str, value: str, gap: str = "80 milliseconds", watermark: str | None = None) -> DataFrame:
    """The last value of each burst: rows of a key less than ``gap`` apart are one."""
    if rows.isStreaming:
        rows = rows.withWatermark(time, watermark or gap)
    out = rows.groupBy(key, F.session_window(F.col(time), gap).alias("burst")).agg(F.max_by(value, time).alias(value), F.max(time).alias("at"), F.count("*").alias("n"))
    return out.select(key, F.col("burst.start").alias("begin"), "at", value, "n")


def progress(rows: DataFrame, task: str, time: str, completed: str, total: str) -> DataFrame:
    """The last state of each task with the time it is expected to take still."""
    from heliograph.functions.scoring import remaining_time

    state = rows.groupBy(task).agg(F.min(time).alias("begin"), F.max_by(F.struct(time, completed, total), F.struct(time, completed)).alias("last")).select(task, "begin", "last.*")
    elapsed: Column = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))) / 1e6
    return state.withColumn("eta", remaining_time(elapsed, F.col(completed), F.col(total)))


class LiveView:
    """A view over growing rows under the latest of growing control rows, given out anew as a whole whenever it changes.

    ``rows`` and ``control`` are streams.  Each micro-batch is kept under
    ``target``, the control table is read anew, and its greatest row by ``order``
    decides: ``view(rows so far, control row)`` is given out if that row is another
    one than before or, where ``follows(control row)`` holds, if rows have come.
    Without a control row there is no view.  A repeated batch writes the same again.
    """

    def __init__(
        self, rows: DataFrame, control: DataFrame, order: list[str], view: Callable[[DataFrame, Row], DataFrame], target: str, follows: Callable[[Row], bool] = lambda row: True
    ) -> None:
        self.rows, self.control, self.order, self.view, self.target, self.follows = rows, control, order, view, target.rstrip("/"), follows

    def _kept(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.target}/{name}/*")

    def put(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for name in ("row", "control"):
            batch.where(F.col(name).isNotNull()).select(f"{name}.*").write.mode("overwrite").parquet(f"{self.target}/{name}s/{number}")
        latest = self._kept(spark, "controls", self.control.schema).orderBy(*(F.desc(c) for c in self.order)).limit(1).collect()
        if not latest:
            return
        chosen = latest[0]
        schema = T.StructType.fromDDL(EMITTED)
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.target}/emitted/none")
        before = self._kept(spark, "emitted", schema).where(F.col("number") < number).orderBy(F.desc("number")).first()
        text = json.dumps(chosen.asDict(recursive=True), default=str, sort_keys=True)
        new_rows = not spark.read.schema(self.rows.schema).parquet(f"{self.target}/rows/{number}").isEmpty()
        if before is not None and before["control"] == text and not (new_rows and self.follows(chosen)):
            return
        self.view(self._kept(spark, "rows", self.rows.schema), chosen).write.mode("overwrite").parquet(f"{self.target}/views/{number}")
        # readers go by this row, which is written last
        spark.createDataFrame([(number, text)], schema).write.mode("overwrite").parquet(f"{self.target}/emitted/{number}")

    def start(self, checkpoint: str):
        """Everything that is there now; each call goes on where the last one ended."""
        tagged = lambda df, name: df.select(*(F.struct(*df.columns).alias(name) if n == name else F.lit(None).cast(of.schema).alias(n) for n, of in (("row", self.rows), ("control", self.control))))  # noqa: E731, E501
        both = tagged(self.rows, "row").unionByName(tagged(self.control, "control"))
        return both.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def emitted(self, spark: SparkSession) -> list[tuple[int, str]]:
        """The numbers of the micro-batches that gave out a view, and their control rows."""
        return [tuple(r) for r in self._kept(spark, "emitted", T.StructType.fromDDL(EMITTED)).orderBy("number").collect()]

    def current(self, spark: SparkSession) -> DataFrame:
        """The view that was given out last."""
        return spark.read.parquet(f"{self.target}/views/{self.emitted(spark)[-1][0]}")


EMITTED = "number long, control string"


#: The state store that keeps timers.
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Within, streams that are started keep their state in a store with timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything that is there now, through the stream: each batch is written to the shared folder; what is read back is the last one (``complete``) or all of them."""
    spark = stream.sparkSession
    target, batches = shared_path(spark, "stream"), []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{number}")
        batches.append(f"{target}/{number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", shared_path(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    paths = dict.fromkeys(batches[-1:] if mode == "complete" else batches)
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def upsert_batches(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str):
    """Each micro-batch put by key into a Parquet snapshot ``target/<batch>``; the last one is whole."""
    from heliograph.operators.catalog import latest, upserted

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a batch without the snapshot before it would lose all earlier rows: reading a missing one is an error
        existing = spark.read.schema(batch.schema).parquet(f"{target}/{number - 1}") if number else None
        snapshot = latest(batch, keys, order) if existing is None else upserted(existing, batch, keys, order)
        snapshot.write.mode("overwrite").parquet(f"{target}/{number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
