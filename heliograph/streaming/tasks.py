"""Progress of long-running tasks: state for each task, kept while it runs and evicted when it ends.

A log of events (``task``, ``at``, ``kind``, ``completed``, ``total``, ``error``)
becomes a log of what changed.  Kinds of events:

* ``start``: the task is there, with nothing done; a second start begins anew.
* ``update``: ``completed`` of ``total`` are done.
* ``complete``: ended; without an error the task is evicted, with one it stays until it is dismissed or times out.
* ``cancel``: the task is marked and evicted, and a flag is left for whoever works on it.
* ``poll``: asks for the flag; the answer is true once after a cancellation, then the flag is gone.
* ``dismiss``: evicted, flag and all, without a word.

A task without an event for longer than ``idle`` is evicted, and so is a flag that
nobody asked for.  Events of tasks that are not there change nothing.

:func:`changes` works it out by windows over a whole log, :func:`streamed` keeps
state between micro-batches, with a timer for each task; both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "task string, at timestamp, kind string, completed long, total long, error string"
CHANGES = "task string, at timestamp, status string, completed long, total long, progress double, eta_ms long, error string"
#: A task's changes as they come from its state, packed as JSON; times in microseconds.
_PACKED = "task string, changes string"
_UNPACKED = f"array<struct<{CHANGES.removeprefix('task string, ').replace('at timestamp', 'at long')}>>"
_STATE = "begun long, seen long, completed long, total long, progress double, error string, flag boolean"
KINDS = ("start", "update", "complete", "cancel", "poll", "dismiss")


@dataclass(frozen=True)
class Task:
    """State of a task; times in microseconds.  ``flag``: cancelled and evicted, only the flag is left."""

    begun: int
    seen: int
    completed: int
    total: int
    progress: float
    error: str | None
    flag: bool


def _row(status: str, at: int, task: Task, eta: int | None = None) -> dict[str, object]:
    return {"at": at, "status": status, "completed": task.completed, "total": task.total, "progress": task.progress, "eta_ms": eta, "error": task.error}


def remaining_ms(begun: int, at: int, completed: int, total: int) -> int | None:
    if completed <= 0 or total <= 0:
        return None
    return (at - begun) // 1000 * max(0, total - completed) // completed


def expired(task: Task, at: int, idle: int) -> tuple[Task | None, list[dict[str, object]]]:
    """The task as it is at a time: gone if that is longer than ``idle`` after its last event."""
    if at - task.seen <= idle:
        return task, []
    return None, [] if task.flag else [_row("expired", task.seen + idle, task)]


def step(task: Task | None, kind: str, at: int, completed: int, total: int, error: str | None) -> tuple[Task | None, list[dict[str, object]]]:
    """The state after an event, and what changed."""
    if kind == "start":
        new = Task(at, at, 0, total, 0.0, None, False)
        return new, [_row("active", at, new)]
    if task is None or kind not in KINDS:
        return task, []
    task = replace(task, seen=at)
    if kind == "dismiss":
        return None, []
    if kind == "poll":
        if task.flag:
            return None, [_row("told", at, task)]
        return task, []
    if task.flag:
        return task, []
    if kind == "update":
        done = min(1.0, max(0.0, completed / total)) if total > 0 else task.progress
        new = replace(task, completed=completed, total=total, progress=done)
        return new, [_row("active", at, new, remaining_ms(task.begun, at, completed, total))]
    new = replace(task, progress=1.0)
    if kind == "cancel":
        new = replace(new, error="cancelled", flag=True)
        return new, [_row("cancelled", at, new)]
    new = replace(new, completed=task.total, error=error)
    return (None, [_row("done", at, new)]) if error is None else (new, [_row("failed", at, new)])


class _Progress(StatefulProcessor):
    """The state of one task between micro-batches, its events and changes packed.  Its rows of one micro-batch are sorted in memory: the source's trigger limits bound them."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", _STATE)

    def close(self) -> None:
        pass

    def _load(self) -> Task | None:
        found = self.state.get()
        return None if found is None else Task(*found)

    def _store(self, before: Task | None, task: Task | None) -> None:
        if before is not None and (task is None or task.seen != before.seen):
            self.handle.deleteTimer((before.seen + self.idle) // 1000 + 1)
        if task is not None:
            self.state.update(tuple(getattr(task, f.name) for f in fields(task)))
            if before is None or task.seen != before.seen:
                self.handle.registerTimer((task.seen + self.idle) // 1000 + 1)
        elif before is not None:
            self.state.clear()

    @staticmethod
    def _frames(key: tuple, rows: list[dict[str, object]]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({"task": [key[0]], "changes": [json.dumps(rows)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = task = self._load()
        out: list[dict[str, object]] = []
        events = [json.loads(e) for frame in rows for e in frame["event"].tolist()]
        events.sort(key=lambda e: (e["us"], "place" not in e, e.get("place", 0)))
        for event in events:
            at = event["us"]
            if task is not None:
                task, gone = expired(task, at, self.idle)
                out += gone
            task, changed = step(task, event.get("kind"), at, event["completed"], event["total"], event.get("error"))
            out += changed
        self._store(before, task)
        return self._frames(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        task, out = self._load(), []
        if task is not None:
            after, out = expired(task, expiredTimerInfo.getExpiryTimeInMs() * 1000, self.idle)
            if after is None:
                self.state.clear()
        return self._frames(key, out)


def _prepared(events: DataFrame, *order: str) -> DataFrame:
    """The columns of :data:`EVENTS` without rows that lack a task or a time; missing numbers are 0.  ``place``: ``order``, for events of one task and time."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    rows = events.where(F.col("task").isNotNull() & F.col("at").isNotNull())
    place = F.col(order[0]).cast("long") if order else F.lit(0).cast("long")
    return rows.select(F.col("task").cast("string").alias("task"), F.col("at").cast("timestamp").alias("at"), "kind", number("completed").alias("completed"), number("total").alias("total"), F.col("error").cast("string").alias("error"), place.alias("place"))


def streamed(events: DataFrame, idle_seconds: int, order: str | None = None, late: str = "0 seconds") -> DataFrame:
    """The changes of a stream of :data:`EVENTS`, with state only of tasks that run, have failed or are to be told.

    Events of one time are taken by the column ``order``.  It must be started
    within :func:`heliograph.streaming.live.timed_state`.
    """
    rows = _prepared(events, *([order] if order else [])).withColumn("us", F.unix_micros("at"))
    # one cell for each event, and one for all changes of a task: what a stateful step costs are cells
    packed = rows.select("task", "at", F.to_json(F.struct("us", "place", "kind", "completed", "total", "error")).alias("event")).withWatermark("at", late)
    out = packed.groupBy("task").transformWithStateInPandas(statefulProcessor=_Progress(idle_seconds * 1_000_000), outputStructType=_PACKED, outputMode="Append", timeMode="EventTime")
    return out.select("task", F.inline(F.from_json("changes", _UNPACKED))).withColumn("at", F.timestamp_micros("at"))


def changes(events: DataFrame, idle_seconds: int, order: str | None = None, until: Column | None = None) -> DataFrame:
    """The same of a whole log by windows; ``until``: tasks that are idle for longer at that time expire, too (none without it).

    A stretch is what belongs to one start and has no idle gap; in it the first
    end (``complete`` without an error, ``cancel``, ``dismiss``) counts.
    """
    by = ["at", "place"]
    idle = idle_seconds * 1_000_000
    whole, life = Window.partitionBy("task").orderBy(*by), Window.partitionBy("task", "life").orderBy(*by)
    up_to, before = life.rowsBetween(Window.unboundedPreceding, Window.currentRow), life.rowsBetween(Window.unboundedPreceding, -1)
    kind, ended, total = F.col("kind"), F.col("ended"), F.col("total")
    every = _prepared(events, *([order] if order else [])).withColumn("us", F.unix_micros("at"))

    rows = every.where(kind.isin(*KINDS)).withColumn("life", F.sum((kind == "start").cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("life > 0")
    late = F.coalesce(F.col("us") - F.lag("us").over(life) > idle, F.lit(False)).cast("int")
    rows = rows.withColumn("late", late).withColumn("late", F.max("late").over(up_to)).where("late = 0").drop("late")
    end = F.when(kind == "dismiss", 3).when((kind == "complete") & F.col("error").isNull(), 1).when(kind == "cancel", 2)
    rows = rows.withColumn("end", end).withColumn("ended", F.first("end", ignorenulls=True).over(before)).withColumn("told", F.coalesce((kind == "poll") & (ended == 2), F.lit(False)))
    gone = F.max(F.when((kind == "dismiss") | F.col("told"), 1).otherwise(0)).over(before)
    alive = rows.withColumn("gone", F.coalesce(gone, F.lit(0))).where((ended.isNull() | (ended == 2)) & (F.col("gone") == 0))

    last = lambda value: F.last(value, ignorenulls=True).over(up_to)
    runs = ended.isNull()
    stops, counts = runs & kind.isin("complete", "cancel"), runs & kind.isin("start", "update")
    share = F.when(kind == "start", F.lit(0.0)).when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("completed") / total)))
    problem = F.when(runs & (kind == "cancel"), F.lit("cancelled")).when(runs & (kind == "complete"), F.col("error"))
    alive = alive.withColumns({"begun": F.first("us").over(up_to), "all": last(F.when(counts, total)), "share": last(F.when(stops, F.lit(1.0)).when(counts, share)), "problem": last(problem)})
    done = F.when(kind == "start", F.lit(0)).when(counts, F.col("completed")).when(stops & (kind == "complete"), F.col("all"))
    eta = F.when(counts & (kind == "update") & (F.col("completed") > 0) & (total > 0), F.expr("((us - begun) div 1000) * greatest(0, total - completed) div completed"))
    status = (
        F.when(F.col("told"), "told").when(~runs, None).when(counts, "active").when(kind == "cancel", "cancelled")
        .when(kind == "complete", F.when(F.col("error").isNull(), "done").otherwise("failed"))
    )
    known = alive.withColumns({"done": last(done), "eta_ms": eta, "status": status})
    columns = lambda at, status, eta, error: ("task", at.alias("at"), status.alias("status"), F.col("done").cast("long").alias("completed"), F.col("all").alias("total"), F.col("share").alias("progress"), eta.cast("long").alias("eta_ms"), error.alias("error"))  # noqa: E731, E501
    out = known.where(F.col("status").isNotNull()).select(*columns(F.col("at"), F.col("status"), F.col("eta_ms"), F.when(F.col("status") != "done", F.col("problem"))))

    # what a stretch leaves behind expires if its idle time passes before the task starts again, by a later event of the task or by the clock
    left = known.withColumn("after", F.lead("us").over(life)).where(F.col("after").isNull() & runs & F.col("end").isNull())
    limit = F.col("us") + idle
    newest = every.groupBy("task").agg(F.max("us").alias("newest"))
    starts = rows.where(kind == "start").select("task", (F.col("life") - 1).alias("life"), F.col("us").alias("again"))
    passed = F.col("newest") > limit
    if until is not None:
        passed = passed | (F.unix_micros(until.cast("timestamp")) > limit)
    left = left.join(newest, "task").join(starts, ["task", "life"], "left").where(passed & (F.col("again").isNull() | (F.col("again") > limit)))
    return out.unionByName(left.select(*columns(F.timestamp_micros(limit), F.lit("expired"), F.lit(None), F.col("problem"))))
