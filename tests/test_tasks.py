"""Progress of tasks: state in a stream over several triggers against windows over the whole log and a plain fold."""

from __future__ import annotations

import datetime
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliograph.streaming import live, tasks

BEGIN = datetime.datetime(2024, 1, 1)
LOG = f"{tasks.EVENTS}, number long"


def event(task, second, kind, completed=0, total=0, error=None, number=0):
    return task, BEGIN + datetime.timedelta(seconds=second), kind, completed, total, error, number


def plain(rows, idle, until=None):
    """The log task by task, event by event."""
    out, states = [], {}
    micros = lambda at: int((at - BEGIN).total_seconds() * 1_000_000)
    for task, at, kind, completed, total, error, _ in sorted(rows, key=lambda r: (r[1], r[6])):
        state, changed = states.get(task), []
        if state is not None:
            state, changed = tasks.expired(state, micros(at), idle * 1_000_000)
        states[task], more = tasks.step(state, kind, micros(at), completed, total, error)
        out += [(task, r) for r in changed + more]
    for task, state in states.items():
        if state is not None and until is not None:
            out += [(task, r) for r in tasks.expired(state, micros(until), idle * 1_000_000)[1]]
    return sorted(repr((t, BEGIN + datetime.timedelta(microseconds=r["at"]), r["status"], r["completed"], r["total"], r["progress"], r["eta_ms"], r["error"])) for t, r in out)


def found(df):
    return sorted(repr((r["task"], r["at"].replace(tzinfo=None), r["status"], r["completed"], r["total"], r["progress"], r["eta_ms"], r["error"])) for r in df.collect())


def random_log(seed, n=600):
    rng = random.Random(seed)
    second, rows = 0, []
    for k in range(n):
        second += rng.choice([0, 1, 1, 2, 15])
        rows.append(event(f"t{rng.randint(0, 5)}", second, rng.choice(["start", "update", "update", "update", "complete", "cancel", "poll", "dismiss", "odd"]), rng.randint(-1, 12), rng.choice([0, 10, 10]), rng.choice([None, "disk full"]), k))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_windows_equal_a_fold(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, LOG)
    assert found(tasks.changes(log, 20, "number")) == plain(rows, 20)
    until = max(r[1] for r in rows) + datetime.timedelta(seconds=21)
    assert found(tasks.changes(log, 20, "number", F.lit(until))) == plain(rows, 20, until)


def test_odd_logs(spark):
    log = spark.createDataFrame([], LOG)
    assert tasks.changes(log, 20).collect() == []
    rows = [event(None, 1, "start"), ("a", None, "start", 1, 1, None, 0), event("a", 1, None), ("a", BEGIN, "start", None, None, None, 0)]
    assert found(tasks.changes(spark.createDataFrame(rows, LOG), 20)) == plain([("a", BEGIN, "start", 0, 0, None, 0)], 20)


def run(spark, folder, batches, idle):
    """The changes of each trigger, the batches of rows coming one by one, and the keys that keep state at the end."""
    each, target = [], folder / "in"
    with live.timed_state(spark):
        for number, rows in enumerate(batches):
            spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(target))
            stream = tasks.streamed(spark.readStream.schema(LOG).parquet(str(target)), idle, "number")

            def put(batch, _):
                each.append(found(batch))

            query = stream.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
            kept = [p["stateOperators"][0]["numRowsTotal"] for p in (q if isinstance(q, dict) else __import__("json").loads(q.json) for q in query.recentProgress) if p["stateOperators"]]
            each.append(kept[-1] if kept else None)
            assert number < len(batches)
    return each


def test_stream_keeps_state_between_triggers(spark, tmp_path):
    batches = [
        [event("a", 0, "start", total=10), event("b", 0, "start", total=4), event("c", 1, "start", total=2), event("d", 1, "start", total=9)],
        [event("a", 10, "update", 5, 10), event("b", 11, "complete"), event("c", 12, "cancel"), event("c", 13, "poll"), event("c", 14, "poll")],
        [event("a", 20, "update", 10, 10), event("b", 21, "update", 1, 4), event("d", 25, "complete", error="disk full")],
        [event("e", 500, "start")],
    ]
    each = run(spark, tmp_path, batches, 60)
    rows = [r for part in each if isinstance(part, list) for r in part]
    everything = [e for b in batches for e in b]
    assert sorted(rows) == plain(everything, 60, BEGIN + datetime.timedelta(seconds=500))
    told = [r for r in rows if "'told'" in r]
    assert len(told) == 1 and "'c'" in told[0]
    assert {r.split(",")[0] for r in rows if "'expired'" in r} == {"('a'", "('d'"}
    assert each[-1] == 1  # only e keeps state


@pytest.mark.parametrize("seed", [7, 8])
def test_stream_equals_a_fold(spark, tmp_path, seed):
    rows = random_log(seed, 200)
    each = run(spark, tmp_path, [rows[:70], rows[70:130], rows[130:]], 20)
    got = sorted(r for part in each if isinstance(part, list) for r in part)
    until = max(r[1] for r in rows)
    assert got == plain(rows, 20, until)


def test_a_task_takes_few_calls_and_cells():
    """a cell for each event and one for all changes of a task; a new task asks its state once, writes it once and sets one timer; one that is not there writes nothing."""
    calls = []

    class Store:
        def get(self):
            calls.append("get")

        def update(self, value):
            calls.append("update")

        def registerTimer(self, at):  # noqa: N802
            calls.append("timer")

    held = tasks._Progress(20_000_000)
    held.state = held.handle = Store()
    log = [{"us": us, "kind": kind, "completed": c, "total": 10} | ({} if place is None else {"place": place}) for us, place, kind, c in [(5, 2, "update", 5), (5, 1, "start", 0), (9, None, "update", 7), (9, 3, "update", 6)]]
    frames = [pd.DataFrame({"event": [json.dumps(e) for e in part]}) for part in (log[:3], log[3:])]
    (out,) = held.handleInputRows(("a",), iter(frames), None)
    assert out.columns.tolist() == ["task", "changes"] and len(out) == 1
    assert [(r["at"], r["status"], r["completed"]) for r in json.loads(out["changes"][0])] == [(5, "active", 0), (5, "active", 5), (9, "active", 6), (9, "active", 7)]
    assert calls == ["get", "update", "timer"]
    calls.clear()
    assert list(held.handleInputRows(("b",), iter([frames[1]]), None)) == [] and calls == ["get"]


# ---- a view under the latest control row


@pytest.mark.parametrize("follows", [True, False])
def test_control_changes_between_triggers(spark, tmp_path, follows):
    schema, control_schema = "id long, size long", "at long, least long, ascending boolean"
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def view(rows, control):
        order = F.col("size").asc() if control["ascending"] else F.col("size").desc()
        return rows.where(F.col("size") >= control["least"]).orderBy(order, "id").limit(3)

    put([], schema, "rows"), put([], control_schema, "controls")
    stream = lambda schema, name: spark.readStream.schema(schema).parquet(str(tmp_path / name))

    def trigger():
        held = live.LiveView(stream(schema, "rows"), stream(control_schema, "controls"), ["at"], view, str(tmp_path / "out"), lambda row: follows)
        held.start(str(tmp_path / "state")).awaitTermination()
        return held

    put([(1, 5), (2, 9), (3, 1), (4, None)], schema, "rows")
    trigger()  # no control row yet
    put([(1, 2, False)], control_schema, "controls")
    held = trigger()
    assert sorted(tuple(r) for r in held.current(spark).collect()) == [(1, 5), (2, 9)]
    put([(5, 7)], schema, "rows")
    held = trigger()
    assert sorted(tuple(r) for r in held.current(spark).collect()) == ([(1, 5), (2, 9), (5, 7)] if follows else [(1, 5), (2, 9)])
    put([(0, 100, True)], control_schema, "controls")  # older than the latest one: nothing changes
    assert len(trigger().emitted(spark)) == (2 if follows else 1)
    put([(2, 0, True), (3, 1, True)], control_schema, "controls")
    held = trigger()
    assert sorted(tuple(r) for r in held.current(spark).collect()) == [(1, 5), (3, 1), (5, 7)]
    assert len(held.emitted(spark)) == (3 if follows else 2)


def test_imports_end_or_are_cancelled(spark):
    from heliograph.sources import imports

    at = lambda second: BEGIN + datetime.timedelta(seconds=second)
    files = [("a", 1, at(1), "x.jpg"), ("a", 2, at(2), "y.txt"), ("a", 3, at(3), "z.NEF"), ("b", 1, at(1), "p.jpg"), ("b", 2, at(5), "q.jpg"), (None, 1, at(1), "n.jpg"), ("c", 1, None, "n.jpg")]
    files = spark.createDataFrame(files, "task string, number long, at timestamp, name string")
    cancels = spark.createDataFrame([("b", at(3)), ("b", at(9)), ("a", at(50)), ("z", at(1))], "task string, at timestamp")
    good, bad, log = imports.imported(files, cancels, "/in/")
    assert sorted((r["task"], r["path"]) for r in good.collect()) == [("a", "/in/x.jpg"), ("a", "/in/z.NEF"), ("b", "/in/p.jpg")]
    assert [(r["task"], r["name"], r["error"]) for r in bad.collect()] == [("a", "y.txt", "unsupported type")]
    seen = sorted((r["task"], r["at"], r["completed"], r["status"]) for r in tasks.changes(log, 100, "place").collect())
    assert [(t, c, s) for t, _, c, s in seen if t == "a"][-2:] == [("a", 3, "active"), ("a", 3, "done")]
    assert [(c, s) for t, _, c, s in seen if t == "b"] == [(0, "active"), (1, "active"), (1, "cancelled")]


def test_seeded(spark):
    from heliograph.operators import catalog

    built_in = spark.createDataFrame([("warm", 1), ("cool", 1)], "name string, n int")
    own = spark.createDataFrame([("mine", 0)], "name string, n int")
    assert {r["name"] for r in catalog.seeded(own, built_in).collect()} == {"mine"}
    assert {r["name"] for r in catalog.seeded(own.limit(0), built_in).collect()} == {"warm", "cool"}
