"""Logs: places by key, Merkle roots by runs, undo worked out from the log, batch edits."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from heliograph.functions import hashing
from heliograph.operators import history

MASK = (1 << 64) - 1


def plain_root(texts):
    level = []
    for text in texts:
        high, low = hashing.HIGH_START, hashing.LOW_START
        for byte in (text or "").encode():
            low = (low ^ byte) * hashing.LOW_PRIME & MASK
            high ^= byte
            for prime in hashing.HIGH_PRIMES:
                high = (high ^ high >> 33) * prime & MASK
            high ^= high >> 33
        level.append((high, low))
    while len(level) > 1:
        level = [(a[0] ^ (b[1] + hashing.BLEND_HIGH & MASK), a[1] ^ (b[0] + hashing.BLEND_LOW & MASK)) for a, b in zip(level[::2], level[1::2], strict=False)] + level[len(level) // 2 * 2 :]
    return f"{level[0][0]:016x}{level[0][1]:016x}"


@pytest.mark.parametrize("run", [1, 4, 1 << 16])
def test_roots_equal_a_plain_tree(spark, run):
    rng = random.Random(1)
    sizes = {1: 1, 2: 2, 3: 3, 4: 5, 5: 16, 6: 17, 7: 900, None: 7}
    rows = [(k, n, rng.choice([None, "", "a", f"é{n}", "x" * 50])) for k, size in sizes.items() for n in range(size)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, n long, s string").repartition(7)
    found = {r["k"]: r["root"] for r in hashing.merkle_roots(df, "k", ["n"], F.col("s"), run).collect()}
    assert found == {k: plain_root([s for _, _, s in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]) for k in sizes}
    assert hashing.merkle_roots(df.limit(0), "k", ["n"], F.col("s")).collect() == []


def test_roots_take_three_exchanges(spark):
    df = spark.createDataFrame([(1, n, "a") for n in range(100)], "k long, n long, s string")
    plan = hashing.merkle_roots(df, "k", ["n"], F.col("s"), 4)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # and the ranges, which are written


def test_places_of_a_hot_key(spark):
    rows = [("hot", n) for n in range(3000)] + [("a", n) for n in range(5)] + [(None, n) for n in range(4)] + [("z", 0)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n long").repartition(5)
    placed = hashing.numbered_by_key(df, "k", ["n"])
    assert sorted(placed.columns) == ["k", "n", "place"]
    assert all(r["n"] == r["place"] for r in placed.collect())
    assert placed.count() == len(rows)


def walked(kinds):
    """The edits that hold after a log, by their number in it."""
    real = [n for n, kind in enumerate(kinds) if kind not in ("undo", "redo")]
    cursor = 0
    for kind in kinds:
        if kind == "undo":
            cursor = min(len(real), cursor + 1)
        elif kind == "redo":
            cursor = max(0, cursor - 1)
        elif kind != "mark":
            cursor = 0
    return [n for n in real[: len(real) - cursor] if kinds[n] != "mark"]


def test_undo_equals_a_walk(spark):
    rng = random.Random(6)
    logs = {k: [rng.choice(["edit", "undo", "undo", "redo", "mark", None] if rng.random() < 0.4 else ["undo", "redo"]) for _ in range(rng.randint(0, 25))] for k in range(150)}
    logs |= {900: ["edit"] + ["undo"] * 5 + ["redo"] * 2, 901: ["edit", "edit", "redo", "undo"], 902: ["undo", "redo"], 903: ["edit", "undo", "edit"], 904: ["mark", "undo"]}
    rows = [(k, n, kind, {f"f{n % 4}": str(n)}) for k, kinds in logs.items() for n, kind in enumerate(kinds)]
    random.Random(7).shuffle(rows)
    found = defaultdict(dict)
    for r in history.replayed(spark.createDataFrame(rows, "k long, n long, kind string, d map<string,string>"), "k", ["n"], "kind", "d").collect():
        found[r["k"]][r["field"]] = r["value"]
    for k, kinds in logs.items():
        want = {}
        for n in walked(kinds):
            want[f"f{n % 4}"] = str(n)
        assert found[k] == want, (k, kinds)


def test_batch_edits(spark):
    active = spark.createDataFrame([("a", "v1"), ("b", "v2"), ("c", "v3")], "id string, version string")
    targets = spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "id string")
    states = spark.createDataFrame([("v3", {"exposure": "1.5", "tint": "no number", "other": "9"})], "version string, state map<string,string>")
    copies = spark.createDataFrame([("a", "c"), ("b", "x"), ("x", "c")], "id string, source string")
    rows = history.batch_copied(targets, active, states, "id", "version", "state", copies, "source").collect()
    assert [(r["id"], r["version"], r["label"]) for r in rows] == [("a", "v1", "Copy from c")]  # x has no version, to copy from or to
    assert rows[0]["delta"] == {k: str(1.5 if k == "exposure" else v) for k, v in history.BATCH_DEFAULTS.items()}
    reset = history.batch_reset(targets, active, "id", "version").collect()
    assert sorted((r["id"], r["label"]) for r in reset) == [("a", "Reset"), ("b", "Reset")]
    assert reset[0]["delta"] == {k: str(v) for k, v in history.BATCH_DEFAULTS.items()}
    preset = history.batch_preset(targets, active, "id", "version", {"clarity": 7.0}, "Look").first()
    assert preset["delta"]["clarity"] == "7.0" and preset["delta"]["lutIntensity"] == "1.0" and len(preset["delta"]) == 18
