"""What keeps operators right and small on larger tables: missing margins, ties, stacks of tiles, plans without moved targets."""

from __future__ import annotations

import math

import numpy as np
import pytest

from heliograph.operators import history, imaging, masks, raw, scopes, tiles
from heliograph.sources.shared import as_view

PIXELS = "image_id long, y int, x int, r double, g double, b double"


def _images(spark, n: int = 3, h: int = 11, w: int = 9, gaps: bool = True):
    rows = [(i, y, x, (7 * i + 3 * y + x) % 10 / 10, (y * x + i) % 7 / 7, (y + 2 * x) % 5 / 5) for i in range(n) for y in range(h) for x in range(w) if not (gaps and (y * 5 + x * 3 + i) % 11 == 0)]
    return spark.createDataFrame(rows, PIXELS)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _values(df):
    return {(r["image_id"], r["y"], r["x"]): tuple(round(r[c], 9) for c in "rgb") for r in df.collect()}


def test_missing_rows_above_and_beside_are_empty(spark):
    """sensors beside missing ones take 0 there, and not themselves, where a tile has no pixel in its margin."""
    rows = [(1, y, x, 0.1 * (y + x)) for y in range(2, 6) for x in range(2, 6)]
    schema = "image_id long, y int, x int, v double"
    alone = spark.createDataFrame(rows, schema)
    # a sensor far away makes the arrays larger and changes nothing beside the others
    more = spark.createDataFrame([*rows, (1, 0, 0, 0.3), (1, 9, 9, 0.3)], schema)
    sizes = spark.createDataFrame([(1, 10, 10)], "image_id long, w int, h int")
    got, want = (_values(raw.demosaic(df, sizes=sizes)) for df in (alone, more))
    assert got == {k: v for k, v in want.items() if k in got}
    assert got[(1, 2, 3)][1] == pytest.approx(0.5) and got[(1, 2, 3)][2] == pytest.approx(0.5 * 0.6)  # nothing above


def test_small_tiles_are_worked_out_as_stacks(spark):
    """tiles of one shape share a call."""
    count = tiles.Step(0, lambda planes, at: {**planes, "r": np.full(planes["r"].shape, float(np.prod(planes["r"].shape[:-2])))})
    rows = tiles.over_tiles(_images(spark, 40, 8, 8, gaps=False), [count], side=4).collect()
    assert len(rows) == 40 * 64 and max(r["r"] for r in rows) > 5


@pytest.mark.parametrize("side", [3, 4, 1000])
def test_targets_are_the_same_by_any_tiles(spark, side, monkeypatch):
    """against plain loops over targets and sources."""
    monkeypatch.setattr(tiles, "SIDE", side)
    df = _images(spark)
    pixels = {(r["image_id"], r["y"], r["x"]): r for r in df.collect()}
    size = {i: (max(k[2] for k in pixels if k[0] == i) + 1, max(k[1] for k in pixels if k[0] == i) + 1) for i in range(3)}

    def plain(target, place):
        out = {}
        for i, (w, h) in size.items():
            wide, high = target(w, h)
            for ty in range(high):
                for tx in range(wide):
                    sx, sy = place(tx, ty, w, h)
                    sx, sy = max(0, min(sx, w - 1.001)), max(0, min(sy, h - 1.001))
                    sums, found = [0.0] * 3, False
                    for dy in (0, 1):
                        for dx in (0, 1):
                            fx, fy = sx - math.floor(sx), sy - math.floor(sy)
                            k = (fx if dx else 1 - fx) * (fy if dy else 1 - fy)
                            p = pixels.get((i, min(h - 1, math.floor(sy) + dy), min(w - 1, math.floor(sx) + dx)))
                            if k and p:
                                found, sums = True, [s + k * p[c] for s, c in zip(sums, "rgb", strict=True)]
                    if found:
                        out[(i, ty, tx)] = tuple(round(s, 9) for s in sums)
        return out

    close = lambda got, want: got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)
    assert close(_values(imaging.resize(df, 5, 13)), plain(lambda w, h: (5, 13), lambda tx, ty, w, h: (tx * w / 5, ty * h / 13)))
    cos, sin = math.cos(math.radians(30)), math.sin(math.radians(30))
    box = lambda w, h: (math.ceil(round(w * cos + h * sin, 9)), math.ceil(round(w * sin + h * cos, 9)))

    def turned(tx, ty, w, h):
        dx, dy = tx - box(w, h)[0] / 2, ty - box(w, h)[1] / 2
        return dx * cos + dy * sin + w / 2, dy * cos - dx * sin + h / 2

    assert close(_values(imaging.rotate(df, 30)), plain(box, turned))


def test_targets_are_not_moved(spark):
    """only sizes and pixels go through exchanges; no target is joined or gathered."""
    df = _images(spark)
    for made in (imaging.rotate(df, 30), imaging.lens_calib(df, (0.1,)), imaging.resize(df, 4, 4, "bicubic"), imaging.thumbnail(df, 4), imaging.encoder_input(df, 4)):
        assert "Join" not in _plan(made)


def test_tensors_of_many_images_at_once(spark):
    """no call for each image; every image keeps its own pixels."""
    df = _images(spark, 30, 4, 4)
    made = imaging.tensors(df, 4, 4)
    assert "FlatMapGroups" not in _plan(made)
    pixels = {(r["image_id"], r["y"], r["x"]): r["g"] for r in df.collect()}
    found = {r["image_id"]: np.frombuffer(r["tensor"], "<f4").reshape(3, 4, 4) for r in made.collect()}
    assert len(found) == 30
    for i, tensor in found.items():
        want = [[(pixels.get((i, y, x), 0.0) - imaging.MODEL_MEAN[1]) / imaging.MODEL_DEVIATION[1] for x in range(4)] for y in range(4)]
        assert np.allclose(tensor[1], want, atol=1e-6)


def test_equal_means_do_not_depend_on_the_order(spark):
    """three pixels whose components are the same numbers in another order, and a difference right on a limit."""
    rows = [(1, 0, x, r, 0.0, b) for x, (r, b) in enumerate([(0.3, 0.1), (0.2, 0.2), (0.1, 0.3)])] + [(2, 0, 0, 0.48, 0.0, 0.4), (3, 0, 0, 0.58, 0.0, 0.5), (4, 0, 0, 0.28, 0.0, 0.2)]
    found = {r["image_id"]: r for r in scopes.caption(spark.createDataFrame(rows, PIXELS).coalesce(1)).collect()}
    assert found[1]["tags"][0] == "red-dominant"
    assert all("neutral" in found[k]["caption"] for k in (1, 2, 3, 4))


def test_ancestors_of_a_long_chain(spark):
    """more steps than a recursive statement takes, by doubling; a loop is an error."""
    versions = spark.range(1, 331).selectExpr("id", "case when id > 1 then id - 1 end as parent_id")
    other = spark.range(1000, 1200).selectExpr("id", "id + 1 as parent_id")
    found = history.ancestors(spark, as_view(versions.union(other)), 330).collect()
    assert sorted((r["step"], r["id"]) for r in found) == [(k, 330 - k) for k in range(330)]
    assert history.ancestors(spark, as_view(versions), 5000).count() == 0
    with pytest.raises(ValueError):
        history.ancestors(spark, as_view(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent_id long")), 1)


def test_guesses_meet_the_means_once(spark):
    """F8: one join for all kinds, the same as one by one."""
    df = _images(spark)
    kinds = ("sky", "background", "subject")
    found = masks.guesses(df, kinds)
    assert _plan(found).count("Join") == 1
    key = lambda r: (r["image_id"], r["y"], r["x"], r["coverage"])
    for kind in kinds:
        assert sorted(map(key, found.where(f"kind = '{kind}'").collect())) == sorted(map(key, masks.guessed(df, kind).collect()))


def test_tasks_take_bounded_parts(spark, small):
    """F8, F11: parts of the input and of exchanges have a bound of their own, well below Spark's."""
    from heliograph.plans import queries as plans

    plans.QUERIES["waveform"](spark, small)
    size = lambda name: int(spark.conf.get(name).rstrip("bmB"))
    assert size("spark.sql.files.maxPartitionBytes") == 32 and size("spark.sql.adaptive.advisoryPartitionSizeInBytes") == 16
