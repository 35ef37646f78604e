"""Tiles with margins, geometry by each image's size, development and masks against plain arrays."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions.colour import LUMA
from heliograph.operators import imaging, masks, raw, scopes, tiles
from heliograph.sources import tables


def table(spark, *images):
    """Images, arrays of height, width and 3, as pixels; NaN pixels are left out."""
    rows = [(k, y, x, *(float(v) for v in image[y, x])) for k, image in enumerate(images) for y in range(image.shape[0]) for x in range(image.shape[1]) if not np.isnan(image[y, x]).any()]
    return spark.createDataFrame(rows, tables.PIXELS)


def arrays(df, n=1):
    rows = df.collect()
    assert len({(r["image_id"], r["y"], r["x"]) for r in rows}) == len(rows)
    out = []
    for k in range(n):
        own = [r for r in rows if r["image_id"] == k]
        image = np.full((max((r["y"] for r in own), default=-1) + 1, max((r["x"] for r in own), default=-1) + 1, 3), np.nan)
        for r in own:
            image[r["y"], r["x"]] = [np.nan if r[c] is None else r[c] for c in "rgb"]
        out.append(image)
    return out


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    holes = rng.random((9, 13, 3))
    holes[2, 3] = holes[0, 0] = np.nan
    return [rng.random((17, 11, 3)) * 1.4, holes, rng.random((1, 1, 3)), rng.random((3, 40, 3))]


@pytest.fixture(scope="module")
def pixels(spark, images):
    return table(spark, *images).cache()


STEPS = [
    [tiles.clarity_step(0.4, 2), tiles.sharpen_step(0.3, 0.0)],
    [tiles.local_tone_step(0.6, 0.4, 0.2, 3)],
    [tiles.laplacian_step(None, "laplacian")],
    [tiles.halation_step(0.3, 0.6, 1.2, (1.0, 0.3, 0.1), 0.5), tiles.sharpen_step(0.2, 0.01)],
]


@pytest.mark.parametrize("steps", STEPS)
def test_tiles_change_nothing(pixels, steps):
    key = lambda r: (r["image_id"], r["y"], r["x"])
    whole = sorted(tiles.over_tiles(pixels, steps, side=1000).collect(), key=key)
    assert len(whole) == pixels.count()
    for side in (1, 4, 7):
        parts = sorted(tiles.over_tiles(pixels, steps, side=side).collect(), key=key)
        assert [key(r) for r in parts] == [key(r) for r in whole]
        for a, b in zip(whole, parts, strict=True):
            for x, y in zip(a[3:], b[3:], strict=True):
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9))


def test_a_chain_is_one_exchange(spark, pixels):
    chain = {"clarity": {"value": 0.4}, "sharpen": {"amount": 0.2}, "exposure": {"value": 0.3}}
    plan = imaging.develop(spark.createDataFrame(pixels.rdd, pixels.schema), chain)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "Window" not in plan


def test_a_large_image_is_spread(spark):
    wide = spark.range(600 * 900).select(F.lit(1).cast("long").alias("image_id"), (F.col("id") / 900).cast("int").alias("y"), (F.col("id") % 900).cast("int").alias("x"), *(F.lit(0.5).alias(c) for c in "rgb"))
    seen = []
    rows = tiles.over_tiles(wide, [tiles.Step(2, lambda planes, at: {**planes, "r": np.full(planes["r"].shape, planes["r"].size, dtype=float)})])
    seen = {r["r"] for r in rows.select("r").distinct().collect()}
    assert max(seen) <= (tiles.SIDE + 4) ** 2  # the most that a task has seen of it
    assert rows.count() == 600 * 900


def test_box_mean_of_odd_rows(spark):
    rows = [(1, 0, 0, 0.5, 0.5, 0.5), (1, 0, 1, None, 0.1, 0.1), (1, None, 0, 0.1, 0.1, 0.1), (1, 0, 2, 0.9, 0.9, 0.9), (1, 0, 2, 0.9, 0.9, 0.9)]
    df = spark.createDataFrame(rows, tables.PIXELS)
    found = {r["x"]: (r["r"], r["mean"]) for r in imaging.box_mean(df, F.col("r"), 1, "mean").collect()}
    assert found == {0: (0.5, 0.5), 1: (None, None), 2: (0.9, pytest.approx(0.9))}
    assert imaging.box_mean(df.limit(0), F.col("r"), 1, "mean").collect() == []


# ---- geometry


@pytest.mark.parametrize("degrees", [30.0, -75.5, 135.0])
def test_free_angles(pixels, images, degrees):
    for k, turned in enumerate(arrays(imaging.rotate(pixels.where("image_id <> 1"), degrees), 4)):
        if k == 1:
            continue
        image = images[k]
        h, w = image.shape[:2]
        cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        corners = [(x * cos - y * sin, x * sin + y * cos) for x in (-w / 2, w / 2) for y in (-h / 2, h / 2)]
        rw, rh = (max(1, math.ceil(round(max(c[i] for c in corners) - min(c[i] for c in corners), 9))) for i in (0, 1))
        assert turned.shape[:2] == (rh, rw)
        for ty in range(rh):
            for tx in range(rw):
                dx, dy = tx - rw / 2, ty - rh / 2
                sx, sy = (max(0.0, min(v, n - 1.001)) for v, n in ((dx * cos + dy * sin + w / 2, w), (-dx * sin + dy * cos + h / 2, h)))
                x0, y0 = int(sx), int(sy)
                x1, y1, fx, fy = min(w - 1, x0 + 1), min(h - 1, y0 + 1), sx - x0, sy - y0
                want = image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x1] * fx * (1 - fy) + image[y1, x0] * (1 - fx) * fy + image[y1, x1] * fx * fy
                assert turned[ty, tx] == pytest.approx(want, abs=1e-6)


def test_angles_near_quarter_turns(pixels, images):
    for degrees, k in ((0.4, 0), (90.3, 1), (-90.0, 3), (179.6, 2), (450.0, 1)):
        found = arrays(imaging.rotate(pixels, degrees), 4)
        assert np.allclose(found[0], np.rot90(images[0], -k), equal_nan=True)
    cut = arrays(imaging.crop_rotate(pixels, 90.0, x=2, y=3, width=100, height=5), 1)[0]
    assert np.allclose(cut, np.rot90(images[0][3:8, 2:], -1))


def test_thumbnails_of_several_sizes(pixels, images):
    made = arrays(imaging.thumbnail(pixels, 10), 4)
    assert [m.shape[:2] for m in made] == [(10, 6), (7, 10), (1, 1), (1, 10)]
    assert np.allclose(made[2], images[2])
    image, scale = images[0], 10 / 17
    for y in range(10):
        for x in range(6):
            (y0, y1, wy), (x0, x1, wx) = ((min(max(math.floor(v), 0), n - 1), min(max(math.floor(v), 0) + 1, n - 1), v - math.floor(v)) for v, n in (((y + 0.5) / scale - 0.5, 17), ((x + 0.5) / scale - 0.5, 11)))
            want = (image[y0, x0] * (1 - wx) + image[y0, x1] * wx) * (1 - wy) + (image[y1, x0] * (1 - wx) + image[y1, x1] * wx) * wy
            assert made[0][y, x] == pytest.approx(want)


def test_encoder_tensors(spark, pixels, images):
    small = imaging.encoder_input(pixels, 6)
    tensors = {r["image_id"]: np.frombuffer(r["tensor"], dtype="<f4").reshape(3, 6, 6) for r in imaging.tensors(small, 6, 6).collect()}
    assert set(tensors) == {0, 1, 2, 3}
    mean, deviation = (np.array(v) for v in (imaging.MODEL_MEAN, imaging.MODEL_DEVIATION))
    assert np.allclose(tensors[2], ((images[2][0, 0] - mean) / deviation)[:, None, None], atol=1e-5)
    image = images[0]
    for y, x in ((0, 0), (5, 5), (2, 3)):
        sy, sx = (y + 0.5) * 17 / 6 - 0.5, (x + 0.5) * 11 / 6 - 0.5
        y0, x0 = max(0, int(sy)), max(0, int(sx))
        wy, wx, y1, x1 = max(0.0, sy - y0), max(0.0, sx - x0), min(16, y0 + 1), min(10, x0 + 1)
        want = image[y0, x0] * (1 - wx) * (1 - wy) + image[y0, x1] * wx * (1 - wy) + image[y1, x0] * (1 - wx) * wy + image[y1, x1] * wx * wy
        assert tensors[0][:, y, x] == pytest.approx((want - mean) / deviation, abs=1e-5)
    with pytest.raises(Exception, match="outside the tensor"):
        imaging.tensors(pixels, 6, 6).collect()
    black = imaging.tensors(spark.createDataFrame([(7, 0, 0, None, None, None)], tables.PIXELS), 1, 1).first()["tensor"]
    assert np.frombuffer(black, dtype="<f4") == pytest.approx(-mean / deviation)


# ---- development


@pytest.mark.parametrize("pattern", sorted(raw.PATTERNS))
def test_development(spark, pattern):
    rng = np.random.default_rng(5)
    mosaic = rng.random((9, 7)) * 1.5 - 0.1
    df = spark.createDataFrame([(1, y, x, float(mosaic[y, x])) for y in range(9) for x in range(7)], "image_id long, y int, x int, v double")
    v = np.maximum(mosaic, 0)
    whole = v.copy()
    for y, x in zip(*np.nonzero(v >= 1), strict=True):
        around = [v[b, a] for b in range(max(0, y - 1), min(9, y + 2)) for a in range(max(0, x - 1), min(7, x + 2)) if (b, a) != (y, x) and v[b, a] < 1]
        whole[y, x] = min(1.0, 0.5 * v[y, x] + 0.5 * np.mean(around)) if around else 1.0
    at = lambda y, x: whole[min(max(y, 0), 8), min(max(x, 0), 6)]
    want = np.zeros((9, 7, 3))
    for y in range(9):
        for x in range(7):
            cross = (at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1)) / 4
            corners = (at(y - 1, x - 1) + at(y - 1, x + 1) + at(y + 1, x - 1) + at(y + 1, x + 1)) / 4
            kind = pattern[(y % 2) * 2 + x % 2]
            want[y, x] = {"R": (at(y, x), cross, corners), "B": (corners, cross, at(y, x)), "G": ((at(y, x - 1) + at(y, x + 1)) / 2, at(y, x), (at(y - 1, x) + at(y + 1, x)) / 2)}[kind]
    want = want * np.array([2.0, 1.0, 1.5]) @ (np.array(raw.XYZ_TO_WORKING)).T
    for side in (3, 256):
        steps = [raw.linear_step(), raw.highlight_step(), raw.demosaic_step(pattern)]
        seen = tiles.over_tiles(df, steps, ("v",), ("r", "g", "b"), side=side)
        seen = raw.to_working_space(raw.white_balanced(seen, (4.0, 2.0, 3.0)))
        assert np.allclose(arrays(seen.withColumn("image_id", F.lit(0)))[0], want)
    half = raw.developed(df, pattern=pattern, multipliers=(4.0, 2.0, 3.0), resolution="half").withColumn("image_id", F.lit(0))
    assert np.allclose(arrays(half)[0], want[:8:2, :6:2])
    with pytest.raises(ValueError, match="resolution"):
        raw.developed(df, resolution="tiny")


def test_tiny_mosaics(spark):
    df = spark.createDataFrame([(0, 0, 0, 3.0)], "image_id long, y int, x int, v double")
    assert arrays(raw.developed(df, reconstruct=False))[0].shape == (1, 1, 3)
    assert arrays(raw.demosaic(df))[0].tolist() == [[[3.0, 3.0, 3.0]]]
    assert raw.developed(df, resolution="eighth").count() == 1
    assert raw.developed(df.limit(0)).collect() == []


# ---- masks


def test_strokes_over_tile_edges(spark, pixels):
    strokes = spark.createDataFrame(
        [(0, [[0.2, 0.3], [0.8, 0.6], [0.9, 0.95]], 0.2, 0.7, 0.5), (0, [[0.5, 0.5]], 0.15, None, None), (0, [[0.1]], 0.5, 1.0, 0.0), (1, [], 0.5, 1.0, 0.0), (9, [[0.5, 0.5]], 0.5, 1.0, 0.0), (3, [[0.5, 2.0]], 0.1, 1.0, 0.0)],
        "image_id long, points array<array<double>>, radius double, opacity double, feather double",
    )
    for joined in (False, True):
        key = lambda df: sorted((r["image_id"], r["y"], r["x"], r["coverage"]) for r in df.collect())
        whole = key(masks.brush(pixels, strokes, side=1000, joined=joined))
        assert len(whole) == pixels.count()
        assert key(masks.brush(pixels, strokes, side=3, joined=joined)) == whole
        cover = {(y, x): c for k, y, x, c in whole if k == 0}
        lines = [((0.2, 0.3), (0.8, 0.6)), ((0.8, 0.6), (0.9, 0.95))] if joined else [((p, q), (p, q)) for p, q in ((0.2, 0.3), (0.8, 0.6), (0.9, 0.95))]
        dabs = [(a, b, 0.2, 178 / 255, 0.5) for a, b in lines] + [((0.5, 0.5), (0.5, 0.5), 0.15, 1.0, 0.0)]
        for (y, x), found in cover.items():
            left = 1.0
            for (ax, ay), (bx, by), radius, most, soft in dabs:
                (ax, bx), (ay, by), px, py = (ax * 11, bx * 11), (ay * 17, by * 17), x + 0.5, y + 0.5
                n = (bx - ax) ** 2 + (by - ay) ** 2
                t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n)) if n else 0.0
                apart, reach = math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)), radius * 11
                if apart <= reach:
                    left *= 1 - most * (min(1.0, (reach - apart) / (reach * soft)) if soft else 1.0)
            assert found == math.floor(round((1 - left) * 255, 6))
        assert {c for k, _, _, c in whole if k != 0} == {0}


def test_shapes(spark, pixels, images):
    sized = masks.with_sizes(pixels.where("image_id = 0"))
    rows = sized.select("y", "x", masks.radial((0.5, 0.5), (0.2, 0.4), 90).alias("turned"), masks.linear((0, 0), (0, 1)).alias("down"), masks.luminance_range(0, 1, 0).alias("all"), masks.inverted(masks.hue_range(0, 360, 0.0, 0.1, 0.5)).alias("hue")).collect()
    by = {(r["y"], r["x"]): r for r in rows}
    assert by[8, 5]["turned"] > 200 and by[8, 0]["turned"] == math.floor(255 * (1 - 5 / 6.8)) and by[2, 5]["turned"] == 0  # turned by a quarter: wide, not high
    assert by[0, 0]["down"] == math.floor(255 * (1 - 0.5 / 17)) and by[16, 3]["down"] == math.floor(round(255 * 0.5 / 17, 6))
    assert {r["all"] for r in rows} == {255}
    assert all(128 <= r["hue"] <= 255 for r in rows)
    assert masks.full(2.0) == 255 and masks.full(-1) == 0 and masks.full(0.5) == 127


def test_guesses_of_a_single_pixel(spark):
    one = spark.createDataFrame([(1, 0, 0, 0.4, 0.4, 0.4)], tables.PIXELS)
    assert [masks.guessed(one, kind).first()["coverage"] for kind in ("Sky", "background", "anything")] == [102, 255, 0]
    assert masks.guessed(one.limit(0), "sky").collect() == []


# ---- statistics


def test_features_equal_a_plain_version(pixels, images):
    found = {r["image_id"]: r["features"] for r in scopes.feature_vector(pixels, samples=30).collect()}
    for k in (0, 2, 3):
        image = np.clip(images[k], 0, 1)
        h, w = image.shape[:2]
        step, own = max(1, int(math.sqrt(w * h / 30))), image @ np.array(LUMA)
        seen, light = image[::step, ::step].reshape(-1, 3), own[::step, ::step].ravel()
        shares = [np.bincount(np.minimum(7, (v * 8).astype(int)), minlength=8) / len(v) for v in (*seen.T, light)]
        laps = [4 * own[y, x] - own[y - 1, x] - own[y + 1, x] - own[y, x - 1] - own[y, x + 1] for y in range(step, h - 1, step) for x in range(step, w - 1, step)]
        want = [*np.concatenate(shares), *seen.mean(axis=0), light.mean(), light.std(), np.std(laps) if laps else 0.0, np.mean(np.abs(laps) > 0.05) if laps else 0.0]
        assert found[k] == pytest.approx(want, abs=1e-9)


def test_byte_histogram_steps_by_size(pixels):
    found = {r["image_id"]: r["n"] for r in scopes.byte_histogram(pixels, 4, 4).groupBy("image_id").agg(F.sum("n").alias("n")).collect()}
    assert found[0] == 3 * len(range(0, 17, 4)) * len(range(0, 11, 2)) and found[2] == 3 and found[3] == 3 * 3 * len(range(0, 40, 10))


def test_temperatures():
    """The locus is a fit in thousands of kelvins."""
    for kelvin, x, y in ((2856, 0.4476, 0.4074), (4000, 0.3805, 0.3768), (10000, 0.2807, 0.2884)):
        assert imaging.planckian(kelvin)[0] == pytest.approx(x, abs=2e-3)
        assert imaging.planckian(kelvin)[1] == pytest.approx(y, abs=0.03)
    assert imaging.planckian(500) == imaging.planckian(1000)
