"""Image operators on pixels in long form (``image_id``, ``y``, ``x``, ``r``, ``g``, ``b``).

Point operators are projections and fuse into one stage.  Neighbourhoods are
worked out over tiles with margins (:mod:`heliograph.operators.tiles`), a chain of
them in one exchange.  Geometry resamples in the tiles where the sources lie.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.functions.colour import LUMA, clamp01, luminance, to_srgb
from heliograph.operators import tiles

RGB = ("r", "g", "b")
MIDDLE_GREY = 0.18
EXPOSURE_SCALE = 17.52


def _each(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in RGB})


def _luma() -> Column:
    return luminance(*(F.col(c) for c in RGB))


def exposure(df: DataFrame, value: float) -> DataFrame:
    return _each(df, lambda v: v + value / EXPOSURE_SCALE)


def contrast(df: DataFrame, value: float) -> DataFrame:
    return _each(df, lambda v: (v - MIDDLE_GREY) * (1 + value) + MIDDLE_GREY)


def white(df: DataFrame, value: float) -> DataFrame:
    return _each(df, lambda v: v / (value if value > 1e-6 else 1.0))


def black(df: DataFrame, value: float) -> DataFrame:
    return _each(df, lambda v: v - (F.lit(1.0) - v) * value)


def shadows(df: DataFrame, value: float) -> DataFrame:
    """An offset that fades out towards half luminance."""
    t = _luma() / 0.5
    add = F.when(_luma() < 0.5, F.pow(F.cos(t * (math.pi / 2)), F.lit(2.0)) * value).otherwise(0.0)
    return df.withColumn("__add", add).transform(lambda d: _each(d, lambda v: v + F.col("__add"))).drop("__add")


def highlights(df: DataFrame, value: float) -> DataFrame:
    """An offset that grows from half luminance."""
    t = (_luma() - 0.5) / 0.5
    add = F.when(_luma() > 0.5, t * t * value).otherwise(0.0)
    return df.withColumn("__add", add).transform(lambda d: _each(d, lambda v: v + F.col("__add"))).drop("__add")


def planckian(kelvin: float) -> tuple[float, float]:
    """CIE x and y of a black body from 1000 to 40000 K."""
    u = 1e3 / min(max(kelvin, 1000.0), 40000.0)
    low, high = (-0.2661239, -0.2343580, 0.8776956, 0.179910), (-3.0258469, 2.1070379, 0.2226347, 0.240390)
    a, b, c, d = low if kelvin <= 7000 else high
    x = ((a * u + b) * u + c) * u + d
    return x, -3.0 * x * x + 2.87 * x - 0.275


def color_temp(df: DataFrame, kelvin: float | None, tint_shift: float = 0.0) -> DataFrame:
    """The inverse of each component of light of this temperature as its gain; none: as shot."""
    if kelvin is None:
        return df
    x, y = planckian(kelvin)
    y += 0.01 * tint_shift
    rows = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
    light = [a * x + b * y + c * (1 - x - y) for a, b, c in rows]
    return df.withColumns({name: F.col(name) * (1 / v if v > 1e-6 else 1.0) for name, v in zip(RGB, light, strict=True)})


def tint(df: DataFrame, value: float) -> DataFrame:
    t = 0.01 * value
    return df.withColumns({"r": F.col("r") - t / 2, "g": F.col("g") + t, "b": F.col("b") - t / 2})


def saturation(df: DataFrame, value: float) -> DataFrame:
    return df.withColumn("__l", _luma()).transform(lambda d: _each(d, lambda v: F.col("__l") + (v - F.col("__l")) * value)).drop("__l")


def vibrance(df: DataFrame, value: float) -> DataFrame:
    """Saturation, in hundredths, that is stronger where there is little."""
    low, high = F.least(*RGB), F.greatest(*RGB)
    own = F.when(high > 1e-6, (high - low) / high).otherwise(0.0)
    gain = (F.lit(1.0) - own) * (0.01 * value) + 1
    return df.withColumn("__l", _luma()).withColumn("__k", gain).transform(lambda d: _each(d, lambda v: F.col("__l") + (v - F.col("__l")) * F.col("__k"))).drop("__l", "__k")


#: The hues in degrees whose neighbourhoods are adjusted.
HLS_HUES = (0, 45, 90, 135, 180, 225, 270, 315)


def hls(df: DataFrame, profiles: list[tuple[float, float, float]], width: float = 45.0) -> DataFrame:
    """Hue, lightness and saturation moved near each of :data:`HLS_HUES` by hundredths (``d_hue, d_light, d_sat`` for each), less with distance round the circle."""
    r, g, b = (F.col(c) for c in RGB)
    high, low = F.greatest(*RGB), F.least(*RGB)
    span = high - low
    grey = span < 1e-6
    sector = F.when(high == r, (g - b) / span).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    light = (high + low) / 2
    hue = F.when(grey, 0.0).otherwise(F.pmod(sector * 60, F.lit(360.0)))
    sat = F.when(grey, 0.0).otherwise(span / (F.lit(1.0) - F.abs(light * 2 - 1) + 1e-6))

    def moved(place: int) -> Column:
        parts = []
        for center, profile in zip(HLS_HUES, profiles, strict=False):
            apart = F.abs(F.col("__h") - center)
            apart = F.when(apart > 180, F.lit(360.0) - apart).otherwise(apart)
            parts.append(F.greatest(F.lit(0.0), F.lit(1.0) - apart / width) * (profile[place] * 0.01))
        return reduce(lambda a, c: a + c, parts, F.lit(0.0))

    out = df.withColumn("__h", hue).withColumn("__l0", light).withColumn("__s0", sat)
    out = out.withColumn("__hue", F.pmod(F.col("__h") + moved(0), F.lit(360.0))).withColumn("__li", clamp01(F.col("__l0") + moved(1))).withColumn("__sa", clamp01(F.col("__s0") + moved(2)))
    chroma = (F.lit(1.0) - F.abs(F.col("__li") * 2 - 1)) * F.col("__sa")

    def component(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + F.col("__hue") / 30, F.lit(12.0))
        return F.col("__li") - chroma / 2 * F.greatest(F.lit(-1.0), F.least(F.least(k - 3, F.lit(9.0) - k), F.lit(1.0)))

    return out.withColumns({"r": component(0), "g": component(8), "b": component(4)}).drop("__h", "__l0", "__s0", "__hue", "__li", "__sa")


def monotone_tangents(points: list[tuple[float, float]]) -> list[float]:
    """Tangents of a monotone cubic through the points: mean of the neighbouring slopes, cut to a circle of radius three."""
    slopes = [(y1 - y0) / (x1 - x0) for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False)]
    tangents = [slopes[0], *((a + b) / 2 if a * b > 0 else 0.0 for a, b in zip(slopes, slopes[1:], strict=False)), slopes[-1]]
    for k, slope in enumerate(slopes):
        if slope == 0:
            tangents[k] = tangents[k + 1] = 0.0
            continue
        size = math.hypot(tangents[k] / slope, tangents[k + 1] / slope)
        if size > 3:
            tangents[k], tangents[k + 1] = 3 * tangents[k] / size, 3 * tangents[k + 1] / size
    return tangents


def curve_value(v: Column, points: list[tuple[float, float]]) -> Column:
    """The monotone cubic at ``v``; constant beyond its ends."""
    tangents = monotone_tangents(points)
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1), m0, m1 in reversed(list(zip(points, points[1:], tangents, tangents[1:], strict=False))):
        h = x1 - x0
        t = (v - x0) / h
        piece = (t * t * t * 2 - t * t * 3 + 1) * y0 + (t * t * t - t * t * 2 + t) * (h * m0) + (t * t * 3 - t * t * t * 2) * y1 + (t * t * t - t * t) * (h * m1)
        out = F.when(v < x1, piece).otherwise(out)
    return F.when(v <= points[0][0], points[0][1]).otherwise(out)


def curve(df: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """The curve on luminance; components keep their ratios."""
    ratio = F.when(_luma() > 1e-6, curve_value(_luma(), points) / _luma()).otherwise(1.0)
    return df.withColumn("__k", ratio).transform(lambda d: _each(d, lambda v: v * F.col("__k"))).drop("__k")


def color_wheel(df: DataFrame, lift: tuple[float, ...], gamma: tuple[float, ...], gain: tuple[float, ...]) -> DataFrame:
    def graded(v: Column, k: int) -> Column:
        out = v * gain[k] + (F.lit(1.0) - v) * lift[k]
        return F.when(out > 0, F.pow(out, F.lit(1.0 / gamma[k]))).otherwise(out) if gamma[k] > 0 else out

    return df.withColumns({c: graded(F.col(c), k) for k, c in enumerate(RGB)})


def cst(df: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """A colour matrix."""
    r, g, b = (F.col(c) for c in RGB)
    return df.withColumns({c: r * row[0] + g * row[1] + b * row[2] for c, row in zip(RGB, matrix, strict=True)})


def lmt(df: DataFrame, size: int, values: list[list[float]], blend: float = 1.0) -> DataFrame:
    """A three-dimensional lookup table, red fastest, between its entries by three-way linear weights.

    The table is sent to every task: ``size ** 3`` entries, 65 ** 3 (6.6 MB) at most.
    """
    if size > 65:
        raise ValueError("lookup tables have at most 65 entries a side")
    table = df.sparkSession.sparkContext.broadcast(np.asarray(values, dtype=np.float64).reshape(size, size, size, 3))
    schema = df.schema

    def look(batches):
        lut = table.value
        for batch in batches:
            rgb = batch[list(RGB)].to_numpy(dtype=float)
            at = np.clip(rgb, 0, 1) * (size - 1)
            low = np.minimum(at.astype(int), max(size - 2, 0))
            part = at - low
            out = np.zeros_like(rgb)
            for corner in range(8):
                bits = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
                weight = np.where(bits, part, 1 - part).prod(axis=1)
                i = np.minimum(low + bits, size - 1)
                out += weight[:, None] * lut[i[:, 2], i[:, 1], i[:, 0]]
            batch[list(RGB)] = rgb + (out - rgb) * blend
            yield batch

    return df.mapInPandas(look, schema)


#: Working primaries to display primaries of the ``aces`` variant.
ACES_MATRIX = ((1.0498110175, 0.0, -0.0000974845), (-0.4959030231, 1.3733130458, 0.0982400361), (0.0, 0.0, 0.9912520182))


def odt(df: DataFrame, variant: str = "open", white: float = 1.0, midpoint: float = 0.18, slope: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """Display output: ``open`` bends contrast about the midpoint, ``aces`` changes primaries; both roll off like v / (1 + v) and are sRGB-encoded."""
    positive = lambda v: F.greatest(v, F.lit(0.0))
    roll = lambda v: v / (v + 1)
    if variant == "open":
        bent = lambda v: F.pow(F.lit(2.0), F.log2(positive(v) / midpoint + 1e-6) * slope) * midpoint
        return _each(df, lambda v: to_srgb(F.pow(roll(bent(v)), F.lit(gamma)) * white))
    return _each(cst(df, [list(row) for row in ACES_MATRIX]), lambda v: to_srgb(positive(roll(positive(v)) * white)))


def raw_decode(df: DataFrame) -> DataFrame:
    """Pixels are developed already."""
    return df


def box_mean(df: DataFrame, value: Column, radius: int, name: str) -> DataFrame:
    """The pixels with the mean of a value over a square; what lies outside the image does not count, nor do null values, which have no mean."""
    step = tiles.mean_step("__v", radius, name)
    return tiles.over_tiles(df.withColumn("__v", value), [step], (*RGB, "__v"), (*RGB, name))


def clarity(df: DataFrame, value: float, radius: int = 5) -> DataFrame:
    """Components scaled so that luminance gains ``value`` times its detail, what it differs from its box mean."""
    return tiles.over_tiles(df, [tiles.clarity_step(value, radius)])


def local_tone(df: DataFrame, shadow: float, highlight: float, clarity_amount: float = 0.0, radius: int = 18) -> DataFrame:
    """Stops by the box mean of luminance: where its log2 is below 0 up to ``shadow`` are added, above 0 up to ``highlight`` taken, over four stops; and ``clarity_amount`` of the detail."""
    return tiles.over_tiles(df, [tiles.local_tone_step(shadow, highlight, clarity_amount, max(1, radius))])


def laplacian(df: DataFrame, value: Column | None = None) -> DataFrame:
    """Adds ``laplacian`` of luminance, or of a value: four neighbours less four times the pixel, null at the border."""
    if value is None:
        return tiles.over_tiles(df, [tiles.laplacian_step(None, "laplacian")])
    return tiles.over_tiles(df.withColumn("__v", value), [tiles.laplacian_step("__v", "laplacian")], (*RGB, "__v"), (*RGB, "laplacian"))


def sharpen(df: DataFrame, amount: float, threshold: float = 0.0) -> DataFrame:
    """Each component moved away from its eight neighbours, where that is by the threshold or more; the border stays."""
    return tiles.over_tiles(df, [tiles.sharpen_step(amount, threshold)])


_sizes = tiles.sizes_of


def resize(df: DataFrame, width: int, height: int, method: str = "bilinear") -> DataFrame:
    """Each image on a grid of ``height`` rows of ``width``.

    ``bilinear`` and ``bicubic`` sample at ``target * source size / target size``;
    ``area`` averages all sources under the target's footprint, those that its edges
    touch among them.  Pixels that are missing count as black.
    """
    if method == "area":
        return _area(df, width, height)
    by = BILINEAR if method == "bilinear" else BICUBIC
    return tiles.resampled(df, separable(lambda w, h: (width, height), by, lambda t, s, c, w, h: _short(t * s / c, s)))


def thumbnail(df: DataFrame, long_edge: int, sizes: DataFrame | None = None) -> DataFrame:
    """Each image made smaller, so that its longer side has ``long_edge`` pixels, each side rounded; smaller ones stay.

    Bilinear between the middles of pixels; the share of the second pixel is taken
    before its place is clamped.
    """
    scale = lambda w, h: long_edge / max(w, h)
    count = lambda size, k: max(1, math.floor(size * k + 0.5)) if k < 1 else size
    place = lambda t, s, c, w, h: (t + 0.5) / scale(w, h) - 0.5 if scale(w, h) < 1 else t * 1.0
    return tiles.resampled(df, separable(lambda w, h: (count(w, scale(w, h)), count(h, scale(w, h))), MIDDLES, place), sizes)


def encoder_input(df: DataFrame, size: int, sizes: DataFrame | None = None) -> DataFrame:
    """Each image on a square grid for a model, bilinear between the middles of pixels; places before the first pixel are the first pixel."""
    return tiles.resampled(df, separable(lambda w, h: (size, size), ENCODER, lambda t, s, c, w, h: (t + 0.5) * (s / c) - 0.5), sizes)


def _area(df: DataFrame, width: int, height: int) -> DataFrame:
    def side(target: str, source: str, size: str, n: int) -> tuple[Column, Column]:
        """The targets of a source along one side, and how many sources a target has there."""
        step, at = F.col(size) / n, F.col(source)
        first = lambda t: F.floor(t * step)
        last = lambda t: F.least(F.col(size) - 1, F.ceil((t + 1) * step))
        around = F.sequence(F.floor((at - 1) / step) - 1, F.floor(at / step) + 1)
        own = F.filter(around, lambda t: (t >= 0) & (t < n) & (at >= first(t)) & (at <= last(t)))
        return own, last(F.col(target)) - first(F.col(target)) + 1

    (rows, high), (columns, wide) = side("ty", "y", "h", height), side("tx", "x", "w", width)
    near = df.join(_sizes(df), "image_id").withColumn("ty", F.explode(rows)).withColumn("tx", F.explode(columns))
    return near.groupBy("image_id", F.col("ty").cast("int").alias("y"), F.col("tx").cast("int").alias("x")).agg(*((F.sum(c) / F.first(wide * high)).alias(c) for c in RGB))


def _short(place: np.ndarray, size: int, short_of_end: float = 1.001) -> np.ndarray:
    """A place clamped to ``short_of_end`` before the end."""
    return np.maximum(0.0, np.minimum(place, size - short_of_end))


def _cubic(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    """The bicubic kernel at a distance."""
    d = np.abs(t)
    near = d * d * d * (a + 2) - d * d * (a + 3) + 1
    return np.where(d <= 1, near, np.where(d < 2, d * d * d * a - d * d * (5 * a) + d * (8 * a) - 4 * a, 0.0))


def _linear(d: int, share: np.ndarray) -> np.ndarray:
    return share if d == 1 else 1.0 - share


#: Ways to sample along a side: steps from the first source, the first source of a place, its share, and the weight of a step.
BILINEAR = ((0, 1), np.floor, lambda v, first: v - first, _linear)
BICUBIC = ((-1, 0, 1, 2), np.floor, lambda v, first: v - first, lambda d, share: _cubic(d - share))
MIDDLES = ((0, 1), np.floor, lambda v, first: v - np.floor(v), _linear)
ENCODER = ((0, 1), np.trunc, lambda v, first: np.maximum(0.0, v - first), _linear)


def _axis(v: np.ndarray, size: int, by: tuple) -> tuple[np.ndarray, tiles.Taps]:
    """The first source of places along one side, and the taps: source and weight of each step."""
    steps, first, share, weight = by
    start = first(v)
    # the first source is clamped before the second one is found
    inside = np.clip(start, 0, size - 1)
    part = share(v, inside if by is ENCODER else start)
    return inside.astype(np.int64), [(np.clip(inside + d, 0, size - 1).astype(np.int64), weight(d, part)) for d in steps]


def separable(target: Callable[[int, int], tuple[int, int]], by: tuple, place: Callable[..., np.ndarray]) -> tiles.Sampling:
    """Rows and columns sampled on their own; ``place(target, source size, target size, w, h)`` is where a target lies in the source."""

    def taps(y: np.ndarray, x: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray, tiles.Taps, tiles.Taps]:
        wide, high = target(w, h)
        (top, down), (left, across) = _axis(place(y, h, high, w, h), h, by), _axis(place(x, w, wide, w, h), w, by)
        return top, left, down, across

    return tiles.Sampling(max(abs(d) for d in by[0]), target, taps)


def sampled(df: DataFrame, target: Callable[[int, int], tuple[int, int]], places: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Targets from the source places ``x`` and ``y`` that ``places(target y, target x, w, h)`` gives, clamped to just before the image's end, bilinear."""

    def taps(y: np.ndarray, x: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray, tiles.Taps, tiles.Taps]:
        sx, sy = places(y, x, w, h)
        (top, down), (left, across) = _axis(_short(sy, h), h, BILINEAR), _axis(_short(sx, w), w, BILINEAR)
        return top, left, down, across

    return tiles.resampled(df, tiles.Sampling(1, target, taps))


def crop(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """A rectangle of each image, from its own corner."""
    inside = df.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return inside.withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def rotate(df: DataFrame, degrees: float) -> DataFrame:
    """Clockwise.  Angles that round to quarter turns move pixels exactly; others turn about the middle, onto a grid that encloses the turned image."""
    turn = math.floor(abs(degrees) + 0.5) * (1 if degrees >= 0 else -1) % 360
    if turn % 90 == 0:
        joined = df.join(_sizes(df), "image_id")
        new = {
            0: (F.col("x"), F.col("y")), 90: (F.col("h") - 1 - F.col("y"), F.col("x")),
            180: (F.col("w") - 1 - F.col("x"), F.col("h") - 1 - F.col("y")), 270: (F.col("y"), F.col("w") - 1 - F.col("x")),
        }[turn]
        return joined.select("image_id", new[1].alias("y"), new[0].alias("x"), *RGB)
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    box = lambda w, h, a, b: max(1, math.ceil(round(w * abs(a) + h * abs(b), 9)))
    target = lambda w, h: (box(w, h, cos, sin), box(w, h, sin, cos))

    def places(y: np.ndarray, x: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
        wide, high = target(w, h)
        dx, dy = x - wide * 0.5, y - high * 0.5
        return dx * cos + dy * sin + w * 0.5, dy * cos - dx * sin + h * 0.5

    return sampled(df, target, places)


def crop_rotate(df: DataFrame, degrees: float = 0.0, x: int = 0, y: int = 0, width: int = 0, height: int = 0) -> DataFrame:
    """A rectangle of each image, clamped to it (width or height 0: up to its end), then turned."""
    whole = 2**31 - 1
    x, y = max(0, x), max(0, y)
    return rotate(crop(df, x, y, width if width > 0 else whole - x, height if height > 0 else whole - y), degrees)


def lens_calib(
    df: DataFrame, radial: tuple[float, ...], tangential: tuple[float, float] = (0.0, 0.0), center: tuple[float, float] = (0.5, 0.5), focal: float = 0.0
) -> DataFrame:
    """Lens distortion undone: sources at ``1 + k1 r2 + (k2 + k4) r4 + (k3 + k5 + k6) r6`` times their distance from the centre, with two tangential terms.

    ``center`` is a share of the size; distances are in units of ``focal`` pixels, else of the longer side.
    """
    k = [*radial, *[0.0] * 6][:6]
    p1, p2 = tangential

    def places(ty: np.ndarray, tx: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
        cx, cy, unit = w * center[0], h * center[1], focal if focal > 0 else max(w, h)
        x, y = (tx - cx) / unit, (ty - cy) / unit
        r2 = x * x + y * y
        scale = r2 * (r2 * (r2 * (k[2] + k[4] + k[5]) + (k[1] + k[3])) + k[0]) + 1
        sx = x * scale + x * y * (2 * p1) + (r2 + x * x * 2) * p2
        sy = y * scale + (r2 + y * y * 2) * p1 + x * y * (2 * p2)
        return sx * unit + cx, sy * unit + cy

    return sampled(df, lambda w, h: (w, h), places)


@lru_cache(maxsize=1)
def _generator(seed: int) -> dict:
    """What a worker has worked out of the noise of a seed: the values, and the state they end in."""
    return {"values": np.zeros(0), "state": (seed ^ 0x9E3779B9) & 0xFFFFFFFF}


def _noise(seed: int, n: int) -> np.ndarray:
    """The first ``n`` values of the generator, from -0.5 to 0.5; each state is the hash of the one before."""
    known = _generator(seed)
    if len(known["values"]) < n:
        state, more = known["state"], np.empty(n - len(known["values"]))
        for k in range(len(more)):
            state = (state * 747796405 + 2891336453) & 0xFFFFFFFF
            word = (((state >> ((state >> 28) + 4)) ^ state) * 277803737) & 0xFFFFFFFF
            state = (word >> 22) ^ word
            more[k] = state / 4294967295.0 - 0.5
        known.update(state=state, values=np.concatenate([known["values"], more]))
    return known["values"]


def film_grain(df: DataFrame, strength: float, seed: int = 0x6A09E667F3BCC909) -> DataFrame:
    """Noise added to all components alike, ``0.15 + 0.85 * (1 - luminance)`` of ``strength``.

    The noise of a pixel is the generator's value at its place in the image, row by row,
    so pixels need not be gathered by image; a worker works out as many values as the largest image has pixels.
    """
    placed = df.join(_sizes(df), "image_id")
    kept = list(df.columns)

    def grain(batches):
        for batch in batches:
            at = batch["y"].to_numpy(dtype=np.int64) * batch["w"].to_numpy(dtype=np.int64) + batch["x"].to_numpy(dtype=np.int64)
            noise = _noise(seed, int(at.max()) + 1)[at] if len(at) else np.zeros(0)
            rgb = batch[list(RGB)].to_numpy(dtype=float)
            amount = strength * (0.15 + 0.85 * (1 - rgb @ np.array(LUMA)))
            batch[list(RGB)] = rgb + (noise * amount)[:, None]
            yield batch[kept]

    return placed.select(*kept, "w").mapInPandas(grain, df.schema)


def halation(df: DataFrame, low: float, high: float, sigma: float, tint_rgb: tuple[float, float, float], strength: float, sizes: DataFrame | None = None) -> DataFrame:
    """Bright places, a ramp of luminance from ``low`` to ``high``, blurred by a separable Gaussian with clamped edges, added in one colour.

    Pixels that are missing count as dark.  ``sizes`` (``image_id``, ``w``, ``h``) is worked out of the pixels where it is not given.
    """
    return tiles.over_tiles(df, [tiles.halation_step(low, high, sigma, tint_rgb, strength)], sizes=sizes)


def gain_map(sdr: DataFrame, hdr: DataFrame) -> DataFrame:
    """``gain``: log2 of the luminance of the second image over the first's."""
    a = sdr.select("image_id", "y", "x", F.greatest(_luma(), F.lit(1e-6)).alias("__s"))
    b = hdr.select("image_id", "y", "x", F.greatest(_luma(), F.lit(1e-6)).alias("__h"))
    return a.join(b, ["image_id", "y", "x"]).select("image_id", "y", "x", F.log2(F.col("__h") / F.col("__s")).alias("gain"))


def mask(kind: str, invert: bool = False, **p: float) -> Column:
    """Coverage from 0 to 1 of a mask: ``radial`` (cx, cy, radius, feather), ``linear`` (x0, y0, x1, y1), ``luminance`` and ``hue`` (low, high, feather), ``disc`` (cx, cy, radius)."""
    x, y = F.col("x"), F.col("y")
    if kind in ("radial", "disc"):
        apart = F.sqrt((x - p["cx"]) * (x - p["cx"]) + (y - p["cy"]) * (y - p["cy"])) / p["radius"]
        soft = max(p.get("feather", 0.0), 1e-6)
        out = clamp01((F.lit(1.0) - apart) / soft + (1.0 if kind == "disc" else 0.0)) if kind == "radial" else (apart <= 1).cast("double")
    elif kind == "linear":
        dx, dy = p["x1"] - p["x0"], p["y1"] - p["y0"]
        out = clamp01(((x - p["x0"]) * dx + (y - p["y0"]) * dy) / max(dx * dx + dy * dy, 1e-9))
    else:
        value = _luma() if kind == "luminance" else F.pmod(F.degrees(F.atan2((F.col("g") - F.col("b")) * math.sqrt(3), F.col("r") * 2 - F.col("g") - F.col("b"))), F.lit(360.0))
        soft = max(p.get("feather", 0.0), 1e-6)
        out = clamp01((value - p["low"]) / soft + 1) * clamp01((F.lit(p["high"]) - value) / soft + 1)
    return F.lit(1.0) - out if invert else out


def polygon_mask(points: list[tuple[float, float]]) -> Column:
    """Whether a pixel lies in a polygon: an odd number of its edges cross the line to the right."""
    x, y, crossings = F.col("x"), F.col("y"), F.lit(0)
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]], strict=True):
        if y0 != y1:
            crosses = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (y - y0) * ((x1 - x0) / (y1 - y0)) + x0)
            crossings = crossings + crosses.cast("int")
    return F.pmod(crossings, F.lit(2)).cast("double")


def normalised_channels(df: DataFrame, mean: tuple[float, ...], deviation: tuple[float, ...]) -> DataFrame:
    """Model input: each component less its mean over its deviation."""
    return df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(RGB, mean, deviation, strict=True)})


#: Means and deviations that image models were trained with.
MODEL_MEAN, MODEL_DEVIATION = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


def tensors(df: DataFrame, width: int, height: int) -> DataFrame:
    """``image_id`` and ``tensor``: float32 in order of channel, row and column, of images of one size, as :func:`resize` or :func:`encoder_input` make them.

    Some ``tiles.RUN`` pixels of whole images are what a task holds.  Pixels that are
    missing count as black; pixels outside the size are an error.
    """
    scaled = normalised_channels(df.select("image_id", "y", "x", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in RGB)), MODEL_MEAN, MODEL_DEVIATION)
    black = [-m / s for m, s in zip(MODEL_MEAN, MODEL_DEVIATION, strict=True)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in tiles.runs(batches, ["image_id"]):
            y, x = (table.column(c).to_numpy().astype(int) for c in ("y", "x"))
            if y.min() < 0 or x.min() < 0 or y.max() >= height or x.max() >= width:
                raise ValueError("a pixel lies outside the tensor's size")
            ends = np.append(first[1:], table.num_rows)
            most = max(1, tiles.CELLS // (3 * height * width))
            for low in range(0, len(first), most):
                begin, end = first[low : low + most], ends[low : low + most]
                rows = slice(begin[0], end[-1])
                image = np.repeat(np.arange(len(begin)), end - begin)
                out = np.empty((len(begin), 3, height, width), dtype="<f4")
                out[:] = np.array(black)[:, None, None]
                for k, c in enumerate(RGB):
                    out[image, k, y[rows], x[rows]] = table.column(c).to_numpy()[rows]
                ids = table.column("image_id").take(pa.array(begin)).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, pa.array([one.tobytes() for one in out], pa.binary())], names=["image_id", "tensor"])

    packed = T.StructType([df.schema["image_id"], T.StructField("tensor", T.BinaryType())])
    return scaled.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(pack, packed)


#: Operators by script name.  ``stage`` orders them, then their place here.
REGISTRY: dict[str, tuple[int, Callable[..., DataFrame]]] = {
    "raw_decode": (0, raw_decode), "resize": (1, resize), "crop": (1, crop), "crop_rotate": (1, crop_rotate), "lens_calib": (1, lens_calib), "cst": (2, cst),
    "exposure": (3, exposure), "contrast": (3, contrast), "white": (3, white), "black": (3, black), "shadows": (3, shadows), "highlights": (3, highlights),
    "color_temp": (3, color_temp), "hs_local_tone": (3, local_tone), "curve": (4, curve), "tint": (4, tint), "saturation": (4, saturation), "vibrance": (4, vibrance),
    "hls": (4, hls), "color_wheel": (4, color_wheel), "clarity": (5, clarity), "sharpen": (5, sharpen), "lmt": (6, lmt), "odt": (6, odt),
    "film_grain": (6, film_grain), "halation": (6, halation),
}


def apply(df: DataFrame, name: str, **params: object) -> DataFrame:
    """One operator by name."""
    if name not in REGISTRY:
        raise ValueError(f"unknown operator {name}")
    return REGISTRY[name][1](df, **params)


#: Operators on neighbourhoods, as steps over tiles.
STEPS: dict[str, Callable[..., tiles.Step]] = {
    "clarity": lambda value, radius=5: tiles.clarity_step(value, radius),
    "hs_local_tone": lambda shadow, highlight, clarity_amount=0.0, radius=18: tiles.local_tone_step(shadow, highlight, clarity_amount, max(1, radius)),
    "sharpen": lambda amount, threshold=0.0: tiles.sharpen_step(amount, threshold),
    "halation": tiles.halation_step,
}


def develop(df: DataFrame, steps: dict[str, dict[str, object]]) -> DataFrame:
    """All steps in order of stage and, within one, of the registry.  Neighbourhoods that follow each other share one exchange."""
    names = list(REGISTRY)
    chain: list[tiles.Step] = []
    for name in sorted(steps, key=lambda n: (REGISTRY[n][0], names.index(n))):
        if name in STEPS:
            chain.append(STEPS[name](**steps[name]))
            continue
        df, chain = (tiles.over_tiles(df, chain) if chain else df), []
        df = apply(df, name, **steps[name])
    return tiles.over_tiles(df, chain) if chain else df
