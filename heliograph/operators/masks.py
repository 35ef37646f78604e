"""Masks as coverage from 0 to 255 for each pixel: shapes, ranges of luminance and hue, brush strokes, guesses from an image's own means.

Shapes and ranges are column expressions over pixels with their image's size
(``w``, ``h``).  Strokes are joined to pixels by tiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.colour import clamp01, luminance
from heliograph.operators.imaging import RGB
from heliograph.operators.tiles import sizes_of

#: Pixels along the side of the tiles that strokes and pixels meet by.
STROKE_SIDE = 64


def with_sizes(df: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Pixels with ``w`` and ``h`` of their image."""
    return df.join(sizes_of(df) if sizes is None else sizes.select("image_id", "w", "h"), "image_id")


def full(opacity: float) -> int:
    """Coverage of an opacity."""
    return max(0, min(255, int(max(0.0, min(1.0, opacity)) * 255)))


def inverted(coverage: Column) -> Column:
    return F.lit(255) - coverage


def _whole(value: Column, most: int) -> Column:
    """A value cut to a whole number from 0 to ``most``; what lies a millionth below a whole number counts as it."""
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.round(value, 6)))).cast("int")


def _byte(component: str) -> Column:
    return F.floor(clamp01(F.col(component)) * 255 + 0.5)


def radial(center: tuple[float, float], radius: tuple[float, float], rotation: float = 0.0, opacity: float = 1.0) -> Column:
    """Fades from the centre to the longer radius, inside a rectangle of both radii that is turned by ``rotation`` degrees.  Places are shares of the image's sides."""
    w, h = F.col("w"), F.col("h")
    dx, dy = F.col("x") + 0.5 - w * center[0], F.col("y") + 0.5 - h * center[1]
    cos, sin = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    along, beside = dx * cos + dy * sin, dy * cos - dx * sin
    reach = F.greatest(w * radius[0], h * radius[1])
    inside = (F.abs(along) <= w * radius[0]) & (F.abs(beside) <= h * radius[1]) & (reach > 0)
    return F.when(inside, _whole((F.lit(1.0) - F.sqrt(dx * dx + dy * dy) / reach) * full(opacity), 255)).otherwise(0)


def linear(start: tuple[float, float], end: tuple[float, float], opacity: float = 1.0) -> Column:
    """Fades from one place to another, full before the first, none behind the second."""
    w, h = F.col("w"), F.col("h")
    vx, vy = w * (end[0] - start[0]), h * (end[1] - start[1])
    along = ((F.col("x") + 0.5 - w * start[0]) * vx + (F.col("y") + 0.5 - h * start[1]) * vy) / F.greatest(vx * vx + vy * vy, F.lit(1e-9))
    return _whole((F.lit(1.0) - clamp01(along)) * full(opacity), 255)


def luminance_range(low: float, high: float, feather: float, opacity: float = 1.0) -> Column:
    """Luminance, as a byte, from ``low`` to ``high``; fades out over ``feather`` on both sides."""
    lum = _whole(luminance(*(_byte(c) for c in RGB)), 255)
    first, last, soft = (max(a, min(255, int(v * 255))) for v, a in ((low, 0), (high, 0), (feather, 1)))
    apart = F.when(lum < first, F.lit(first) - lum).otherwise(lum - last)
    most = full(opacity)
    return F.when(lum.between(first, last), most).when((lum >= first - soft) & (lum <= last + soft), _whole((F.lit(1.0) - apart / soft) * most, most)).otherwise(0)


def hue_and_saturation() -> tuple[Column, Column]:
    """Hue in degrees and saturation of colours as bytes."""
    r, g, b = (_byte(c) for c in RGB)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = high - low
    sector = F.when(high == r, F.pmod((g - b) / spread, F.lit(6.0))).when(high == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4)
    return F.when(spread == 0, 0.0).otherwise(sector * 60), F.when(high == 0, 0.0).otherwise(spread / high)


def hue_range(center: float, width: float, least_saturation: float, feather: float, opacity: float = 1.0) -> Column:
    """Hues around a centre, less the farther away, and at half a turn times ``feather`` beyond the range again from full to none."""
    hue, saturation = hue_and_saturation()
    width, soft, most = max(1.0, width), max(0.001, feather) * 180, full(opacity)
    apart = F.abs(hue - center)
    apart = F.when(apart > 180, F.lit(360.0) - apart).otherwise(apart)
    inside, beyond = _whole((F.lit(1.0) - apart / width) * most, most), _whole((F.lit(1.0) - (apart - width) / soft) * most, most)
    return F.when(saturation < least_saturation, 0).when(apart <= width, inside).when(apart <= width + soft, beyond).otherwise(0)


def brush(df: DataFrame, strokes: DataFrame, sizes: DataFrame | None = None, side: int | None = None, joined: bool = False) -> DataFrame:
    """``image_id``, ``y``, ``x`` and ``coverage`` of every pixel under brush strokes.

    ``strokes``: ``image_id``, ``points`` (array of arrays of two shares of the
    sides; shorter ones are left out), ``radius`` (a share of the shorter side),
    ``opacity`` and ``feather`` (the share of the radius over which a dab fades out,
    0: none).  Each point is a dab; with ``joined`` points that follow each other are
    drawn as lines.  Dabs lie over each other: what one leaves uncovered the next may
    cover.  A dab goes to the tiles that it touches and meets the pixels there.
    """
    side = side or STROKE_SIDE
    of = sizes_of(df) if sizes is None else sizes.select("image_id", "w", "h")
    good = F.filter("points", lambda p: F.size(p) >= 2)
    ends = F.transform(good, lambda p, k: F.struct(p[0].alias("ax"), p[1].alias("ay"), F.element_at(good, F.least(k + 2, F.size(good)))[0].alias("bx"), F.element_at(good, F.least(k + 2, F.size(good)))[1].alias("by")))
    lines = F.when(F.size(good) > 1, F.slice(ends, 1, F.greatest(F.size(good) - 1, F.lit(1)))).otherwise(ends) if joined else F.transform(ends, lambda e: F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), e["ax"].alias("bx"), e["ay"].alias("by")))
    dabs = strokes.join(of, "image_id").withColumn("e", F.explode(lines))
    scaled = {f"s{c}": F.col(f"e.{c}") * F.col("w" if c.endswith("x") else "h") for c in ("ax", "ay", "bx", "by")}
    dabs = dabs.withColumns({**scaled, "reach": F.col("radius") * F.least("w", "h"), "most": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("opacity", F.lit(1.0)))), "soft": F.coalesce("feather", F.lit(0.0))})

    def touched(a: str, b: str, size: str) -> Column:
        first = F.floor(F.greatest(F.lit(0.0), F.least(a, b) - F.col("reach") - 0.5) / side)
        last = F.floor(F.least(F.col(size) - 1.0, F.greatest(a, b) + F.col("reach")) / side)
        return F.filter(F.sequence(F.least(first, last), last), lambda t: t >= first)

    dabs = dabs.where(F.col("reach") > 0).withColumn("ty", F.explode(touched("say", "sby", "h"))).withColumn("tx", F.explode(touched("sax", "sbx", "w")))
    dabs = dabs.select("image_id", "ty", "tx", *scaled, "reach", "most", "soft")
    placed = df.select("image_id", "y", "x", F.floor(F.col("y") / side).alias("ty"), F.floor(F.col("x") / side).alias("tx"))
    px, py = F.col("x") + 0.5 - F.col("sax"), F.col("y") + 0.5 - F.col("say")
    vx, vy = F.col("sbx") - F.col("sax"), F.col("sby") - F.col("say")
    along = clamp01((px * vx + py * vy) / F.greatest(vx * vx + vy * vy, F.lit(1e-12)))
    apart = F.sqrt((px - along * vx) * (px - along * vx) + (py - along * vy) * (py - along * vy))
    met = placed.join(dabs, ["image_id", "ty", "tx"]).withColumn("apart", apart).where(F.col("apart") <= F.col("reach"))
    fade = F.when(F.col("soft") > 0, clamp01((F.col("reach") - F.col("apart")) / (F.col("reach") * F.col("soft")))).otherwise(1.0)
    covered = met.groupBy("image_id", "y", "x").agg((F.lit(1.0) - F.product(F.lit(1.0) - F.floor(F.col("most") * 255) / 255 * fade)).alias("__c"))
    out = df.select("image_id", "y", "x").join(covered, ["image_id", "y", "x"], "left")
    return out.select("image_id", "y", "x", _whole(F.coalesce("__c", F.lit(0.0)) * 255, 255).alias("coverage"))


def guessed(df: DataFrame, kind: str, sizes: DataFrame | None = None) -> DataFrame:
    """``image_id``, ``y``, ``x`` and ``coverage`` where no model is at hand: ``sky`` (bright and high up), ``background`` (far from the middle and flat), else a subject (in the middle and unlike the mean)."""
    return guesses(df, (kind,), sizes).drop("kind")


def guesses(df: DataFrame, kinds: tuple[str, ...], sizes: DataFrame | None = None) -> DataFrame:
    """A row for each pixel and ``kind`` of :func:`guessed`, the pixels met with their images' means once for all kinds."""
    own = luminance(*(F.col(c) for c in RGB))
    stats = df.groupBy("image_id").agg(F.avg(own).alias("mean"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    if sizes is not None:
        stats = stats.select("image_id", "mean").join(sizes.select("image_id", "w", "h"), "image_id")
    share = lambda at, size: F.when(F.col(size) > 1, F.col(at) / (F.col(size) - 1.0)).otherwise(0.0)
    ny, nx, mean = share("y", "h"), share("x", "w"), F.col("mean")
    cx, cy = F.abs(nx - 0.5) * 2, F.abs(ny - 0.5) * 2
    apart, unlike = F.sqrt(cx * cx + cy * cy), clamp01(F.abs(own - mean) / (mean + 1e-3))

    def value(kind: str) -> Column:
        if kind.lower() == "sky":
            return clamp01((own - mean) / (F.lit(1.0) - mean + 1e-3)) * 0.6 + (F.lit(1.0) - ny) * 0.4
        if kind.lower() == "background":
            return clamp01(apart) * 0.6 + (F.lit(1.0) - unlike) * 0.4
        return clamp01(F.lit(1.0) - apart) * 0.6 + unlike * 0.4

    each = F.array(*(F.struct(F.lit(kind).alias("kind"), _whole(clamp01(value(kind)) * 255, 255).alias("coverage")) for kind in kinds))
    return df.join(stats, "image_id").select("image_id", "y", "x", F.inline(each))
