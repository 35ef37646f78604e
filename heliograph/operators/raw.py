"""Development of sensor mosaics: clamp, clipped highlights, colours from a Bayer pattern, white balance, working space, smaller previews."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators import imaging, tiles
from heliograph.operators.tiles import Place, Planes, Step

#: The channel of each sensor of two rows of two.
PATTERNS = {"RGGB": "rggb", "BGGR": "bggr", "GBRG": "gbrg", "GRBG": "grbg"}

#: From XYZ to the working space.
XYZ_TO_WORKING = (
    (0.6624541811, 0.1340042065, 0.1561876870),
    (0.2722287168, 0.6740817658, 0.0536895174),
    (-0.0055746495, 0.0040607335, 1.0103391003),
)
IDENTITY = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))

#: Resolutions of a decode: every so many pixels of every so many rows.
RESOLUTIONS = {"full": 1, "half": 2, "quarter": 4, "eighth": 8}


def linear_step() -> Step:
    """Sensors below 0 are 0."""
    return Step(0, lambda planes, at: {**planes, "v": np.maximum(planes["v"], 0.0)})


def highlight_step(sensor: str = "v") -> Step:
    """Clipped sensors (1 or more) go half-way to the mean of the sensors around them that are not clipped, 1 at most."""

    def work(planes: Planes, at: Place) -> Planes:
        v = planes[sensor]
        around = np.stack([tiles.shifted(v, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
        good = ~np.isnan(around) & (around < 1)
        n = good.sum(axis=0)
        mean = np.where(good, around, 0.0).sum(axis=0) / np.maximum(n, 1)
        return {**planes, sensor: np.where(v >= 1, np.minimum(1.0, np.where(n > 0, 0.5 * v + 0.5 * mean, v)), v)}

    return Step(1, work)


def demosaic_step(pattern: str = "RGGB") -> Step:
    """Bilinear colours: of four or two neighbours each; places beyond the image are its edge, missing sensors are 0.

    A green sensor takes red from its sides and blue from above and below, in all rows.
    """
    letters = PATTERNS[pattern]

    def work(planes: Planes, at: Place) -> Planes:
        v = np.nan_to_num(planes["v"])
        high, wide = v.shape[-2:]
        rows = lambda d: np.clip(np.clip(np.arange(at.y, at.y + high) + d, 0, max(0, at.h - 1)) - at.y, 0, high - 1)
        columns = lambda d: np.clip(np.clip(np.arange(at.x, at.x + wide) + d, 0, max(0, at.w - 1)) - at.x, 0, wide - 1)
        near = lambda dy, dx: v[..., rows(dy)[:, None], columns(dx)]
        sides, ends = near(0, -1) + near(0, 1), near(-1, 0) + near(1, 0)
        corners = near(-1, -1) + near(-1, 1) + near(1, -1) + near(1, 1)
        y, x = np.arange(at.y, at.y + high) & 1, np.arange(at.x, at.x + wide) & 1
        kind = np.array(list(letters)).reshape(2, 2)[np.ix_(y, x)]
        cross, diagonal = 0.25 * (sides + ends), 0.25 * corners
        return {
            "r": np.where(kind == "r", v, np.where(kind == "b", diagonal, 0.5 * sides)),
            "g": np.where(kind == "g", v, cross),
            "b": np.where(kind == "b", v, np.where(kind == "r", diagonal, 0.5 * ends)),
        }

    return Step(1, work, ("r", "g", "b"), sized=True)


def demosaic(df: DataFrame, value: str = "v", pattern: str = "RGGB", sizes: DataFrame | None = None) -> DataFrame:
    """A mosaic (``value`` at each pixel) to colours."""
    return tiles.over_tiles(df.select("image_id", "y", "x", F.col(value).alias("v")), [demosaic_step(pattern)], ("v",), imaging.RGB, sizes=sizes)


def white_balanced(df: DataFrame, multipliers: tuple[float, float, float]) -> DataFrame:
    """Components times the camera's multipliers, green's being 1."""
    green = multipliers[1] if multipliers[1] > 0 else 1.0
    return df.withColumns({c: F.col(c) * (m / green) for c, m in zip(imaging.RGB, multipliers, strict=True)})


def to_working_space(df: DataFrame, camera: tuple[tuple[float, ...], ...] = IDENTITY) -> DataFrame:
    """Camera colours to XYZ by the camera's matrix, and on to the working space."""
    return imaging.cst(df, (np.array(XYZ_TO_WORKING) @ np.array(camera)).tolist())


def soft_highlights(df: DataFrame) -> DataFrame:
    """Colours with a component of 1 or more go half-way to their mean, 1 at most."""
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    clipped = F.greatest(*imaging.RGB) >= 1
    return df.withColumns({c: F.when(clipped, F.least(F.lit(1.0), F.col(c) * 0.5 + mean * 0.5)).otherwise(F.col(c)) for c in imaging.RGB})


def decimated(df: DataFrame, factor: int, sizes: DataFrame) -> DataFrame:
    """Every ``factor``-th pixel of every ``factor``-th row; sides shrink to whole parts, 1 at least."""
    if factor == 1:
        return df
    last = lambda size: F.greatest(F.lit(1), F.floor(F.col(size) / factor))
    some = df.where((F.pmod("y", F.lit(factor)) == 0) & (F.pmod("x", F.lit(factor)) == 0)).withColumn("y", (F.col("y") / factor).cast("int")).withColumn("x", (F.col("x") / factor).cast("int"))
    limits = sizes.select("image_id", last("h").alias("__h"), last("w").alias("__w"))
    return some.join(limits, "image_id").where((F.col("y") < F.col("__h")) & (F.col("x") < F.col("__w"))).drop("__h", "__w")


def developed(
    df: DataFrame, value: str = "v", pattern: str | None = "RGGB", reconstruct: bool = True, multipliers: tuple[float, float, float] | None = None,
    camera: tuple[tuple[float, ...], ...] = IDENTITY, resolution: str = "full", sizes: DataFrame | None = None,
) -> DataFrame:
    """Pixels of a mosaic, ``value`` at each sensor, or, with ``pattern`` None, of colours that are linear already.

    The neighbourhoods (highlights, colours) are worked out in one exchange.
    """
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution}")
    sizes = tiles.sizes_of(df) if sizes is None else sizes
    if pattern is None:
        out = df.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in imaging.RGB})
        out = soft_highlights(out) if reconstruct else out
    else:
        steps = [linear_step(), *([highlight_step()] if reconstruct else []), demosaic_step(pattern)]
        out = tiles.over_tiles(df.select("image_id", "y", "x", F.col(value).alias("v")), steps, ("v",), imaging.RGB, sizes=sizes)
    out = white_balanced(out, multipliers) if multipliers else out
    return decimated(to_working_space(out, camera), RESOLUTIONS[resolution], sizes)
