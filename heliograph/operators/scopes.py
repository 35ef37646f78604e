"""Histograms, waveforms and image statistics: partial aggregation, then one shuffle of bins."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.colour import LUMA, clamp01, luminance

from .imaging import RGB, laplacian
from .tiles import sizes_of


def long_channels(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each component: ``channel`` 0 to 2 and ``v``."""
    return df.select("image_id", *keep, F.posexplode(F.array(*RGB)).alias("channel", "v"))


def bin_of(v: Column, bins: int) -> Column:
    return F.floor(clamp01(v) * (bins - 1) + 0.5).cast("int")


def histogram(df: DataFrame, bins: int = 256, step: int = 4) -> DataFrame:
    """Counts by image, channel and bin over every ``step``-th pixel of every ``step``-th row."""
    grid = df.where((F.pmod("x", F.lit(step)) == 0) & (F.pmod("y", F.lit(step)) == 0)) if step > 1 else df
    return long_channels(grid).groupBy("image_id", "channel", bin_of(F.col("v"), bins).alias("bin")).agg(F.count("*").alias("n"))


def tail_bins(bins: int) -> int:
    return max(1, min(4, bins // 64))


def clip_warning(hist: DataFrame, bins: int = 256, limit: float = 0.02) -> DataFrame:
    """For each image the shares of pixels in the lowest and highest bins, the most of any channel, and whether they warn."""
    t = tail_bins(bins)
    per = hist.groupBy("image_id", "channel").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("bin") < t, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("bin") >= bins - t, F.col("n")).otherwise(0)).alias("high")
    )
    out = per.groupBy("image_id").agg(F.max(F.col("low") / F.col("total")).alias("shadow_share"), F.max(F.col("high") / F.col("total")).alias("highlight_share"))
    return out.withColumn("shadow_warning", F.col("shadow_share") >= limit).withColumn("highlight_warning", F.col("highlight_share") >= limit)


def normalised_histogram(hist: DataFrame, bins: int = 256, limit: float = 0.02) -> DataFrame:
    """Counts over the greatest count of an image; the tails that warn are not among those compared."""
    t = tail_bins(bins)
    warned = clip_warning(hist, bins, limit).select("image_id", "shadow_warning", "highlight_warning")
    rows = hist.join(warned, "image_id")
    counts = F.when((F.col("bin") < t) & F.col("shadow_warning"), 0).when((F.col("bin") >= bins - t) & F.col("highlight_warning"), 0).otherwise(F.col("n"))
    peak = rows.groupBy("image_id").agg(F.greatest(F.max(counts), F.lit(1)).alias("peak"))
    return hist.join(peak, "image_id").select("image_id", "channel", "bin", F.least(F.col("n") / F.col("peak"), F.lit(1.0)).alias("v"))


def waveform(df: DataFrame, columns: int, rows: int) -> DataFrame:
    """Counts by column of the image and level, over the greatest count of the image."""
    sizes = df.groupBy("image_id").agg((F.max("x") + 1).alias("w"))
    level = F.floor((F.lit(1.0) - clamp01(F.col("v"))) * (rows - 1)).cast("int")
    placed = long_channels(df.join(sizes, "image_id"), "x", "w")
    counts = placed.groupBy("image_id", "channel", F.floor(F.col("x") * columns / F.col("w")).cast("int").alias("col"), level.alias("row")).agg(F.count("*").alias("n"))
    peak = F.max("n").over(Window.partitionBy("image_id"))
    return counts.withColumn("v", F.col("n") / peak)


def column_means(df: DataFrame, columns: int = 128) -> DataFrame:
    sizes = df.groupBy("image_id").agg((F.max("x") + 1).alias("w"))
    col = F.floor(F.col("x") * columns / F.col("w")).cast("int")
    return df.join(sizes, "image_id").groupBy("image_id", col.alias("col")).agg(*(F.avg(c).alias(c) for c in RGB))


def luma_stats(df: DataFrame) -> DataFrame:
    """Mean and deviation of luminance, and the deviation of its Laplacian, for each image."""
    out = laplacian(df).withColumn("luma", luminance(*(F.col(c) for c in RGB)))
    return out.groupBy("image_id").agg(
        F.avg("luma").alias("mean"), F.stddev_pop("luma").alias("deviation"), F.stddev_pop("laplacian").alias("sharpness"),
        F.avg((F.abs("laplacian") > 0.05).cast("double")).alias("edge_density"), *(F.avg(c).alias(f"mean_{c}") for c in RGB),
    )


def byte_histogram(df: DataFrame, across: int = 128, down: int = 128) -> DataFrame:
    """Counts by image, channel and byte over about ``across`` columns and ``down`` rows of each image."""
    step = lambda size, most: F.greatest(F.lit(1), F.floor(F.col(size) / most))
    seen = df.join(sizes_of(df), "image_id").where((F.col("x") % step("w", across) == 0) & (F.col("y") % step("h", down) == 0))
    return long_channels(seen).groupBy("image_id", "channel", bin_of(F.col("v"), 256).alias("bin")).agg(F.count("*").alias("n"))


def feature_vector(df: DataFrame, samples: int = 10_000) -> DataFrame:
    """39 numbers for each image, over a grid of about ``samples`` of its pixels with components from 0 to 1.

    Eight bins of each component and of luminance, as shares; their four means;
    the deviations of luminance and of its Laplacian, and the share of strong edges.
    The Laplacian leaves out the border and pixels with a neighbour missing.
    """
    bins = 8
    sound = df.withColumns({c: clamp01(F.col(c)) for c in RGB})
    rows = laplacian(sound).withColumn("luma", luminance(*(F.col(c) for c in RGB))).join(sizes_of(df), "image_id")
    step = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("w") * F.col("h") / float(samples))))
    x, y = F.col("x"), F.col("y")
    seen = rows.where((x % step == 0) & (y % step == 0))
    place = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))
    shares = [F.avg((place(c) == k).cast("double")) for c in (*RGB, "luma") for k in range(bins)]
    inner = F.when((x >= step) & (y >= step) & (x < F.col("w") - 1) & (y < F.col("h") - 1), F.col("laplacian"))
    edges = F.coalesce(F.stddev_pop(inner), F.lit(0.0)), F.coalesce(F.avg((F.abs(inner) > 0.05).cast("double")), F.lit(0.0))
    return seen.groupBy("image_id").agg(F.array(*shares, *(F.avg(c) for c in (*RGB, "luma")), F.stddev_pop("luma"), *edges).alias("features"))


def caption(pixels: DataFrame) -> DataFrame:
    """``caption`` and ``tags`` of each image, by the means of its components over a grid of about 10000 of its pixels.

    Means are sums of decimals, which do not depend on the order of the pixels, and are
    compared to twelve places: a mean on a limit or equal to another one counts as that.
    """
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    step = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("w") * F.col("h") / 10000.0)))
    seen = pixels.join(sizes, "image_id").where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    means = seen.groupBy("image_id").agg(*(F.avg(clamp01(F.col(c)).cast("decimal(16,15)")).alias(c) for c in RGB))
    exact = lambda v: F.lit(Decimal(str(v)))
    bright = F.round(reduce(lambda a, c: a + c, (F.col(c) * exact(k) for c, k in zip(RGB, LUMA, strict=True))), 12)
    warmth = F.round(F.col("r") - F.col("b"), 12)
    means = means.select("image_id", bright.alias("bright"), warmth.alias("warmth"), *(F.round(c, 12).alias(c) for c in RGB))
    bright, warmth = F.col("bright"), F.col("warmth")
    light = (
        F.when(bright < exact(0.15), "A dark image").when(bright < exact(0.35), "A dim image").when(bright < exact(0.65), "A well-exposed image")
        .when(bright < exact(0.85), "A bright image").otherwise("An overexposed image")
    )
    tone = F.when(warmth > exact(0.08), "warm tones").when(warmth < exact(-0.08), "cool blue tones").otherwise("neutral tones")
    most = F.when((F.col("r") >= F.col("g")) & (F.col("r") >= F.col("b")), "red-dominant").when((F.col("g") >= F.col("r")) & (F.col("g") >= F.col("b")), "green-dominant").otherwise("blue-dominant")
    key = F.when(bright < exact(0.35), "low-key").when(bright > exact(0.65), "high-key").otherwise("mid-key")
    return means.select("image_id", F.concat(light, F.lit(" with "), tone).alias("caption"), F.array(most, key).alias("tags"))
