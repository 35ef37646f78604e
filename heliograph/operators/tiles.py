"""Neighbourhood operators over square tiles with a margin.

Each pixel goes to the tile that it lies in and to those whose margin it lies in,
one exchange by (image, tile) for a whole chain of operators, and one Arrow
function works tiles out as dense arrays: a large one alone, small ones of one
shape as a stack.  What a task holds is a tile with its margin or some ``RUN``
pixels of small ones, whatever the image's size; an image's tiles are spread over
tasks.  Resampling works the same way: a target is worked out in the tile that its
source lies in.

A cell without a pixel is NaN.  A step that looks ``n`` pixels around it needs a
margin of ``n``, a chain the sum of its steps' margins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.functions.colour import LUMA

#: Pixels along a tile's side.
SIDE = 256

#: Rows that a task takes at once, in whole tiles, and cells of a stack of tiles.
RUN, CELLS = 100_000, 2_000_000

Planes = dict[str, np.ndarray]


@dataclass(frozen=True)
class Place:
    """Where a tile's arrays lie in their image: rows and columns of the first cell, and the image's size (0: not known)."""

    y: int
    x: int
    w: int = 0
    h: int = 0


@dataclass(frozen=True)
class Step:
    """One operator on planes, whose last two axes are rows and columns; it may change planes and add others.  ``sized``: it needs the image's size."""

    margin: int
    work: Callable[[Planes, Place], Planes]
    adds: tuple[str, ...] = field(default=())
    sized: bool = False


def _around(at: Column, margin: int, side: int) -> Column:
    """Numbers of the tiles along one side that have a place inside or in their margin; none before the first."""
    first = F.floor((at - margin) / side)
    return F.transform(F.sequence(F.when(at >= 0, F.greatest(F.lit(0), first)).otherwise(first), F.floor((at + margin) / side)), lambda t: t.cast("int"))


def sizes_of(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))


def over_tiles(df: DataFrame, steps: list[Step], planes: tuple[str, ...] = ("r", "g", "b"), keep: tuple[str, ...] | None = None, side: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``image_id``, ``y``, ``x`` and the planes of every pixel after a chain of steps.

    ``planes``: double columns that the steps work on; ``keep``: those that come out
    (all, and what steps add).  Null planes are NaN inside and null again at the end.
    Of repeated pixels (the same image, row and column) one is taken.
    """
    side = side or SIDE
    margin = sum(s.margin for s in steps)
    sized = any(s.sized for s in steps)
    out = tuple(dict.fromkeys(keep if keep is not None else (*planes, *(a for s in steps for a in s.adds))))
    schema = T.StructType([df.schema["image_id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in out)])
    dealt = df.where(F.col("y").isNotNull() & F.col("x").isNotNull()).select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(F.col(c).cast("double").alias(c) for c in planes))
    dealt = dealt.withColumn("ty", F.explode(_around(F.col("y"), margin, side))).withColumn("tx", F.explode(_around(F.col("x"), margin, side)))

    keys = ["image_id", "ty", "tx"]
    if sized:
        # sizes go to the tiles by the same key, as rows without a place, so the pixels are moved once all the same
        of = sizes if sizes is not None else sizes_of(df)
        spread = lambda size: F.transform(F.sequence(F.lit(0), F.floor((F.col(size) - 1) / side)), lambda t: t.cast("int"))
        of = of.select("image_id", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h")).withColumn("ty", F.explode(spread("h"))).withColumn("tx", F.explode(spread("w")))
        dealt = dealt.unionByName(of, allowMissingColumns=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in runs(batches, keys):
            group = _groups(table, first)
            size = np.zeros((len(first), 2), dtype=np.int64)
            there = np.ones(table.num_rows, dtype=bool)
            if sized:
                there = table.column("y").is_valid().to_numpy()
                size[group[~there]] = np.stack([table.column(c).to_numpy()[~there] for c in ("w", "h")], axis=1)
            ty, tx, y, x = (_whole(table, c) for c in ("ty", "tx", "y", "x"))
            inside = there & (y // side == ty) & (x // side == tx)
            # only what lies in the margin of a pixel inside is needed, and all of that has a cell
            box = np.stack([_least(y, inside, group, len(first)) - margin, _least(x, inside, group, len(first)) - margin, -_least(-y, inside, group, len(first)) + margin, -_least(-x, inside, group, len(first)) + margin], axis=1)
            near = there & (y >= box[group, 0]) & (x >= box[group, 1]) & (y <= box[group, 2]) & (x <= box[group, 3])
            for shape, rows, slot, groups in stacks(np.concatenate([box, size], axis=1), group, near):
                y0, x0, y1, x1, w, h = (int(v) for v in shape)
                of_stack = (len(groups), y1 - y0 + 1, x1 - x0 + 1)
                cells = (slot, y[rows] - y0, x[rows] - x0)
                grids: Planes = {}
                for name in planes:
                    grids[name] = np.full(of_stack, np.nan)
                    grids[name][cells] = table.column(name).to_numpy()[rows].astype(float)
                here = np.zeros(of_stack, dtype=bool)
                here[cells] = inside[rows]
                with np.errstate(all="ignore"):
                    for step in steps:
                        grids = step.work(grids, Place(y0, x0, w, h))
                at, row, column = np.nonzero(here)
                values = [pa.array(np.broadcast_to(grids[c], of_stack)[at, row, column], from_pandas=True) for c in out]
                image = _taken(table, first[groups[at]])
                yield pa.RecordBatch.from_arrays([image, pa.array((row + y0).astype(np.int32)), pa.array((column + x0).astype(np.int32)), *values], names=schema.names)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in whole groups, about ``RUN`` rows or one larger group at a time, and the first row of each group."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, RUN
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        first = _first(table, keys)
        # the last group may go on
        last = int(first[-1])
        if last:
            yield table.slice(0, last), first[:-1]
        held, n = table.slice(last).to_batches(), n - last
        enough = max(RUN, 2 * n)
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _first(table, keys)


def _first(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in keys:
        codes = table.column(name).combine_chunks().dictionary_encode("encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _groups(table: pa.Table, first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))


def _whole(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).fill_null(0).to_numpy().astype(np.int64)


def _taken(table: pa.Table, rows: np.ndarray) -> pa.Array:
    found = table.column("image_id").take(pa.array(rows))
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _least(value: np.ndarray, which: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The least of the values that count of each group."""
    out = np.full(n, 2**31, dtype=np.int64)
    np.minimum.at(out, group[which], value[which])
    return out


def stacks(shapes: np.ndarray, group: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of one shape (``y0``, ``x0``, ``y1``, ``x1`` and more) together, up to ``CELLS`` cells: the shape, the rows that count, the place of each in the stack, the groups.  Groups without such a row are left out."""
    rows = np.flatnonzero(which)
    alive = np.unique(group[rows])
    if not len(alive):
        return
    kinds, kind = np.unique(shapes[alive], axis=0, return_inverse=True)
    order = np.argsort(kind.reshape(-1), kind="stable")
    place = np.zeros(len(shapes), dtype=np.int64)
    place[alive[order]] = np.arange(len(alive))
    rows = rows[np.argsort(place[group[rows]], kind="stable")]
    at = place[group[rows]]
    ends = np.cumsum(np.bincount(kind.reshape(-1), minlength=len(kinds)))
    for shape, begin, end in zip(kinds, [0, *ends[:-1]], ends, strict=True):
        most = max(1, CELLS // int((shape[2] - shape[0] + 1) * (shape[3] - shape[1] + 1)))
        for low in range(int(begin), int(end), most):
            high = min(low + most, int(end))
            span = slice(*np.searchsorted(at, [low, high]))
            yield shape, rows[span], at[span] - low, alive[order[low:high]]


# ---- resampling

#: Sources and weights of targets along one side.
Taps = list[tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Sampling:
    """Where the targets of an image of a size come from.

    ``target(w, h)``: width and height of the target.  ``taps(y, x, w, h)``: of a
    column of target rows and a row of target columns the home row and column, and the
    taps down and across, as arrays that fit each other; all taps lie within ``margin``
    of the home, and in the image.
    """

    margin: int
    target: Callable[[int, int], tuple[int, int]]
    taps: Callable[[np.ndarray, np.ndarray, int, int], tuple[np.ndarray, np.ndarray, Taps, Taps]]


def resampled(df: DataFrame, sampling: Sampling, sizes: DataFrame | None = None, planes: tuple[str, ...] = ("r", "g", "b"), side: int | None = None) -> DataFrame:
    """``image_id``, ``y``, ``x`` and the planes of the targets of every image: weighted sums of pixels.

    Pixels that are missing and null planes count as 0; a target without any pixel has
    no row, a plane of which it has none is null.  Of repeated pixels one is taken.
    Targets are worked out in the tile of their home, in blocks of a tile's side, so
    neither targets nor their sources are moved: pixels are, once.
    """
    side = side or SIDE
    keys = ["image_id", "ty", "tx"]
    margin = sampling.margin
    schema = T.StructType([df.schema["image_id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in planes)])
    block_schema = T.StructType([df.schema["image_id"], *(T.StructField(c, T.IntegerType()) for c in ("ty", "tx", "y", "x", "w", "h"))])
    of = (sizes_of(df) if sizes is None else sizes).select("image_id", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h")).where("image_id is not null and w > 0 and h > 0")

    def targets(by: int, bx: int, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
        wide, high = sampling.target(w, h)
        return np.arange(by * side, min(high, (by + 1) * side))[:, None], np.arange(bx * side, min(wide, (bx + 1) * side))[None, :]

    def homes(by: int, bx: int, w: int, h: int) -> np.ndarray:
        """The tiles that a block's targets have their homes in."""
        y, x = targets(by, bx, w, h)
        home_y, home_x = np.broadcast_arrays(*sampling.taps(y, x, w, h)[:2])
        return np.unique(np.stack([home_y.reshape(-1) // side, home_x.reshape(-1) // side], axis=1), axis=0)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block and tile that meet."""
        for batch in batches:
            w, h = (batch.column(c).to_numpy() for c in ("w", "h"))
            for shape in np.unique(np.stack([w, h], axis=1), axis=0):
                wide, high = sampling.target(int(shape[0]), int(shape[1]))
                images = batch.column("image_id").filter(pa.array((w == shape[0]) & (h == shape[1])))
                for by in range(-(-high // side)):
                    for bx in range(-(-wide // side)):
                        for tile in [(0, 0)] if max(shape) <= side else homes(by, bx, int(shape[0]), int(shape[1])):
                            yield pa.RecordBatch.from_arrays([images, *(pa.array(np.full(len(images), v, dtype=np.int32)) for v in (*tile, by, bx, *shape))], names=block_schema.names)

    dealt = df.where("image_id is not null and y is not null and x is not null").select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(F.col(c).cast("double").alias(c) for c in planes))
    dealt = dealt.withColumn("ty", F.explode(_around(F.col("y"), margin, side))).withColumn("tx", F.explode(_around(F.col("x"), margin, side)))
    dealt = dealt.unionByName(of.mapInArrow(blocks, block_schema), allowMissingColumns=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in runs(batches, keys):
            group = _groups(table, first)
            asked = table.column("w").is_valid().to_numpy()
            ty, tx, y, x = (_whole(table, c) for c in ("ty", "tx", "y", "x"))
            # the tiles' own pixels and margins, as far as the image goes
            size = np.zeros((len(first), 2), dtype=np.int64)
            size[group[asked]] = np.stack([table.column(c).to_numpy()[asked] for c in ("w", "h")], axis=1)
            ty, tx = ty[first], tx[first]
            box = [np.maximum(0, ty * side - margin), np.maximum(0, tx * side - margin), np.minimum(size[:, 1], (ty + 1) * side + margin) - 1, np.minimum(size[:, 0], (tx + 1) * side + margin) - 1]
            shapes = np.stack([*box, size[:, 0], size[:, 1], ty, tx], axis=1)
            pixel = ~asked & (y >= box[0][group]) & (x >= box[1][group]) & (y <= box[2][group]) & (x <= box[3][group])
            for shape, rows, slot, groups in stacks(shapes, group, pixel):
                y0, x0, y1, x1, w, h, own_y, own_x = (int(v) for v in shape)
                n, high, wide = len(groups), y1 - y0 + 1, x1 - x0 + 1
                cells = (slot, (y[rows] - y0) * wide + x[rows] - x0)
                here = np.zeros((n, high * wide), dtype=bool)
                here[cells] = True
                grids = []
                for name in planes:
                    column, grid, known = table.column(name), np.zeros((n, high * wide)), here
                    valid = column.is_valid().to_numpy()[rows]
                    grid[cells] = np.where(valid, column.fill_null(0.0).to_numpy()[rows], 0.0)
                    if not valid.all():
                        known = np.zeros_like(here)
                        known[cells] = valid
                    grids.append((grid, known))
                # images of one size have the same blocks
                mine = slice(first[groups[0]], first[groups[0] + 1] if groups[0] + 1 < len(first) else table.num_rows)
                for by, bx in sorted(set(zip(y[mine][asked[mine]].tolist(), x[mine][asked[mine]].tolist(), strict=True))):
                    rows_of, columns_of = targets(by, bx, w, h)
                    home_y, home_x, down, across = sampling.taps(rows_of, columns_of, w, h)
                    shape_of = (len(rows_of), columns_of.shape[1])
                    inside = np.broadcast_to((home_y // side == own_y) & (home_x // side == own_x), shape_of)
                    spread = lambda v: np.broadcast_to(v, shape_of)[inside]  # noqa: B023, E731
                    target_y, target_x = spread(rows_of).astype(np.int32), spread(columns_of).astype(np.int32)
                    taps = [((spread(sy) - y0).astype(np.int64) * wide + (spread(sx) - x0).astype(np.int64), spread(ky) * spread(kx)) for sy, ky in down for sx, kx in across]
                    most = max(1, CELLS // max(1, len(target_y)))
                    for low in range(0, n, most):
                        part = slice(low, low + most)
                        seen = np.zeros((len(here[part]), len(target_y)), dtype=bool)
                        sums = [(np.zeros(seen.shape), seen if known is here else np.zeros_like(seen)) for _, known in grids]
                        for at, weight in taps:
                            counts = weight != 0
                            seen |= here[part][:, at] & counts
                            for (grid, known), (total, found) in zip(grids, sums, strict=True):
                                total += np.where(counts, grid[part][:, at] * weight, 0.0)
                                if known is not here:
                                    found |= known[part][:, at] & counts
                        image, target = np.nonzero(seen)
                        values = [pa.array(total[image, target], mask=None if found is seen else ~found[image, target]) for total, found in sums]
                        yield pa.RecordBatch.from_arrays([_taken(table, first[groups[part][image]]), pa.array(target_y[target]), pa.array(target_x[target]), *values], names=schema.names)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, schema)


# ---- arithmetic on planes


def luma(planes: Planes) -> np.ndarray:
    return planes["r"] * LUMA[0] + planes["g"] * LUMA[1] + planes["b"] * LUMA[2]


def shifted(plane: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The plane's value ``dy`` rows down and ``dx`` columns right of each cell; NaN outside."""
    out = np.full(plane.shape, np.nan)
    h, w = plane.shape[-2:]
    if abs(dy) < h and abs(dx) < w:
        out[..., max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = plane[..., max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def _run_sums(plane: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Sums over ``2 * radius + 1`` cells along an axis; what lies outside is 0."""
    plane = np.moveaxis(plane, axis, 0)
    n = len(plane)
    total = np.concatenate((np.zeros((1, *plane.shape[1:])), np.cumsum(plane, axis=0)))
    at = np.arange(n)
    return np.moveaxis(total[np.minimum(at + radius + 1, n)] - total[np.maximum(at - radius, 0)], 0, axis)


def square_sums(plane: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over squares, and how many cells they have.

    Rows are summed first, then columns: NaN cells do not count, nor does what a row
    holds beside one that is NaN in the column of the square's middle.
    """
    there = ~np.isnan(plane)
    both = lambda p: _run_sums(np.where(there, _run_sums(p, radius, -1), 0.0), radius, -2)
    return both(np.where(there, plane, 0.0)), both(there.astype(float))


def box_means(plane: np.ndarray, radius: int) -> np.ndarray:
    sums, counts = square_sums(plane, radius)
    return np.where(counts > 0.5, sums / np.maximum(counts, 1), np.nan)


# ---- steps


def mean_step(source: str, radius: int, name: str) -> Step:
    return Step(radius, lambda planes, at: {**planes, name: box_means(planes[source], radius)}, (name,))


def _scaled(planes: Planes, gain: np.ndarray) -> Planes:
    return {**planes, **{c: planes[c] * gain for c in "rgb"}}


def clarity_step(value: float, radius: int) -> Step:
    def work(planes: Planes, at: Place) -> Planes:
        own = luma(planes)
        return _scaled(planes, np.where(own > 1e-5, (own - box_means(own, radius)) / own * value + 1, 1.0))

    return Step(radius, work)


def local_tone_step(shadow: float, highlight: float, clarity_amount: float, radius: int) -> Step:
    def work(planes: Planes, at: Place) -> Planes:
        own = luma(planes)
        log = lambda v: np.log2(np.maximum(v, 1e-5))
        place = log(box_means(own, radius))
        share = lambda v: np.minimum(1.0, np.maximum(0.0, v) / 4)
        stops = share(-place) * shadow - share(place) * highlight + (log(own) - place) * clarity_amount
        return _scaled(planes, np.where(own > 1e-5, np.exp2(stops), 1.0))

    return Step(radius, work)


def sharpen_step(amount: float, threshold: float) -> Step:
    def work(planes: Planes, at: Place) -> Planes:
        out = dict(planes)
        for c in "rgb":
            sums, counts = square_sums(planes[c], 1)
            moved = planes[c] * 9 - sums
            out[c] = planes[c] + np.where((counts > 8.5) & (np.abs(moved) >= threshold), moved * amount, 0.0)
        return out

    return Step(1, work)


def laplacian_step(value: str | None, name: str) -> Step:
    def work(planes: Planes, at: Place) -> Planes:
        here = luma(planes) if value is None else planes[value]
        return {**planes, name: sum(shifted(here, dy, dx) for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0))) - here * 4}

    return Step(1, work, (name,))


def halation_step(low: float, high: float, sigma: float, tint_rgb: tuple[float, float, float], strength: float) -> Step:
    radius = max(1, int(3 * sigma))
    kernel = np.array([math.exp(-0.5 * r * r / (sigma * sigma)) for r in range(-radius, radius + 1)])
    kernel /= kernel.sum()

    def blurred(plane: np.ndarray, first: int, size: int) -> np.ndarray:
        """Along the last axis; places beyond the image stand for its edge."""
        n = plane.shape[-1]
        out = np.zeros(plane.shape)
        for weight, step in zip(kernel, range(-radius, radius + 1), strict=True):
            at = np.clip(np.arange(first, first + n) + step, 0, size - 1) - first
            inside = (at >= 0) & (at < n)
            out += weight * np.where(inside, plane[..., np.clip(at, 0, n - 1)], 0.0)
        return out

    def work(planes: Planes, at: Place) -> Planes:
        own = luma(planes)
        mask = np.where(np.isnan(own) | (own <= low), 0.0, np.clip((own - low) / max(1e-6, high - low), 0.0, 1.0))
        mask = np.where(np.isnan(own), 0.0, blurred(mask, at.x, at.w))
        mask = np.swapaxes(blurred(np.swapaxes(mask, -1, -2), at.y, at.h), -1, -2)
        return {**planes, **{c: planes[c] + mask * (strength * t) for c, t in zip("rgb", tint_rgb, strict=True)}}

    return Step(radius, work, sized=True)
