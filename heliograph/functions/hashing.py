"""A 128-bit content hash in two 64-bit lanes, its blend, and a Merkle root.

Spark's longs are signed, so the arithmetic modulo 2**64 runs in NumPy, a whole
Arrow batch at a time: one step for each byte position, over all rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.sources.shared import written

_U = np.uint64
#: The lanes' starts and multipliers, and what a blend adds to its right side's lanes.
HIGH_START, LOW_START = 0x9E3779B97F4A7C15, 0xCBF29CE484222325
HIGH_PRIMES, LOW_PRIME = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53), 0x100000001B3
BLEND_HIGH, BLEND_LOW = 0x85EBCA77C2B2AE63, 0x9E3779B97F4A7C15


def hash_bytes(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """High and low lane of each row: the low lane is FNV-1a, the high one mixes each byte in by shifts and multiplications."""
    n = np.array([len(r) for r in rows], dtype=np.int64)
    high, low = np.full(len(rows), HIGH_START, dtype=np.uint64), np.full(len(rows), LOW_START, dtype=np.uint64)
    flat = np.frombuffer(b"".join(rows), dtype=np.uint8).astype(np.uint64)
    start = np.cumsum(n) - n
    for k in range(int(n.max(initial=0))):
        own = np.flatnonzero(n > k)
        byte = flat[start[own] + k]
        low[own] = (low[own] ^ byte) * _U(LOW_PRIME)
        mixed = high[own] ^ byte
        for prime in HIGH_PRIMES:
            mixed = (mixed ^ mixed >> _U(33)) * _U(prime)
        high[own] = mixed ^ mixed >> _U(33)
    return high, low


def _hex(high: np.ndarray, low: np.ndarray) -> list[str]:
    return [f"{h:016x}{x:016x}" for h, x in zip(high.tolist(), low.tolist(), strict=True)]


@F.pandas_udf(T.StringType())
def hash128(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """32 hex digits, high lane first; null counts as empty."""
    for series in texts:
        yield pd.Series(_hex(*hash_bytes([(t or "").encode() for t in series])), index=series.index)


@F.pandas_udf(T.StringType())
def blend(left: pd.Series, right: pd.Series) -> pd.Series:
    """Two hashes as one: each lane of the left with the other lane of the right and a constant."""
    halves = [np.array([int(h[a : a + 16], 16) for h in side], dtype=np.uint64) for side in (left, right) for a in (0, 16)]
    high = halves[0] ^ (halves[3] + _U(BLEND_HIGH))
    low = halves[1] ^ (halves[2] + _U(BLEND_LOW))
    return pd.Series(_hex(high, low), index=left.index)


#: Leaves of a run, the aligned part of a key's leaves that one step reduces.
RUN = 1 << 16


def _reduced(starts: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The root of each segment of hashes, all segments level by level at once; of an odd level the last hash goes up as it is."""
    segment = np.cumsum(starts) - 1
    while len(high) > (segment[-1] + 1 if len(segment) else 0):
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        place = np.arange(len(segment)) - first[segment]
        left = np.flatnonzero(place % 2 == 0)
        paired = np.flatnonzero((left + 1 < len(segment)) & (segment[np.minimum(left + 1, len(segment) - 1)] == segment[left]))
        new_high, new_low, right = high[left], low[left], left[paired] + 1
        new_high[paired] ^= low[right] + _U(BLEND_HIGH)
        new_low[paired] ^= high[right] + _U(BLEND_LOW)
        segment, high, low = segment[left], new_high, new_low
    return high, low


def _changes(columns: list[pa.Array], before: list | None) -> np.ndarray:
    """Where any of some columns has another value than in the row before; null equals null."""
    out = np.zeros(len(columns[0]), dtype=bool)
    for k, column in enumerate(columns):
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(column).to_numpy(zero_copy_only=False)
        out[1:] |= ~(same | (nulls[1:] & nulls[:-1]))
        out[0] |= before is None or before[k] != column[0].as_py()
    return out


def _roots_of_sorted(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys``, ``high`` and ``low``: the root over each group's rows in ``order``.  One exchange by the keys; a task holds a batch and one group's hashes."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            table = table.combine_chunks()
            if not table.num_rows:
                continue
            starts = np.flatnonzero(_changes([table.column(k).combine_chunks() for k in keys], None))
            # the last group may go on in the next batch
            cut = int(starts[-1])
            if cut:
                yield from whole(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield from whole(rest.combine_chunks())

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        own = [table.column(k).combine_chunks() for k in keys]
        starts = _changes(own, None)
        lanes = [table.column(c).to_numpy().astype(np.int64).view(np.uint64).copy() for c in ("high", "low")]
        high, low = _reduced(starts, *lanes)
        at = pa.array(np.flatnonzero(starts))
        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in own), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], [*keys, "high", "low"])

    return df.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, "high", "low").mapInArrow(reduce_, schema)


def numbered_by_key(rows: DataFrame, key: str, order: list[str], hashed: str | None = None) -> DataFrame:
    """Rows with ``place``, from 0, in the order of their key's rows; ``hashed``: a string column that becomes ``high`` and ``low`` of its hash.

    Rows are ranged by key and order, so a key with a third of all rows is spread;
    each partition counts on its own, and what a key has in the partitions before is
    added to the rows of a partition's first key (a row for each partition on the
    driver).  The ranged rows are written once, since ranges could fall otherwise again.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c != hashed]
    fields = [*(rows.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in (("high", "low") if hashed else ())), T.StructField("__part", T.IntegerType()), T.StructField("__local", T.LongType())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(batch.schema.get_field_index(key))
            starts = _changes([own], last)
            group = np.cumsum(starts)
            first = np.concatenate(([0], np.flatnonzero(starts)))
            base = np.where(group == 0, seen, 0)
            local = np.arange(batch.num_rows) - first[group] + base
            last, seen = [own[-1].as_py()], int(local[-1]) + 1
            lanes = [pa.array(lane.view(np.int64)) for lane in hash_bytes([(t or "").encode() for t in batch.column(batch.schema.get_field_index(hashed)).to_pylist()])] if hashed else []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (*kept, "__part")]
            yield pa.RecordBatch.from_arrays([*columns[:-1], *lanes, columns[-1], pa.array(local)], [f.name for f in fields])

    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__part", F.spark_partition_id())
    placed = written(ranged.mapInArrow(count, T.StructType(fields)), "numbered-by-key")
    ends = placed.groupBy("__part").agg(F.min_by(F.struct(key), F.struct(F.col(key).isNotNull(), key)).alias("first"), F.max_by(F.struct(key, "__local"), F.struct(F.col(key).isNotNull(), key, "__local")).alias("last"))
    offsets, before = [], None
    for row in ends.orderBy("__part").collect():  # one for each partition
        first, end = row["first"][0], row["last"]
        skip = before[1] if before is not None and before[0] == first else 0
        offsets.append((row["__part"], skip, first))
        before = (end[0], end["__local"] + 1 + (skip if end[0] == first else 0))
    table = spark.createDataFrame(offsets, T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__skip", T.LongType()), T.StructField("__first", rows.schema[key].dataType)]))
    joined = placed.join(F.broadcast(table), "__part")
    place = F.col("__local") + F.when(F.col(key).eqNullSafe(F.col("__first")), F.col("__skip")).otherwise(0)
    return joined.withColumn("place", place).drop("__part", "__local", "__skip", "__first")


def merkle_roots(rows: DataFrame, key: str, order: list[str], content: Column, run: int | None = None) -> DataFrame:
    """``key`` and ``root`` over each key's rows in order; of an odd level the last hash goes up as it is.

    Leaves are hashed once and numbered (:func:`numbered_by_key`); aligned runs of
    ``run`` leaves are reduced inside tasks, then a key's runs: three exchanges
    whatever a log's length, and a long log is spread over tasks by its runs.  A null
    key is a key; null content counts as empty.
    """
    run = run or RUN
    leaves = numbered_by_key(rows.select(key, *(c for c in order if c != key), content.alias("__content")), key, order, "__content")
    runs = _roots_of_sorted(leaves.withColumn("__run", F.floor(F.col("place") / run)).select(key, "__run", "place", "high", "low"), [key, "__run"], "place")
    roots = _roots_of_sorted(runs, [key], "__run")
    hex_ = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return roots.select(key, F.concat(hex_("high"), hex_("low")).alias("root"))


@F.pandas_udf(T.StringType())
def float_checksum(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a over the float32 bytes of an array, 16 hex digits."""
    for series in vectors:
        _, low = hash_bytes([np.asarray(v if v is not None else [], dtype="<f4").tobytes() for v in series])
        yield pd.Series([f"{x:016x}" for x in low.tolist()], index=series.index)
