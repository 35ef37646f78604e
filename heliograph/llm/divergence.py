"""Operator 13, source divergence audit: how far the sources of a language lie from each other and from the language, term by term.

Each language keeps the terms that enough of its documents hold.  They are dealt
to blocks of bounded size, and each source's counts of a block are one compressed
vector.  The sources of a language sit on seats of a few sources each; the vectors
of a (language, block, seat) stay in one partition.  In round ``r`` a copy of
every seat's vectors visits the seat ``r`` places on, so after half as many rounds
as there are seats each two seats have met once; a meeting gives the values of
both directions.  In the first round a seat meets itself and the vector of its
language, and a heap for each source keeps its highest terms.  No task holds more
than two seats' vectors of one block.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.sources.shared import shared_path

from .staging import staged
from .textscan import byte_slices, text_of

#: Bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]``: letters of ASCII (A-Z lower-cased) and every byte of other characters.
TERM = np.zeros(256, dtype=bool)
TERM[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Documents of a language that must hold a term.
LEAST_DOCUMENTS = 30
#: Added to every count.
SMOOTHING = 5
#: Ranks of the ``term`` part.
MOST_TERMS = 50

#: Terms of a block at most on the average, and sources of a seat at most: what a meeting holds is two seats of dense blocks.
BLOCK_TERMS = 1 << 13
SEAT_SOURCES = 4
#: Rounds that one job takes.
ROUNDS_AT_ONCE = 8
#: Bytes of text that are counted together.
SLICE_BYTES = 1 << 21


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The row and the code of each term of a slice, and the strings of the codes."""
    inside = TERM[raw]
    letters = np.ascontiguousarray(raw[inside])
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]  # a term never crosses a row
    begins[offsets[:-1][full]] = inside[offsets[:-1][full]]
    ends[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    start = np.flatnonzero(begins)
    sizes = np.concatenate(([0], np.cumsum(np.flatnonzero(ends) + 1 - start)))
    column = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(letters))
    coded = column.dictionary_encode()
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return rows, coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text cut between terms into pieces of about ``SLICE_BYTES``."""
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + SLICE_BYTES)
        while end < len(data) and TERM[data[end]] and TERM[data[end - 1]]:
            end += 1
        yield data[begin:end]
        begin = end


def slice_counts(groups: np.ndarray, n_groups: int, text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """For each group and term of a slice: group, term, occurrences, rows that hold it."""
    slices = text_of(text, lower=True)
    if len(slices) == 1 and len(slices.data) > SLICE_BYTES:  # one very long text: what is held is its vocabulary
        found: dict[str, int] = {}
        for piece in _pieces(slices.data):
            _, names, codes = _terms(piece, np.array([0, len(piece)]))
            for name, count in zip(names.to_pylist(), np.bincount(codes, minlength=len(names)).tolist(), strict=True):
                found[name] = found.get(name, 0) + count
        counts = np.fromiter(found.values(), dtype=np.int64, count=len(found))
        return np.full(len(found), groups[0]), pa.array(list(found), pa.large_string()), counts, np.ones(len(found), dtype=np.int64)
    rows, names, codes = _terms(slices.data, slices.offsets)
    size = max(1, len(names))
    held, times = np.unique(rows * size + codes, return_counts=True)
    keys, place = np.unique(groups[held // size] * size + held % size, return_inverse=True)
    counts = np.bincount(place, weights=times, minlength=len(keys)).astype(np.int64)
    return keys // size, names.take(pa.array(keys % size)), counts, np.bincount(place, minlength=len(keys))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences and ``docs`` rows that hold it; nulls count as empty strings."""
    part = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    source = docs.select(part(lang_col).alias("lang"), part(source_col).alias("source"), docs[text_col].cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_ in byte_slices(batch, "text", SLICE_BYTES):
                lang, name = (slice_.column(c).dictionary_encode() for c in ("lang", "source"))
                both = lang.indices.to_numpy().astype(np.int64) * len(name.dictionary) + name.indices.to_numpy()
                groups, terms, n, held = slice_counts(both, len(lang.dictionary) * len(name.dictionary), slice_.column("text"))
                of = (lang.dictionary.take(pa.array(groups // max(1, len(name.dictionary)))), name.dictionary.take(pa.array(groups % max(1, len(name.dictionary)))))
                yield pa.RecordBatch.from_arrays([*of, terms.cast(pa.string()), pa.array(n, pa.int64()), pa.array(held, pa.int64())], ["lang", "source", "term", "n", "docs"])

    counted = source.mapInArrow(scan, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``1 + floor(10 ** 9 * (count + 5) / (total + 5 * terms))`` exactly: three digits at a time, so that nothing overflows below 9 * 10 ** 15 occurrences."""
    whole = total + SMOOTHING * terms
    share, rest = np.divmod(counts.astype(np.int64) + SMOOTHING, np.int64(whole))
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, np.int64(whole))
        share = share * 1000 + digit
    return share + 1


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: the gaps between its places and its counts, compressed."""
    order = np.argsort(places, kind="stable")
    return zlib.compress(np.concatenate((np.diff(places[order], prepend=0), counts[order])).astype(np.int64).tobytes(), 1)


@F.pandas_udf(T.BinaryType())
def _pack(places: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else packed(np.asarray(p, dtype=np.int64), np.asarray(n, dtype=np.int64)) for p, n in zip(places, counts, strict=True)], dtype=object)


def unpacked(vector: bytes | None, size: int) -> np.ndarray:
    """The dense counts of a vector of :func:`packed`."""
    out = np.zeros(size, dtype=np.int64)
    if vector is not None:
        both = np.frombuffer(zlib.decompress(vector), dtype=np.int64)
        half = len(both) // 2
        out[np.cumsum(both[:half])] = both[half:]
    return out


_MEETING = "lang string, source string, part string, item string, value long"


def _met(residents: pa.Table, visitors: pa.Table) -> pa.Table:
    """Values of a meeting: of each two sources in both directions, and of each resident's highest terms if the visitor is the language."""
    rows: list[tuple[str, str, str, str, int]] = []
    guests, home = visitors.to_pylist(), residents.to_pylist()

    def shares(row: dict) -> np.ndarray:
        return scaled(unpacked(row["vector"], row["size"]), row["total"], row["terms"])

    own = [shares(row) for row in home] if guests else []
    for guest in guests:
        if guest["source"] is None:  # the language itself
            q = shares(guest)
            for row, p in zip(home, own, strict=True):
                held = np.flatnonzero((unpacked(row["vector"], row["size"]) > 0) & (p > q))
                best = heapq.nsmallest(MOST_TERMS, ((-int(p[k] - q[k]), guest["names"][k]) for k in held))
                rows += [(row["lang"], row["source"], "term", name, -value) for value, name in best]
            continue
        q = shares(guest)
        for row, p in zip(home, own, strict=True):
            # within a seat each pair is met once, too
            if guest["seat"] == row["seat"] and guest["source"] <= row["source"]:
                continue
            value = int(np.abs(p - q).sum())
            rows += [(row["lang"], row["source"], "pair", guest["source"], value), (row["lang"], guest["source"], "pair", row["source"], value)]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(columns)], ["lang", "source", "part", "item", "value"])


def vectors(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sources' vectors, a row for each (lang, block, source), and the languages', with their terms' names."""
    counts = staged(term_counts(docs, lang_col, source_col, text_col), "divergence-counts")
    part = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    groups = docs.select(part(lang_col).alias("lang"), part(source_col).alias("source")).distinct()

    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")
    kept = staged(kept, "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("total"))
    sizes = groups.select("lang").distinct().join(sizes, "lang", "left").fillna(0, ["terms", "total"]).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK_TERMS)).cast("int"))
    sizes = staged(sizes, "divergence-sizes")

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    placed = kept.join(sizes.select("lang", "blocks"), "lang").withColumn("block", block)
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).select("lang", "term", "all", "block", "place")
    placed = staged(placed, "divergence-places")
    lengths = placed.groupBy("lang", "block").agg(F.count("*").cast("int").alias("size"))

    # every source has a row in every block of its language, also where it holds none of the terms
    seat = F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / SEAT_SOURCES).cast("int")
    seated = groups.withColumn("seat", seat).join(sizes, "lang")
    every = seated.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.join(lengths, ["lang", "block"], "left").fillna(0, ["size"]).select("lang", "block", "source", "seat", "terms", "size")
    own = counts.join(placed.select("lang", "term", "block", "place"), ["lang", "term"]).groupBy("lang", "block", "source")
    own = own.agg(F.collect_list(F.struct("place", "n")).alias("held"), F.sum("n").alias("part"))
    own = every.join(own, ["lang", "block", "source"], "left").withColumn("part", F.coalesce("part", F.lit(0)))

    packed_own = staged(own.withColumn("vector", _pack(F.col("held")["place"], F.col("held")["n"])).drop("held"), "divergence-vectors")
    totals = packed_own.groupBy("lang", "source").agg(F.sum("part").alias("total"))
    sources = packed_own.drop("part").join(totals, ["lang", "source"])

    held = F.array_sort(F.collect_list(F.struct("place", F.col("all").alias("n"), "term")))
    whole = placed.groupBy("lang", "block").agg(held.alias("held")).join(sizes.select("lang", "terms", "total"), "lang")
    whole = whole.select("lang", "block", "terms", "total", F.size("held").alias("size"), _pack(F.col("held")["place"], F.col("held")["n"]).alias("vector"), F.col("held")["term"].alias("names"))
    return sources.select("lang", "block", "seat", "source", "terms", "total", "size", "vector"), whole


def audited(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` for every group of a language and a source.

    Part ``pair``: each other source of the language by distance; part ``term``:
    the ``MOST_TERMS`` terms that the group holds most beyond its language.
    Arithmetic is exact.  Null languages, sources and texts count as empty
    strings; repeated rows count each; equal values are ranked by the item's
    UTF-8 bytes; a language that keeps no term has pairs of value 0; other
    columns do not matter, whatever their names; an empty table gives an empty
    result.  Runs its rounds when called and returns the rest lazily.
    """
    spark = docs.sparkSession
    sources, whole = vectors(docs, lang_col, source_col, text_col)
    sources, whole = staged(sources, "divergence-seats"), staged(whole, "divergence-languages")
    seats = sources.groupBy("lang").agg((F.max("seat") + 1).alias("seats"))
    most = sources.agg(F.max("seat")).first()[0]
    place = ("lang", "block", "seat")
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    resident = sources.repartition(parallel, *place).persist(StorageLevel.MEMORY_AND_DISK)
    path = shared_path(spark, "divergence-meetings")

    guests = sources.select(*(F.col(c).alias(c) for c in sources.columns)).join(seats, "lang")
    names = T.StructField("names", T.ArrayType(T.StringType()))

    def visiting(turn: int) -> DataFrame:
        """The vectors on their way to the seat that they visit in a round: ``at``; their own seat stays in ``seat``."""
        meets = (F.lit(turn) * 2 < F.col("seats")) | ((F.lit(turn) * 2 == F.col("seats")) & (F.col("seat") < turn)) | (F.lit(turn) == 0)
        found = guests.where(meets).withColumn("at", F.pmod(F.col("seat") + turn, F.col("seats")))
        return found.withColumn("names", F.lit(None).cast(names.dataType)).select("lang", "block", "at", "seat", "source", "terms", "total", "size", "vector", "names")

    def meeting(visitors: DataFrame) -> DataFrame:
        return resident.groupBy(*place).cogroup(visitors.groupBy("lang", "block", "at")).applyInArrow(_met, _MEETING)

    of_language = whole.join(seats, "lang").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)))
    of_language = of_language.select("lang", "block", "at", F.lit(-1).alias("seat"), F.lit(None).cast("string").alias("source"), "terms", "total", "size", "vector", "names")
    spark.createDataFrame([], _MEETING).write.parquet(path)
    if most is not None:
        turns = [meeting(visiting(0).unionByName(of_language)), *(meeting(visiting(turn)) for turn in range(1, (most + 1) // 2 + 1))]
        for begin in range(0, len(turns), ROUNDS_AT_ONCE):
            together = turns[begin]
            for turn in turns[begin + 1 : begin + ROUNDS_AT_ONCE]:
                together = together.unionByName(turn)
            together.write.mode("append").parquet(path)
    resident.unpersist()
    met = spark.read.schema(_MEETING).parquet(path)
    pairs = met.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    high = met.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= MOST_TERMS)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(high)


#: The same over ``documents``, in DuckDB's SQL.
ORACLE_SQL = r"""
with words as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), groups as (select distinct lang, source from words),
each as (select row, lang, source, unnest(terms) as term from words),
kept as (
  select lang, term, count(*) as n from each group by lang, term having count(distinct row) >= 30
), sizes as (select lang, count(*) as v, sum(n) as total from kept group by lang),
counts as (select lang, source, term, count(*) as n from each group by all),
totals as (select g.lang, g.source, coalesce(sum(c.n), 0) as total from groups g left join (counts c join kept k using (lang, term)) on g.lang = c.lang and g.source = c.source group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 5) // cast(g.total + 5 * s.v as hugeint) as p,
    1 + cast(1000000000 as hugeint) * (k.n + 5) // cast(s.total + 5 * s.v as hugeint) as q
  from totals g join kept k on g.lang = k.lang join sizes s on s.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), sums as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(s.value, 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), found as (
  select *, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (
    select lang, source, 'term' as part, term as item, cast(p - q as bigint) as value, row_number() over (partition by lang, source order by p - q desc, term) as rank
    from shares where n > 0 and p > q
  ) where rank <= 50
)
select lang, source, part, item, value, cast(rank as integer) as rank from found
"""
