"""Operator 10, benchmark decontamination by SimHash windows of the items' sizes.

The items (a table whose size is checked) are sent to every task with their
shingles, weights and 64-bit SimHash fingerprints.  In each whole document,
windows of as many words as an item are fingerprinted wherever they hold a
shingle of it (a window without one has similarity 0, so none is lost).  A
multi-index of four 16-bit blocks gives every item within ``RADIUS`` bits: of
``RADIUS`` differing bits one block holds no more than a quarter.  Of these flips
the index holds all but ``PROBED_FLIPS``, which the search tries, so that an item
takes a few kilobytes.  Candidates of the window's size are verified by the exact
weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.sources.shared import shared_path

from .staging import staged
from .textscan import SHINGLE, byte_slices, row_shingles, text_of, words_of

#: Bits in which fingerprints may differ.
RADIUS = 19
SIMILARITY = 0.8
#: How many of the bits flipped in a block a search tries; the index holds the others.
PROBED_FLIPS = 1
BLOCKS = 4
#: Items sent to tasks at once, about; a larger benchmark is taken in slices of this many.  Each takes some six kilobytes of the index.
ITEMS_AT_ONCE = 5_000
#: Windows looked up in the index at once.
_WINDOWS = 512
_U = np.uint64


def _masks(flips: int) -> np.ndarray:
    """All values of 16 bits with at most ``flips`` set."""
    return np.array([sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(64 // BLOCKS), n)], dtype=np.int64)


def _grouped(keys: np.ndarray, values: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each key's values begin, and the values in order of their keys."""
    order = np.argsort(keys, kind="stable")
    return np.searchsorted(keys[order], np.arange(n_keys + 1)), values[order]


class Items:
    """The items of a benchmark as shingles, fingerprints and a multi-index."""

    def __init__(self, ids: list[object], texts: list[str | None], width: int = SHINGLE, shared: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """``shared``: sorted shingles of these items that several items of the whole benchmark have, and how many; None if these are all its items."""
        text = text_of(pa.array(texts, pa.large_string()), lower=True)
        words = words_of(text)
        self.width, self.ids, self.shingles, self.words = width, [], [], []
        for i in range(len(text)):
            hashes = words.hashes[words.first[i] : words.first[i + 1]]
            if len(hashes) and ids[i] is not None:
                self.ids.append(ids[i])
                self.words.append(len(hashes))
                self.shingles.append(row_shingles(hashes, width))
        own = [np.unique(shingles) for shingles in self.shingles]
        each = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
        #: All shingles, sorted; the items of the ``k``-th are ``where[1][where[0][k]:where[0][k + 1]]``.
        self.all, place = np.unique(each, return_inverse=True)
        self.where = _grouped(place, np.repeat(np.arange(len(own)), [len(o) for o in own]), len(self.all))
        if shared is None:
            held = np.diff(self.where[0])
            shared = self.all[held > 1], held[held > 1]
        #: The weight of a shingle: less if many items have it, so that set phrases count little; 1 for others.
        self.shared, self.weight = shared[0], 1 / shared[1]
        #: The same of the text that is searched, for shingles that only items of other slices have.
        self.besides: tuple[np.ndarray, np.ndarray] | None = None
        #: Which top 22 bits of a shingle's hash any item has.
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.all >> _U(42)).astype(np.int64)] = True
        self.sizes = np.array([len(shingles) for shingles in self.shingles], dtype=np.int64)
        self.prints = np.array([int(self.fingerprints(s, np.array([0]), len(s))[0]) for s in self.shingles], dtype=np.uint64)
        masks, numbers = _masks(RADIUS // BLOCKS - PROBED_FLIPS), np.arange(len(self.prints), dtype=np.int32)
        self.index = [_grouped((self._block(self.prints, k)[:, None] ^ masks).ravel(), np.repeat(numbers, len(masks)), 1 << 16) for k in range(BLOCKS)]

    @staticmethod
    def _block(prints: np.ndarray, k: int) -> np.ndarray:
        return (prints >> _U(16 * k) & _U(0xFFFF)).astype(np.int64)

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        out = np.ones(len(shingles))
        for shared, weight in ((self.shared, self.weight), *([self.besides] if self.besides is not None else [])):
            if len(shared):
                at = np.minimum(np.searchsorted(shared, shingles), len(shared) - 1)
                held = shared[at] == shingles
                out[held] = weight[at[held]]
        return out

    def fingerprints(self, shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """SimHash of ``size`` consecutive shingles from each start: each bit is the sign of the weighted vote of the shingles."""
        bits = (shingles[:, None] >> np.arange(64, dtype=np.uint64)) & _U(1)
        votes = np.where(bits == 1, 1.0, -1.0) * self.weights(shingles)[:, None]
        sums = np.concatenate([np.zeros((1, 64)), np.cumsum(votes, axis=0)])
        signs = np.round(sums[starts + size] - sums[starts], 9) > 0
        return (signs.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def near(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place in values, item)`` of all fingerprints that differ in at most ``RADIUS`` bits, each once."""
        probes, found = _masks(PROBED_FLIPS), []
        for begin in range(0, len(values), _WINDOWS):
            part = values[begin : begin + _WINDOWS]
            for k, (start, items) in enumerate(self.index):
                at = (self._block(part, k)[:, None] ^ probes).ravel()
                counts = start[at + 1] - start[at]
                window = np.repeat(np.repeat(np.arange(len(part)), len(probes)), counts)
                item = items[np.repeat(start[at] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))]
                close = np.bitwise_count(part[window] ^ self.prints[item]) <= RADIUS
                found.append((window[close] + begin) * len(self.prints) + item[close])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))

    def similarity(self, window: np.ndarray, k: int) -> float:
        """Weighted Jaccard similarity of the multisets of shingles."""
        values, counts = np.unique(np.concatenate([window, self.shingles[k]]), return_counts=True)
        own_values, own = np.unique(window, return_counts=True)
        in_window = np.zeros(len(values), dtype=np.int64)
        in_window[np.searchsorted(values, own_values)] = own
        in_item = counts - in_window
        weight = self.weights(values)
        return float((weight * np.minimum(in_window, in_item)).sum() / (weight * np.maximum(in_window, in_item)).sum())

    def search(self, hashes: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int, int, float]]:
        """``(item, first word, words, similarity)``: for each item the best window of a text with similarity of ``SIMILARITY`` or more, the first if several."""
        shingles = row_shingles(hashes, self.width)
        if len(shingles) == 0 or len(self.ids) == 0:
            return []
        if known is None:
            known = self.all[np.minimum(np.searchsorted(self.all, shingles), len(self.all) - 1)] == shingles
        places = np.flatnonzero(known)
        at = np.searchsorted(self.all, shingles[places])
        counts = self.where[0][at + 1] - self.where[0][at]
        item = self.where[1][np.repeat(self.where[0][at] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))]
        # what windows must hold, as pairs of a size and a place, each once
        pairs = np.unique(np.minimum(self.sizes[item], len(shingles)) * (len(shingles) + 1) + np.repeat(places, counts))
        best: dict[int, tuple[float, int, int]] = {}
        for size in np.unique(pairs // (len(shingles) + 1)).tolist():
            held = pairs[pairs // (len(shingles) + 1) == size] % (len(shingles) + 1)
            lowest, highest = np.maximum(held - size + 1, 0), np.minimum(held, len(shingles) - size)
            covered = np.zeros(len(shingles) + 1, dtype=np.int64)
            np.add.at(covered, lowest, 1)
            np.add.at(covered, highest + 1, -1)
            begins = np.flatnonzero(np.cumsum(covered) > 0)
            for run in np.split(begins, np.flatnonzero(np.diff(begins) > 1) + 1):  # each run of neighbours on its own part of the text
                for first in range(0, len(run), _WINDOWS):
                    starts = run[first : first + _WINDOWS]
                    part = shingles[starts[0] : starts[-1] + size]
                    window, near = self.near(self.fingerprints(part, starts - starts[0], size))
                    fits = np.minimum(self.sizes[near], len(shingles)) == size  # windows of other items' size: which there are must not matter
                    for start, k in zip(starts[window[fits]].tolist(), near[fits].tolist(), strict=True):
                        similarity = self.similarity(shingles[start : start + size], k)
                        if similarity >= SIMILARITY and (k not in best or (-similarity, start) < (-best[k][0], best[k][1])):
                            best[k] = (similarity, start, size)
        return [(k, start, min(size + self.width - 1, len(hashes)), similarity) for k, (similarity, start, size) in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``first_word``, ``n_words`` and ``similarity`` for each item of which a document holds a near copy.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles
    have five words, a shorter text is one shingle.  A document shorter than an
    item is compared as a whole.  Null and empty texts, and items without id or
    words, hold nothing; equal items are each reported; repeated rows are each
    searched; other columns do not matter.  A benchmark of more than
    ``ITEMS_AT_ONCE`` items is searched slice by slice (:class:`Slices`), when this is
    called; every slice weighs shingles by their items in the whole benchmark, so the
    slices change no result.  The driver and a task hold the items of one slice.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema[item_id_col].dataType),
        T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType()),
    ])
    items = _items_of(benchmark, item_id_col, item_text_col)
    slices = max(1, -(-items.count() // ITEMS_AT_ONCE))
    spark = docs.sparkSession
    if slices == 1:
        return source.mapInArrow(_search(spark.sparkContext.broadcast(_whole(items))), schema)
    held = Slices(items, slices)
    candidates = staged(held.weighed(source.mapInArrow(held.holding("text"), source.schema), "text"), "decontaminate-candidates")
    path = shared_path(spark, "decontaminate-finds")
    for part in range(slices):
        broadcast = spark.sparkContext.broadcast(held.items(part))
        candidates.mapInArrow(_search(broadcast), schema).write.mode("append").parquet(path)
        broadcast.destroy()
    return spark.read.schema(schema).parquet(path)


def _items_of(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(benchmark[item_id_col].alias("item_id"), benchmark[item_text_col].cast("string").alias("text")).where("text is not null")


def _whole(items: DataFrame) -> Items:
    """A benchmark of at most ``ITEMS_AT_ONCE`` items, about."""
    rows = items.collect()
    return Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def _row_hashes(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """``(slice, row, sorted distinct shingles)`` of the texts of a batch."""
    for part in byte_slices(batch, column):
        words = words_of(text_of(part.column(column), lower=True))
        for i in range(part.num_rows):
            yield part, i, np.unique(row_shingles(words.hashes[words.first[i] : words.first[i + 1]]))


#: A filter of ``1 << FILTER_BITS`` bits, of which each shingle sets as many as there are multipliers (odd numbers).
FILTER_BITS = 27
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, 4, dtype=np.uint64) * _U(2) + _U(1)


def _places(shingles: np.ndarray) -> np.ndarray:
    return ((shingles[:, None] * _MULTIPLIERS) >> _U(64 - FILTER_BITS)).astype(np.int64)


def _filter(shingles: DataFrame) -> Broadcast[np.ndarray]:
    """The bitmap of a table of ``shingle``, 16 MB whatever the table; it is made in Spark, block by block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places(batch.column("shingle").to_numpy().view(np.uint64))))], ["bit"])

    block = F.shiftright("bit", 15)
    marked = shingles.select("shingle").mapInArrow(scan, "bit long").groupBy(block.alias("block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND((1 << 15) - 1)).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in marked.toLocalIterator():  # 2 ** 12 blocks of 4 KB at most
        bits[row["block"] << 12 : (row["block"] + 1) << 12] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return shingles.sparkSession.sparkContext.broadcast(bits)


def _may_hold(bits: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Which shingles may be in the table of a filter: all that are, by chance others."""
    places = _places(shingles)
    return (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).all(axis=1)


class Slices:
    """A benchmark of any size, of which the driver and tasks hold one slice of items at a time.

    Which texts may hold a shingle of any item is told by a bitmap of fixed size, in
    one pass over all documents; the slices are searched for in those texts alone.
    What a shingle weighs depends on its items in the whole benchmark: the shingles
    that several items have are a table, joined to the texts and to each slice.
    """

    def __init__(self, items: DataFrame, slices: int) -> None:
        self.number = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
        self.rows = items

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = batch.column("part").to_pylist()
                for k, (_, _, shingles) in enumerate(_row_hashes(batch, "text")):
                    yield pa.RecordBatch.from_arrays([pa.array([parts[k]] * len(shingles), pa.int64()), pa.array(shingles.view(np.int64))], ["part", "shingle"])

        own = items.where("item_id is not null").select("text", self.number.cast("long").alias("part")).mapInArrow(scan, "part long, shingle long")
        self.own = staged(own, "decontaminate-shingles")
        self.shared = staged(self.own.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "decontaminate-shared")

    def items(self, part: int) -> Items:
        """One slice, with the weights of its own shingles."""
        rows = self.rows.where(self.number == part).collect()
        held = self.own.where(F.col("part") == part).select("shingle").distinct().join(self.shared, "shingle").toArrow()
        shingles = held.column("shingle").to_numpy().view(np.uint64)
        order = np.argsort(shingles)
        return Items([r["item_id"] for r in rows], [r["text"] for r in rows], shared=(shingles[order], held.column("n").to_numpy()[order]))

    def holding(self, column: str, others: bool = False):
        """A filter of rows whose text may hold a shingle of an item, or (``others``) of those whose text holds none."""
        held = _filter(self.own)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [bool(_may_hold(held.value, shingles).any()) != others for _, _, shingles in _row_hashes(batch, column)]
                if any(keep):
                    yield batch.filter(pa.array(keep, pa.bool_()))

        return scan

    def weighed(self, texts: DataFrame, column: str) -> DataFrame:
        """Rows with ``besides``: those of the text's shingles that several items have, and how many."""
        key = F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
        held = _filter(self.shared)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("key").to_pylist()
                for k, (_, _, shingles) in enumerate(_row_hashes(batch, "text")):
                    found = shingles[_may_hold(held.value, shingles)]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[k]] * len(found), pa.string()), pa.array(found.view(np.int64))], ["key", "shingle"])

        each = texts.select(key.alias("key"), F.col(column).alias("text")).dropDuplicates(["key"]).mapInArrow(scan, "key string, shingle long")
        besides = each.join(self.shared, "shingle").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shingle", "n"))).alias("besides"))
        return texts.withColumn("key", key).join(besides, "key", "left").drop("key")


def _besides(value: list[dict] | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The weights of a row of :meth:`Slices.weighed`."""
    if not value:
        return None
    shingles = np.array([v["shingle"] for v in value], dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], 1 / np.array([v["n"] for v in value])[order]


def _finds(column: pa.Array, items: Items, besides: pa.Array | None = None) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """``(row, finds)`` of :meth:`Items.search` for the texts of a column that hold a shingle of an item; ``besides``: weights that :meth:`Slices.weighed` has joined."""
    words = words_of(text_of(column, lower=True))
    for i in range(len(column)):
        hashes = words.hashes[words.first[i] : words.first[i + 1]]
        shingles = row_shingles(hashes, items.width)
        at = np.flatnonzero(items.maybe[(shingles >> _U(42)).astype(np.int64)])
        if len(at):
            known = np.zeros(len(shingles), dtype=bool)
            known[at] = items.all[np.minimum(np.searchsorted(items.all, shingles[at]), len(items.all) - 1)] == shingles[at]
            items.besides = None if besides is None else _besides(besides[i].as_py())
            yield i, items.search(hashes, known)


def _search(held):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = held.value
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                besides = part.column("besides") if "besides" in part.schema.names else None
                rows = [(ids[i], items.ids[k], *rest) for i, finds in _finds(part.column("text"), items, besides) for k, *rest in finds]
                kinds = [part.schema.field("doc_id").type, None, pa.int64(), pa.int64(), pa.float64()]
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return scan


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text (a string column) holds no near copy of an item, by :func:`leaks`.

    Rows are judged where they are read, with all their columns, so nothing is
    shuffled; null texts stay; rows without id and repeated rows are each judged
    by their own text.  With several slices of items, rows that hold no shingle of an
    item stay as they are, and only the others go from slice to slice.
    """
    spark = docs.sparkSession
    row = "__row"

    def clean(held, packed: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in byte_slices(batch, text_col):
                    keep = np.ones(part.num_rows, dtype=bool)
                    for i, finds in _finds(part.column(text_col), held.value, part.column("besides") if packed else None):
                        keep[i] = not finds
                    yield part.filter(pa.array(keep))

        return scan

    items = _items_of(benchmark, item_id_col, item_text_col)
    slices = max(1, -(-items.count() // ITEMS_AT_ONCE))
    if slices == 1:
        return docs.mapInArrow(clean(spark.sparkContext.broadcast(_whole(items)), False), docs.schema)
    held = Slices(items, slices)
    packed = docs.mapInArrow(held.holding(text_col), docs.schema).select(F.struct(*docs.columns).alias(row), F.col(text_col))
    left = staged(held.weighed(packed, text_col), "decontaminate-candidates")
    for part in range(slices):
        broadcast = spark.sparkContext.broadcast(held.items(part))
        left = staged(left.mapInArrow(clean(broadcast, True), left.schema), "decontaminate-slice")
        broadcast.destroy()
    return docs.mapInArrow(held.holding(text_col, others=True), docs.schema).union(left.select(f"{row}.*"))
