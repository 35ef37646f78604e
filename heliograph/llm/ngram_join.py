"""Operator 2, n-gram Jaccard join over whole texts.

Documents are sets of distinct word 5-grams.  Two link when their Jaccard
similarity is at least 4/5.  The join is exact and never pairs up a group:

1. *Classes.*  Documents with equal sets are one class, named by a 64-bit hash of
   the set; all that follows is between classes, so ids and repeated rows do not matter.
2. *Tiles.*  Under one order of all shingles, rare ones first, linked sets of
   sizes s <= t share a shingle among the first s//9 + 1 of the smaller and the
   first t//5 + 1 of the larger.  A tile is the classes with one such shingle, in
   order of size, so that only a band of sizes has to be compared.
3. *Candidates.*  Small tiles give their pairs within the size band and the
   bound by position, counted: linked sets of like sizes share not one but many
   of their first shingles.  Of tiles of more than ``SMALL_TILE`` classes those
   rows remain that the bound by position lets link with any size in the tile.
   They are cut into blocks of ``BLOCK`` rows by size; each block compares hashed
   bitmap signatures, whose bit counts bound the overlap from above, and gives a
   spanning forest of the candidates (highest bound first) instead of all of them.
4. *Verification.*  Bit counts again, then exact intersection of sorted arrays.
5. *More rounds.*  Verified links are joined into components.  Of tiles that are
   not one component yet, pairs of blocks give a forest between components: of a
   large group of near copies each block is a component by then, so a pair of blocks
   gives one candidate.  In the last round blocks give every candidate between
   different components, so no link between components is lost.

Texts are read where they lie: bitmaps and arrays are made of those whose class is
wanted, by a filter of fixed size, and only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .staging import hash_filter, most_frequent, staged
from .textscan import NOT_SPACE, SHINGLE, byte_slices, mix, row_shingles, signed, text_of, words_of

SMALL_TILE = 24
BLOCK = 1024
#: Bits of the signatures compared within tiles, at most; long sets have more for the comparison by pairs.
TILE_BITS = 1 << 13
#: The shingles that are put last in the order, those found most often.  The bound touches speed only.
COMMON_SHINGLES = 1 << 18
_CHUNK = 1 << 21
#: Classes that a task remembers, so as to give the rows of equal sets once.
_REMEMBERED = 1_000_000
_U = np.uint64


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """``(slice, row, sorted distinct shingles)`` for every row of a batch."""
    for part in byte_slices(batch, "text"):
        text = text_of(part.column("text"), lower=True)
        words = words_of(text, NOT_SPACE)
        for i in range(len(text)):
            yield part, i, np.unique(row_shingles(words.hashes[words.first[i] : words.first[i + 1]], width))


def _set_hash(shingles: np.ndarray) -> int:
    """The name of the class of a set, as a signed long."""
    total = mix(np.sum(mix(shingles + _U(0x51ED270B)), keepdims=True) + _U(len(shingles)))
    return int(total.view(np.int64)[0])


def _batch(schema: str, *columns: object) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


_PROFILE = "kind byte, id long, size long, class long"


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """``kind`` 0: a document (id, size and class of its set); ``kind`` 1: a shingle often found, as ``id``, and ``size`` its sets in one chunk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        total = 0

        def common() -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = counts >= 3
            n = int(often.sum())
            return _batch(_PROFILE, np.ones(n, dtype=np.int8), signed(shingles[often]), counts[often].astype(np.int64), np.zeros(n, dtype=np.int64))

        for batch in batches:
            sizes, classes = [], []
            for _, _, shingles in _sets(batch, width):
                key = _set_hash(shingles)
                sizes.append(len(shingles))
                classes.append(key)
                if key not in seen:
                    held.append(shingles)
                    total += len(shingles)
                    seen.add(key)
                    if len(seen) > _REMEMBERED:
                        seen.clear()
                if total > _CHUNK:
                    yield common()
                    total = 0
            n = len(sizes)
            yield _batch(_PROFILE, np.zeros(n, dtype=np.int8), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()))
        if held:
            yield common()

    return docs.mapInArrow(scan, _PROFILE)


def _in_order(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray, take: int) -> np.ndarray:
    """The first ``take`` of sorted ``shingles`` in the order of the join: those not in ``common`` by value, then the others by rank."""
    if len(common) == 0:
        return shingles[:take]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    often = common[at] == shingles
    rare = shingles[~often]
    if len(rare) >= take:
        return rare[:take]
    return np.concatenate([rare, shingles[often][np.argsort(rank[at[often]], kind="stable")]])[:take]


_PREFIX = "token long, class long, place long"


def _prefixes(docs: DataFrame, common: np.ndarray, rank: np.ndarray, width: int) -> DataFrame:
    """Rows of tiles: ``token``, ``class`` and ``place``, which is ``size << 32 | position``.  Equal sets of a task give their rows once."""
    held = docs.sparkSession.sparkContext.broadcast((common, rank))  # at most COMMON_SHINGLES entries

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = held.value
        seen: set[int] = set()
        for batch in batches:
            tokens, classes, places, total = [], [], [], 0

            def taken() -> pa.RecordBatch:
                return _batch(_PREFIX, signed(np.concatenate(tokens)), np.concatenate(classes), np.concatenate(places))

            for _, _, shingles in _sets(batch, width):
                size = len(shingles)
                if size == 0 or (key := _set_hash(shingles)) in seen:
                    continue
                seen.add(key)
                if len(seen) > _REMEMBERED:
                    seen.clear()
                chosen = _in_order(shingles, common, rank, size // 5 + 1)
                tokens.append(chosen)
                classes.append(np.full(len(chosen), key, dtype=np.int64))
                places.append((size << 32) + np.arange(len(chosen), dtype=np.int64))
                total += len(chosen)
                if total > 200_000:
                    yield taken()
                    tokens, classes, places, total = [], [], [], 0
            if tokens:
                yield taken()

    return docs.select("text").mapInArrow(scan, _PREFIX)


def _close(size: np.ndarray, other: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Jaccard of at least 4/5 with this overlap: ``100 * i >= 80 * (s + t - i)``."""
    return 9 * overlap >= 4 * (size + other)


def _least_shared(size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many of the first ``size // 5 + 1`` and ``other // 5 + 1`` shingles linked sets share at least.

    Of ``i`` common shingles, in order, the ``k``-th is followed by ``i - k`` more in
    either set, so it stands among the first ``p`` of ``size`` if ``k <= p - (size - i)``.
    """
    overlap = -(-4 * (size + other) // 9)
    return np.minimum(size // 5 + 1 - (size - overlap), other // 5 + 1 - (other - overlap))


_TILE = "kind byte, a long, b long, n long, need long"


def _tiles(prefixes: DataFrame) -> DataFrame:
    """Pairs of small tiles (``kind`` 0) and rows of large ones (``a`` is the class, ``b`` the token, ``n`` the place).

    Pairs ``a``, ``b`` may come several times, each with the number ``n`` of tiles; ``need``
    is how many tiles, large ones included, a link must have, 0 where the bound
    by position fails in all ``n`` (a link passes it in the tile of its first common
    shingle).  Rows of large tiles are of ``kind`` 1 if by their position the token can be
    the first that they share with a set as small as the tile's least (or 4/5 of
    their own), else of ``kind`` 2.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        carry, large, least, last = empty, None, 0, (None, None)  # rows of the token not yet ended; the token known to be large, its least size and last row

        def large_rows(token: np.ndarray, name: np.ndarray, place: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
            size, position = place >> 32, place & 0xFFFFFFFF
            kind = np.where(4 * least <= 5 * size - 9 * position, 1, 2).astype(np.int8)
            return _batch(_TILE, kind, name, token, place, np.zeros(len(name), dtype=np.int64))

        def pairs(token: np.ndarray, name: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
            size, position = place >> 32, place & 0xFFFFFFFF
            found = []
            for k in range(1, min(SMALL_TILE, len(token))):
                i = np.flatnonzero(token[k:] == token[:-k])
                if len(i) == 0:
                    break
                j = i + k
                near = 5 * size[i] >= 4 * size[j]
                i, j = i[near], j[near]
                first = (position[i] <= size[i] // 9) & _close(size[i], size[j], np.minimum(size[i] - position[i], size[j] - position[j]))
                found.append(np.stack([np.minimum(name[i], name[j]), np.maximum(name[i], name[j]), np.where(first, _least_shared(size[i], size[j]), 0)]))
            if found and (both := np.concatenate(found, axis=1)).size:
                a, b, need = both[:, np.lexsort((both[1], both[0]))]
                begins = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                need, n = np.maximum.reduceat(need, begins), np.diff(np.append(begins, len(a)))
                yield _batch(_TILE, np.zeros(len(n), dtype=np.int8), a[begins], b[begins], n, need)

        def settle(token: np.ndarray, name: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(token) == 0:
                return
            _, first, count = np.unique(token, return_index=True, return_counts=True)
            n = np.repeat(count, count)
            if (small := (n > 1) & (n <= SMALL_TILE)).any():
                yield from pairs(token[small], name[small], place[small])
            if (many := n > SMALL_TILE).any():
                sizes = np.repeat(place[first] >> 32, count)
                yield large_rows(token[many], name[many], place[many], sizes[many])

        for batch in batches:
            rows = tuple(batch.column(c).to_numpy() for c in ("token", "class", "place"))
            if len(rows[0]) == 0:
                continue
            # equal sets of several tasks stand next to each other
            again = np.concatenate(([(rows[0][0], rows[1][0]) == last], (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])))
            last = (rows[0][-1], rows[1][-1])
            rows = tuple(r[~again] for r in rows)
            if large is not None:  # the large token goes on: its rows pass through
                end = int(np.searchsorted(rows[0], large, side="right"))
                if end:
                    yield large_rows(*(r[:end] for r in rows), least)
                rows = tuple(r[end:] for r in rows)
                if len(rows[0]) == 0:
                    continue
                large = None
            if len(rows[0]) == 0:
                continue
            rows = tuple(np.concatenate([c, r]) for c, r in zip(carry, rows, strict=True))
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            yield from settle(*(r[:cut] for r in rows))
            carry = tuple(r[cut:] for r in rows)
            if len(carry[0]) > SMALL_TILE:
                large, least = carry[0][0], carry[2][0] >> 32
                yield large_rows(*carry, least)
                carry = empty
        yield from settle(*carry)

    return prefixes.repartition("token").sortWithinPartitions("token", "place", "class").mapInArrow(scan, _TILE)


def _bitmap(shingles: np.ndarray, n_bits: int) -> np.ndarray:
    """A bit for the hash of each shingle; of two powers of two the shorter bitmap is the longer one folded."""
    bits = np.zeros(n_bits, dtype=np.uint8)
    bits[(mix(shingles ^ _U(0x3C3C3C3C)) & _U(n_bits - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def _own_bits(size: int) -> int:
    """Four to eight bits for each element, so that bit counts tell long sets apart as well as short ones."""
    return 1 << max(9, (4 * size - 1).bit_length())


def _folded(bits: np.ndarray, length: int) -> np.ndarray:
    """Bitmaps (the last axis) of ``length`` bytes."""
    while bits.shape[-1] > length:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


_SIGNATURE = "class long, size long, bitmap binary, long_bitmap binary"


def _wanted_sets(docs: DataFrame, classes: DataFrame, width: int, schema: str, row_of, most: int) -> DataFrame:
    """``row_of(class, shingles)`` for the sets of ``classes``, and of few others, once for each task; made where the texts are read."""
    inside = hash_filter(classes, "class")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rows, held = [], 0
        for batch in batches:
            for _, _, shingles in _sets(batch, width):
                if len(shingles) == 0:
                    continue
                key = _set_hash(shingles)
                if key in seen or not inside(key):
                    continue
                seen.add(key)
                if len(seen) > _REMEMBERED:
                    seen.clear()
                rows.append(row_of(key, shingles))
                held += len(shingles)
                if held > most:
                    yield _batch(schema, *zip(*rows, strict=True))
                    rows, held = [], 0
        if rows:
            yield _batch(schema, *zip(*rows, strict=True))

    return docs.select("text").mapInArrow(scan, schema)


def _signatures(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``class``, ``size``, ``bitmap`` of at most ``TILE_BITS`` and ``long_bitmap`` of the set's own length."""

    def row(key: int, shingles: np.ndarray) -> tuple:
        bits = _bitmap(shingles, _own_bits(len(shingles)))
        return key, len(shingles), _folded(bits, TILE_BITS // 8).tobytes(), bits.tobytes()

    found = _wanted_sets(docs, classes, width, _SIGNATURE, row, 2_000_000).join(classes, "class", "left_semi")
    return found.groupBy("class").agg(F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), F.first("long_bitmap").alias("long_bitmap"))


def _arrays(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``class`` and ``shingles`` (sorted 64-bit values)."""
    found = _wanted_sets(docs, classes, width, "class long, shingles binary", lambda key, shingles: (key, shingles.tobytes()), 500_000).join(classes, "class", "left_semi")
    return found.groupBy("class").agg(F.first("shingles").alias("shingles"))


def _bound(size: np.ndarray, other: np.ndarray, bits: np.ndarray, other_bits: np.ndarray) -> np.ndarray:
    """The most that two sets can share: a bit set in one only stands for an element that the other lacks."""
    common = np.bitwise_count(bits & other_bits).sum(axis=-1, dtype=np.int64)
    own, others = np.bitwise_count(bits).sum(axis=-1, dtype=np.int64), np.bitwise_count(other_bits).sum(axis=-1, dtype=np.int64)
    return np.minimum(size - (own - common), other - (others - common))


def _likely(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs that the bit counts of the long bitmaps leave."""

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = []
                for one, two, size, other in zip(
                    batch.column("a_long_bitmap"), batch.column("b_long_bitmap"), batch.column("a_size").to_pylist(), batch.column("b_size").to_pylist(), strict=True
                ):
                    x, y = np.frombuffer(one.as_buffer(), dtype=np.uint8), np.frombuffer(two.as_buffer(), dtype=np.uint8)
                    n = min(len(x), len(y))
                    ok.append(bool(_close(size, other, _bound(size, other, _folded(x, n), _folded(y, n)))))
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return _sides(pairs, signatures, "size", "long_bitmap").mapInArrow(by_bits, "a long, b long")


def _sides(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("class").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return pairs


def _verified(pairs: DataFrame, signatures: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets are close: by bit counts first, then by exact intersection of the sets of what is left."""

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = []
                for one, two in zip(batch.column("a_shingles"), batch.column("b_shingles"), strict=True):
                    x, y = np.frombuffer(one.as_buffer(), dtype=np.uint64), np.frombuffer(two.as_buffer(), dtype=np.uint64)
                    ok.append(bool(_close(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))))
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    likely = staged(_likely(pairs, signatures), "join-likely")
    classes = likely.select(F.col("a").alias("class")).union(likely.select("b")).distinct()
    arrays = staged(_arrays(docs, classes, width), "join-arrays")
    return _sides(likely, arrays, "shingles").mapInArrow(exactly, "a long, b long")


def _blocks(members: DataFrame, which: str) -> DataFrame:
    """Rows of large tiles dealt to pairs of blocks: adds ``left_block`` and ``right_block``; a row of the tile goes to each pair that its block is in.

    ``which``: ``own`` (each block with itself), ``across`` (different blocks) or ``all``.

    A tile of at most ``BLOCK`` rows is one block.  Else a band holds sizes within
    a factor of 5/4, so links lie within a band or between neighbours, and bands of
    more than ``BLOCK`` rows are split by a hash.  What is joined by the bare token is
    the table of bands; rows of members are dealt by token and band, then by block.
    """
    banded = members.withColumn("band", F.floor(F.log("size") / F.log(F.lit(1.25))).cast("int"))
    counts = staged(banded.groupBy("token", "band").agg(F.count("*").alias("n")), "join-bands")
    totals = counts.groupBy("token").agg(F.sum("n").alias("total")).where("total > 1")
    known = counts.join(totals, "token").withColumn("block_band", F.when(F.col("total") > BLOCK, F.col("band")).otherwise(0))
    known = known.withColumn("parts", F.when(F.col("total") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int"))
    known = staged(known.select("token", "band", "block_band", "parts"), "join-parts")
    block = lambda band, part: F.col(band).cast("long") * (1 << 32) + F.col(part)
    blocks = known.select("token", "block_band", "parts").distinct().select("token", "block_band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.select("token", "block_band", block("block_band", "part").alias("block"))
    other = blocks.select("token", F.col("block_band").alias("other_band"), F.col("block").alias("other"))
    met = {"own": "block = other", "across": "block < other", "all": "block <= other"}[which]
    near = blocks.join(other, "token").where(f"other_band - block_band in (0, 1) and {met}").select("token", F.col("block").alias("left_block"), F.col("other").alias("right_block"))
    sides = staged(near.select("token", "left_block", "right_block", F.explode(F.array_distinct(F.array("left_block", "right_block"))).alias("block")), "join-sides")
    placed = banded.join(known, ["token", "band"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    placed = placed.select("token", "class", "size", "position", "bitmap", "component", block("block_band", "part").alias("block"))
    return placed.join(sides, ["token", "block"])


def _forest(weight: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the highest weights (0: no edge) between rows of different groups, by Prim's method."""
    n = len(group)
    weight = np.where(group[:, None] == group[None, :], np.iinfo(np.int64).max, weight)
    waiting, best, source, edges = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), []
    for _ in range(n):
        at = int(np.argmax(np.where(waiting, best, -1)))
        if 0 < best[at] < np.iinfo(np.int64).max:
            edges.append((int(source[at]), at))
        waiting[at] = False
        better = waiting & (weight[at] > best)
        best[better], source[better] = weight[at][better], at
    return edges


def _weights(size: np.ndarray, position: np.ndarray, bitmaps: list[bytes]) -> np.ndarray:
    """The most that each two rows of a tile can share, 0 for those that can't link or whose first common shingle is another."""
    n = len(size)
    weight = np.zeros((n, n), dtype=np.int64)
    length = np.array([len(b) for b in bitmaps])
    for own in np.unique(length).tolist():  # sizes within a factor of 5/4 have bitmaps of one length or of its double
        rows = np.flatnonzero((length == own) | (length == 2 * own))
        bits = np.stack([_folded(np.frombuffer(bitmaps[i], dtype=np.uint8), own) for i in rows]).view(np.uint64)
        left = size[rows] - position[rows]
        for k, i in enumerate(rows.tolist()):
            if length[i] != own:
                continue
            near = np.flatnonzero(_close(size[i], size[rows], np.minimum(left[k], left)))
            if len(near):
                bound = _bound(size[i], size[rows[near]], bits[k], bits[near])
                bound = np.where(_close(size[i], size[rows[near]], bound), np.maximum(bound, 1), 0)
                weight[i, rows[near]] = np.maximum(weight[i, rows[near]], bound)
    weight = np.maximum(weight, weight.T)
    np.fill_diagonal(weight, 0)
    return weight


def _block_pairs(members: DataFrame, which: str, rest: bool = False) -> DataFrame:
    """Candidates ``a``, ``b`` of large tiles between different components: a spanning forest for each pair of blocks, or with ``rest`` all."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("class", "ascending")])
        name, size, position, block, component = (group.column(c).to_numpy() for c in ("class", "size", "position", "block", "component"))
        weight = _weights(size, position, group.column("bitmap").to_pylist())
        if block.min() != block.max():
            weight[block[:, None] == block[None, :]] = 0
        if rest:
            edges = np.argwhere(np.triu(weight > 0) & (component[:, None] != component[None, :]))
        else:
            edges = np.array(_forest(weight, component), dtype=np.int64).reshape(-1, 2)
        ends = name[edges]
        return pa.table({"a": ends.min(axis=1) if len(ends) else ends[:, 0], "b": ends.max(axis=1) if len(ends) else ends[:, 1]})

    dealt = _blocks(members, which)
    return dealt.groupBy("token", "left_block", "right_block").applyInArrow(compare, "a long, b long").distinct()


def _split(members: DataFrame, reached: DataFrame, least: int = 1) -> DataFrame:
    """Rows, with ``component``, of the tiles of more than ``least`` rows whose classes are not one component yet."""
    labelled = members.join(reached.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    labelled = staged(labelled, "join-labelled")
    split = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where(f"low <> high and n > {least}").select("token")
    return labelled.join(split, "token", "left_semi")


def _components_of_classes(source: DataFrame, scanned: DataFrame, width: int) -> DataFrame:
    """``class`` and ``component`` (the least class reachable by links) of the classes with links; ``source`` has ``text``, ``scanned`` its :func:`profiles`."""
    often = most_frequent(scanned.where("kind = 1").groupBy("id").agg(F.sum("size").alias("n")), "n", COMMON_SHINGLES).select("id", "n").toArrow()
    # bounded; it sets the order and so the speed, not the result
    shingles, n = often.column("id").to_numpy().view(np.uint64), often.column("n").to_numpy()
    rank = np.empty(len(n), dtype=np.int64)
    rank[np.lexsort((shingles, n))] = np.arange(len(n))  # the least frequent of them first
    order = np.argsort(shingles)

    tiles = staged(_tiles(_prefixes(source, shingles[order], rank[order], width)), "join-tiles")
    shared = tiles.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("need > 0")
    larges = tiles.where("kind > 0").groupBy(F.col("a").alias("class")).agg(F.count("*").alias("large"))
    for side in ("a", "b"):  # tiles that the two may share besides: the large ones of either
        shared = shared.join(larges.select(F.col("class").alias(side), F.col("large").alias(f"{side}_large")), side, "left")
    small = staged(shared.where("n + least(coalesce(a_large, 0), coalesce(b_large, 0)) >= need").select("a", "b"), "join-pairs")

    place = F.col("n").alias("place")
    members = tiles.where("kind = 1").select(F.col("a").alias("class"), F.col("b").alias("token"), F.shiftright(place, 32).alias("size"), place.bitwiseAND(0xFFFFFFFF).alias("position"))
    alike = members.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"), F.sum("position").alias("place"))
    # tiles of the same members count once, as the token that comes first in the order: two of them share no earlier one
    tokens = alike.where("n > 1").groupBy("n", "x", "y").agg(F.min_by("token", F.struct("place", "token")).alias("token")).select("token")
    members = staged(members.join(tokens, "token", "left_semi"), "join-members")

    needed = small.select(F.col("a").alias("class")).union(small.select("b")).union(members.select("class")).distinct()
    signatures = staged(_signatures(source, needed, width), "join-signatures")
    bitmaps = signatures.select("class", "bitmap")
    full = members.join(bitmaps, "class").withColumn("component", F.col("class"))
    first = small.union(_block_pairs(full, "own")).distinct()
    links = staged(_verified(first, signatures, source, width), "join-links")
    reached = staged(components(links), "join-components")
    if not members.isEmpty():
        # between blocks a forest of components, then all that is left between different ones
        for which, rest, least in (("across", False, BLOCK), ("all", True, 1)):
            more = staged(_block_pairs(_split(members, reached, least).join(bitmaps, "class"), which, rest), "join-more")
            if not more.isEmpty():
                links = staged(links.union(_verified(more, signatures, source, width)), "join-links")
                reached = staged(components(links), "join-components")
    return reached.withColumnRenamed("id", "class")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (least id reachable by links) for every row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A text of
    fewer than ``width`` words is one shingle; a null or empty text, or one
    without words, has no shingles and is its own component.  Rows with equal
    sets, repeated rows among them, are linked; rows of one id with different
    texts are judged each by its text.  A row without id gets its component's
    least id, if a row of it has an id, else null.  Other columns of ``docs`` do
    not matter.  An empty table gives an empty result.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scanned = staged(profiles(source, width), "join-profiles")
    reached = _components_of_classes(source, scanned, width)
    profile = scanned.where("kind = 0").select(F.col("id").alias("doc_id"), "size", "class")
    classes = profile.where("size > 0").groupBy("class").agg(F.min("doc_id").alias("least")).join(reached, "class", "left")
    classes = classes.withColumn("component", F.coalesce("component", "class"))
    heads = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(classes.join(heads, "component").select("class", "component_id"), "join-classes")
    return profile.join(named, "class", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """One row of each group of near copies: that with the least id (rows without one come last; ties go by the text's class).

    Rows are judged by id and text together, so of rows with one id and different
    texts each goes its own way, and of repeated rows one stays.  Rows of one id and
    one set of shingles count as repeated, whatever their other columns.  Rows without
    words are near copies of nothing and all stay.  Rows are dropped where they are
    read, by filters of fixed size that let every row pass that must; of those that
    may stand for a group the rest is found by an exact join.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scanned = staged(profiles(source, width), "join-profiles")
    reached = _components_of_classes(source, scanned, width)
    rows = scanned.where("kind = 0 and size > 0").groupBy("class", F.col("id").alias("doc_id")).agg(F.count("*").alias("n"))
    best = rows.groupBy("class").agg(F.min_by(F.struct("doc_id", "n"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("best")).select("class", "best.*")
    best = best.join(reached, "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "class")
    chosen = staged(best.groupBy("component").agg(F.min_by(F.struct("class", "doc_id", "n"), first).alias("best")).select("best.*"), "join-chosen")
    # only rows that may stand for a group of several are dealt by key; all others are judged where they are read
    pair = F.col("class").bitwiseXOR(F.xxhash64("doc_id"))
    sizes = best.groupBy("component").agg(F.sum(F.lit(1)).alias("classes"))
    several = rows.groupBy("class").agg(F.sum("n").alias("rows"))
    grouped = best.select("class", "component").join(sizes, "component").join(several, "class").where("classes > 1 or rows > 1").select("class")
    in_group, stands = hash_filter(grouped, "class"), hash_filter(chosen.select(pair.alias("pair")), "pair")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(id_col).cast("long")).alias("key"))
    named = T.StructType([packed.schema["row"], T.StructField("class", T.LongType())])

    def scan(alone: bool):
        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, keys = pa.RecordBatch.from_arrays([batch.column("row").field(text_col)], ["text"]), batch.column("key").to_pylist()
                names, keep = [], []
                for key, (_, _, shingles) in zip(keys, _sets(texts, width), strict=True):
                    name = _set_hash(shingles) if len(shingles) else None
                    grouped = name is not None and in_group(name)
                    names.append(name)
                    keep.append(not grouped if alone else grouped and stands(name ^ key))
                if any(keep):
                    yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.int64())], ["row", "class"]).filter(pa.array(keep, pa.bool_()))

        return judge

    unique = packed.mapInArrow(scan(True), named).select("row.*")
    some = packed.mapInArrow(scan(False), named).withColumn("doc_id", F.col("row")[id_col].cast("long"))
    chosen = chosen.select(F.col("class").alias("best_class"), F.col("doc_id").alias("best_id"), "n")
    matched = staged(some.join(chosen, (F.col("class") == F.col("best_class")) & F.col("doc_id").eqNullSafe(F.col("best_id"))).select("row", "class", "doc_id", "n"), "join-kept")
    first_of = matched.where("n > 1").dropDuplicates(["class", "doc_id"])
    return unique.union(matched.where("n = 1").select("row.*")).union(first_of.select("row.*"))
