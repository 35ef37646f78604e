"""Operator 3, LM scoring by online logistic context mixing.

A text is lower-cased (A-Z) and read as its words, *units* of a word and a space,
then one end, byte 0xFF, which no text has.  A unit is coded in bits: the ``CODED``
most frequent units of the training texts, and an escape, have a Huffman code; after
an escape the bytes of the unit follow.

*Bits of codes* are predicted by counts in several contexts, each together with
the bits of the code so far: which of the ``ANCHORS`` most frequent units stands out
most in the text so far; for the first ``HEAD`` bits the unit before (of rare ones, its
ending), and the endings of the two units before; for the others no context.  The contexts of units
before are hashed to a table that grows with the corpus, up to ``1 << MOST_BITS``
slots.  Predictions are stretched to the logistic domain and summed by mixers, whose
weights a gate picks: how often the contexts were seen, and how deep in the code
the bit is.  A text begins with weights that were learned online from all training
texts, each task from its own and averaged, each occurrence taken out of the counts that predict it; after every
``CHUNK`` units the text's own copy of them is refined by the errors just made.  What
is predicted depends on what stands before it only, and not on the other texts.  Bits
beyond the first depend on the anchor and the unit only, so a task works them out
once for each such pair.

*Bytes after an escape* are predicted by hashed contexts of the last 1, 2, 3 or 5 bytes of
the unit, or all of them, mixed in the same way.  They depend on the unit alone,
so a task works out each distinct unit once; with a share of ``AGAIN`` the unit is one
that was spelled in the text before.

Everything is counted over all training texts in Spark: units exactly, contexts in
tables that tasks fill and Spark adds up block by block.  The base score needs each
word's exact count: the ``MOST_WORDS`` most frequent are sent to the tasks, words beyond
are joined with the whole table, so that bound touches speed only.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import most_frequent, staged
from .textscan import _SALTS, NOT_SPACE, Text, byte_slices, hash_ranges, mix, range_hasher, text_of, words_of

#: Units with a code of their own, at most; others are spelled.
CODED = 1 << 17
#: Frequent units that may mark what kind of text this is.
ANCHORS = 32
#: Bits of a code that contexts of units before predict.
HEAD = 6
#: Units between two refinements of a text's weights.
CHUNK = 64
#: Slots of the table of contexts across units, as a power of two: the least and the most.
LEAST_BITS, MOST_BITS = 16, 24
#: Training tokens and distinct units below which the mixers take each slice of texts or units more than once.
FEW_TOKENS, FEW_UNITS = 1_000_000, 120_000
CONTEXTS = (1, 2, 3, 5, 0)
TABLE_BITS = 23
BLOCK_SLOTS = 4096
#: Words whose counts are sent to tasks, at most; the bound touches speed only.
MOST_WORDS = 1 << 20
_U = np.uint64
_STRETCH = 16.0
_FINE = 64
_LOSS = np.logaddexp(0, np.arange(-12 * _FINE, 12 * _FINE + 1) / _FINE)
_UNIT_BYTES = 8_000
#: Bytes of text whose bits are looked at at once.
SLICE_BYTES = 1 << 19
#: Units whose scores a worker keeps, at most.
MOST_KNOWN = 1 << 18
#: The share of units spelled that are taken to be one spelled before in the text.
AGAIN = 0.25
_DEPTHS = 12
#: Units whose first bits are one step of the mixers' learning, and the most occurrences of a pair of anchor and unit that are one.
STEP_UNITS, STEP_TIMES, STEP_LATER = 667, 100, 16_000
#: Pairs of anchor and unit whose bits are looked at at once.
PAIRS_AT_ONCE = 1 << 14
_RATE = 0.02


def unit_text(text: Text) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray]:
    """The rows as words with a space after each and byte 0xFF at the end; begin and end of every unit; the first unit of every row."""
    words = words_of(text)
    count = np.diff(words.first)
    lengths = np.zeros(len(words.start) + len(count), dtype=np.int64)
    ends = words.first[1:] + np.arange(len(count))  # where the rows' end units stand among all units
    is_word = np.ones(len(lengths), dtype=bool)
    is_word[ends] = False
    lengths[is_word] = words.end - words.start
    lengths += 1
    stop = np.cumsum(lengths)
    data = np.full(int(stop[-1]) if len(stop) else 0, 32, dtype=np.uint8)
    data[stop[ends] - 1] = 0xFF
    inside = np.ones(len(data), dtype=bool)
    inside[stop - 1] = False
    data[inside] = text.data[NOT_SPACE[text.data]]
    first = np.concatenate(([0], ends + 1))
    offsets = np.concatenate(([0], stop))[first]
    return Text(data, offsets), stop - lengths, stop, first


def _gathered(text: Text, start: np.ndarray, end: np.ndarray) -> Text:
    """The byte ranges one after the other, as rows."""
    lengths = end - start
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1] - start, lengths)
    return Text(text.data[at], offsets)


_SPREAD = _U(0xC2B2AE3D27D4EB4F)
_ALL_BYTES, _SHIFTS = np.arange(256, dtype=np.uint64)[:, None], np.arange(8, dtype=np.uint64)
#: By byte: its eight bits, and marks of what stands before each of them; slots of one context and one half of a byte are neighbours, which spares memory's time.
_BYTE_BITS = (_ALL_BYTES >> (_U(7) - _SHIFTS) & _U(1)).astype(np.int32)
_BYTE_MARKS = np.where(_SHIFTS < 4, mix(_SALTS[22:23]), mix(_ALL_BYTES >> _U(4)))
_BYTE_MARKS += (_U(1) << _SHIFTS % _U(4) | (_ALL_BYTES >> (_U(8) - _SHIFTS)) & (_U(1) << _SHIFTS % _U(4)) - _U(1)) << _U(64 - TABLE_BITS)


def bit_slots(units: Text) -> tuple[np.ndarray, np.ndarray]:
    """Table slots by context, byte and bit, and the bits by byte and bit, of units that are rows of ``units``."""
    n = len(units.data)
    begin = np.repeat(units.offsets[:-1], np.diff(units.offsets))
    place = np.arange(n)
    marks = _BYTE_MARKS.take(units.data, axis=0)
    slots = np.empty((len(CONTEXTS), n, 8), dtype=np.uint64)
    hashed = range_hasher(units)
    for k, size in enumerate(CONTEXTS):
        context = (hashed(np.maximum(begin, place - size) if size else begin, place) + _SALTS[k]) * _SPREAD
        np.add(context[:, None], marks, out=slots[k])
    slots >>= _U(64 - TABLE_BITS)
    return slots.view(np.int64), _BYTE_BITS.take(units.data, axis=0)


def _stretched(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + 0.2) / (zeros + 0.2)), -7.9, 7.9)


def _level(n: np.ndarray) -> np.ndarray:
    """How often a context was seen, in eight levels."""
    return np.minimum(np.ceil(np.log2(np.maximum(n, 0) + 1.0)), 7).astype(np.uint8)


def _seen_level(n: np.ndarray) -> np.ndarray:
    """How often a context was seen, in four levels: never, once, up to four times, more."""
    return (n > 0).astype(np.int8) + (n > 1) + (n > 4)


#: By count: both kinds of levels (those of more are the last one's).
_LEVELS = _level(np.arange(129))
_SEEN_LEVELS = _seen_level(np.arange(6))


_LITTLE, _MOST_STRETCH = np.float32(0.2), np.float32(7.9)


def _without_own(counts: np.ndarray, slots: np.ndarray, bit: np.ndarray, levels: np.ndarray = _SEEN_LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Prediction and level of each bit by the counts (two for each slot, of 16 bits as a rule) without this occurrence."""
    if counts.dtype == np.uint16:  # both at once
        both = counts.view("<i4").reshape(-1).take(slots)
        ones, zeros = both >> 16 & 0xFFFF, both & 0xFFFF
    else:
        zeros, ones = np.moveaxis(np.minimum(counts[slots], 65535), -1, 0).astype(np.int32)
    ones -= bit
    zeros += bit - np.int32(1)
    np.maximum(ones, 0, out=ones)
    np.maximum(zeros, 0, out=zeros)
    ratio = (ones.astype(np.float32) + _LITTLE) / (zeros.astype(np.float32) + _LITTLE)
    ones += zeros
    np.clip(np.log(ratio, out=ratio), -_MOST_STRETCH, _MOST_STRETCH, out=ratio)
    if levels is _SEEN_LEVELS:
        return ratio, (ones > 0).view(np.int8) + (ones > 1) + (ones > 4)
    return ratio, levels.take(ones, mode="clip")


def _gates(levels: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which weights the two mixers of bytes take: levels of the longest and a middle context; level of the five bytes and place of the bit."""
    return levels[-1].astype(np.int64) * 8 + levels[2], levels[-2].astype(np.int64) * 8 + nodes


def _errors(stretch: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """By how much each bit is above what was predicted."""
    p = np.exp(-np.clip(stretch, -20, 20))
    p += np.float32(1)
    return np.subtract(bit, np.reciprocal(p, out=p), dtype=np.float32)


def _dot(inputs: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    if weights.shape[1] == 4 and weights.dtype == np.float32:  # 16 bytes at once
        rows = weights.take(gate, axis=0)
        out = rows[:, 0] * inputs[0]
        out += rows[:, 3]
        for k in (1, 2):
            out += rows[:, k] * inputs[k]
        return out
    columns = np.ascontiguousarray(weights.T)
    out = columns[-1].take(gate)
    for k in range(len(inputs)):
        out += columns[k].take(gate) * inputs[k]
    return out


def first_byte_weights() -> list[np.ndarray]:
    mixers = [np.full((64, len(CONTEXTS) + 1), 1.0 / len(CONTEXTS)) for _ in range(2)]
    for m in mixers:
        m[:, -1] = 0
    return mixers


def fit_mixers(counts: np.ndarray, units: Text, n: np.ndarray, mixers: list[np.ndarray], seen_bits: list[np.ndarray], rate: float = 0.02) -> None:
    """One pass of the two mixers over units in order, each as often as ``n`` says; a unit is taken out of the counts that predict it once.  ``seen_bits``: how many bits each gate has had."""
    for begin in range(0, len(units), 400):
        rows = np.arange(begin, min(begin + 400, len(units)))
        part = _gathered(units, units.offsets[rows], units.offsets[rows + 1])
        slots, bits = bit_slots(part)
        truth = bits.reshape(-1)
        inputs, levels = _without_own(counts, slots.reshape(len(CONTEXTS), -1), truth, _LEVELS)
        places = np.tile(np.arange(8), len(part.data))
        weight = np.repeat(n[rows].astype(np.float32), np.diff(part.offsets) * 8)
        for mixer, total, gate in zip(mixers, seen_bits, _gates(levels, places), strict=True):
            error = weight * _errors(_dot(inputs, mixer.astype(np.float32), gate), truth)
            share = np.bincount(gate, weight, 64)
            total += share
            share = np.sqrt(np.maximum(share, 1.0))
            for k in range(len(CONTEXTS)):
                mixer[:, k] += rate * np.bincount(gate, error * inputs[k], 64) / share
            mixer[:, -1] += rate * np.bincount(gate, error, 64) / share


def learned(rows: DataFrame, first: list[np.ndarray], over: Callable[[Iterator[pa.RecordBatch], list[np.ndarray], list[np.ndarray]], None]) -> list[np.ndarray]:
    """Mixers learned from all rows: each task learns online from its own (``over`` changes the mixers and the counts of their gates' bits), and each gate's weights are averaged by its bits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers, seen = [m.copy() for m in first], [np.zeros(len(m)) for m in first]
        over(batches, mixers, seen)
        for k, (mixer, bits) in enumerate(zip(mixers, seen, strict=True)):
            if bits.any():
                whole = np.column_stack((mixer * bits[:, None], bits))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([whole.tolist()], pa.list_(pa.list_(pa.float64())))], ["mixer", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.array(one) for one in sorted(group.column("sums").to_pylist()))
        return pa.table({"mixer": group.column("mixer").slice(0, 1), "sums": pa.array([total.tolist()], pa.list_(pa.list_(pa.float64())))})

    schema = "mixer int, sums array<array<double>>"
    out = [m.copy() for m in first]
    for row in rows.mapInArrow(scan, schema).groupBy("mixer").applyInArrow(add, schema).collect():  # a row for each mixer
        sums = np.array(row["sums"])
        had = sums[:, -1] > 0
        out[row["mixer"]][had] = sums[had, :-1] / sums[had, -1:]
    return out


class Speller:
    """Stretched predictions and levels of all slots (a slot has both in 16 bits), and the mixers' weights."""

    def __init__(self, counts: np.ndarray, mixers: list[np.ndarray]) -> None:
        self.slots = np.empty(len(counts), dtype=np.int16)
        for begin in range(0, len(counts), 1 << 18):
            part = counts[begin : begin + (1 << 18)].astype(np.float64)
            stretch = np.round(_stretched(part[:, 1], part[:, 0]) * _STRETCH).astype(np.int16)
            self.slots[begin : begin + len(part)] = stretch * 8 + _level(part.sum(axis=1))
        # both mixers' weights at once, by level of the longest, of a middle context and of the five bytes, and place of the bit
        gates = np.arange(8**4)
        levels = [np.zeros(0, dtype=np.int64)] * len(CONTEXTS)
        levels[-1], levels[2], levels[-2] = gates >> 9, gates >> 6 & 7, gates >> 3 & 7
        whole = sum(m[g] for m, g in zip(mixers, _gates(levels, gates & 7), strict=True)) / 2
        self.weights = (whole / np.append(np.full(len(CONTEXTS), _STRETCH), 1.0)).astype(np.float32)
        self.forget()

    def forget(self) -> None:
        self.known, self.scores = np.zeros(0, dtype=np.uint64), np.zeros(0)

    def distinct_scores(self, hashes: np.ndarray, units: Units, which: np.ndarray) -> np.ndarray:
        """Natural log probability of distinct units, ``which`` of ``units``, in order of their hashes; those of the worker's last ``MOST_KNOWN`` are kept."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), dtype=bool)
        out = np.empty(len(hashes))
        out[~new] = self.scores[at[~new]] if len(self.known) else 0
        if new.any():
            out[new] = self.unit_scores(units.spelled(which[new]))
            if len(self.known) > MOST_KNOWN:
                self.forget()
            place = np.searchsorted(self.known, hashes[new])
            self.known, self.scores = np.insert(self.known, place, hashes[new]), np.insert(self.scores, place, out[new])
        return out

    def unit_scores(self, units: Text) -> np.ndarray:
        """Natural log probability of each row of ``units``."""
        out = np.zeros(len(units))
        begin = 0
        while begin < len(units):
            end = max(begin + 1, int(np.searchsorted(units.offsets, units.offsets[begin] + _UNIT_BYTES, side="right")) - 1)
            part = Text(units.data[units.offsets[begin] : units.offsets[end]], units.offsets[begin : end + 1] - units.offsets[begin])
            slots, bits = bit_slots(part)
            both = self.slots.take(slots.reshape(len(CONTEXTS), -1))
            gate = np.tile(np.arange(8, dtype=np.int16), len(part.data))
            for k, shift in ((-1, 9), (2, 6), (-2, 3)):
                gate += (both[k] & np.int16(7)) << np.int16(shift)
            both >>= 3
            stretch = _dot(both.astype(np.float32), self.weights, gate.astype(np.int64))
            stretch = np.rint(np.clip(stretch, -12, 12) * _FINE).astype(np.int64)  # one value for both bits, so they sum to one
            loss = _LOSS.take(stretch * (1 - 2 * bits.reshape(-1)) + 12 * _FINE)
            sums = np.concatenate(([0], np.cumsum(loss)))[::8]
            out[begin:end] = -(sums[part.offsets[1:]] - sums[part.offsets[:-1]])
            begin = end
        return out


class Code:
    """A Huffman code of the units of ``hashes`` (with their counts) and of the escape, which is number ``len(self.hashes)``.

    Units are numbered by hash; a unit's bits are ``bits[start[k]:start[k + 1]]``, predicted at the inner ``nodes`` of the tree.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, escapes: int) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        n = len(hashes) + 1
        heap = sorted((int(c), k) for k, c in enumerate([*self.counts.tolist(), max(1, escapes)]))
        up: dict[int, tuple[int, int]] = {}
        inner = n
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            up[left], up[right] = (inner, 0), (inner, 1)
            heapq.heappush(heap, (a + b, inner))
            inner += 1
        nodes: list[int] = []
        bits: list[int] = []
        start = [0]
        for k in range(n):
            path = []
            while k in up:
                k, bit = up[k]
                path.append((k - n, bit))
            nodes += [node for node, _ in reversed(path)]
            bits += [bit for _, bit in reversed(path)]
            start.append(len(nodes))
        self.n_nodes = max(1, n - 1)
        self.start, self.nodes, self.bits = np.array(start), np.array(nodes, dtype=np.int32), np.array(bits, dtype=np.uint8)
        #: How many of the first ``HEAD`` bits each unit has, and these after a 1 (with zeros for those that a shorter code lacks).
        self.head_length, self.head = np.minimum(np.diff(self.start), HEAD), np.ones(n, dtype=np.int64)
        #: The node by the bits before it after a 1; marks of nodes, and places after them: slots of one context and three bits are neighbours, which spares memory's time.
        self.head_nodes, used = np.zeros(1 << HEAD, dtype=np.int64), np.zeros(1 << HEAD, dtype=bool)
        for depth in range(HEAD):
            some = np.flatnonzero(self.head_length > depth)
            before, at = self.head[some], self.start[some] + depth
            self.head_nodes[before], used[before] = self.nodes[at], True
            self.head *= 2
            self.head[some] += self.bits[at]
        before = np.arange(1 << HEAD)
        depth = np.array([max(0, k.bit_length() - 1) for k in before.tolist()])
        self.marks, self.places = np.zeros(self.n_nodes, dtype=np.uint64), np.zeros(self.n_nodes, dtype=np.uint64)
        some = np.flatnonzero(used)
        self.marks[self.head_nodes[some]] = mix((before >> depth % 3).astype(np.uint64) * (depth >= 3) + _SALTS[20])[some]
        self.places[self.head_nodes[some]] = (1 << depth % 3 | before & (1 << depth % 3) - 1)[some]
        #: Where the units whose hashes begin alike begin.
        self.index_bits = max(1, int(2 * len(self.hashes)).bit_length())
        self.index = np.searchsorted(self.hashes >> _U(64 - self.index_bits), np.arange(1 << self.index_bits, dtype=np.uint64))
        #: The most frequent units, which can be anchors, and the share of each among them.
        top = np.lexsort((self.hashes, -self.counts))[:ANCHORS]
        self.anchor = np.full(n, -1, dtype=np.int64)
        self.anchor[top] = np.arange(len(top))
        self.share = self.counts[top] / max(1, int(self.counts[top].sum()))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.hashes) == 0:
            return np.zeros(len(hashes), dtype=np.int64)
        last = len(self.hashes) - 1
        at = self.index.take((hashes >> _U(64 - self.index_bits)).view(np.int64))
        np.minimum(at, last, out=at)
        here = self.hashes.take(at)
        found = here == hashes
        more = np.flatnonzero((here < hashes) & (at < last))
        while len(more):  # a few units begin alike, in order
            at[more] += 1
            here, wanted = self.hashes.take(at[more]), hashes[more]
            found[more] = here == wanted
            more = more[(here < wanted) & (at[more] < last)]
        return np.where(found, at, last + 1)

    def spread(self, numbers: np.ndarray, begin: int = 0, end: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each bit from ``begin`` to ``end`` of each unit's code in order: which unit, how deep, at which node, and the bit."""
        first = self.start[numbers] + begin
        lengths = np.maximum(np.minimum(self.start[numbers + 1], self.start[numbers] + end) - first, 0)
        unit = np.repeat(np.arange(len(numbers), dtype=np.int32), lengths)
        nth = np.arange(len(unit)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(first, lengths) + nth
        return unit, np.minimum(nth + begin, _DEPTHS - 1), self.nodes[at], self.bits[at]


class Units:
    """The units of some rows with their contexts."""

    def __init__(self, plain: Text, code: Code) -> None:
        words = words_of(plain)
        rows = np.arange(len(plain))
        ends = words.first[1:] + rows  # where the rows' end units stand among all units
        is_word = np.ones(len(words.start) + len(plain), dtype=bool)
        is_word[ends] = False
        self.data, self.is_word, self.first = plain.data, is_word, np.concatenate(([0], ends + 1))
        self.start, self.end, self.hashes = (np.zeros(len(is_word), dtype=kind) for kind in (np.int64, np.int64, np.uint64))  # the end's hash is that of no bytes
        self.start[is_word], self.end[is_word], self.hashes[is_word] = words.start, words.end, words.hashes
        self.row = np.repeat(rows, np.diff(self.first))
        self.place = np.arange(len(self.hashes)) - self.first[self.row]
        self.number = code.numbers(self.hashes)
        byte = [np.where(self.end - k >= self.start, plain.data.take(self.end - k, mode="clip"), 0).astype(np.uint64) * is_word for k in (1, 2, 3)] if len(plain.data) else [np.zeros(len(is_word), dtype=np.uint64)] * 3
        two = byte[0] | byte[1] << _U(8)
        often = np.append(code.counts >= 16, False)[self.number]
        own = np.where(often, self.hashes, two | byte[2] << _U(16))
        before, twice = self._before(two, 1), self._before(two, 2)
        self.contexts = (mix(self._before(own, 1) + _SALTS[24]), mix((before | twice << _U(16)) + _SALTS[25]))
        self.chunk = self.place // CHUNK
        self.anchor = self._anchors(code)

    def n_bytes(self) -> np.ndarray:
        """Bytes of each row's units: words with a space each, and the end."""
        return np.bincount(self.row, self.end - self.start + 1, len(self.first) - 1).astype(np.int64)

    def spelled(self, which: np.ndarray) -> Text:
        """The bytes of some units, as rows."""
        lengths = self.end[which] - self.start[which]
        offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        data = np.full(int(offsets[-1]), 32, dtype=np.uint8)
        data[offsets[1:] - 1] = np.where(self.is_word[which], 32, 0xFF)
        inside = np.ones(len(data), dtype=bool)
        inside[offsets[1:] - 1] = False
        data[inside] = self.data[np.repeat(self.start[which] - np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths) + np.arange(int(lengths.sum()))]
        return Text(data, offsets)

    def _before(self, values: np.ndarray, k: int) -> np.ndarray:
        """Each unit's value ``k`` units earlier; that of none at a row's begin."""
        out = np.zeros_like(values)
        out[k:] = np.where(self.place[k:] >= k, values[:-k], 0) if len(values) > k else out[k:]
        return out

    def _anchors(self, code: Code) -> np.ndarray:
        """For each unit the anchor that stands out most in the row's chunks before its own; ``ANCHORS`` if none has come yet."""
        parts = -(-np.diff(self.first) // CHUNK)
        begin = np.concatenate(([0], np.cumsum(parts)))
        own = begin[self.row] + self.chunk
        anchor = code.anchor[self.number]
        some = np.flatnonzero(anchor >= 0)
        seen = np.bincount((own[some] + 1) * ANCHORS + anchor[some], minlength=(int(begin[-1]) + 1) * ANCHORS).reshape(-1, ANCHORS)
        sums = np.cumsum(seen, axis=0)[:-1]  # up to each chunk, its own left out
        sums = sums - np.repeat(sums[begin[:-1]], parts, axis=0) if len(parts) else sums
        total = sums.sum(axis=1, keepdims=True)
        expected = total * np.pad(code.share, (0, ANCHORS - len(code.share)))[None, :]
        best = ((sums - expected) / np.sqrt(expected + 1)).argmax(axis=1) if len(sums) else np.zeros(0, dtype=np.int64)
        return np.where(total[:, 0] > 0, best, ANCHORS)[own] if len(own) else own


def _head_marks(code: Code, bits: int, node: np.ndarray) -> np.ndarray:
    """What is added to a context's hash so that its first ``bits`` bits are a slot of the table of contexts."""
    return code.marks[node] + (code.places[node] << _U(64 - bits))


def _near_slots(code: Code, node: np.ndarray, anchor: np.ndarray) -> list[np.ndarray]:
    """Where the counts of bits stand without context, and by anchor; one table holds all counts, one kind after the other."""
    return [node.astype(np.int64), (anchor + 1) * code.n_nodes + node]


def _code_slots(units: Units, code: Code, bits: int, unit: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """Where the counts of the first bits of codes stand: by anchor, and by the contexts of units before."""
    marks, base = _head_marks(code, bits, node), (ANCHORS + 2) * code.n_nodes
    return _near_slots(code, node, units.anchor[unit])[1:] + [base + (context[unit] + marks >> _U(64 - bits)).astype(np.int64) for context in units.contexts]


def table_slots(code: Code, bits: int) -> int:
    return (ANCHORS + 2) * code.n_nodes + (1 << bits)


def _merged_blocks(rows: DataFrame, n_slots: int, most: int = 65535) -> np.ndarray:
    """Counts of bits 0 and 1 of all slots, with their ratio kept up to ``most``: tables of tasks (``block``, ``scale``, ``counts``) added up block by block in Spark."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros((BLOCK_SLOTS, 2), dtype=np.int64)
        for scale, counts in zip(group.column("scale").to_pylist(), group.column("counts"), strict=True):
            total += np.frombuffer(counts.as_buffer(), dtype=np.uint16).reshape(-1, 2).astype(np.int64) * scale
        small = total / np.maximum(1.0, total.max(axis=1, keepdims=True) / most)
        return pa.table({"block": group.column("block").slice(0, 1), "counts": pa.array([np.round(small).astype(np.uint16).tobytes()], pa.binary())})

    out = np.zeros((-(-n_slots // BLOCK_SLOTS) * BLOCK_SLOTS, 2), dtype=np.uint16)
    for row in rows.groupBy("block").applyInArrow(add, "block int, counts binary").toLocalIterator():  # n_slots in all
        out[row["block"] * BLOCK_SLOTS : (row["block"] + 1) * BLOCK_SLOTS] = np.frombuffer(row["counts"], dtype=np.uint16).reshape(-1, 2)
    return out


def _blocks_of(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    blocks = counts.reshape(-1, 2 * BLOCK_SLOTS)
    for k in np.flatnonzero(blocks.any(axis=1)).tolist():
        scale = int(blocks[k].max()) // 65535 + 1  # 1, unless a slot of the block is very frequent
        small = np.round(blocks[k] / scale).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([scale], pa.int64()), pa.array([small.tobytes()], pa.binary())], ["block", "scale", "counts"])


def _pair_numbers(units: Units, code: Code) -> np.ndarray:
    """A number for each unit's anchor and the unit itself, below ``_n_pairs``."""
    return units.anchor * len(code.start) + units.number


def _n_pairs(code: Code) -> int:
    return (ANCHORS + 1) * len(code.start)


def add_contexts(counts: np.ndarray, units: Units, code: Code, bits: int, pairs: np.ndarray | None = None) -> None:
    """Count the bits of codes in all contexts; ``counts`` (int32) has two places for each slot.  ``pairs`` (int32) that is given counts anchors with units instead, for :func:`add_pairs`."""
    numbers = _pair_numbers(units, code)
    if pairs is None:
        add_pairs(counts, code, *np.unique(numbers, return_counts=True))
    else:
        np.add.at(pairs, numbers, np.int32(1))
    head, base = code.head.take(units.number), (ANCHORS + 2) * code.n_nodes
    length = code.head_length.take(units.number)
    contexts, head_marks = units.contexts, _head_marks(code, bits, code.head_nodes)
    for depth in range(HEAD):
        some = np.flatnonzero(length > depth)
        if len(some) < len(head):
            head, length, contexts = head[some], length[some], [context[some] for context in contexts]
        marks, bit = head_marks.take(head >> HEAD - depth), (head >> HEAD - 1 - depth & 1) + 2 * base
        for context in contexts:
            slots = (context + marks >> _U(64 - bits)).view(np.int64)
            slots *= 2
            slots += bit
            np.add.at(counts, slots, np.int32(1))


def add_pairs(counts: np.ndarray, code: Code, pairs: np.ndarray, n: np.ndarray) -> None:
    """Count the bits of codes without context and by anchor."""
    for begin in range(0, len(pairs), PAIRS_AT_ONCE):
        part, often = pairs[begin : begin + PAIRS_AT_ONCE], n[begin : begin + PAIRS_AT_ONCE].astype(np.int32)
        unit, _, node, bit = code.spread(part % len(code.start))
        often = often[unit]
        for slots in _near_slots(code, node, (part // len(code.start))[unit]):
            np.add.at(counts, slots * 2 + bit, often)


def count_contexts(training: DataFrame, code: Code, bits: int) -> np.ndarray:
    """The counts of the bits of codes in all contexts over all rows' ``text``.

    A task fills a table of its own, so it takes several splits of the input where
    there are many: the tables that are shuffled are fewer than the splits.
    """
    spark = training.sparkSession
    splits, cores = training.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    held, n_slots = spark.sparkContext.broadcast(code), table_slots(code, bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, counts, pairs = held.value, None, None
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                if counts is None:
                    counts, pairs = np.zeros(2 * (-(-n_slots // BLOCK_SLOTS) * BLOCK_SLOTS), dtype=np.int32), np.zeros(_n_pairs(code), dtype=np.int32)
                add_contexts(counts, Units(text_of(part.column("text"), lower=True), code), code, bits, pairs)
        if counts is not None:
            some = np.flatnonzero(pairs)
            add_pairs(counts, code, some, pairs[some])
            del pairs, some
            yield from _blocks_of(counts)

    rows = training.coalesce(max(1, min(splits, max(cores, splits // 16)))).mapInArrow(scan, "block int, scale long, counts binary")
    return _merged_blocks(rows, n_slots)


def count_spellings(units: DataFrame) -> np.ndarray:
    """The counts of bits of bytes in all contexts within units; ``n`` is a unit's weight."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            rows, n = _binary_rows(batch.column("unit")), batch.column("n").to_numpy()
            counts = np.zeros(2 << TABLE_BITS, dtype=np.int32) if counts is None else counts
            begin = 0
            while begin < len(rows):
                end = max(begin + 1, int(np.searchsorted(rows.offsets, rows.offsets[begin] + _UNIT_BYTES, side="right")) - 1)
                part = Text(rows.data[rows.offsets[begin] : rows.offsets[end]], rows.offsets[begin : end + 1] - rows.offsets[begin])
                slots, bits = bit_slots(part)
                weight = np.repeat(np.repeat(n[begin:end], np.diff(part.offsets)), 8).astype(np.int32)
                for k in range(len(CONTEXTS)):
                    np.add.at(counts, (slots[k] * 2 + bits).reshape(-1), weight)
                begin = end
        if counts is not None:
            yield from _blocks_of(counts)

    return _merged_blocks(units.mapInArrow(scan, "block int, scale long, counts binary"), 1 << TABLE_BITS)


_INPUTS = 3


def _code_gates(levels: list[np.ndarray], depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which weights the mixers of codes take: levels of the two contexts of units before; depth in the code and level of the anchor's."""
    return levels[1].astype(np.int64) * 4 + levels[2], depth * 4 + levels[0]


_GATES = (16, 4 * _DEPTHS)


def first_weights() -> list[np.ndarray]:
    """Of both mixers of the first bits, and of that of the others, which has two inputs."""
    shapes = [(n, _INPUTS + 1) for n in _GATES] + [(_GATES[1], 3)]
    out = [np.full(shape, 1.4 / (shape[1] - 1)) for shape in shapes]
    for weights in out:
        weights[:, -1] = 0
    return out


def fit_code_mixers(
    counts: np.ndarray, code: Code, bits: int, column: pa.Array, rounds: int = 3, mixers: list[np.ndarray] | None = None, seen: list[np.ndarray] | None = None, pairs: np.ndarray | None = None
) -> list[np.ndarray]:
    """The weights of the mixers, learned online from all units of some texts; ``mixers`` that are given go on.  ``seen``: how many bits each gate has had.

    ``pairs`` (int32) that is given counts anchors with units, and the mixer of the bits
    beyond the first waits for :func:`fit_later_bits`.
    """
    both, other, tail = mixers = first_weights() if mixers is None else mixers
    units = Units(text_of(column, lower=True), code)
    heads, bit, gates = _head_bits(counts, code, bits, units)
    wide = [np.vstack((m, np.zeros(m.shape[1]))) for m in (both, other)]
    for _ in range(rounds):
        _learn(heads, bit, list(zip(wide, gates, strict=True)), None, HEAD * STEP_UNITS)
    for m, w in zip((both, other), wide, strict=True):
        m[:] = w[:-1]
    if seen is not None:
        for total, gate in zip(seen, gates, strict=False):
            total += np.bincount(gate, minlength=len(total) + 1)[:-1]
    numbers = _pair_numbers(units, code)
    if pairs is None:
        fit_later_bits(counts, code, *np.unique(numbers, return_counts=True), rounds, tail, None if seen is None else seen[2])
    else:
        np.add.at(pairs, numbers, np.int32(1))
    return mixers


def _head_bits(counts: np.ndarray, code: Code, bits: int, units: Units) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Inputs, bits and both gates of the first bits of codes, by the counts without each occurrence.

    ``HEAD`` bits for each unit; those that a shorter code lacks have no inputs and a gate
    of their own, the last.  ``STEP_UNITS`` units follow one after the other, bit by bit each.
    """
    n, base = len(units.number), (ANCHORS + 2) * code.n_nodes
    inputs, bit = np.empty((_INPUTS, n * HEAD), dtype=np.float32), np.empty(n * HEAD, dtype=np.float32)
    gates = [np.empty(n * HEAD, dtype=np.int64) for _ in _GATES]
    whole = n // STEP_UNITS * STEP_UNITS

    def put(out: np.ndarray, depth: int, values: np.ndarray) -> None:
        out[: whole * HEAD].reshape(-1, HEAD, STEP_UNITS)[:, depth] = values[:whole].reshape(-1, STEP_UNITS)
        out[whole * HEAD :].reshape(HEAD, -1)[depth] = values[whole:]

    head = code.head.take(units.number)
    length = code.head_length.take(units.number)
    contexts, head_marks = units.contexts, _head_marks(code, bits, code.head_nodes)
    # by anchor, node and bit there are some thousand cases
    near = _near_slots(code, code.head_nodes[None, :], np.arange(ANCHORS + 1)[:, None])[1].reshape(-1)
    by_anchor = [np.concatenate(x) for x in zip(*(_without_own(counts, near, np.full(len(near), b, dtype=np.int32)) for b in (0, 1)), strict=True)]
    anchor = units.anchor << HEAD
    for depth in range(HEAD):
        own, case = head >> HEAD - 1 - depth & 1, head >> HEAD - depth
        marks, now = head_marks.take(case), own.astype(np.int32)
        own *= len(near)
        case += own
        case += anchor
        seen = [by_anchor[1].take(case)]
        values = [by_anchor[0].take(case)]
        for context in contexts:
            slots = (context + marks >> _U(64 - bits)).view(np.int64)
            slots += base
            value, level = _without_own(counts, slots, now)
            values.append(value)
            seen.append(level)
        both = [seen[1] * np.int8(4) + seen[2], seen[0] + np.int8(4 * depth)]
        lacking = np.flatnonzero(length <= depth)
        if len(lacking):
            for x in values:
                x[lacking] = 0
            for gate, n_gates in zip(both, _GATES, strict=True):
                gate[lacking] = n_gates
        for out, x in zip((*inputs, bit, *gates), (*values, now, *both), strict=True):
            put(out, depth, x)
    return inputs, bit, gates


def fit_later_bits(counts: np.ndarray, code: Code, pairs: np.ndarray, n: np.ndarray, rounds: int, tail: np.ndarray, seen: np.ndarray | None) -> None:
    """The mixer of bits beyond the first, which depend on the anchor and the unit only: each such pair is looked at once, with all its occurrences."""
    parts = -(-n // STEP_TIMES)  # of very frequent ones some thousand occurrences are several steps
    pairs, n = np.repeat(pairs, parts), np.repeat(n / parts, parts)
    order = np.argsort(mix(pairs.astype(np.uint64) + _SALTS[21] * np.arange(len(pairs), dtype=np.uint64)))  # not anchor by anchor: the last ones would weigh most
    for k in range(rounds):
        for begin in range(0, len(order), PAIRS_AT_ONCE):
            part = order[begin : begin + PAIRS_AT_ONCE]
            unit, depth, node, bit = code.spread(pairs[part] % len(code.start), HEAD)
            bit = bit.astype(np.int32)
            inputs = np.empty((2, len(bit)), dtype=np.float32)
            for i, slots in enumerate(_near_slots(code, node, (pairs[part] // len(code.start))[unit])):
                inputs[i], level = _without_own(counts, slots, bit)
            gate, often = depth * 4 + level, n[part][unit].astype(np.float32)
            _learn(inputs, bit, [(tail, gate)], often, STEP_LATER)
            if seen is not None and k == 0:
                seen += np.bincount(gate, often, len(seen))


def _learn(inputs: np.ndarray, bit: np.ndarray, mixers: list[tuple[np.ndarray, np.ndarray]], often: np.ndarray | None = None, step: int = 4000) -> None:
    """One pass over bits in order, ``step`` at a time; each stands for as many as ``often`` says."""
    edges = np.arange(0, len(bit), step) if often is None else np.flatnonzero(np.diff(np.cumsum(often, dtype=np.float64) // step, prepend=-1.0))
    for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(bit)], strict=False):
        part = slice(begin, end)
        stretch = sum(_dot(inputs[:, part], m.astype(np.float32), g[part]) for m, g in mixers) / np.float32(len(mixers))
        error = _errors(stretch, bit[part])
        times = None if often is None else often[part]
        for mixer, gate in mixers:
            _refine(mixer, error if times is None else error * times, inputs[:, part], gate[part], times)


def _refine(weights: np.ndarray, error: np.ndarray, inputs: np.ndarray, gate: np.ndarray, often: np.ndarray | None = None) -> None:
    """A step of each gate's weights along its summed errors, shortened where there are many."""
    share = _RATE / np.sqrt(np.maximum(np.bincount(gate, often, len(weights)), 1.0))
    for k in range(len(inputs)):
        weights[:, k] += share * np.bincount(gate, error * inputs[k], len(weights))
    weights[:, -1] += share * np.bincount(gate, error, len(weights))


class CodeModel:
    """Stretched predictions and levels of all slots of codes (a slot has both in 16 bits), and the mixers' first weights."""

    def __init__(self, counts: np.ndarray, code: Code, bits: int, mixers: list[np.ndarray]) -> None:
        self.code, self.bits = code, bits
        self.mixers = [m.astype(np.float32) for m in mixers]
        self.later: np.ndarray | None = None
        self.slots = np.empty(len(counts), dtype=np.int16)
        for begin in range(0, len(counts), 1 << 18):
            part = counts[begin : begin + (1 << 18)].astype(np.float64)
            stretch = np.round(_stretched(part[:, 1], part[:, 0]) * _STRETCH).astype(np.int16)
            self.slots[begin : begin + len(part)] = stretch * 4 + _seen_level(part.sum(axis=1))

    def _taken(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.slots.take(slots)
        levels = both & np.int16(3)
        both >>= 2
        return both * np.float32(1 / _STRETCH), levels

    def scores(self, units: Units) -> np.ndarray:
        """Natural log probability of each row's codes."""
        n_rows = len(units.first) - 1
        return -(np.bincount(units.row, self._tails(units), n_rows) + self._heads(units, n_rows))

    def _tails(self, units: Units) -> np.ndarray:
        """The loss of each unit's bits after the first; a worker keeps that of each pair of anchor and unit (and 1, so 0 is none yet)."""
        numbers = _pair_numbers(units, self.code)
        if self.later is None:
            self.later = np.zeros(_n_pairs(self.code), dtype=np.float32)
        found = self.later.take(numbers)
        new = np.unique(numbers[found == 0])
        for begin in range(0, len(new), PAIRS_AT_ONCE):
            pairs = new[begin : begin + PAIRS_AT_ONCE]
            unit, depth, node, bit = self.code.spread(pairs % len(self.code.start), HEAD)
            inputs, levels = zip(*map(self._taken, _near_slots(self.code, node, (pairs // len(self.code.start))[unit])), strict=True)
            loss = _losses(_dot(inputs, self.mixers[2], depth * 4 + levels[1]), bit)[0]
            self.later[pairs] = np.bincount(unit, loss, len(pairs)) + 1
        return (self.later.take(numbers) if len(new) else found) - np.float32(1)

    def _heads(self, units: Units, n_rows: int) -> np.ndarray:
        """The loss of each row's first bits: chunk by chunk, for all rows at once, each with weights of its own.  Bits that a shorter code lacks have no inputs, no loss and a gate of their own."""
        chunk = units.chunk
        order = np.argsort(chunk.astype(np.uint16) if len(chunk) and int(chunk.max()) < 1 << 16 else chunk, kind="stable")
        code, n, n_gates = self.code, len(order), _GATES[0] + 1
        edges = np.concatenate(([0], np.cumsum(np.bincount(chunk)))).tolist()
        head, row = code.head.take(units.number.take(order)), units.row.take(order)
        length, anchor = code.head_length.take(units.number.take(order)), units.anchor.take(order) << HEAD
        contexts, head_marks = [context.take(order) for context in units.contexts], _head_marks(code, self.bits, code.head_nodes)
        # what the anchor and the node give: the input, and the second mixer's sum but for the contexts, whose weights follow
        value, level = self._taken(_near_slots(code, code.head_nodes[None, :], np.arange(ANCHORS + 1)[:, None])[1].reshape(-1))
        depth = np.array([0, *(k.bit_length() - 1 for k in range(1, 1 << HEAD))])
        gate = np.tile(depth * 4, ANCHORS + 1) + level
        second = self.mixers[1].take(gate, axis=0)
        by_case = np.column_stack((value, value * second[:, 0] + second[:, 3], second[:, 1:3]))
        slots = self.slots[(ANCHORS + 2) * code.n_nodes :]
        inputs, fixed = np.empty((_INPUTS, HEAD, n), dtype=np.float32), np.empty((HEAD, n), dtype=np.float32)
        bit, gate = np.empty((HEAD, n), dtype=np.int8), np.empty((HEAD, n), dtype=np.int8)
        for k in range(HEAD):
            bit[k], case = head >> HEAD - 1 - k & 1, head >> HEAD - k
            marks = head_marks.take(case)
            case += anchor
            given = by_case.take(case, axis=0)
            inputs[0, k], fixed[k] = given[:, 0], given[:, 1]
            gate[k] = 0
            for i, context in enumerate(contexts):
                both = slots.take((context + marks >> _U(64 - self.bits)).view(np.int64))
                gate[k] = gate[k] * np.int8(4) + (both & np.int16(3)).astype(np.int8)
                both >>= 2
                np.multiply(both, np.float32(1 / _STRETCH), out=inputs[1 + i, k])
                fixed[k] += given[:, 2 + i] * inputs[1 + i, k]
            lacking = np.flatnonzero(length <= k)
            if len(lacking):
                for x in (*inputs[:, k], fixed[k]):
                    x[lacking] = 0
                gate[k][lacking] = _GATES[0]
        weights = np.repeat(np.vstack((self.mixers[0], np.zeros((1, _INPUTS + 1), dtype=np.float32)))[None], n_rows, axis=0)
        loss = np.empty(n)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            fresh = np.concatenate(([True], row[a + 1 : b] != row[a : b - 1]))  # rows stand in order within a chunk
            here, local = row[a:b][fresh], np.cumsum(fresh) - 1
            mine = weights[here].reshape(-1, _INPUTS + 1)
            at = (gate[:, a:b] + (local * n_gates)[None, :]).reshape(-1)
            part, now = inputs[:, :, a:b].reshape(_INPUTS, -1), bit[:, a:b].reshape(-1)
            lost, p = _losses((_dot(part, mine, at) + fixed[:, a:b].reshape(-1)) / np.float32(2), now)
            loss[a:b] = lost.reshape(HEAD, -1).sum(axis=0)
            if b < n:
                _refine(mine, now - p, part, at)
                mine.reshape(-1, n_gates, _INPUTS + 1)[:, -1] = 0
                weights[here] = mine.reshape(-1, n_gates, _INPUTS + 1)
        loss -= (HEAD - length) * float(_losses(np.zeros(1, dtype=np.float32), np.zeros(1, dtype=np.int8))[0][0])
        return np.bincount(row, loss, n_rows)


def _losses(stretch: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each bit, and the probability of a 1."""
    stretch = np.clip(stretch, -12, 12)
    odds = np.exp(-stretch)
    whole = 1 + odds
    return np.log(whole) + stretch * (bit == 0), np.reciprocal(whole)


def count_units(docs: DataFrame) -> DataFrame:
    """``unit`` (bytes) and ``n`` over all rows' ``text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 2 << 20):
                text, start, end, _ = unit_text(text_of(part.column("text"), lower=True))
                _, at, counts = np.unique(hash_ranges(text, start, end), return_index=True, return_counts=True)
                units = _gathered(text, start[at], end[at])
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(units.offsets.astype(np.int64)), pa.py_buffer(units.data)])
                yield pa.RecordBatch.from_arrays([rows.cast(pa.binary()), pa.array(counts.astype(np.int64))], ["unit", "n"])

    return docs.mapInArrow(scan, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _binary_rows(column: pa.Array) -> Text:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return Text(data, offsets - offsets[0])


def _listed(units: Units, which: np.ndarray) -> pa.Array:
    """For each row the distinct ones of some units (in order), and how often each is among them."""
    order = np.lexsort((units.hashes[which], units.row[which]))
    row, hashes = units.row[which][order], units.hashes[which][order]
    fresh = np.ones(len(which), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    begins = np.flatnonzero(fresh)
    raw = units.spelled(which[order[begins]])
    unit = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(raw.offsets.astype(np.int64)), pa.py_buffer(raw.data)]).cast(pa.binary())
    counted = pa.StructArray.from_arrays([unit, pa.array(np.diff(np.append(begins, len(which))))], ["unit", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[begins], np.arange(len(units.first))), pa.int32()), counted)


def _hashed(units: DataFrame, speller: Speller | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (of the bytes but the last, as :class:`Units` has them), counts and log probabilities of spellings of a bounded table of units, by hash."""
    held = units.sparkSession.sparkContext.broadcast(speller)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _binary_rows(batch.column("unit"))
            hashes = hash_ranges(rows, rows.offsets[:-1], rows.offsets[1:] - 1)
            scores = np.zeros(len(rows)) if held.value is None else held.value.unit_scores(rows)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("n"), pa.array(scores)], ["h", "n", "score"])

    found = units.select("unit", "n").mapInArrow(scan, "h long, n long, score double").toArrow()
    hashes = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order], found.column("score").to_numpy()[order]


def context_bits(train_tokens: int) -> int:
    """Eight slots for each training token up to some millions, then with the root of their number, ``1 << MOST_BITS`` at most."""
    level = np.log2(max(train_tokens, 1))
    return int(np.clip(min(level + 3, 21 + max(0, level - 24) / 2), LEAST_BITS, MOST_BITS))


def learn(training: DataFrame, units: DataFrame, train_tokens: int, vocabulary: int) -> tuple[CodeModel, Speller]:
    """Both models from ``training`` (``text``) and its counted units."""
    coded = most_frequent(units.where("n > 1"), "n", CODED)
    hashes, n, _ = _hashed(coded)
    code = Code(hashes, n, train_tokens - int(n.sum()))
    bits = context_bits(train_tokens)
    counts = count_contexts(training, code, bits)
    spark = training.sparkSession
    tables = spark.sparkContext.broadcast((counts, code))
    rounds = 3 if train_tokens < FEW_TOKENS else 1

    def code_mixers(batches: Iterator[pa.RecordBatch], mixers: list[np.ndarray], seen: list[np.ndarray]) -> None:
        counts, code = tables.value
        pairs = np.zeros(_n_pairs(code), dtype=np.int32)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES // 2):
                fit_code_mixers(counts, code, bits, part.column("text"), rounds, mixers, seen, pairs)
        some = np.flatnonzero(pairs)
        fit_later_bits(counts, code, some, pairs[some], rounds, mixers[2], seen[2])

    mixers = learned(training.where("text is not null"), first_weights(), code_mixers)
    tables.destroy()
    # a unit with a code is spelled by no text: it teaches once how units are spelled; others as often as they stand
    least = int(n.min()) if len(n) else 1 << 62
    spelled = units.select("unit", F.when(F.col("n") >= least, 1).otherwise(F.col("n")).cast("long").alias("n"))
    spellings = count_spellings(spelled)
    held = spark.sparkContext.broadcast(spellings)
    passes = min(50, max(1, FEW_UNITS // max(1, vocabulary)))

    def byte_mixers(batches: Iterator[pa.RecordBatch], mixers: list[np.ndarray], seen: list[np.ndarray]) -> None:
        for batch in batches:
            rows, n = _binary_rows(batch.column("unit")), batch.column("n").to_numpy()
            for _ in range(passes):
                fit_mixers(held.value, rows, n, mixers, seen)

    # an order of its own, so that what is learned is the same each time
    dealt = spelled.repartition(vocabulary // 100_000 + 1, "unit").sortWithinPartitions(F.xxhash64("unit"), "unit")
    byte_weights = learned(dealt, first_byte_weights(), byte_mixers)
    held.destroy()
    return CodeModel(counts, code, bits, mixers), Speller(spellings, byte_weights)


def log_probabilities(units: Units, codes: CodeModel, speller: Speller, hot: tuple[np.ndarray, np.ndarray] = (np.zeros(0, dtype=np.uint64), np.zeros(0))) -> np.ndarray:
    """Natural log probability of each row; ``hot``: hashes and log probabilities of spellings worked out already."""
    out = codes.scores(units)
    spelled = np.flatnonzero(units.number == len(codes.code.hashes))
    if len(spelled):
        distinct, at, back = np.unique(units.hashes[spelled], return_index=True, return_inverse=True)
        place, known = _found(hot[0], distinct)
        each = np.empty(len(distinct))
        each[known] = hot[1][place[known]]
        each[~known] = speller.distinct_scores(distinct[~known], units, spelled[at[~known]])
        each = each[back]
        out += np.bincount(units.row[spelled], _or_again(each, back, units.row[spelled]), len(out))
    return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted stand among sorted keys, and whether they do."""
    if len(keys) == 0:
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def _or_again(each: np.ndarray, kind: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Log probabilities of spelled units, each mixed with how often it is among those spelled in its row before."""
    n = len(each)
    place = np.arange(n) - np.searchsorted(row, row)
    order = np.lexsort((np.arange(n), kind, row))
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (kind[order][1:] != kind[order][:-1]) | (row[order][1:] != row[order][:-1])
    begins = np.flatnonzero(fresh)
    before = np.empty(n, dtype=np.int64)
    before[order] = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    share = np.where(place > 0, AGAIN, 0.0)
    return np.logaddexp(each + np.log1p(-share), np.log(share * before / np.maximum(place, 1) + 1e-300))


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte`` for every row of ``docs``.

    Learns from the texts of the rows for which ``held_out`` is false.  Tokens are words (runs
    of anything but ASCII white space) and one end.  A null or empty text has the
    end alone; ``held_out`` null counts as false; repeated rows are each scored;
    other columns do not matter; with nothing to learn from all counts are 0 and
    predictions even.  ``bits_per_byte``: total bits over bytes, the end's counted.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = source.where("not held_out").select("text")
    units = staged(count_units(training), "lm-units")
    # a word is one unit, and all ends are one
    train_tokens, vocabulary, n_ends = units.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("unit") == F.lit(b"\xff"), F.col("n"))), F.lit(0))).first()
    spread = float(train_tokens + 0.5 * (vocabulary + 1))
    models = learn(training, units, train_tokens, vocabulary)
    held = docs.sparkSession.sparkContext.broadcast((models, _hashed(most_frequent(units, "n", MOST_WORDS), models[1])))  # tables of bounded size, MOST_WORDS counts

    names = ["row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_sum", "score", "n_bytes", "rare"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (codes, speller), (hot_hash, hot_count, hot_spelled) = held.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                units = Units(text_of(part.column("text"), lower=True), codes.code)
                score = log_probabilities(units, codes, speller, (hot_hash, hot_spelled))
                is_word = units.is_word
                count = np.append(codes.code.counts, 0)[units.number]
                open_ = np.flatnonzero(is_word & (count == 0))
                place, found = _found(hot_hash, units.hashes[open_])
                count[open_[found]] = hot_count[place[found]]
                known = is_word & (count > 0)
                logs = np.where(known, np.log10((count + 0.5) / spread), 0.0)
                n_known = np.bincount(units.row[known], minlength=part.num_rows)
                rows = np.arange(row, row + part.num_rows, dtype=np.int64)
                row += part.num_rows
                columns = [
                    pa.array(rows), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(units.first).astype(np.int64)),
                    pa.array(n_known.astype(np.int64)), pa.array(np.bincount(units.row, logs, part.num_rows)), pa.array(score / np.log(10)),
                    pa.array(units.n_bytes()), _listed(units, np.flatnonzero(is_word & ~known)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("hot_known", T.LongType()), T.StructField("hot_sum", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("rare", T.ArrayType(T.StructType([T.StructField("unit", T.BinaryType()), T.StructField("n", T.LongType())]))),
    ])
    first = staged(source.mapInArrow(scan, schema), "lm-scores")
    beyond = first.select("row", F.explode("rare").alias("r")).select("row", "r.unit", F.col("r.n").alias("here")).join(units, "unit", "left")
    beyond = beyond.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("here")).otherwise(0)).alias("rare_known"), F.sum(F.col("here") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / spread)).alias("rare_sum")
    )
    end_log = float(np.log10((n_ends + 0.5) / spread))
    return first.join(beyond, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if n_ends else 0)).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(end_log)).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
