"""Operator 11, token counts: strings proven to be one token are counted without merging.

The model merges neighbouring symbols as long as the result is in its
vocabulary.  Two facts are worked out from the vocabulary alone, before any text
is read:

* Where no vocabulary string holds one character directly before another, no
  merge can ever span that place.  Texts are cut there, and the stretches
  between such places (pre-tokens) are merged independently of each other.
* Which vocabulary strings end as one token when they are merged alone.  Not
  all do: greedy merging can pass a string by.

A pre-token among the proven strings is one token; only the others are merged,
each distinct one once for a slice of texts.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textscan import byte_slices, text_of

#: Stands for a space inside vocabulary strings (a fixed value of the format).
SPACE = "▁"

#: Fields of the model's file (fixed values of the format).
PIECE_FIELD, TRAINER_FIELD, NORMALIZER_FIELD = 1, 2, 3
NORMAL, BYTE = 1, 6

#: Counts of merged pre-tokens kept by a worker; a full table is emptied.  They change no result.
MOST_KEPT = 200_000
#: Longer pre-tokens are merged anew each time.
LONGEST_KEPT = 48
#: Bytes of a text that are looked at together; what reaches beyond the last certain cut is carried on.
BLOCK_BYTES = 1 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(field, value)`` of a message in the protocol-buffer wire format."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if wire == 2 else ({1: 8, 5: 4}[wire], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def load_vocabulary(path: str) -> dict[str, float]:
    """The strings that merging may make, with their scores, of a byte-fallback BPE model that changes no character but spaces.

    Raises ``ValueError`` for any other kind of model.
    """
    with open(path, "rb") as file:
        parts = list(_fields(file.read()))
    settings = {name: dict(_fields(next(v for f, v in parts if f == field))) for name, field in (("trainer", TRAINER_FIELD), ("normalizer", NORMALIZER_FIELD))}
    trainer, normalizer = settings["trainer"], settings["normalizer"]
    if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
        raise ValueError("a BPE model with byte fallback and leading spaces is needed")
    if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("the model's normalizer must add a space in front and change nothing else")
    scores = {}
    for piece in (dict(_fields(v)) for f, v in parts if f == PIECE_FIELD):
        kind = piece.get(3, NORMAL)
        if kind == NORMAL:
            scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0]
        elif kind not in (2, 3, BYTE):  # unknown, control
            raise ValueError("strings of the user's own are not supported")
    return scores


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """``text`` after merging: again and again the neighbours whose union has the best score, the leftmost of equals."""
    symbols: list[str] = list(text)
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(left: int, right: int) -> None:
        both = symbols[left] + symbols[right]
        if both in scores:
            heapq.heappush(heap, (-scores[both], left, both))

    for k in range(len(symbols) - 1):
        offer(k, k + 1)
    while heap:
        _, left, both = heapq.heappop(heap)
        right = after[left]
        # an offer is stale if one of its symbols has been merged since
        if not symbols[left] or right >= len(symbols) or len(symbols[left]) + len(symbols[right]) != len(both) or symbols[left] + symbols[right] != both:
            continue
        symbols[left], symbols[right] = both, ""
        after[left] = after[right]
        if after[left] < len(symbols):
            before[after[left]] = left
            offer(left, after[left])
        if before[left] >= 0:
            offer(before[left], left)
    return [s for s in symbols if s]


def whole_tokens(scores: dict[str, float]) -> frozenset[str]:
    """The vocabulary strings that merging alone makes into one token."""
    return frozenset(piece for piece in scores if len(merged(piece, scores)) == 1)


class Cuts:
    """Places that no vocabulary string spans.

    Characters of the vocabulary are numbered from 1, all others are 0; a table
    of pairs says which character ever stands directly before which.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        letters = sorted({c for piece in scores for c in piece})
        self.numbers = np.zeros(0x110000, dtype=np.uint16)
        self.numbers[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        for piece in scores:
            at = self.numbers[[ord(c) for c in piece]]
            self.joined[at[:-1], at[1:]] = True

    def starts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Byte offsets at which pre-tokens begin in UTF-8 ``data``; ``rows``: offsets that are cuts in any case."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        numbers = self.numbers[points]
        cut = np.ones(len(points), dtype=bool)
        cut[1:] = ~self.joined[numbers[:-1], numbers[1:]]
        place = np.flatnonzero((data & 0xC0) != 0x80)
        forced = np.zeros(len(data) + 1, dtype=bool)
        forced[rows] = True
        return place[cut | forced[place]]


class Counter:
    """Numbers of tokens of texts."""

    def __init__(self, scores: dict[str, float], whole: frozenset[str] | None = None) -> None:
        self.scores, self.cuts = scores, Cuts(scores)
        self.whole = whole_tokens(scores) if whole is None else whole
        self.kept: dict[str, int] = {}
        self.merges = 0

    def of(self, stretch: str) -> int:
        """Tokens of one pre-token."""
        if stretch in self.whole:
            return 1
        found = self.kept.get(stretch)
        if found is None:
            self.merges += 1
            # a character that is not in the vocabulary is a token for each of its bytes
            found = sum(1 if s in self.scores else len(s.encode()) for s in merged(stretch, self.scores))
            if len(stretch) <= LONGEST_KEPT:
                if len(self.kept) >= MOST_KEPT:
                    self.kept.clear()
                self.kept[stretch] = found
        return found

    def _each(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token of a buffer."""
        ends = np.append(starts, len(data)).astype(np.int64)
        column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
        coded = column.dictionary_encode()
        counts = np.fromiter(map(self.of, coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
        return counts[coded.indices.to_numpy()]

    def short(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a slice."""
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        space, nothing = (pa.scalar(x, pa.large_string()) for x in (SPACE, ""))
        spaced = pc.if_else(pc.equal(filled, nothing), nothing, pc.binary_join_element_wise(space, pc.replace_substring(filled, " ", SPACE), nothing))
        text = text_of(spaced)
        if not len(text.data):
            return np.zeros(len(text), dtype=np.int64)
        starts = self.cuts.starts(text.data, text.offsets)
        sums = np.concatenate(([0], np.cumsum(self._each(text.data, starts))))
        at = np.searchsorted(starts, text.offsets)
        return sums[at[1:]] - sums[at[:-1]]

    def long(self, raw: memoryview) -> int:
        """Tokens of one text, block by block; held are a block and the stretch before it without a certain cut."""
        total, rest = 0, SPACE.encode()
        for begin in range(0, len(raw), BLOCK_BYTES):
            rest += bytes(raw[begin : begin + BLOCK_BYTES])
            whole = len(rest) - _unfinished(rest) if begin + BLOCK_BYTES < len(raw) else len(rest)
            data = np.frombuffer(rest[:whole].replace(b" ", SPACE.encode()), dtype=np.uint8)
            starts = self.cuts.starts(data, np.zeros(1, dtype=np.int64))
            if begin + BLOCK_BYTES < len(raw):  # what comes next may belong to the last pre-token
                data, rest = data[: starts[-1]], data[starts[-1] :].tobytes() + rest[whole:]
                starts = starts[:-1]
            total += int(self._each(data, starts).sum())
        return total


def _unfinished(raw: bytes) -> int:
    """Bytes at the end that begin a character without ending it."""
    for back in range(1, min(4, len(raw)) + 1):
        byte = raw[-back]
        if byte >= 0xC0:
            return back if back < 2 + (byte >= 0xE0) + (byte >= 0xF0) else 0
        if byte < 0x80:
            return 0
    return 0


def counted(docs: DataFrame, scores: dict[str, float], limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` for every row of ``docs``.

    ``scores`` is a vocabulary of :func:`load_vocabulary`; it and what is proven
    of it go to every task, and their size is the vocabulary's.  A null text
    counts as empty and has no tokens; a text longer than ``BLOCK_BYTES`` is
    counted block by block; repeated rows are each counted; other columns do not
    matter, whatever their names; an empty table gives an empty result.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens"))])
    whole = whole_tokens(scores)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(scores, whole)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                text = part.column("text")
                sizes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                if part.num_rows == 1 and sizes[0].as_py() > BLOCK_BYTES:
                    tokens = [counter.long(memoryview(text[0].as_buffer()))]
                else:
                    tokens = counter.short(text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return source.mapInArrow(scan, schema).withColumn("over_limit", F.col("n_tokens") > limit)
