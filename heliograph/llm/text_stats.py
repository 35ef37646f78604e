"""Per-document text statistics, computed in one vectorised pass over each Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textscan import SHINGLE, byte_slices, text_of, window_hashes, words_of

_CONTINUATION = np.arange(256) & 0xC0 == 0x80
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER_ASCII = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_HIGH_START = np.arange(256) >= 0xC0
_SPACES = b" \t\n\r\x0b\x0c"

#: The statistics, all counts.  A null text counts as empty: every count is 0.
STATS = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_distinct", "n_upper", "n_alpha", "n_digits", "n_pipes", "n_bangs", "n_stops", "longest_word", "n_listed",
)


def _repeat_words(hashes: np.ndarray, width: int = SHINGLE) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(width):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def _lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them equal to an earlier line."""
    seen: set[bytes] = set()
    lines = again = 0
    for line in raw.split(b"\n"):
        if line.strip(_SPACES):
            lines += 1
            again += line in seen
            seen.add(line)
    return lines, again


def batch_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of a column."""
    text = text_of(column)
    words = words_of(text)
    count = np.diff(words.first)
    lengths = np.concatenate(([0], np.cumsum(~_CONTINUATION[text.data], dtype=np.int64)))
    word_chars = lengths[words.end] - lengths[words.start]
    sums = np.concatenate(([0], np.cumsum(word_chars)))
    out = {name: np.zeros(len(text), dtype=np.int64) for name in STATS}
    out["n_chars"] = lengths[text.offsets[1:]] - lengths[text.offsets[:-1]]
    out["n_words"] = count.astype(np.int64)
    out["word_chars"] = sums[words.first[1:]] - sums[words.first[:-1]]
    for name, flags in (
        ("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_alpha", _UPPER | _LOWER_ASCII | _HIGH_START), ("n_digits", _DIGIT),
        ("n_pipes", np.arange(256) == 124), ("n_bangs", np.arange(256) == 33), ("n_stops", np.arange(256) == 46),
    ):
        out[name] = text.per_row(flags[text.data])
    for i in range(len(text)):
        out["n_lines"][i], out["n_dup_lines"][i] = _lines(text.row(i))
        hashes = words.hashes[words.first[i] : words.first[i + 1]]
        if len(hashes):
            out["n_distinct"][i] = len(np.unique(hashes))
            out["n_repeat_words"][i] = _repeat_words(hashes)
            out["longest_word"][i] = word_chars[words.first[i] : words.first[i + 1]].max()
    last = np.full(len(words.end), 0, dtype=np.uint8) if len(words.end) == 0 else text.data[words.end - 1]
    odd = np.concatenate(([0], np.cumsum(np.isin(last, np.frombuffer(b"#*$%&|!<>", dtype=np.uint8)))))
    out["n_listed"] = odd[words.first[1:]] - odd[words.first[:-1]]
    return out


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the columns of :data:`STATS` for every row; other columns of ``docs`` do not matter, whatever their names."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in STATS])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                stats = batch_stats(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(stats[c]) for c in STATS)], ["doc_id", *STATS])

    return source.mapInArrow(scan, schema)


def with_row_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row``, a struct of all columns of ``docs`` (``text_col`` is a string column), and the columns of :data:`STATS`."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    schema = T.StructType([*packed.schema, *(T.StructField(c, T.LongType()) for c in STATS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field(text_col)], ["row", "text"])
            for part in byte_slices(both, "text"):
                stats = batch_stats(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(stats[c]) for c in STATS)], ["row", *STATS])

    return packed.mapInArrow(scan, schema)
