"""Operator 7, license scans: exact phrases of words, and short notices with a bounded number of edits.

Exact: places where a phrase's words stand one after the other.  Fuzzy: a notice
with at most ``k`` edits holds at least one of its ``k + 1`` pieces unchanged
(pigeonhole), so exact search for the pieces finds every candidate; around each
candidate the regex library matches the notice with at most ``k`` errors and
gives the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textscan import NOTICE_WORD, Text, byte_slices, text_of, words_of

#: The phrases of exact search and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int


#: The notices of fuzzy search, lower-case words with single spaces.
NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("licensed under the apache license", "apache", 3),
    Notice("apache license version", "apache", 2),
    Notice("under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("released into the public domain", "public-domain", 3),
    Notice("all rights reserved", "proprietary", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("european union public licence", "eupl", 3),
    Notice("boost software license version", "boost", 3),
    Notice("artistic license", "artistic", 1),
    Notice("isc license", "isc", 1),
    Notice("zlib license", "zlib", 1),
    Notice("permission to use copy modify and or distribute this software", "isc", 5),
    Notice("neither the name of the copyright holder nor the names of its contributors", "bsd", 6),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 5),
    Notice("the software is provided as is without warranty of any kind", "mit", 5),
    Notice("dedicated the work to the public domain", "cc0", 3),
    Notice("common development and distribution license", "cddl", 3),
)


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """``(offset, piece)``: the notice cut into ``edits + 1`` parts of about one length."""
    cuts = [round(k * len(notice.text) / (notice.edits + 1)) for k in range(notice.edits + 2)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class FuzzyNotices:
    """Search for notices with a bounded number of edits in texts of lower-case words with single spaces."""

    def __init__(self, notices: tuple[Notice, ...]) -> None:
        self.notices = [
            (n, pieces(n), regex.compile(rf"(?be)(?<!\S)(?:{regex.escape(n.text)}){{e<={n.edits}}}(?!\S)")) for n in notices
        ]

    def find(self, text: str) -> list[tuple[Notice, int, int, int]]:
        """``(notice, begin, end, edits)``, with one match at most for each stretch of candidates."""
        found = []
        for notice, seeds, pattern in self.notices:
            spans = []
            for offset, seed in seeds:
                at = text.find(seed)
                while at >= 0:
                    spans.append((max(0, at - offset - notice.edits), at - offset + len(notice.text) + notice.edits))
                    at = text.find(seed, at + 1)
            begin = end = -1
            for a, b in [*sorted(spans), (len(text) * 2 + 1, -1)]:
                if a > end:
                    if end >= 0:
                        found += self._matches(notice, pattern, text, begin, end)
                    begin, end = a, b
                end = max(end, b)
        return found

    @staticmethod
    def _matches(notice: Notice, pattern: regex.Pattern, text: str, begin: int, end: int) -> list[tuple[Notice, int, int, int]]:
        # the matcher takes the window's end for the text's, so the window runs on to the end of a word
        stop = text.find(" ", min(end, len(text)))
        return [(notice, m.start(), m.end(), sum(m.fuzzy_counts)) for m in pattern.finditer(text, begin, stop if stop >= 0 else len(text)) if m.end() > m.start()]


def _phrase_starts(raw: bytes, phrase: bytes) -> list[int]:
    """Byte offsets, in words joined by single spaces, where ``phrase`` stands as whole words; overlaps count."""
    starts, at = [], raw.find(phrase)
    while at >= 0:
        if (at == 0 or raw[at - 1] == 32) and (at + len(phrase) == len(raw) or raw[at + len(phrase)] == 32):
            starts.append(at)
        at = raw.find(phrase, at + 1)
    return starts


def _joined(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' words with single spaces between them, as one buffer; its row offsets; words in each row."""
    words = words_of(text, NOTICE_WORD)
    counts = np.diff(words.first)
    lengths = words.end - words.start + 1
    ends = np.concatenate(([0], np.cumsum(lengths)))
    out = np.full(int(ends[-1]), 32, dtype=np.uint8)
    inside = NOTICE_WORD[text.data]
    target = np.zeros(int(ends[-1]), dtype=bool)
    gaps = ends[1:] - 1
    target[:] = True
    target[gaps] = False
    out[target] = text.data[inside]
    return out, ends[words.first], counts


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """``doc_id``, ``n_words`` and ``finds`` for every row of ``docs``.

    ``finds``: array of ``kind`` (exact or fuzzy), ``label``, ``notice``,
    ``first_word``, ``last_word``, ``edits`` and ``matched`` (the words found).
    Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters.
    A null or empty text has no words and no finds; repeated rows are each
    scanned; other columns do not matter; an empty table gives an empty result.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    find_type = T.StructType.fromDDL("kind string, label string, notice string, first_word long, last_word long, edits int, matched string")
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("finds", T.ArrayType(find_type))])
    arrow_find = pa.struct([("kind", pa.string()), ("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuzzy = FuzzyNotices(notices)
        exact = [(p, p.encode(), label) for p, label in phrases.items()]
        for batch in batches:
            for part in byte_slices(batch, "text"):
                buffer, offsets, counts = _joined(text_of(part.column("text"), lower=True))
                finds = []
                for i in range(part.num_rows):
                    raw, row = buffer[offsets[i] : max(offsets[i], offsets[i + 1] - 1)].tobytes(), []
                    for phrase, encoded, label in exact:
                        for at in _phrase_starts(raw, encoded):
                            first = raw.count(b" ", 0, at)
                            row.append({"kind": "exact", "label": label, "notice": phrase, "first_word": first, "last_word": first + phrase.count(" "), "edits": 0, "matched": phrase})
                    text = raw.decode("utf-8", "replace")
                    for notice, begin, end, edits in fuzzy.find(text):
                        first = text.count(" ", 0, begin)
                        matched = text[begin:end]
                        row.append({"kind": "fuzzy", "label": notice.label, "notice": notice.text, "first_word": first, "last_word": first + matched.count(" "), "edits": edits, "matched": matched})
                    finds.append(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(finds, pa.list_(arrow_find))], ["doc_id", "n_words", "finds"])

    return source.mapInArrow(scan, schema)


def summary(found: DataFrame) -> DataFrame:
    """One row for each row of :func:`scanned`: counts, first and last exact place, labels of exact and of all finds, and a score.

    ``score``: 1 with an exact find; else the best fuzzy find's share of its
    notice that is unedited; 0 without finds.
    """
    exact = F.filter("finds", lambda f: f["kind"] == "exact")
    labels = lambda finds: F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda f: f["label"]))), ",")
    nearness = F.array_max(F.transform("finds", lambda f: 1 - f["edits"] / F.length(f["notice"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(F.transform(exact, lambda f: f["first_word"])).alias("first_word"),
        F.array_max(F.transform(exact, lambda f: f["first_word"])).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("finds")).alias("labels"),
        F.when(F.size(exact) > 0, F.lit(1.0)).otherwise(F.coalesce(nearness, F.lit(0.0))).alias("score"),
    )
