"""Token ids of search texts by greedy longest match in a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks, the length of a row of ids, and what a token at the end of a word may end with.
BEGIN, END, PAD, LENGTH, WORD_END = 49406, 49407, 0, 77, "</w>"
#: The first id of tokens not in the vocabulary, the characters of a text that count, and of a piece.
UNKNOWN, MOST_CHARACTERS, LONGEST_PIECE = 49408, 200, 8


def encode(text: str | None, vocabulary: dict[str, int], length: int = LENGTH) -> list[int]:
    """Begin, the ids of the words, end, padding.

    A word in the vocabulary (as it is, or with the mark of a word's end) is one id;
    others are cut from the left into the longest pieces known, of eight
    characters at most; an unknown character has an id by its code.
    """
    known = lambda piece: vocabulary.get(piece, vocabulary.get(piece + WORD_END))
    ids = [BEGIN]
    for word in (text or "").lower().strip()[:MOST_CHARACTERS].split():
        whole = known(word)
        if whole is not None:
            ids.append(whole)
            continue
        rest = word.lstrip("".join(c for c in word if not c.isalnum()))
        while rest:
            size = next((n for n in range(min(LONGEST_PIECE, len(rest)), 0, -1) if known(rest[:n]) is not None), 1)
            piece, rest = rest[:size], rest[size:]
            own = vocabulary.get(piece)
            if own is None and not rest:
                own = vocabulary.get(piece + WORD_END)
            ids.append(UNKNOWN + (ord(piece[0]) & 0x3FF) if own is None else own)
    ids = ids[: length - 1] + [END]
    return ids + [PAD] * (length - len(ids))


def token_ids(text: Column, vocabulary: dict[str, int], length: int = LENGTH) -> Column:
    """:func:`encode` of a column; the vocabulary goes to the tasks with the function."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(lambda t: encode(t, vocabulary, length))

    return ids(text)
