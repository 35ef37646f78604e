"""Rows that every operator must take: nulls, empty and odd texts, repeats, and extra columns with clashing names."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, ids string"


@pytest.fixture(scope="session")
def odd(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, words), (7, words), (7, words), (None, words), (8, words.replace("w3 ", "x3 ")), (9, "é" * 3 + " 漢字 🎉"),
        (10, "a" * 5000), (11, "the " * 3000), (12, "1 2 3 !!! ***"),
    ]
    return spark.createDataFrame([(i, t, "en", None, None, 5, "r", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
