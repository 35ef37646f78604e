"""Operator 8, quality rules: weak supervision in place of all-must-pass filtering.

Each rule looks at the statistics of a text and votes *good* (1), *bad* (-1)
or abstains (0).  The votes of all documents are counted per pattern in Spark
(at most ``3 ** len(RULES)`` rows, whatever the corpus), expectation-maximisation
over those counts estimates for each rule how it votes on good and on bad
documents, and every pattern gets the posterior probability of *good*.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .text_stats import with_row_stats, with_stats


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules over the columns of :data:`text_stats.STATS`."""
    symbols, marked, upper = _share("n_symbols", "word_chars"), _share("n_listed", "n_words"), _share("n_upper", "n_alpha")
    repeated, distinct, lines = _share("n_repeat_words", "n_words"), _share("n_distinct", "n_words"), _share("n_dup_lines", "n_lines")
    length, some = _share("word_chars", "n_words"), F.col("n_words") >= 10
    return {
        "symbols": _vote(symbols > 0.03, F.col("n_symbols") == 0),
        "marked_words": _vote(marked > 0.05, F.col("n_listed") == 0),
        "capitals": _vote((upper > 0.3) & (F.col("n_upper") >= 10), upper < 0.1),
        "repeated_windows": _vote(some & (repeated > 0.2), repeated <= 0.05),
        "distinct_words": _vote(some & (distinct < 0.4), some & (distinct >= 0.5)),
        "repeated_lines": _vote((F.col("n_lines") >= 4) & (lines > 0.4), F.col("n_dup_lines") == 0),
        "word_length": _vote(some & ((length < 2.5) | (length > 12)), length.between(3, 10)),
        "length": _vote(F.col("n_words") < 10, F.col("n_words") >= 10),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior probability of *good* for each vote pattern, by expectation-maximisation.

    ``patterns``: one row for each pattern, votes in -1, 0, 1; ``counts``: its
    documents.  The start takes patterns without a bad vote as good.  Pseudo
    counts hold each rule to voting in its own sense rather more often than not,
    so the classes can't swap.
    """
    if len(patterns) == 0:
        return np.zeros(0)
    good = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    hot = np.stack([(patterns == v) for v in (-1, 0, 1)], axis=2).astype(float)
    prior_good, prior_bad = np.array([0.1, 1.0, 2.0]), np.array([2.0, 1.0, 1.0])
    for _ in range(rounds):
        ratio = np.zeros(len(patterns))
        for weight, prior, sign in ((counts * good, prior_good, 1), (counts * (1 - good), prior_bad, -1)):
            seen = np.einsum("p,prv->rv", weight, hot) + prior
            rate = np.clip(seen / seen.sum(axis=1, keepdims=True), 1e-4, 1)
            ratio += sign * np.einsum("prv,rv->p", hot, np.log(rate))
            ratio += sign * np.log(weight.sum() + 1.0)
        good = 1 / (1 + np.exp(-np.clip(ratio, -50, 50)))
    return good


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Statistics, ``base_failed``, ``posterior`` and ``kept`` for every row of ``docs``.

    ``base_failed``: fewer than ten words, or over a fifth of them in repeated
    windows of five.  ``kept``: not that, and ``posterior >= threshold``.
    A null or empty text has no words and fails; repeated rows and ties are each
    judged alike; an empty table gives an empty result.
    """
    return _posteriors(staged(with_stats(docs, id_col, text_col).withColumn("pattern", _pattern()), "quality-stats"), threshold)


def _pattern() -> Column:
    return F.concat_ws(",", *(v.cast("string") for v in rules().values()))


def _posteriors(stats: DataFrame, threshold: float) -> DataFrame:
    """Adds ``posterior``, ``base_failed`` and ``kept`` to rows with statistics and their ``pattern``."""
    votes = rules()
    counted = stats.groupBy("pattern").count().collect()  # at most 3 ** 8 rows
    patterns = np.array([[int(v) for v in row["pattern"].split(",")] for row in counted]).reshape(len(counted), len(votes))
    posterior = fit(patterns, np.array([row["count"] for row in counted], dtype=float))
    table = stats.sparkSession.createDataFrame([(row["pattern"], float(p)) for row, p in zip(counted, posterior, strict=True)], "pattern string, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        stats.join(F.broadcast(table), "pattern", "left")  # bounded by 3 ** 8 rows
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def kept_documents(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, with their own columns.

    Each row is judged by its own text (a string column), whatever its id: rows are
    written to the shared folder with their statistics once, and read again when the
    posteriors are known, so nothing is shuffled.
    """
    both = with_row_stats(docs, text_col).withColumn("pattern", _pattern())
    return _posteriors(staged(both, "quality-rows"), threshold).where("kept").select("row.*")
