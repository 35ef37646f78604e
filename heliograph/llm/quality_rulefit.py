"""Operator 5, quality classifier: a sparse rule ensemble over text statistics.

Small trees are boosted on at most ``MOST_TRAINING`` labelled documents; every
path from a root is a conjunctive rule; an l1 penalty keeps few of them in a
logistic model; the rules that are left become one Spark column expression, so
scoring is a projection over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import hash_bound, staged
from .text_stats import with_stats

#: Labelled rows learned from, at most: the first in an order by hash.
MOST_TRAINING = 20_000

Rule = tuple[tuple[str, bool, float], ...]


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def measures() -> dict[str, Column]:
    """What rules may ask for, from the columns of :data:`text_stats.STATS`."""
    return {
        "words": F.col("n_words").cast("double"),
        "symbols": _share("n_symbols", "word_chars"),
        "capitals": _share("n_upper", "n_alpha"),
        "marked": _share("n_listed", "n_words"),
        "repeated": _share("n_repeat_words", "n_words"),
        "distinct": _share("n_distinct", "n_words"),
        "lines": _share("n_dup_lines", "n_lines"),
        "length": _share("word_chars", "n_words"),
        "longest": F.col("longest_word").cast("double"),
        "digits": _share("n_digits", "word_chars"),
        "pipes": _share("n_pipes", "n_words"),
        "bangs": _share("n_bangs", "n_words"),
        "stops": _share("n_stops", "n_words"),
        "alpha": _share("n_alpha", "word_chars"),
        "line_words": _share("n_words", "n_lines"),
    }


def _tree(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, weight: np.ndarray, depth: int, rows: np.ndarray) -> list[tuple[list[tuple[int, bool, float]], np.ndarray, float]]:
    """Paths of a regression tree: ``(conditions, rows, value)`` of all nodes but the root; ``(feature, above, cut)`` is a condition."""
    value = residual[rows].sum() / (weight[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 20:
        return []
    best = (1e-6, -1, 0.0)
    whole = residual[rows].sum() ** 2 / (weight[rows].sum() + 1.0)
    for j, own in enumerate(cuts):
        if len(own) == 0:
            continue
        bins = np.searchsorted(own, x[rows, j], side="left")  # bin b: above cuts[b - 1], not above cuts[b]
        r = np.cumsum(np.bincount(bins, residual[rows], len(own) + 1))[:-1]
        w = np.cumsum(np.bincount(bins, weight[rows], len(own) + 1))[:-1]
        n = np.cumsum(np.bincount(bins, minlength=len(own) + 1))[:-1]
        gain = r**2 / (w + 1.0) + (residual[rows].sum() - r) ** 2 / (weight[rows].sum() - w + 1.0) - whole
        gain[(n < 5) | (len(rows) - n < 5)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(own[k]))
    if best[1] < 0:
        return []
    _, j, cut = best
    out = []
    for above in (False, True):
        part = rows[(x[rows, j] > cut) == above]
        value = residual[part].sum() / (weight[part].sum() + 1.0)
        below = _tree(x, cuts, residual, weight, depth - 1, part)
        out.append(([(j, above, cut)], part, value))
        out += [([(j, above, cut), *path], rest, v) for path, rest, v in below]
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 16, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    """Distinct conjunctive rules of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.005, 0.995, 100), method="lower")) for j in range(x.shape[1])]
    logit = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        paths = _tree(x, cuts, y - p, p * (1 - p), depth, np.arange(len(y)))
        longest = {}
        for path, rows, value in paths:
            rules[tuple((names[j], above, cut) for j, above, cut in path)] = None
            longest[tuple(path)] = (rows, value)
        for path, (rows, value) in longest.items():
            if not any(len(other) > len(path) and other[: len(path)] == path for other in longest):
                logit[rows] += rate * np.clip(value, -4, 4)
    return list(rules)


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model with an l1 penalty on the weights, by accelerated proximal gradient."""
    n, k = z.shape
    w, b = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if k == 0:
        return w, b
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    ahead_w, ahead_b, momentum = w.copy(), b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ ahead_w + ahead_b))) - y
        new_w = ahead_w - step * (z.T @ error) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = ahead_b - step * error.mean()
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead_w, ahead_b = new_w + (momentum - 1) / nxt * (new_w - w), new_b + (momentum - 1) / nxt * (new_b - b)
        w, b, momentum = new_w, new_b, nxt
    return w, b


@dataclass
class RuleModel:
    """Weighted rules; :meth:`score` is their Spark expression."""

    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 over the columns of :func:`measures`."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & (F.col(name) > cut if above else F.col(name) <= cut)
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    if len(y) == 0:
        return RuleModel([], 0.0)
    rules = extract_rules(x, y, names)
    columns = {name: x[:, j] for j, name in enumerate(names)}
    z = np.ones((len(y), len(rules)))
    for k, rule in enumerate(rules):
        for name, above, cut in rule:
            z[:, k] *= (columns[name] > cut) == above
    weights, intercept = fit_lasso(z, y)
    return RuleModel([(rule, float(w)) for rule, w in zip(rules, weights, strict=True) if w], intercept)


def scored(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_TRAINING) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``.

    Learns from the rows of ``labels`` (``doc_id`` and ``label_col``) for whose id
    ``held_out`` is not true.  Null and empty texts get the score of all counts 0;
    ids without a document, null ids and null labels teach nothing; of repeated
    label rows each counts; without labels every score is 0.5; other columns do
    not matter.
    """
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    stats = staged(with_stats(docs, id_col, text_col), "rulefit-stats").select("doc_id", *(c.alias(n) for n, c in measures().items()))
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held)
    hashed = known.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).where(F.col("h") <= hash_bound(most, known.count()))
    sample = hashed.orderBy("h", "doc_id", "label").limit(most).select("doc_id", "label")
    names = list(measures())
    rows = stats.join(F.broadcast(sample), "doc_id").select("label", *names).toPandas()  # the sample has ``most`` rows at most
    model = fit(rows[names].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float), names)
    score = model.score()
    return stats.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
