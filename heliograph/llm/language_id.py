"""Operator 9, language ID: a linear-chain conditional random field over the words of a text.

Every word has a label, so text that switches language is labelled word by
word.  A word's score for a label sums the weights of hashed features: its
prefixes and suffixes (affixes), its byte n-grams, and the whole word
(lexicon).  Transition weights are learned with them.  Training maximises the
likelihood by forward-backward over segments, some of them spliced from two
languages so that transitions see switches.  Every language that rows name is a
label.  About ``MOST_TRAINING`` documents are learned from, ``LEAST_EACH`` of every
language at least (or all it has), the first in an order by hash.

Prediction runs forward-backward over segments of ``SEGMENT`` words of every
whole text, all segments of a batch at once; a text's language is the label with
the largest mean posterior over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .staging import hash_bound
from .textscan import Text, byte_slices, hash_ranges, mix, text_of, words_of

#: Documents learned from, about: spread over all languages, of each as many as this allows and ``LEAST_EACH`` at least.
MOST_TRAINING = 1000
LEAST_EACH = 15
#: How far above an even spread over the labels the mean posterior of a text must lie for the pipeline to keep it (0 to 1).
LEAST_OVER_CHANCE = 0.1
SEGMENT = 64
#: Bytes of text whose words are labelled at once; each takes some hundred bytes of working arrays.
SLICE_BYTES = 1 << 19
BUCKETS = 1 << 16
UNKNOWN = "und"
_U = np.uint64
_LETTER = regex.compile(r"\p{L}")


def _gram_features(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the two and of the three bytes that begin at each byte, with what stands around the word as it is."""
    data = np.concatenate([text.data, np.zeros(2, np.uint8)]).astype(np.uint64)
    two = data[:-2] | data[1:-1] << _U(8) | _U(1 << 40)
    three = data[:-2] | data[1:-1] << _U(8) | data[2:] << _U(16) | _U(2 << 40)
    return _bucket(two), _bucket(three)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) & _U(BUCKETS - 1)).astype(np.int32)


@dataclass
class Features:
    """Hashed features of the words of some rows: one column for each affix and the whole word, and n-grams by byte range."""

    whole: np.ndarray
    grams: tuple[np.ndarray, np.ndarray]
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Features:
        text = text_of(column, lower=True)
        words = words_of(text)
        columns = [_bucket(words.hashes + _U(11))]
        for k in (1, 2, 3):
            columns.append(_bucket(hash_ranges(text, words.start, np.minimum(words.start + k, words.end)) + _U(20 + k)))
            columns.append(_bucket(hash_ranges(text, np.maximum(words.end - k, words.start), words.end) + _U(30 + k)))
        return cls(np.stack(columns, axis=1), _gram_features(text), words.start, words.end, words.first)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Each word's score for each label."""
        out = np.zeros((len(self.start), weights.shape[1]), dtype=np.float32)
        if len(out) == 0:
            return out
        for k in range(self.whole.shape[1]):
            out += weights[self.whole[:, k]]
        for gram in self.grams:
            sums = np.zeros((len(gram) + 1, weights.shape[1]), dtype=np.float64)
            np.cumsum(weights[gram], axis=0, out=sums[1:])
            out += (sums[self.end] - sums[self.start]).astype(np.float32)
        return out

    def add_gradient(self, grad: np.ndarray, by_word: np.ndarray) -> None:
        for k in range(self.whole.shape[1]):
            for label in range(grad.shape[1]):
                grad[:, label] += np.bincount(self.whole[:, k], by_word[:, label], BUCKETS)
        spread = np.repeat(np.arange(len(self.start)), self.end - self.start)
        inside = np.concatenate([np.arange(a, b) for a, b in zip(self.start, self.end, strict=True)]) if len(self.start) else spread
        for gram in self.grams:
            for label in range(grad.shape[1]):
                grad[:, label] += np.bincount(gram[inside], by_word[spread, label], BUCKETS)


def segments(first: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of the segments of all rows, one line each, -1 where a segment is shorter; and the row of each segment."""
    counts = np.diff(first)
    parts = -(-counts // size)
    row = np.repeat(np.arange(len(counts)), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = first[row][:, None] + nth[:, None] * size + np.arange(size)[None, :]
    return np.where(at < first[row + 1][:, None], at, -1), row


def forward_backward(scores: np.ndarray, filled: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each label at each place of each segment, and expected transitions summed over all; ``scores``: segment, place, label."""
    n, length, labels = scores.shape
    peak = scores.max(axis=2, keepdims=True)
    local = np.exp(np.clip(scores - peak, -60, 0))
    move = np.exp(transitions)
    forward = np.empty_like(local)
    forward[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        now = (forward[:, t - 1] @ move) * local[:, t]
        forward[:, t] = now / now.sum(axis=1, keepdims=True)
    backward = np.ones((n, labels))
    posterior = np.empty_like(local)
    moves = np.zeros((labels, labels))
    for t in range(length - 1, -1, -1):
        both = forward[:, t] * backward
        posterior[:, t] = both / both.sum(axis=1, keepdims=True)
        if t:
            ahead = np.where(filled[:, t, None], local[:, t] * backward, 1.0)
            pair = forward[:, t - 1][:, :, None] * move[None] * ahead[:, None, :]
            total = pair.sum(axis=(1, 2), keepdims=True)
            moves += (pair / total)[filled[:, t]].sum(axis=0)
            step = ahead @ move.T
            backward = np.where(filled[:, t, None], step / step.sum(axis=1, keepdims=True), 1.0)
    return posterior, moves


def fit(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, feature weights and transition weights, by AdaGrad on the likelihood of segments."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    weights, transitions = np.zeros((BUCKETS, len(labels)), dtype=np.float32), np.zeros((len(labels), len(labels)))
    if not labels:
        return labels, weights, transitions
    past_w, past_t = np.full_like(weights, 1e-2), np.full_like(transitions, 1e-2)
    gold_of = {lang: k for k, lang in enumerate(labels)}
    order = np.arange(len(texts))
    for _ in range(epochs):
        rng.shuffle(order)
        for begin in range(0, len(order), 150):
            rows = order[begin : begin + 150]
            features = Features.of(pa.array([texts[i] for i in rows], pa.large_string()))
            at, row = segments(features.first)
            if len(at) == 0:
                continue
            gold_rows = np.array([gold_of[langs[i]] for i in rows])
            swap = rng.permutation(len(at))[: len(at) // 4]  # a quarter is spliced: its second half comes from another segment
            source = np.arange(len(at))[:, None].repeat(SEGMENT, axis=1)
            source[swap, SEGMENT // 2 :] = rng.permutation(len(at))[: len(swap), None]
            at = np.take_along_axis(at, np.arange(SEGMENT)[None, :].repeat(len(at), axis=0), axis=1)[source, np.arange(SEGMENT)[None, :]]
            gold = gold_rows[row][source]
            filled = at >= 0
            filled[:, 1:] &= filled[:, :-1]  # a gap ends a segment
            keep = filled[:, 0]
            at, gold, filled = at[keep], gold[keep], filled[keep]
            scores = features.scores(weights)[at] * filled[:, :, None]
            posterior, moves = forward_backward(scores.astype(np.float64), filled, transitions)
            error = (np.eye(len(labels))[gold] - posterior) * filled[:, :, None]
            by_word = np.zeros((len(features.start), len(labels)))
            np.add.at(by_word, at[filled], error[filled])
            grad = np.zeros(weights.shape)
            features.add_gradient(grad, by_word)
            grad /= filled.sum()
            seen = np.zeros_like(transitions)
            np.add.at(seen, (gold[:, :-1][filled[:, 1:]], gold[:, 1:][filled[:, 1:]]), 1)
            move = (seen - moves) / filled.sum()
            past_w += grad**2
            past_t += move**2
            weights += (rate * grad / np.sqrt(past_w)).astype(np.float32)
            transitions += 0.1 * rate * move / np.sqrt(past_t)
    return labels, weights, transitions


def word_posteriors(column: pa.Array, weights: np.ndarray, transitions: np.ndarray) -> tuple[Features, np.ndarray]:
    """Posterior of each label for every word of every text of a column."""
    features = Features.of(column)
    at, _ = segments(features.first)
    filled = at >= 0
    out = np.zeros((len(features.start), weights.shape[1]))
    scores = features.scores(weights)
    step = max(1, min(2000, 2000 * 64**2 // max(1, weights.shape[1]) ** 2))  # segments x labels x labels floats are held
    for begin in range(0, len(at), step):
        part, mask = at[begin : begin + step], filled[begin : begin + step]
        posterior, _ = forward_backward(np.where(mask[:, :, None], scores[part], 0).astype(np.float64), mask, transitions)
        out[part[mask]] = posterior[mask]
    return features, out


def training_rows(docs: DataFrame, held_out: F.Column | None, id_col: str, text_col: str, lang_col: str, most: int) -> tuple[list[str], list[str]]:
    """Texts and languages of about ``most`` documents, spread over all languages, the first of each by a hash of id; ``LEAST_EACH`` of each, if it has so many."""
    known = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), (held_out if held_out is not None else F.lit(False)).alias("held"))
    known = known.where("not held and lang is not null and text is not null and id is not null")
    langs = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    each = max(LEAST_EACH, most // max(1, len(langs)))
    place = {lang["lang"]: k for k, lang in enumerate(langs)}
    bounds = docs.sparkSession.createDataFrame([(lang["lang"], hash_bound(each, lang["count"])) for lang in langs], "lang string, bound long")
    own = known.select(F.xxhash64("id").alias("h"), "id", "text", "lang").join(F.broadcast(bounds), "lang").where("h <= bound")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    found = own.withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "nth", "text").collect()
    found.sort(key=lambda r: (place[r["lang"]], r["nth"]))
    return [r["text"] for r in found], [r["lang"] for r in found]


def predicted(
    docs: DataFrame, training: DataFrame | None = None, held_out: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_TRAINING
) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``switches`` (places where the likeliest label changes) for every row of ``docs``.

    Learns from ``training`` (else ``docs``) rows for which ``held_out`` is not
    true.  ``und`` with score 0 where the text is null or has no letter, and for
    every row where nothing can be learned from.  Ties go to the first label.
    Repeated rows are each predicted; other columns do not matter.
    """
    labels, weights, transitions = fit(*training_rows(docs if training is None else training, held_out, id_col, text_col, lang_col, most))
    model = docs.sparkSession.sparkContext.broadcast((labels, weights, transitions))  # BUCKETS x labels floats
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("switches", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", _slice_bytes(labels)):
                langs, scores, switches = labelled(part.column("text"), *model.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(switches)], ["doc_id", "lang_pred", "score", "switches"])

    return source.mapInArrow(scan, schema)


def labelled(column: pa.Array, labels: list[str], weights: np.ndarray, transitions: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its mean posterior and the number of switches of each text of a column."""
    texts = column.to_pylist()
    langs, scores, switches = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    if labels:
        features, posterior = word_posteriors(column, weights, transitions)
        best = posterior.argmax(axis=1)
        sums = np.concatenate([np.zeros((1, len(labels))), np.cumsum(posterior, axis=0)])
        change = np.concatenate(([0, 0], np.cumsum(best[1:] != best[:-1]))) if len(best) else np.zeros(2, np.int64)
        for i, text in enumerate(texts):
            a, b = features.first[i], features.first[i + 1]
            if b > a and _LETTER.search(text):
                mean = (sums[b] - sums[a]) / (b - a)
                langs[i], scores[i], switches[i] = labels[int(mean.argmax())], min(1.0, float(mean.max())), change[b] - change[a + 1]
    return langs, scores, switches


def _slice_bytes(labels: list[str]) -> int:
    """Bytes of text whose words are labelled at once: fewer for many labels."""
    return SLICE_BYTES * 64 // max(64, len(labels))


def least_score(labels: int) -> float:
    """The mean posterior that a text of a known language reaches: ``LEAST_OVER_CHANCE`` of the way from an even spread to certainty."""
    return 0.0 if labels < 2 else 1 / labels + LEAST_OVER_CHANCE * (1 - 1 / labels)


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_TRAINING) -> DataFrame:
    """The rows of ``docs`` whose text (a string column) the field knows a language for.

    A row goes if its text is null or has no letter, or if its likeliest language
    has a mean posterior below :func:`least_score`: the field finds no language much
    likelier than the others, as for scripts it never met and for short mixed codes.
    Hexadecimal digests and pseudo-Latin filler score a little above that and stay: a
    bound that dropped them would come near to real texts of few words.
    Where it has nothing to learn from (no row with a ``lang``), or one language
    only, a letter is enough.

    Rows are judged where they are read, with all their columns, so nothing is
    shuffled; rows without id and repeated rows are each judged by their own text.
    """
    labels, weights, transitions = fit(*training_rows(docs, None, id_col, text_col, lang_col, most))
    model = docs.sparkSession.sparkContext.broadcast((labels, weights, transitions))  # BUCKETS x labels floats
    least = least_score(len(labels))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()  # a worker that encoded texts before would hold both
        for batch in batches:
            for part in byte_slices(batch, text_col, _slice_bytes(labels)):
                if labels:
                    _, scores, _ = labelled(part.column(text_col), *model.value)
                    keep = (scores > 0) & (scores >= least)  # a label's name may be UNKNOWN
                else:
                    keep = [text is not None and _LETTER.search(text) is not None for text in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
