"""the mixers of op3 learn from all training texts and units."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from heliograph.llm import lm, textscan


def test_every_task_and_row_counts(spark):
    def over(batches, mixers, seen):
        for batch in batches:
            for v in batch.column("id").to_pylist():
                gate = v % 2
                mixers[0][gate] = (mixers[0][gate] * seen[0][gate] + v) / (seen[0][gate] + 1)
                seen[0][gate] += 1

    rows = spark.range(0, 1001, 1, 7)
    found = lm.learned(rows, [np.full((3, 2), 5.0)], over)[0]
    assert np.allclose(found, [[500, 500], [500, 500], [5, 5]])  # means of all even and all odd ids; a gate without bits keeps its weights


def test_units_beyond_some_hundred_thousand_teach():
    rng = np.random.default_rng(2)
    most = " ".join(f"w{k}" for k in rng.integers(0, 4, 201_000))
    ends = [" ".join(["w1"] * 30_000), " ".join(f"w{k}" for k in rng.integers(0, 4, 30_000))]
    counted = Counter(f"{most} {ends[0]} {ends[1]}".split())
    units = [f"{w} ".encode() for w in counted]
    rows = lm._binary_rows(pa.array(units, pa.binary()))
    code = lm.Code(textscan.hash_ranges(rows, rows.offsets[:-1], rows.offsets[1:] - 1), np.array(list(counted.values())), 0)
    counts = np.zeros(2 * lm.table_slots(code, 16), dtype=np.int32)
    lm.add_contexts(counts, lm.Units(textscan.textscan.text_of(pa.array([most, *ends], pa.large_string()), lower=True), code), code, 16)
    first, second = (lm.fit_code_mixers(counts.reshape(-1, 2), code, 16, pa.array([most, end], pa.large_string()), 1) for end in ends)
    assert any(not np.allclose(a, b) for a, b in zip(first, second, strict=True))


def test_later_bits_are_learned_once_for_each_pair(monkeypatch):
    """op3: bits beyond the first depend on anchor and unit only; each such pair is looked at once, and all its occurrences count."""
    words = [f"w{i}" for i in range(200)]
    text = pa.array([" ".join(words) + " " + " ".join(words[:100] * 9)])
    hashes = lm.Units(textscan.text_of(pa.array([" ".join(words)])), lm.Code(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)).hashes[:-1]
    code = lm.Code(hashes, np.array([10] * 100 + [1] * 100), 1)
    units = lm.Units(textscan.text_of(text), code)
    counts = np.zeros((-(-lm.table_slots(code, 16) // lm.BLOCK_SLOTS) * lm.BLOCK_SLOTS, 2), dtype=np.int32)
    lm.add_contexts(counts.reshape(-1), units, code, 16)
    looked, learn = [], lm._learn
    monkeypatch.setattr(lm, "_learn", lambda inputs, *rest: (looked.append(inputs.shape), learn(inputs, *rest))[1])
    mixers = lm.first_weights()
    seen = [np.zeros(len(m)) for m in mixers]
    lm.fit_code_mixers(counts.astype(np.uint16), code, 16, text, 1, mixers, seen)
    later = len(code.spread(units.number, lm.HEAD)[0])
    pairs = np.unique(units.anchor * len(code.start) + units.number)
    assert looked[1][1] == len(code.spread(pairs % len(code.start), lm.HEAD)[0]) < later
    assert seen[2].sum() == later and seen[0].sum() == looked[0][1]


def test_predictions_without_their_own_occurrence():
    counts = np.array([[0, 0], [1, 0], [0, 1], [7, 3], [65535, 65535]], dtype=np.uint16)
    for bit in (0, 1):
        got, level = lm._without_own(counts, np.arange(5), np.full(5, bit, dtype=np.int32))
        seen = counts.astype(float)
        seen[:, bit] = np.maximum(seen[:, bit] - 1, 0)
        assert np.allclose(got, lm._stretched(seen[:, 1], seen[:, 0]), atol=1e-5)
        assert level.tolist() == lm._seen_level(seen.sum(axis=1)).tolist()
        wide, same = lm._without_own(counts.astype(np.int32), np.arange(5), np.full(5, bit, dtype=np.int32))
        assert np.array_equal(wide, got) and np.array_equal(same, level)


def test_batches_of_whole_texts_are_bounded(spark):
    """pipeline: a batch holds some megabytes of text, not ten thousand rows of any length; a session's own bound stays."""
    from heliograph.llm import staging

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda: [r[0] for r in spark.range(4000).selectExpr("id", "repeat('x', 5000) as text").coalesce(1).mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array([x.nbytes])], ["n"]) for x in b), "n long").collect()]
    try:
        spark.conf.unset(name)
        staging.small_batches(spark)
        assert len(sizes()) > 5 and max(sizes()) < 1.1 * staging.BATCH_BYTES
        spark.conf.set(name, "7m")
        staging.small_batches(spark)
        assert spark.conf.get(name) == "7m"
    finally:
        spark.conf.unset(name)
