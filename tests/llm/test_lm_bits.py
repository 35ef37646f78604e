"""op3: what its CPU time hangs on. Bits are worked out by columns, later ones once for a whole task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from heliograph.llm import lm, textscan


def model_of(texts):
    """A code, counts and units of some texts."""
    text = textscan.text_of(pa.array(texts, pa.large_string()), lower=True)
    hashes, n = np.unique(lm.Units(text, lm.Code(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)).hashes, return_counts=True)
    code = lm.Code(hashes[n > 1], n[n > 1], int((n == 1).sum()))
    units = lm.Units(text, code)
    counts = np.zeros(2 * lm.table_slots(code, 16), dtype=np.int32)
    lm.add_contexts(counts, units, code, 16)
    return code, units, counts.reshape(-1, 2)


def zipf_texts(seed, n=40):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{k}" for k in rng.zipf(1.3, size=int(rng.integers(0, 400)))) for _ in range(n)]


def test_later_bits_are_worked_out_once_for_a_whole_task(monkeypatch):
    code, units, counts = model_of(zipf_texts(1))
    model, looked, spread = lm.CodeModel(counts, code, 16, lm.first_weights()), [], lm.Code.spread
    monkeypatch.setattr(lm.Code, "spread", lambda self, numbers, *rest: (looked.append(len(numbers)), spread(self, numbers, *rest))[1])
    first = model.scores(units)
    pairs = len(np.unique(units.anchor * len(code.start) + units.number))
    assert sum(looked) == pairs < len(units.number)  # before: all units' first bits as well
    looked.clear()
    assert np.array_equal(model.scores(units), first) and not looked  # before: all of them again


def test_counts_and_learning_by_task_equal_those_by_slice():
    texts = zipf_texts(2)
    code, units, counts = model_of(texts)
    parts, pairs, again = [pa.array(texts[:25]), pa.array(texts[25:])], np.zeros(lm._n_pairs(code), dtype=np.int32), np.zeros(counts.size, dtype=np.int32)
    for part in parts:
        lm.add_contexts(again, lm.Units(textscan.text_of(part, lower=True), code), code, 16, pairs)
    some = np.flatnonzero(pairs)
    lm.add_pairs(again, code, some, pairs[some])
    assert np.array_equal(again, counts.reshape(-1)) and pairs.sum() == len(units.number)
    mixers, seen, pairs = lm.first_weights(), [np.zeros(len(m)) for m in lm.first_weights()], np.zeros(lm._n_pairs(code), dtype=np.int32)
    for part in parts:
        lm.fit_code_mixers(counts, code, 16, part, 1, mixers, seen, pairs)
    some = np.flatnonzero(pairs)
    lm.fit_later_bits(counts, code, some, pairs[some], 1, mixers[2], seen[2])
    assert [s.sum() for s in seen] == [len(code.spread(units.number, 0, lm.HEAD)[0])] * 2 + [len(code.spread(units.number, lm.HEAD)[0])]


def test_first_bits_are_those_of_the_plain_slots():
    code, units, counts = model_of(zipf_texts(3))
    inputs, bit, gates = lm._head_bits(counts, code, 16, units)
    unit, depth, node, plain = code.spread(units.number, 0, lm.HEAD)
    step = unit // lm.STEP_UNITS * lm.STEP_UNITS
    at = step * lm.HEAD + depth * np.minimum(lm.STEP_UNITS, len(units.number) - step) + unit - step
    wanted = [lm._without_own(counts, slots, plain.astype(np.int32)) for slots in lm._code_slots(units, code, 16, unit, node)]
    assert np.array_equal(bit[at], plain)
    for k, (values, _) in enumerate(wanted):
        assert np.allclose(inputs[k][at], values, atol=1e-6)
    for gate, own, n in zip(gates, lm._code_gates([levels for _, levels in wanted], depth), lm._GATES, strict=True):
        assert np.array_equal(gate[at], own)
        assert (np.delete(gate, at) == n).all() and not np.delete(inputs, at, axis=1).any()  # bits that short codes lack


def test_units_are_found_by_hash():
    rng = np.random.default_rng(4)
    for n in (1, 2, 1000):
        hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        hashes[: n // 2] >>= np.uint64(40)  # many begin alike
        hashes = np.unique(hashes)
        code = lm.Code(hashes, np.ones(len(hashes), dtype=np.int64), 1)
        wanted = np.concatenate((hashes, hashes + np.uint64(1), np.array([0, (1 << 64) - 1], dtype=np.uint64)))
        place = {h: k for k, h in enumerate(hashes.tolist())}
        assert code.numbers(wanted).tolist() == [place.get(h, len(hashes)) for h in wanted.tolist()]


def test_rare_words_of_each_row():
    units = lm.Units(textscan.text_of(pa.array(["b a b", "", "é b"])), lm.Code(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1))
    got = lm._listed(units, np.flatnonzero(units.is_word)).to_pylist()
    assert [{r["unit"]: r["n"] for r in row} for row in got] == [{b"b ": 2, b"a ": 1}, {}, {"é ".encode(): 1, b"b ": 1}]
    assert lm._listed(units, np.zeros(0, dtype=np.int64)).to_pylist() == [[], [], []]
