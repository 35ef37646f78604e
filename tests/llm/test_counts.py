"""Operators 11 to 13 against the library, SQL and plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest
import sentencepiece

import __spark_entry__ as entry
from heliograph.llm import divergence, fill_middle, queries, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "abcdefghi éèñß한국語漢字🎉́ \n\t\x1c\x85\x00 's0123٣²Ⅷ..!!--__▁▁  <s></s><0x0A>thaetionser"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def scores():
    return token_count.load_vocabulary(MODEL)


def some_texts() -> list[str]:
    random.seed(5)
    made = ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    return [*made, "a" * 5000, " " * 333, "the " * 3000, "", "x" * 20 + " " * 40 + "y", "漢字" * 3000, "internationalisation"]


# ---- operator 11


def test_counts_equal_the_library(library, scores):
    texts = some_texts()
    assert token_count.Counter(scores).short(pa.array(texts)).tolist() == [len(ids) for ids in library.encode(texts)]


def test_proven_strings_are_one_token(library, scores):
    whole = token_count.whole_tokens(scores)
    for piece in random.Random(2).sample(sorted(whole), 2000):
        assert token_count.merged(piece, scores) == [piece]
        if piece.startswith("▁") and piece.strip("▁"):
            assert library.encode(piece[1:], out_type=str) == [piece]


def test_a_string_that_merging_passes_by_is_not_proven():
    scores = {"a": -9.0, "b": -9.0, "c": -9.0, "bc": -1.0, "ab": -2.0, "abc": -3.0, "x": -9.0, "axb": -4.0}
    whole = token_count.whole_tokens(scores)
    assert "abc" in whole and "axb" not in whole
    assert token_count.Counter(scores).of("axb") == 3
    assert token_count.merged("abab", scores) == ["ab", "ab"] and token_count.merged("abcab", scores) == ["abc", "ab"]


def test_no_vocabulary_string_spans_a_cut(scores):
    cuts = token_count.Cuts(scores)
    for piece in scores:
        data = np.frombuffer(piece.encode(), dtype=np.uint8)
        assert cuts.starts(data, np.array([0])).tolist() == [0]


@pytest.mark.parametrize("size", [5, 64])
def test_blocks_change_nothing(library, scores, monkeypatch, size):
    monkeypatch.setattr(token_count, "BLOCK_BYTES", size)
    counter = token_count.Counter(scores)
    for text in some_texts()[-300:]:
        if text:
            assert counter.long(memoryview(text.encode())) == len(library.encode(text))


def test_small_caches_change_no_count(library, scores, monkeypatch):
    monkeypatch.setattr(token_count, "MOST_KEPT", 3)
    monkeypatch.setattr(token_count, "LONGEST_KEPT", 4)
    texts = some_texts()[:500]
    assert token_count.Counter(scores).short(pa.array(texts)).tolist() == [len(ids) for ids in library.encode(texts)]


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as file:
        raw = file.read()
    assert raw.endswith(b"\x20\x00\x32\x00")
    changed = raw[:-4] + b"\x20\x01\x32\x00"  # spaces are to be joined
    (tmp_path / "other.model").write_bytes(changed)
    with pytest.raises(ValueError, match="normalizer"):
        token_count.load_vocabulary(str(tmp_path / "other.model"))


def test_op11(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    found = queries.op11_token_counts(spark, small).collect()
    assert len(found) == len(texts)
    for row in found:
        text = texts[row["doc_id"]]
        n = len(library.encode(text))
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_counts_of_odd_rows(spark, odd, nothing, scores, library):
    rows = token_count.counted(odd, scores).collect()
    expected = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in odd.collect())
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert token_count.counted(nothing, scores).collect() == []
    long = "word é 漢字 " * 300_000
    found = token_count.counted(spark.createDataFrame([(1, long), (2, "a")], "doc_id long, text string"), scores, limit=1).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found] == [(len(long.encode()), len(library.encode(long)), True), (1, 1, False)]


# ---- operator 12


def plainly_turned(text, key):
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("points", [1, 3, 1 << 20])
def test_pieces_equal_a_regular_expression(monkeypatch, points):
    monkeypatch.setattr(fill_middle, "BLOCK_POINTS", points)
    for key, text in enumerate(t[:400] for t in some_texts()):
        text = text.replace("s>", random.Random(key).choice(["P>", "S>", "<M>", "<P", " <S"]))
        found = fill_middle.turned(text, key, fill_middle.Plan())
        assert found == plainly_turned(text, key)
        assert fill_middle.restored(found[4], found[1]) == text


def test_op12(spark, small):
    assert oracle.difference(queries.op12_fill_in_middle(spark, small), oracle.connect(small), entry.oracle_sql()["op12_fill_in_middle"]) == ""
    forms = Counter(r["form"] for r in queries.op12_fill_in_middle(spark, small).collect())
    assert set(forms) == {"plain", "spm", "psm"} and forms["spm"] > forms["psm"]


def test_turned_odd_rows(spark, odd, nothing):
    found = sorted(((r["doc_id"] or 0, r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in fill_middle.transformed(odd).collect()), key=repr)
    expected = sorted(((r["doc_id"] or 0, *plainly_turned(r["text"] or "", r["doc_id"]), r["text"] or "") for r in odd.collect()), key=repr)
    assert found == expected
    assert fill_middle.digested(fill_middle.transformed(nothing)).collect() == []
    every = fill_middle.transformed(spark.createDataFrame([(1, "ab cd " * 500_000)], "doc_id long, text string"), fill_middle.Plan(rate=100)).first()
    assert every["form"] != "plain" and every["n"] == 1_000_001 and every["restored"] == "ab cd " * 500_000


# ---- operator 13


def plain_audit(rows, least=30, most=50):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = term.findall(text.translate(LOWER))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    found = set()
    for lang in held.keys() | {g[0] for g in counts}:
        kept = [t for t, n in held[lang].items() if n >= least]
        of = {s: c for (l, s), c in counts.items() if l == lang}
        shares = {}
        for name, c in [*of.items(), (None, sum(of.values(), Counter()))]:
            total = sum(c[t] for t in kept)
            shares[name] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for name in of:
            pairs = sorted((-sum(abs(shares[name][t] - shares[other][t]) for t in kept), other.encode()) for other in of if other != name)
            terms = sorted((shares[None][t] - shares[name][t], t.encode()) for t in kept if of[name][t] and shares[name][t] > shares[None][t])[:most]
            for part, ranked in (("pair", pairs), ("term", terms)):
                found |= {(lang, name, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return found


def as_tuples(df):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("seat", "block", "rounds", "least"), [(4, 1 << 13, 8, 30), (1, 64, 2, 3), (3, 500, 1, 2)])
def test_audit_equals_a_plain_one(spark, small, monkeypatch, seat, block, rounds, least):
    for name, value in (("SEAT_SOURCES", seat), ("BLOCK_TERMS", block), ("ROUNDS_AT_ONCE", rounds), ("LEAST_DOCUMENTS", least)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    expected = plain_audit(rows, least)
    assert as_tuples(divergence.audited(docs)) == expected
    assert {r[2] for r in expected} == {"pair", "term"}


def test_op13(spark, small):
    assert oracle.difference(queries.op13_source_divergence(spark, small), oracle.connect(small), entry.oracle_sql()["op13_source_divergence"]) == ""


def test_audit_of_odd_rows(spark, odd, nothing, monkeypatch):
    assert as_tuples(divergence.audited(odd)) == plain_audit([("en", None, r["text"]) for r in odd.collect()])
    assert divergence.audited(nothing).collect() == []
    monkeypatch.setattr(divergence, "LEAST_DOCUMENTS", 1)
    monkeypatch.setattr(divergence, "SEAT_SOURCES", 1)
    rows = [(None, "a", "X y Y"), (None, None, "x z"), ("", "b", None), ("de", "a", "é É"), ("de", "a", "é É"), ("de", "b", ""), ("fr", "c", "12"), ("fr", "d", None), ("nl", "e", "een")]
    rows += [("tie", f"s{k}", "p q r s") for k in range(5)]
    docs = spark.createDataFrame([(*r, "x", 1, "t") for r in rows], "lang string, source string, text string, term string, n long, part string")
    found = as_tuples(divergence.audited(docs))
    assert found == plain_audit(rows, 1)
    assert ("fr", "c", "pair", "d", 0, 1) in found  # no term is kept


def test_very_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Aé b漢 " * 2000 + "end"
    whole = divergence.slice_counts(np.array([0]), 1, pa.array([text]))
    monkeypatch.setattr(divergence, "SLICE_BYTES", 100)
    pieces = divergence.slice_counts(np.array([0]), 1, pa.array([text]))
    as_dict = lambda x: dict(zip(x[1].to_pylist(), zip(x[0].tolist(), x[2].tolist(), x[3].tolist(), strict=True), strict=True))
    assert as_dict(pieces) == as_dict(whole) == {"aé": (0, 2000, 1), "b漢": (0, 2000, 1), "end": (0, 1, 1)}


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        total = rng.choice([0, 7, 10**6, 8 * 10**15])
        terms, counts = rng.randint(1, 10**5), [0, total // 3, total]
        assert divergence.scaled(np.array(counts), total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]


def test_vectors_come_back():
    at, counts = np.array([9, 2, 5]), np.array([1, 1 << 40, 3])
    assert divergence.unpacked(divergence.packed(at, counts), 12).tolist() == [0, 0, 1 << 40, 0, 0, 3, 0, 0, 0, 1, 0, 0]
    assert divergence.unpacked(None, 2).tolist() == [0, 0]


# ---- very long texts, ties and clashing names in the operators before


def test_very_long_texts(spark):
    import tiktoken

    from heliograph.llm import bpe, license_scan, quality_rules

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    long = "word Apache  License é\n" * 50_000
    docs = spark.createDataFrame([(1, long), (2, "mit license mit license")], "doc_id long, text string")
    ids = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={}).encode_ordinary(long)
    row = bpe.digests(docs, ranks, pattern).where("doc_id = 1").first()
    assert row["n_tokens"] == len(ids) and row["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    found = {r["doc_id"]: r for r in license_scan.summary(license_scan.scanned(docs)).collect()}
    assert (found[1]["n_words"], found[1]["n_base"], found[1]["first_word"], found[1]["last_word"]) == (200_000, 50_000, 1, 199_997)
    assert (found[2]["n_base"], found[2]["first_word"], found[2]["last_word"], found[2]["score"]) == (2, 0, 2, 1.0)  # the same notice twice
    judged = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    assert (judged[1]["n_words"], judged[1]["n_dup_lines"], judged[1]["n_repeat_words"], judged[1]["base_failed"]) == (200_000, 49_999, 200_000, True)


def test_clashing_names_and_ties(spark):
    from heliograph.llm import chat_format, quality_rules

    rows = [(1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "yes", "x", 1), (2, 0, "user", "hi", "x", 1), (2, 0, "user", "hi", "x", 1)]
    plain = [r[:4] for r in rows]
    clash = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prefix string, hash int")
    found = chat_format.rendered(clash)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, chat_format.rendered(spark.createDataFrame(plain, "conv_id long, turn long, role string, text string")).collect()))
    same = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(k % 2, same, 0.5, True) for k in range(6)], "doc_id long, text string, posterior double, kept boolean")
    judged = quality_rules.judged(docs).collect()
    assert len(judged) == 6 and len({(r["kept"], r["posterior"]) for r in judged}) == 1
