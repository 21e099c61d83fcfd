from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewloom.llm import quality, rans, token_counts, token_files
from reviewloom.sources.workspace import fresh_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    text, words = text or "", words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text):
    words = [w.encode() for w in words_of(text)]
    ones = [xxhash.xxh64_intdigest(w, seed=42) for w in words]
    twos = [xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42)) for a, b in zip(ones, ones[1:])]
    return [signed(h) % quality.BUCKETS for h in ones + twos]


def test_quality_against_brute_force(spark, awkward):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    labels = spark.createDataFrame([(r.doc_id, r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
                                   + [(None, 1), (1, None), (10**9, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    rows, good = docs.collect(), {r.doc_id for r in labels.collect() if r.quality == 1} - {None}
    raw, target = Counter(), Counter()
    for r in rows:
        g = grams(r.text)
        raw.update(g)
        if r.doc_id in good:
            target.update(g)
    t, n = sum(target.values()), sum(raw.values())
    ratio = [round(quality.SCALE * (math.log((target[b] + 1) / (t + quality.BUCKETS)) - math.log((raw[b] + 1) / (n + quality.BUCKETS))))
             for b in range(quality.BUCKETS)]
    want = Counter()
    for r in rows:
        g = grams(r.text)
        score = sum(ratio[b] for b in g) / len(g) / quality.SCALE if g else 0.0
        b = base(r.text)
        want[(r.doc_id, *b, not b[-1] and score >= -0.05, round(score, 9))] += 1
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 9))
                  for r in quality.judge(docs, labels).collect())
    assert got == want
    assert {k for *_, k, _ in got} == {True, False}


@pytest.mark.parametrize("text", ["a b c d e f g h " * 3, " ".join(map(str, range(8))) + " x " + " ".join(map(str, range(8))) + " y z",
                                  "x " * 30, " ".join(map(str, range(50))), " ".join(f"{i % 9}" for i in range(40)) + " end"])
def test_repeats(spark, text):
    r = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)


def test_quality_of_nothing_and_of_all_columns(spark, awkward, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(no_docs, none).count() == 0
    kept = quality.keep_good(awkward, none)
    judged = quality.judge(awkward, none)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in judged.filter("kept").collect())


def test_quality_plan_has_no_python(spark, awkward):
    plan = quality.judge(awkward, spark.createDataFrame([], "doc_id long, quality int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_follows_labels(spark):
    judged = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    pairs = Counter((r.quality, r.kept) for r in judged.filter("NOT base_failed").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect())
    assert pairs[(1, False)] <= 0.01 * pairs[(1, True)] and pairs[(0, True)] <= 0.2 * pairs[(0, False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700), st.integers(1, 9), st.integers(1, 5))
def test_rans_roundtrip(symbols, lanes, interval):
    table = rans.scaled(np.bincount(symbols, minlength=50) if symbols else np.zeros(50, int), 12)
    block = rans.encode(np.asarray(symbols, int), table, lanes, interval)
    assert rans.decode(block, table).tolist() == symbols
    points = -(-len(symbols) // (lanes * interval))
    for first in range(points):
        at = first * lanes * interval
        assert rans.decode(block, table, first, first + 1).tolist() == symbols[at: at + lanes * interval]


def test_rans_notices_damage():
    symbols = np.arange(5000) % 37
    table = rans.scaled(np.bincount(symbols))
    block = bytearray(rans.encode(symbols, table))
    block[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(block), table)
    with pytest.raises(ValueError):
        rans.decode(rans.encode(symbols, table), rans.scaled(np.bincount(symbols[1:])))
    with pytest.raises(ValueError):
        rans.encode([0], rans.scaled(np.array([0, 5])))
    skewed = rans.scaled(np.array([10**12] + [1] * 60_000), 16)
    assert skewed.frequency.sum() == 1 << 16 and skewed.frequency.min() == 1


def test_token_files(spark, awkward, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 2000)
    path = fresh_path(spark, "test-files")
    token_files.write_tokens(awkward, WORDS, path, vocabulary_size=49_408, end_id=2)
    assert spark.read.parquet(f"{path}/blocks").count() > 3
    plain, at = Tokenizer.from_file(WORDS), 0
    rows = token_files.read_tokens(spark, path, vocabulary_size=49_408).orderBy("start").collect()
    want = Counter((r.doc_id, tuple(plain.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in awkward.collect())
    got = Counter()
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
        got[(r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()))] += 1
    assert got == want
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in awkward.collect()), key=lambda i: (i is not None, i))
    empty = fresh_path(spark, "test-files")
    token_files.write_tokens(no_docs, WORDS, empty, vocabulary_size=49_408, end_id=2)
    assert token_files.read_tokens(spark, empty, vocabulary_size=49_408).count() == 0


def test_token_files_do_not_depend_on_how_rows_are_dealt(spark):
    """Rows with one doc_id, or none, come in the order of their lengths and contents."""
    rows = [(i % 7 if i % 3 else None, f"text {i % 11} " * (i % 5)) for i in range(120)]
    found = []
    for parts in (1, 5):
        path = fresh_path(spark, "test-files")
        token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), WORDS, path, vocabulary_size=49_408, end_id=2)
        found.append([(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read_tokens(spark, path, vocabulary_size=49_408).orderBy("start").collect()])
    assert found[0] == found[1] and len(found[0]) == 120
    assert [r[0] for r in found[0]] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))


def test_ids_are_as_wide_as_the_vocabulary_asks():
    assert [token_files.id_type(n) for n in (1, 1 << 16, (1 << 16) + 1)] == ["<u2", "<u2", "<u4"]


def greedy(data: bytes, pieces: set, longest: int) -> int:
    at = count = 0
    while at < len(data):
        size = next(n for n in range(min(longest, len(data) - at), 0, -1) if data[at: at + n] in pieces)
        at += size
        count += 1
    return count


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("abc ", min_size=2, max_size=6), max_size=25), st.lists(st.text("abcd", min_size=1, max_size=12), min_size=1, max_size=8))
def test_automaton_is_greedy(extra, words):
    pieces = {bytes([b]) for b in range(256)} | {p.encode() for p in extra}
    machine = token_counts.Automaton(pieces)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, lengths = token_counts.word_spans(data)
    assert machine.counts(data, starts, lengths).tolist() == [greedy(b" " + w.encode(), pieces, 8) for w in words]


def test_token_counts(spark, awkward, no_docs):
    import base64
    pieces = {base64.b64decode(x.split()[0]) for x in open(RANKS, "rb") if x.strip()}
    longest = max(map(len, pieces))
    want = Counter()
    for r in awkward.collect():
        words = [w.encode() for w in words_of(r.text)]
        want[(r.doc_id, len(words), sum(greedy(b" " + w, pieces, longest) for w in words), len((r.text or "").encode()))] += 1
    got = Counter(tuple(r) for r in token_counts.count_tokens(awkward, RANKS).collect())
    assert got == want
    assert token_counts.count_tokens(no_docs, RANKS).count() == 0
