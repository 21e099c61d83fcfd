from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewloom.llm import divergence, resampling

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit_by_hand(rows, min_docs, top):
    terms = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))) for r in rows]
    counts, held, out = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, words in terms:
        counts[lang, source].update(words)
        held[lang].update(set(words))
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())
        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        q, p = shares(whole), {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            above = sorted((-(p[s][t] - q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pairs), ("term", above)):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return out


def test_audit_against_brute_force(spark, awkward, monkeypatch):
    given_docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = given_docs.unionByName(awkward.select(*given_docs.columns)).withColumns({"n": F.lit(1), "term": F.lit("x"), "p": F.lit(0), "docs": F.lit(2)})
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    for min_docs, top, size in ((30, 50, 128), (2, 3, 128), (1, 50, 3)):
        monkeypatch.setattr(divergence, "SOURCES", size)
        monkeypatch.setattr(divergence, "TERMS", 16 * size)
        found = [tuple(r) for r in divergence.audit(docs, min_docs=min_docs, top=top).collect()]
        assert len(found) == len(set(found))
        assert set(found) == audit_by_hand(rows, min_docs, top)


def test_audit_without_rows_or_terms(spark, no_docs):
    assert divergence.audit(no_docs).collect() == []
    docs = spark.createDataFrame([(None, None, "a"), ("12 34", None, "b"), (None, None, None), (None, "x", "a")], "text string, lang string, source string")
    found = {tuple(r) for r in divergence.audit(docs).collect()}
    assert found == {("", s, "pair", o, 0, n) for s, others in (("a", ["", "b"]), ("b", ["", "a"]), ("", ["a", "b"])) for n, o in enumerate(others, 1)}


def test_shares_of_very_large_counts(spark):
    c, n, v = 3 * 10**15, 7 * 10**15 + 11, 10**9
    row = spark.range(1).select(divergence.share(F.lit(c), F.lit(n), F.lit(v)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row.p == 1 + 10**9 * (c + 5) // (n + 5 * v) and row.none is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 6), st.integers(0, 6)), max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_skyband_keeps_what_few_dominate(cells, top, size):
    cells = sorted((f"s{g}", f"t{i:03}", c, c + more) for i, (g, c, more) in enumerate(cells))
    table = pa.table({"lang": ["x"] * len(cells), "source": [c[0] for c in cells], "term": [c[1] for c in cells],
                      "c": pa.array([c[2] for c in cells], pa.int64()), "low": pa.array([c[3] for c in cells], pa.int64())})
    kept = {(r["source"], r["term"]) for b in divergence.skyband(iter(table.to_batches(max_chunksize=size)), top) for r in b.to_pylist()}
    exact = {(s, t) for s, t, c, low in cells if sum(s2 == s and t2 < t and c2 >= c and l2 <= low for s2, t2, c2, l2 in cells) < top}
    assert kept == exact  # with so few rows nothing is left out of the comparison


def test_skyband_leaves_out_most(spark):
    rng = np.random.default_rng(3)
    n = 5_000
    table = pa.table({"lang": ["x"] * n, "source": ["s"] * n, "term": [f"{i:05}" for i in range(n)], "c": rng.integers(1, 1000, n), "low": rng.integers(1000, 2000, n)})
    kept = sum(b.num_rows for b in divergence.skyband(iter(table.to_batches()), 5))
    assert 5 <= kept < n // 5


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features_of(text):
    words = words_of(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def drawn_by_hand(rows, target, percent=25, min_words=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features_of(text))
    for text in target:
        t.update(features_of(text))
    all_s, all_t = sum(s.values()) + 10_000.0, sum(t.values()) + 10_000.0
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in range(10_000)]
    scored = []
    for doc_id, text in rows:
        f = features_of(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((r for r in scored if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    cut = percent * len(able) // 100
    return Counter([(*r[:4], i) for i, r in enumerate(able[:cut], 1)] + [(*r[:4], None) for r in able[cut:]] + [(*r[:4], None) for r in scored if r[4] < min_words])


def test_resampling_against_brute_force(spark, awkward):
    given_docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = given_docs.unionByName(awkward.select(*given_docs.columns)).withColumns({"weight": F.lit(1), "rank": F.lit("x"), "n_words": F.lit(0), "bucket": F.lit(2)})
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").unionByName(spark.createDataFrame([(None,), ("",)], "text string"))
    rows, texts = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    for percent, min_words in ((25, 20), (100, 0), (3, 1)):
        found = resampling.resample(docs, target, percent=percent, min_words=min_words)
        assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(tuple(r) for r in found.collect()) == drawn_by_hand(rows, texts, percent, min_words)


def test_resampling_of_nothing(spark, no_docs):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, target).collect() == []
    docs = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    found = resampling.resample(docs, target, percent=100).collect()
    assert Counter(tuple(r) for r in found) == drawn_by_hand([(1, "a b " * 20), (2, None)], [], percent=100)
    assert {(r.doc_id, r.n_features, r.rank) for r in found} == {(1, 79, 1), (2, 0, None)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" abcXY09é_.日\n", max_size=300)), min_size=1, max_size=8), st.integers(0, 200))
def test_features(texts, long):
    texts = [*texts, "z" * long + " " + "é" * long]
    words, row, bucket = resampling.features(pa.array(texts, pa.string()))
    assert words.tolist() == [len(words_of(t)) for t in texts]
    assert [sorted(bucket[row == i].tolist()) for i in range(len(texts))] == [sorted(features_of(t)) for t in texts]


@pytest.mark.parametrize("wanted", [1, 2, 1_700, 4_999, 5_000])
def test_bracket_is_widened_until_it_holds_the_cutoff(spark, wanted):
    rows = spark.range(5_000).select((F.col("id") % 7).alias("score"))
    low, high, above = resampling.bracket(rows, wanted, 5_000, error=1e-4)
    scores = sorted((i % 7 for i in range(5_000)), reverse=True)
    assert low <= scores[wanted - 1] <= high and above == sum(s > high for s in scores)
