from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewloom.llm import class_model

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UNSEEN, PRIOR, PSEUDO = 0.5, 32.0, 5.0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def ratio(n, expected):
    extra = PSEUDO * expected / (expected + PSEUDO)
    return math.log((n + extra) / (expected + extra))


def by_hand(rows, classes, rounds):
    """The same model with words as strings, everything in dictionaries, one word and one class at a time."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    texts = [[*words_of(t), None] for _, t in rows]
    train = [t for t, h in zip(texts, held) if not h]
    counts = Counter(w for t in train for w in t)
    total, types = sum(counts.values()), len(counts)
    number = {w: int(class_model.tokens_of(pa.array([w]))[0][:1].view(np.int64)[0]) for w in counts if w is not None}
    seeds = sorted(number, key=lambda w: (-counts[w], number[w]))[:classes - 2]
    cls = {w: 2 + seeds.index(w) if w in seeds else 1 for w in number} | {None: 0}
    bigrams = Counter((a, b) for t in train for a, b in zip([None, *t], t))

    def matrix():
        m = [[0] * classes for _ in range(classes)]
        for (a, b), n in bigrams.items():
            m[cls[a]][cls[b]] += n
        return m

    for step in range(rounds):
        m = matrix()
        left, right = [sum(r) + 1e-9 for r in m], [sum(r[c] for r in m) + 1e-9 for c in range(classes)]
        whole = max(1.0, float(sum(map(sum, m))))
        before, after = {w: Counter() for w in cls}, {w: Counter() for w in cls}
        for (a, b), n in bigrams.items():
            before[b][cls[a]] += n
        for t in train:
            for a, b in zip(t, t[1:]):
                after[a][cls[b]] += 1
        new = dict(cls)
        for w, own in cls.items():
            if w is None or (step == 0 and own >= 2):
                continue
            i, o = sum(before[w].values()), sum(after[w].values())
            scores = {}
            for c in range(1, classes):
                less_in = lambda x: before[w][x] if c == own else 0  # noqa: B023, E731
                less_out = lambda x: after[w][x] if c == own else 0  # noqa: B023, E731
                r, s = (max(right[c] - i, 1e-9), max(left[c] - o, 1e-9)) if c == own else (right[c], left[c])
                scores[c] = (sum(n * ratio(max(m[x][c] - less_in(x), 0), left[x] * r / whole) for x, n in before[w].items())
                             + sum(n * ratio(max(m[c][x] - less_out(x), 0), s * right[x] / whole) for x, n in after[w].items()))
            best = max(scores, key=lambda c: (scores[c], -c))
            if scores[best] > scores[own] + 1e-12:
                new[w] = best
        cls = new
    m, once = matrix(), Counter(cls[w] for w, n in counts.items() if n == 1)
    size = [sum(r[c] for r in m) for c in range(classes)]
    mass = [size[c] + once[c] + UNSEEN for c in range(classes)]
    frequency = [s / max(1, sum(size)) for s in size]
    follows = [[(n + PRIOR * f) / (sum(r) + PRIOR) for n, f in zip(r, frequency)] for r in m] + [frequency]
    out = []
    for (i, _), text, h in zip(rows, texts, held):
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in text)
        score, at = 0.0, 0
        for w in text:
            if counts[w]:
                score += math.log10(follows[at][cls[w]] * counts[w] / mass[cls[w]])
                at = cls[w]
            elif total:
                score += math.log10(sum(follows[at][c] * (once[c] + UNSEEN) / mass[c] for c in range(classes)))
                at = classes
        out.append((i, h, len(text), sum(counts[w] > 0 for w in text), total, base, score if total else base))
    return out


def same(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6))
    found, wanted = sorted((tuple(r) for r in found), key=key), sorted(wanted, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in wanted], rtol=0, atol=1e-6)


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_against_brute_force(spark, awkward, rounds, monkeypatch):
    monkeypatch.setattr(class_model, "PART", 5_000)
    given_docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = given_docs.unionByName(awkward.select(*given_docs.columns)).withColumns({"slice": F.lit(1), "held": F.lit("x"), "part": F.lit(0)}).repartition(5)
    found = class_model.score_documents(docs, classes=9, rounds=rounds)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(found.collect(), by_hand([(r.doc_id, r.text) for r in docs.collect()], 9, rounds))


def test_without_rows_or_training(spark, no_docs):
    assert class_model.score_documents(no_docs).collect() == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    docs = spark.createDataFrame([(held[0], "a b"), (held[1], None), (held[2], " \n")], "doc_id long, text string")
    same(class_model.score_documents(docs).collect(), by_hand([tuple(r) for r in docs.collect()], 64, 3))
    docs = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    same(class_model.score_documents(docs, classes=3).collect(), by_hand([(None, None)] * 2, 3, 3))


def test_rounds_help_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    means = []
    for rounds in (0, 3):
        r = class_model.score_documents(docs, rounds=rounds).filter("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
        means.append(r[0])
        assert r[0] > r[1] + 0.5
    assert means[1] > means[0] + 0.1
    assert spark.sql("SHOW TABLES").filter("tableName LIKE 'llm_%'").count() == 0


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(5)
    counts, cls = rng.integers(1, 4, 40), np.concatenate([[0], rng.integers(1, 6, 39)])
    counts[0] = 30
    size = np.bincount(cls, counts, 7)
    pairs = np.outer(size, size) // size.sum()
    pairs[:, 0] += (size - pairs.sum(axis=0)).astype(int)[0]
    pairs += np.diag(size.astype(int) - pairs.sum(axis=0))  # every token is counted once as the second of a pair
    model = class_model.Model(pairs, np.bincount(cls[counts == 1], minlength=7), int(size.sum()), 40)
    for before in range(8):
        known = model.scores(np.full(40, before), cls, counts)
        new = model.scores(np.array([before]), np.array([1]), np.array([0]))
        assert abs((10 ** known).sum() + (10 ** new).sum() - 1) < 1e-9


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_numbers(values):
    assert class_model.unpack(class_model.pack(np.array(values, np.int64))).tolist() == values


def test_parts_follow_the_order_of_words():
    words = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    part = class_model.part_of(words, 7)
    assert (np.diff(part) >= 0).all() and set(part.tolist()) == set(range(7))
