from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from reviewloom.llm import ngram_join, shingles
from reviewloom.llm.count_tree import CountTree, forest, group_counts, needed, shared_bound, spanning

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} - {()}
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute_force(rows, percent=80):
    """Components over doc_ids; rows with one doc_id link if any of their texts does."""
    sets = [(i, word_sets(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                one, two = root(i), root(j)
                parent[max(one, two)] = min(one, two)
    return sorted(((i, len(s), None if i is None else root(i) if s else i) for i, s in sets), key=str)


def family(rng, size, words, edits):
    base = [f"w{rng.integers(10**9)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            copy[at] = f"e{rng.integers(10**9)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def families():
    rng, texts = np.random.default_rng(5), []
    passage = " ".join(f"p{i}" for i in range(60))
    for size, words, edits in ((40, 300, 7), (30, 60, 2), (8, 2000, 60), (25, 12, 1), (6, 5, 1), (4, 3, 0), (15, 100, 4)):
        texts += family(rng, size, words, edits)
    texts += [f"{passage} " + " ".join(f"u{rng.integers(10**9)}" for _ in range(rng.integers(1, 60))) for _ in range(40)]
    texts += [t.upper() for t in texts[:5]] + ["", None, " ", "one", "ONE", "two words", texts[0] * 2]
    return [(int(i), t) for i, t in zip(rng.permutation(1000), texts)]


@pytest.mark.parametrize("sample, block", [(64, 2000), (1, 2000), (1, 7)])
def test_components_against_brute_force(spark, families, monkeypatch, sample, block):
    monkeypatch.setattr(ngram_join, "SAMPLE", sample)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FAMILY", 125 * block)
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()), key=str)
    assert got == brute_force(families)


def test_awkward_documents(spark, awkward, no_docs):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(awkward).collect()), key=str)
    assert got == brute_force(rows)
    assert ngram_join.similar_documents(no_docs).count() == 0


def test_one_of_each_group(spark, awkward, no_docs):
    """Every row counts by itself: repeated rows, rows without doc_id, and different texts under one doc_id."""
    long = " ".join(f"w{i}" for i in range(50))
    more = spark.createDataFrame([(900, long, "x"), (900, "quite another text of seven words", "y"), (3, long + " end", "z"), (None, long, "n")], "doc_id long, text string, source string")
    docs = awkward.unionByName(more, allowMissingColumns=True)
    rows = docs.collect()
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    component = {r: c for r, _, c in brute_force([(i, r.text) for i, r in enumerate(rows)])}
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(component[i], []).append((r.doc_id is None, r.doc_id or 0, r.text))
    expected = [min(g)[1:] for g in groups.values()]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in expected)
    assert ngram_join.one_of_each_group(no_docs).count() == 0


def test_family_whose_smallest_member_links_to_few(spark):
    """Texts that drift from step to step: the first ones link to their neighbours only, and all share a passage."""
    rng = np.random.default_rng(3)
    text, rows = [f"d{i}" for i in range(400)], []
    for i in range(120):
        rows.append((i, " ".join(text)))
        text = list(text)
        for at in rng.integers(0, 340, 3):
            text[at] = f"n{rng.integers(10**9)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()), key=str)
    assert got == brute_force(rows) and len({c for _, _, c in got}) < 60


def test_frequent_tokens_are_marked(spark, families):
    docs = spark.createDataFrame(families, "doc_id long, text string")
    monkey, ngram_join.SAMPLE = ngram_join.SAMPLE, 1
    try:
        bitmap = ngram_join.frequent_tokens(docs, 5)
    finally:
        ngram_join.SAMPLE = monkey
    tokens, counts = np.unique(np.concatenate(shingles.shingle_sets(pa.array([t for _, t in families]))), return_counts=True)
    assert ngram_join.marked(tokens[counts >= 3], bitmap).all() and len(tokens[counts >= 3]) > 100
    assert ngram_join.marked(tokens[counts < 3], bitmap).mean() < 0.01


def test_shingle_sets_count_like_words():
    texts = ["a b c d e f", "A B c d e F g", "a b", "", None, "x\ty\x0bz  w v\nu t", "é ü " * 40, "a b c d e " * 50, "q" * 9000]
    found = shingles.shingle_sets(pa.array(texts))
    assert [len(f) for f in found] == [len(word_sets(t)) for t in texts]
    assert len(np.intersect1d(found[0], found[1])) == 2
    assert np.array_equal(shingles.shingle_sets(pa.array(["zzz", "a b"]))[1], found[2])


def test_tree_join_keeps_every_similar_pair():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.integers(3, 400)).astype(np.uint64)
        for _ in range(8):
            copy = base.copy()
            copy[rng.integers(0, len(base), len(base) // 12)] = rng.integers(0, 1 << 63, len(base) // 12).astype(np.uint64)
            sets.append(np.unique(shingles.mixed(copy)))
    counts, sizes = [group_counts(s) for s in sets], np.array([len(s) for s in sets])
    labels = np.arange(len(sets)) // 2
    found = [(min(x, y), max(x, y)) for a, b in CountTree(counts, sizes).candidates(80, labels) for x, y in zip(a.tolist(), b.tolist())]
    assert len(found) == len(set(found)) and all(labels[x] != labels[y] for x, y in found)
    shared = lambda i, j: len(set(sets[i].tolist()) & set(sets[j].tolist()))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    want = {(i, j) for i, j in pairs if labels[i] != labels[j] and shared(i, j) >= needed(sizes[i:i + 1], sizes[j:j + 1], 80)[0]}
    exact = {(i, j) for i, j in pairs if labels[i] != labels[j] and shared_bound(counts[i], counts[j]) >= needed(sizes[i:i + 1], sizes[j:j + 1], 80)[0]}
    assert exact <= set(found)
    assert want <= set(found) and len(want) > 50
    assert all(shared_bound(counts[i], counts[j]) >= shared(i, j) for i, j in pairs)

    def parts(edges, joined=()):
        root = list(range(len(sets)))
        for i, j in [*edges, *joined]:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root
    twins = [(i, i + 1) for i in range(0, len(sets), 2)]
    links = forest(sets, labels, labels, 80)
    assert len(links) < len(sets) and parts(links) == parts(want, twins) and all(i > j for i, j in links) and len({i for i, _ in links}) == len(links)
    none = np.array([], np.int64)
    assert forest([], none, none, 80) == [] and forest(sets[:1], labels[:1], labels[:1], 80) == []
    chosen = spanning(counts, sizes, labels, 80)
    assert len(chosen) < len(sets) and parts(chosen) == parts(exact)
    settled = np.arange(len(sets)) // 4  # pairs that are settled are left to others, the rest is linked as before
    some = {x for x in want if settled[x[0]] != settled[x[1]]}
    assert parts(forest(sets, settled, labels, 80)) == parts(some, twins)
