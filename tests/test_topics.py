from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from reviewloom.operators import aspects, lda, topics


def clusters(spark, n=40):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(loc=8 * (i % 3), scale=0.4, size=4)], i % 3) for i in range(3 * n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_few_documents_are_not_clustered(spark):
    df = clusters(spark, 16)
    assert df.count() == 48 and topics.assign_topics(df, 3).columns == [*df.columns, "topic", "topic_distance"]
    assert {r.topic for r in topics.assign_topics_from_text(df, 3, text="none").collect()} == {None}
    assert topics.enough_documents(clusters(spark, 17))


def test_clear_clusters_are_found(spark):
    rows = topics.assign_topics(clusters(spark), 3, noise_quantile=None).collect()
    pairs = {(r["label"], r["topic"]) for r in rows}
    assert len(rows) == 120 and len(pairs) == 3 == len({t for _, t in pairs})


def test_far_documents_are_noise(spark):
    df = clusters(spark).unionByName(spark.createDataFrame([(999, [8.0, 8.0, 8.0, 14.0], 1)], "vec_id long, embedding array<float>, label int"))
    rows = topics.assign_topics(df, 3, noise_quantile=0.9).collect()
    noise = [r for r in rows if r["topic"] == -1]
    assert len(rows) == 121 and 999 in {r["vec_id"] for r in noise} and len(noise) <= 18


def test_topics_of_the_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = topics.assign_topics(df, 10, noise_quantile=None).collect()
    assert len(rows) == df.count() and {r["topic"] for r in rows} == set(range(10))
    vectors = np.array([r["embedding"] for r in rows])
    to_mean = np.linalg.norm(vectors - vectors.mean(axis=0), axis=1).mean()
    assert np.mean([r["topic_distance"] for r in rows]) < to_mean


def test_text_topics(spark):
    words = [["battery", "charge", "power"], ["screen", "glare", "pixel"]]
    rows = [(i, " ".join(words[i % 2][(i + k) % 3] for k in range(8))) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, clean_light string")
    placed = topics.assign_topics_from_text(df, 2, iterations=20).collect()
    assert len({(r["i"] % 2, r["topic"]) for r in placed}) == 2


DOCS = [(0, "Battery battery dies, the battery!"), (0, "Charge it: été été"), (1, "Screen and battery a 4k"), (1, None), (2, "the and")]


def test_keywords_follow_the_formula(spark):
    df = spark.createDataFrame(DOCS, "topic int, clean_light string")
    terms = topics.topic_terms(df)
    expected = {0: Counter({"battery": 3, "dies": 1, "charge": 1, "été": 2}), 1: Counter({"screen": 1, "battery": 1, "4k": 1})}
    assert {(r["topic"], r["term"]): r["tf"] for r in terms.collect()} == {(t, w): n for t, c in expected.items() for w, n in c.items()}
    total = sum(expected.values(), Counter())
    average = sum(total.values()) / 2
    rows = topics.topic_keywords(terms, 2).collect()
    for topic, counts in expected.items():
        weights = {w: round(n * math.log(1 + average / total[w]), 8) for w, n in counts.items()}
        best = sorted(weights, key=lambda w: (-weights[w], w))[:2]
        assert [r["term"] for r in rows if r["topic"] == topic] == best


def test_info_and_gap(spark):
    df = spark.createDataFrame([(*d, ["ux"] if i else []) for i, d in enumerate(DOCS)], "topic int, clean_light string, aspects array<string>")
    keywords = topics.topic_keywords(topics.topic_terms(df), 5)
    info = topics.topic_info(df, keywords).collect()
    assert [(r["topic"], r["n"]) for r in info] == [(0, 2), (1, 2), (2, 1)]
    assert info[2]["keywords"] == [] and info[2]["name"] == "2" and info[0]["name"].startswith("0_")
    lexicon = aspects.lexicon_table(spark, {"power": ["battery", "charge"]})
    gap = {r["topic"]: r for r in topics.topic_lexicon_gap(df, keywords, lexicon).collect()}
    assert gap[0]["missed_keywords"] == 2 and gap[0]["share_without_aspect"] == 0.5 and gap[2]["missed_keywords"] == 0


def test_representatives(spark):
    df = spark.createDataFrame([(i, 0, [float(i), 0.0]) for i in range(5)] + [(9, 1, [1.0, 1.0])], "vec_id long, topic int, embedding array<float>")
    rows = topics.representative_documents(df, "vec_id", 3).orderBy("topic", "position").collect()
    assert [(r["topic"], r["vec_id"]) for r in rows] == [(0, 2), (0, 1), (0, 3), (1, 9)]


def test_the_fit_reads_kept_counts(spark, monkeypatch):
    fit, kept = topics.LDA.fit, []
    monkeypatch.setattr(topics.LDA, "fit", lambda self, df: (kept.append(df.storageLevel.useDisk), fit(self, df))[1])
    df = spark.range(60).select(F.concat(F.lit("word"), (F.col("id") % 3).cast("string")).alias("clean_light"))
    assert topics.assign_topics_from_text(df, 2, iterations=2).count() == 60 and kept == [True]


def drawn_texts(n=60, terms=300, topics_of=3, seed=5):
    """Lists of term numbers of a few made-up topics, and favours of terms that make plain steps slow."""
    import pyarrow as pa
    draw = np.random.default_rng(seed)
    kinds = draw.dirichlet(np.full(terms, 0.1), topics_of)
    lists = [np.sort(draw.choice(terms, int(draw.integers(1, 200)), p=kinds[i % topics_of])).tolist() for i in range(n)] + [[], [3, 3, 3]]
    return lists, pa.array(lists, pa.list_(pa.int32())), draw.gamma(100.0, 0.01, (terms, 4))


def plainly_settled(terms, counts, alpha, tolerance):
    at, change = np.ones(len(alpha)), 1.0
    while change > tolerance:
        theta = np.exp(lda.expected_logs(at))
        new = theta * (terms.T @ (counts / (terms @ theta))) + alpha
        at, change = new, np.abs(new - at).mean()
    return at


def test_polygammas():
    x = np.array([0.01, 0.125, 1.0, 2.5, 30.0, 5000.0])
    log, first, second = lda.polygammas(x)
    step = 1e-4 * x
    assert np.allclose(first, lda.digamma(x), rtol=1e-12)
    assert np.allclose(log, [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    assert np.allclose(first, [(math.lgamma(v + s) - math.lgamma(v - s)) / (2 * s) for v, s in zip(x, step)], rtol=1e-5)
    assert np.allclose(second, (lda.polygammas(x + step)[1] - lda.polygammas(x - step)[1]) / (2 * step), rtol=1e-5)


def test_amplified_steps_end_where_plain_ones_do():
    lists, texts, terms = drawn_texts()
    alpha, stats = np.full(4, 0.25), np.zeros((4, 300))
    found = lda.Inference(terms, alpha).weights(texts, stats)
    assert (found[60] == 0).all()

    def bound(words, counts, at):
        log, first, _ = lda.polygammas(np.append(at, at.sum()))
        logs = first[:-1] - first[-1]
        return counts @ np.log(terms[words] @ np.exp(logs)) + ((alpha - at) * logs + log[:-1]).sum() - log[-1]
    for i, words in enumerate(lists):
        if words:
            distinct, counts = np.unique(words, return_counts=True)
            plain = plainly_settled(terms[distinct], counts, alpha, 1e-3)
            theta = np.exp(lda.expected_logs(found[i]))
            again = theta * (terms[distinct].T @ (counts / (terms[distinct] @ theta))) + alpha
            assert np.abs(again - found[i]).mean() <= 1e-3 and bound(distinct, counts, found[i]) >= bound(distinct, counts, plain) - 1e-3
    counts = Counter(w for words in lists for w in words)
    assert np.allclose((stats * terms.T).sum(axis=0), [counts[t] for t in range(300)])


def test_slow_texts_take_few_steps(monkeypatch):
    lists, texts, terms = drawn_texts(40)
    alike, alpha, steps = 1 + terms / 100, np.full(4, 0.25), []
    for name in ("digamma", "polygammas"):
        monkeypatch.setattr(lda, name, lambda x, made=getattr(lda, name): (steps.append(1), made(x))[1])
    lda.Inference(alike, alpha).weights(texts)
    together = len(steps)
    distinct, counts = np.unique(max(lists, key=len), return_counts=True)
    plainly_settled(alike[distinct], counts, alpha, 1e-3)
    assert together < 100 < (len(steps) - together) / 2


def test_a_fit_is_the_same_however_texts_are_dealt_out(spark):
    lists, _, _ = drawn_texts(90)
    df = spark.createDataFrame([(words,) for words in lists], "_terms array<int>")
    one, many = (lda.LDA(3, 17, 3, 300).fit(df.repartition(n)) for n in (1, 7))
    assert np.allclose(one.terms, many.terms, rtol=1e-6) and np.allclose(one.alpha, many.alpha, rtol=1e-6)


def test_every_step_of_a_fit_sees_all_texts(spark):
    """The sums of a single step by hand, over all texts; texts without a term add nothing."""
    lists, texts, _ = drawn_texts(90)
    fitted = lda.LDA(3, 17, 1, 300).fit(spark.createDataFrame([(words,) for words in lists], "_terms array<int>"))
    first = np.random.default_rng(17).gamma(100.0, 0.01, (3, 300))
    start, stats = lda.Inference(np.exp(lda.expected_logs(first)).T, np.full(3, 1 / 3)), np.zeros((3, 300))
    start.weights(texts, stats)
    weight = (lda.DELAY + 1) ** -lda.FORGET
    second = (1 - weight) * first + weight * (stats * start.terms.T + 1 / 3)
    assert np.allclose(fitted.terms, np.exp(lda.expected_logs(second)).T, rtol=1e-9) and not np.allclose(fitted.alpha, 1 / 3, rtol=1e-4)


def test_term_numbers(spark):
    df = spark.createDataFrame([("Battery the battery a Dies",), (None,), ("a",), ("a \U00020BB7",)], "clean_light string")
    rows = [r[0] for r in df.select(topics.term_numbers(F.col("clean_light"), 1 << 18, ["THE"])).collect()]
    assert rows[0] == sorted(rows[0]) and len(rows[0]) == 3 and len(set(rows[0])) == 2 and rows[1:3] == [[], []] and len(rows[3]) == 1
