from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from reviewloom.llm import gru, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("words", [0, 1, 31, 32, 33, 47, 48, 49, 100, 1000])
def test_windows_cover_every_word(words):
    starts = gru.window_starts(words)
    covered = {i for s in starts for i in range(s, min(words, s + gru.WIDTH))}
    assert covered == set(range(words)) and (np.diff(starts) <= gru.STRIDE).all() and (np.diff(starts) > 0).all()


def test_gradients():
    rng = np.random.default_rng(0)
    net = gru.Network({k: v.astype(np.float64) for k, v in gru.Network.fresh(12, 1).weights.items()})
    net.weights["E"] *= 10
    net.weights["E"][0] = 0
    features, mask = rng.integers(0, 12, (7, 5, 3)), np.ones((7, 5))
    mask[4:, 2] = 0
    labels, share = np.array([1.0, 0, 1, 0, 1]), rng.random(5)
    _, grad = net.gradients(features, mask, labels, share)
    for name, g in grad.items():
        w = net.weights[name]
        for _ in range(4):
            at = tuple(rng.integers(1 if name == "E" else 0, n) for n in w.shape[:1]) + tuple(rng.integers(0, n) for n in w.shape[1:])
            w[at] += 1e-6
            high = net.gradients(features, mask, labels, share)[0]
            w[at] -= 2e-6
            low = net.gradients(features, mask, labels, share)[0]
            w[at] += 1e-6
            assert g[at] == pytest.approx((high - low) / 2e-6, rel=1e-4, abs=1e-7), name


def test_word_features():
    from reviewloom.llm.token_counts import word_spans
    def of(text):
        data = np.frombuffer(text.encode() + b" ", np.uint8)
        return toxicity.word_features(data, *word_spans(data))
    assert (of("Idiot")[0] == of("x \"idiot!!\"")[1]).all()
    assert (of("idiotic")[0, 1:3] == of("idiots")[0, 1:3]).all() and of("idiotic")[0, 0] != of("idiots")[0, 0]
    assert (of("a ?!?! abcd")[:2, 1:] == 0).all() and of("?!?!")[0, 0] == 0


def toxic_corpus(spark):
    rng, rows = np.random.default_rng(6), []
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("alo", "ero", "ino", "uno", "ama")]
    for i in range(900):
        words = list(rng.choice(vocabulary, rng.integers(3, 120)))
        if toxic := int(rng.random() < 0.3):
            for _ in range(1 + len(words) // 40):
                words.insert(rng.integers(0, len(words)), str(rng.choice(["vermin", "vermins,", "filthrag", "Filthrags!"])))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int")


def test_scores(spark, awkward, no_docs):
    corpus = toxic_corpus(spark)
    labels = corpus.filter("doc_id % 3 <> 1").select("doc_id", "toxic").union(
        spark.createDataFrame([(None, 1), (1, None), (3, None), (10**9, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_documents(corpus, labels).collect()}
    assert len(got) == 900
    right = 0
    for r in corpus.collect():
        s = got[r.doc_id]
        assert s.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= s.score <= 1 and s.predicted == int(s.score >= 0.5)
        right += s.predicted == r.toxic
    assert right >= 0.97 * 900
    clean = toxicity.without_toxic(corpus, labels)
    assert clean.columns == corpus.columns and {r.doc_id for r in clean.collect()} == {i for i, s in got.items() if not s.predicted}
    odd = toxicity.score_documents(awkward.select("doc_id", "text"), labels.filter("toxic = 0"))
    assert odd.count() == awkward.count()
    assert {r.score for r in odd.collect()} == {0.0}  # no labelled documents of both kinds
    assert toxicity.without_toxic(awkward, labels).columns == awkward.columns
    assert toxicity.score_documents(no_docs, labels).count() == 0


def test_training_on_long_texts_and_present_ids(spark):
    """Labelled texts all longer than `longest`, and labels most of whose ids are not in the table."""
    from pyspark.sql import functions as F
    corpus = toxic_corpus(spark).filter("length(text) > 150")
    long = corpus.withColumn("text", F.array_join(F.array_repeat("text", 8), " "))
    labels = corpus.select("doc_id", "toxic").union(spark.range(10**6, 10**6 + 20_000).selectExpr("id", "cast(id % 2 as int)"))
    sample = toxicity.training_rows(long, labels, per_label=100, longest=400)
    assert (sample.groupby("toxic").size() == 100).all() and (sample["text"].str.len() > 300).all()
    assert sample["text"].str.len().max() <= 16 * 410 and sample.equals(toxicity.training_rows(long.repartition(7), labels, per_label=100, longest=400))
    few = toxicity.training_rows(long.withColumn("text", F.array_join(F.array_repeat("text", 100), " ")), labels, per_label=100, longest=400)
    assert len(few) == 200 and (few["text"].str.len() <= 402).all()
    rows = toxicity.score_documents(long, labels, longest=400).join(corpus, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    with pytest.warns(UserWarning, match="both kinds"):
        toxicity.score_documents(long, labels.filter("toxic = 0"))


def test_every_window_counts():
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), *(" ".join(words[:at] + ["vermin"] + words[at:]) for at in (0, 57, 200, 399)), "vermin", "", None]
    train = [" ".join(words[i:i + 30]) for i in range(0, 360, 6)] + [" ".join(words[i:i + 10] + ["vermin"] + words[i + 10:i + 30]) for i in range(0, 360, 6)]
    model = toxicity.fit(train, np.array([0] * 60 + [1] * 60), features=1000, least=2, epochs=8, seed=1)
    scores = model.scores(pa.array(texts))
    assert scores[0] < 0.5 and (scores[1:6] > 0.5).all() and scores[6] == scores[7] < 0.5


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    order = score.argsort().argsort()
    p = toxic.sum()
    assert (order[toxic == 1].sum() - p * (p - 1) / 2) / (p * (len(rows) - p)) > 0.95
    assert ((score >= 0.5) & (toxic == 0)).mean() < 0.02


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pipeline(spark):
    """Each stage against a plain version of what it has to do with its own input."""
    from reviewloom.llm import mixing, ngram_join, quality
    from tests.llm.test_ngram_join import brute_force
    from tokenizers import Tokenizer
    import public_tokenizers
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "mixing sources", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300").cache()
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(stage(spark, inputs[-1], SF).cache())
    assert all(d.columns == columns for d in inputs[:5])
    kept = [[r.doc_id for r in d.collect()] for d in inputs]
    assert sorted(kept[1]) == sorted(r.doc_id for r in quality.judge(docs, labels).filter("kept").collect())
    assert sorted(kept[2]) == sorted(r.doc_id for r in toxicity.score_documents(inputs[1], labels).filter("predicted = 0").collect())
    assert len(kept[2]) > 0.7 * len(kept[1])  # most documents are clean
    groups = brute_force([(r.doc_id, r.text) for r in inputs[2].collect()])
    assert sorted(kept[3]) == sorted(i for i, _, c in groups if i == c)
    share = {r.doc_id: r for r in mixing.mix_documents(inputs[3]).collect()}
    times = Counter(kept[4])
    assert all(abs(times[i] - r.taken / r.size) < 1 for i, r in share.items())
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list)
    for r in inputs[5].collect():
        pieces[r.doc_id].append(r)
    for r in inputs[4].collect():
        total = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        assert sum(p.length for p in pieces[r.doc_id]) == total * times[r.doc_id]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, no_docs, tmp_path):
    """Nulls, repeated rows, clashing columns, labels of other documents, no labels, no rows: no stage fails."""
    from pyspark.sql import functions as F
    plain = " ".join(f"word{i}" for i in range(60))
    long = awkward.filter("doc_id IN (7, 8) OR doc_id IS NULL").withColumn("text", F.lit(plain))  # copies under several ids and under none
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (7, None, 1), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    docs = awkward.unionByName(long)
    cases = {"awkward": (docs, labels), "unlabelled": (docs, labels.limit(0)), "empty": (no_docs, labels)}
    for name, (docs, known) in cases.items():
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        known.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        with pytest.warns(UserWarning, match="both kinds"):
            pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        by_doc = Counter()
        for r in pieces:
            by_doc[r.doc_id] += r.length
        assert (not pieces) == (name == "empty") and all(n > 0 for n in by_doc.values())
        assert not {8, None} & set(by_doc)  # one of the copies stays, the one with the smallest id


def test_the_network_is_not_trained_in_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'foul' if i % 2 else 'kind'} word {i % 5} " * 5) for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    sample = toxicity.training_rows(docs, labels, per_label=50, longest=400)
    here = toxicity.fit(sample["text"].tolist(), sample["toxic"].to_numpy(), features=100, least=2, epochs=2, seed=1)
    monkeypatch.setattr(toxicity.gru, "train", lambda *a, **b: pytest.fail("trained in the driver"))
    there = toxicity.fitted(docs, labels, per_label=50, longest=400, features=100, least=2, epochs=2, seed=1)
    assert np.array_equal(here.known, there.known) and all(np.allclose(w, there.net.weights[k], atol=1e-4) for k, w in here.net.weights.items())
