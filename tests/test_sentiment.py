from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.functions import sentiment as sent
from reviewloom.functions.lookup import lookup
from reviewloom.functions.numeric import rating_label
from reviewloom.operators import scoring


def scores(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, clean_light string")
    rows = scoring.score_lexicon(df, **options).orderBy("i").collect()
    return [(r["vader_score"], r["vader_label"]) for r in rows]


def by_hand(text):
    """The rules, one word at a time."""
    cased = (text or "").split(" ")
    words = []
    for w in (text or "").lower().split(" "):
        bare = w.strip(vocab.PUNCTUATION)
        words.append(bare if len(bare) > 2 else w)
    mixed = any(not w.isupper() for w in cased)
    total = 0.0
    for i, word in enumerate(words):
        if word not in vocab.VALENCES:
            continue
        value = vocab.VALENCES[word]
        if cased[i].isupper() and mixed:
            value += math.copysign(vocab.CAPS_BOOST, value)
        for k in (1, 2, 3):
            if i < k or words[i - k] in vocab.VALENCES:
                continue
            before = words[i - k]
            if before in vocab.BOOSTERS:
                strength = vocab.BOOSTERS[before] + (vocab.CAPS_BOOST if cased[i - k].isupper() and mixed else 0)
                value += math.copysign(1, value) * strength * vocab.BOOST_DAMPING[k - 1]
            if before in vocab.NEGATIONS or "n't" in before:
                value *= vocab.NEGATION_SCALE
        if "but" in words:
            value *= 0.5 if i < words.index("but") else 1.5
        total += value
    total = round(total, 9)
    marks, questions = min((text or "").count("!"), 4) * 0.292, (text or "").count("?")
    marks += 0 if questions <= 1 else questions * 0.18 if questions <= 3 else 0.96
    total += marks * ((total > 0) - (total < 0))
    return round(total / math.sqrt(total * total + 15), 4)


def test_label_thresholds_include_their_bounds(spark):
    cases = {0.05: "positive", 1.0: "positive", -0.05: "negative", -1.0: "negative", 0.0: "neutral", 0.049: "neutral",
             -0.049: "neutral"}
    df = spark.createDataFrame([(c,) for c in cases], "c double")
    assert {r["c"]: r["l"] for r in df.select("c", sent.compound_label(F.col("c")).alias("l")).collect()} == cases


def test_polarity_and_blanks(spark):
    labels = [label for _, label in scores(spark, [
        "I really love it, simply fantastic!", "Awful and useless, I hate it.", "It came on a Monday."])]
    assert labels == ["positive", "negative", "neutral"]
    assert scores(spark, ["", None]) == [(0.0, "neutral")] * 2


def test_each_context_rule(spark):
    (plain, very, faint, denied, far, caps, mark, but, asks), _ = zip(*scores(spark, [
        "it is good", "it is very good", "it is slightly good", "it is not good", "not that it is good",
        "it is GOOD", "it is good!", "it is good but it is awful", "it is good ??"]))
    assert very > plain > faint > 0 > denied
    assert far == plain
    assert caps > plain and mark > plain and asks > plain and but < 0


def test_random_texts_agree_with_the_rules_by_hand(spark):
    draw = random.Random(7)
    pool = ["good", "GREAT", "awful", "hate!", "very", "VERY", "hardly", "not", "isn't", "never", "but", "But", "so",
            "the", "box", ":)", "ok", "OK!", "(nice)", "--", "?", "!!", "late,", "worst"]
    texts = [" ".join(draw.choices(pool, k=draw.randint(1, 14))) for _ in range(800)] + ["ALL BAD", "ALL BAD day"]
    found = [score for score, _ in scores(spark, texts)]
    wrong = [(t, f, by_hand(t)) for t, f in zip(texts, found) if abs(f - by_hand(t)) > 1.1e-4]
    assert not wrong


def test_plain_score_and_its_table_form_agree(spark):
    texts = ["good good awful", "Great, nice.", "", "nothing here", "love LOVE hate"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, clean_light string")
    table = spark.createDataFrame([(w, float(v)) for w, v in vocab.VALENCES.items()], "word string, valence double")
    joined = scoring.score_lexicon_with_table(df, "i", table).orderBy("i").collect()
    assert [(r["vader_score"], r["vader_label"]) for r in joined] == scores(spark, texts, context=False)


def test_own_valences(spark):
    assert scores(spark, ["zork"], valences={"zork": 3.0})[0][1] == "positive"


def test_filter_on_a_score_is_not_a_trap(spark):
    """A filter on a computed label stays one evaluation per row, not one per use of every intermediate value."""
    df = spark.range(2000).select("id", F.repeat(F.lit("good and bad "), 200).alias("clean_light"))
    assert scoring.score_lexicon(df).where(F.col("vader_label") != "nothing").count() == 2000


def test_rating_label(spark):
    cases = {"5": "positive", "4": "positive", "3.5": "negative", "3": "neutral", "0": "negative", "10": "positive", "x": None}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r["c"]: r["l"] for r in df.select("c", rating_label(F.col("c")).alias("l")).collect()} == cases


def test_model_labels(spark):
    cases = {"LABEL_0": "negative", "label_1": "neutral", "Label_2": "positive", "POSITIVE": "positive", "odd": "odd"}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r["c"]: r["l"] for r in df.select("c", sent.model_label(F.col("c")).alias("l")).collect()} == cases


def test_lookup_of_any_key(spark):
    table = {"it's": "a\\b", "x\ty": "2", "'": "3", "é": "4"}
    df = spark.createDataFrame([(k,) for k in [*table, "none"]], "k string")
    found = {r["k"]: r["v"] for r in df.select("k", lookup(F.col("k"), table, "string").alias("v")).collect()}
    assert found == {**table, "none": None}
    large = {str(i): i for i in range(25_000)}
    df = spark.createDataFrame([("24999",), ("7",), ("x",)], "k string")
    assert [r["v"] for r in df.select(lookup(F.col("k"), large, "int").alias("v")).collect()] == [24999, 7, None]


def test_trained_model_learns_the_ratings(spark):
    rows = [(i, *[("so good and nice", 5.0), ("so bad and broken", 1.0), ("plain and grey", 3.0), ("so good", None)][i % 4])
            for i in range(80)]
    df = spark.createDataFrame(rows, "review_id long, clean_light string, rating double")
    scored = scoring.score_model(df, scoring.fit_sentiment_model(df)).collect()
    expected = {"so good and nice": "positive", "so bad and broken": "negative", "plain and grey": "neutral", "so good": "positive"}
    assert all(r["transformer_label"] == expected[r["clean_light"]] for r in scored)
    assert all(0.0 <= r["transformer_confidence"] <= 1.0 for r in scored)


def test_external_model_gets_batches_and_empty_strings(spark):
    def load():
        def score(texts):
            assert len(texts) <= 3
            return [("LABEL_0" if t == "" else "Positive", float(len(texts))) for t in texts]
        return score
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, " ", "b", "c", "d", "e"])], "i int, clean_light string").coalesce(1)
    rows = scoring.score_external(df, load, batch_size=3).orderBy("i").collect()
    assert [r["transformer_label"] for r in rows] == ["positive", "negative", "negative", *["positive"] * 4]
    assert [r["transformer_confidence"] for r in rows] == [3.0] * 6 + [1.0]


def test_run_sentiment_needs_one_model_and_optional_ratings(spark):
    df = spark.createDataFrame([("good",)], "clean_light string")
    with pytest.raises(ValueError):
        scoring.run_sentiment(df)
    out = scoring.run_sentiment(df, load_model=lambda: lambda texts: [("neutral", 0.5) for _ in texts])
    assert "rating_sentiment" not in out.columns and out.first()["vader_label"] == "positive"


def test_model_reads_any_script_and_any_number_of_words(spark):
    rows = [(i, "отлично superb café " if i % 2 else "ужасно caf ", 5.0 if i % 2 else 1.0) for i in range(20)]
    rows += [(100 + i, " ".join(f"w{i}x{j}" for j in range(3000)), 3.0) for i in range(100)]  # more words than any vocabulary bound
    df = spark.createDataFrame(rows, "i long, clean_light string, rating double")
    model = scoring.fit_sentiment_model(df)
    assert model.words.count() == 300_000 + 5
    ask = spark.createDataFrame([(1, "отлично"), (2, "ужасно"), (3, "café"), (4, "caf"), (5, "w7x2999 w7x1"), (6, None)], "i long, clean_light string")
    said = {r.i: r.transformer_label for r in scoring.score_model(ask, model).collect()}
    assert [said[i] for i in range(1, 6)] == ["positive", "negative", "positive", "negative", "neutral"] and said[6] == "neutral"


def test_word_in_every_text_is_not_shuffled(spark):
    """The commonest words are scored within the row; the plan shuffles the rest, once, and the rows have keys of their own."""
    rows = [(i, f"the {'good' if i % 2 else 'bad'} the rare{i}", 5.0 if i % 2 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, clean_light string, rating double")
    model = scoring.fit_sentiment_model(df)
    assert {"the", "good", "bad"} <= set(model.head) and len(model.head) <= scoring.HEAD
    whole = {r.i: (r.transformer_label, round(r.transformer_confidence, 9)) for r in scoring.score_model(df, model).collect()}
    for head in ({}, {w: model.head[w] for w in ("the", "rare7")}):
        part = scoring.WordModel(model.words, model.classes, model.priors, model.norms, head)
        tail = part.words.where(~F.col("word").isin(list(head) or [""]))
        part = scoring.WordModel(tail, model.classes, model.priors, model.norms, head)
        for key in (None, "i"):
            scored = scoring.score_model(df, part, key=key)
            assert scored.columns == [*df.columns, "transformer_label", "transformer_confidence"]
            assert {r.i: (r.transformer_label, round(r.transformer_confidence, 9)) for r in scored.collect()} == whole
    assert {k for k, (label, _) in whole.items() if label == "positive"} == {i for i in range(400) if i % 2}


def test_word_model_refuses_a_stream(spark):
    stream = spark.readStream.format("rate").load().selectExpr("cast(value AS string) AS clean_light")
    with pytest.raises(ValueError, match="word model"):
        scoring.score_model(stream, scoring.WordModel(spark.createDataFrame([], "word string, n array<long>"), [0], [0.0], [0.0], {}))


TRICKY = ["VERY good but not GREAT", "not very bad!!!", "isn't good", "good", "", None, "but bad but good?", "REALLY REALLY BAD", "extremely not good ok?? ??",
          "never so good", "kinda awful, hardly nice", "a not b not good", "very", "not", "good " * 30 + "bad"]


def test_context_scores_over_a_table_equal_the_literal_ones(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "i long, clean_light string").repartition(3)
    valences = {**vocab.VALENCES, "very": 0.5, "hardly": -0.25}  # a word with a valence of its own is no intensifier
    for table in (vocab.VALENCES, valences):
        known = spark.createDataFrame([(w, float(v)) for w, v in table.items()], "word string, valence double")
        literal = {r.i: (r.vader_score, r.vader_label) for r in scoring.score_lexicon(df, valences=table).collect()}
        joined = scoring.score_lexicon_context_with_table(df, "i", known)
        assert joined.columns == ["i", "clean_light", "vader_score", "vader_label"]
        assert {r.i: (r.vader_score, r.vader_label) for r in joined.collect()} == literal


def test_context_plan_does_not_grow_with_the_table(spark):
    df = spark.createDataFrame([(1, "good")], "i long, clean_light string")
    def size(n):
        table = spark.range(n).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1.0).alias("valence"))
        return len(scoring.score_lexicon_context_with_table(df, "i", table)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(10) - size(1_000_000)) < 100


def test_words_of_the_context_rules_carry_no_lists(spark):
    df = spark.createDataFrame([(1, "Not GOOD but very bad")], "i long, clean_light string")
    table = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    scored = scoring.score_lexicon_context_with_table(df, "i", table)
    spread = [line for line in scored._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate posexplode" in line]
    assert len(spread) == 1 and "_words" not in spread[0].split("), [")[1] and "_cased" not in spread[0].split("), [")[1]
    literal = scoring.score_lexicon(df, valences={"good": 1.9, "bad": -2.5}).first()
    assert scored.first()["vader_score"] == literal["vader_score"] != 0


def test_bare_words_trim_the_whole_text(spark):
    texts = ["...Good!!! :) (ok) a.b, 'tis :D no! «x» *bold*", "", "....", "x" * 50_000 + "..", ".a" * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(sent.bare_words(F.col("t")).alias("w"))
    def bare(word):
        core = word.strip(vocab.PUNCTUATION)
        return core if len(core) > 2 else word
    assert [r["w"] for r in df.collect()] == [[bare(w) for w in t.lower().split(" ")] for t in texts]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
