"""Sentiment scorers: lexicon with or without context rules, a Spark ML model, and a caller's own model."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom import vocab
from reviewloom.functions import sentiment as sent
from reviewloom.functions.numeric import rating_label
from reviewloom.operators.topics import TERM_BREAK
from reviewloom.schema import RATING
from reviewloom.sources.workspace import fresh_path


def score_lexicon(df: DataFrame, text: str = "clean_light", context: bool = True,
                  valences: Mapping[str, float] | None = None, score: str = "vader_score",
                  label: str = "vader_label") -> DataFrame:
    """Add a compound score in [-1, 1] and its label. Blank and null texts score 0.0, neutral. No shuffle."""
    table = vocab.VALENCES if valences is None else valences
    return (df.withColumn(score, sent.lexicon_compound(F.col(text), table, context))
            .withColumn(label, sent.compound_label(F.col(score))))


def score_lexicon_with_table(df: DataFrame, key: str, valences: DataFrame, text: str = "clean_light",
                             score: str = "vader_score", label: str = "vader_label") -> DataFrame:
    """Context-free score for a valence table `(word, valence)` of any size. `key` must be unique.

    Words without a valence leave at the join, and the sums are combined before the shuffle, which then carries
    one number per text.
    """
    words = df.select(key, F.explode_outer(sent.bare_words(F.col(text))).alias("word"))
    sums = (words.join(valences.select("word", "valence"), "word")
            .groupBy(key).agg(F.sum("valence").alias("_total")))
    total = sent.tidy_sum(F.coalesce("_total", F.lit(0.0)))
    return (df.join(sums, key, "left").withColumn(score, sent.normalize_compound(total))
            .withColumn(label, sent.compound_label(F.col(score))).drop("_total"))


def score_lexicon_context_with_table(df: DataFrame, key: str, valences: DataFrame, text: str = "clean_light",
                                     score: str = "vader_score", label: str = "vader_label") -> DataFrame:
    """Score with the context rules for a valence table `(word, valence)` of any size. `key` must be unique and not null.

    Two kinds of words of a text go on after the join: those the table knows, and intensifiers and negations that it does
    not know. Each known word then looks back over a frame of three positions of its text. The sums are combined before the
    shuffle that brings one number per text back to its row. What a whole text tells its words is settled before they are
    spread: a row per word that still held the text's lists would take the square of the text's length.
    """
    light = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(key, sent.bare_words(light).alias("_words"), F.split(light, " ").alias("_cased"))
    listed = texts.select(
        key, F.exists("_cased", lambda w: ~sent.is_upper(w)).alias("mixed"), F.array_position("_words", "but").alias("but_at"),
        F.arrays_zip(F.col("_words").alias("word"), F.col("_cased").alias("cased")).alias("_listed"))
    placed = listed.select(key, "mixed", "but_at", F.posexplode_outer("_listed").alias("at", "w"))
    words = placed.select(key, "at", "but_at", "w.word", (F.col("mixed") & sent.is_upper(F.col("w.cased"))).alias("shouted"))
    shaping = sent.one_of(F.col("word"), [*vocab.BOOSTERS, *vocab.NEGATIONS]) | F.col("word").contains("n't")
    seen = words.join(valences.select("word", "valence"), "word", "left").where(F.col("valence").isNotNull() | shaping)
    before = Window.partitionBy(key).orderBy("at").rangeBetween(-len(vocab.BOOST_DAMPING), -1)
    seen = seen.withColumn("before", F.collect_list(F.when(F.col("valence").isNull(), F.struct("at", "word", "shouted"))).over(before))
    value = F.col("valence") + F.when(F.col("shouted"), F.signum("valence") * vocab.CAPS_BOOST).otherwise(F.lit(0.0))
    for distance, damping in enumerate(vocab.BOOST_DAMPING, 1):
        value = _looked_back(value, distance, damping)
    sums = (seen.where(F.col("valence").isNotNull()).groupBy(key)
            .agg(F.sum(value * sent.but_weight(F.col("at"), F.col("but_at"))).alias("_total")))
    total = sent.tidy_sum(F.coalesce("_total", F.lit(0.0)))
    raised = sent.let(total, lambda t: t + F.signum(t) * sent.punctuation_emphasis(light))
    return (df.join(sums, key, "left").withColumn(score, sent.let(raised, sent.normalize_compound))
            .withColumn(label, sent.compound_label(F.col(score))).drop("_total"))


def _looked_back(value: Column, distance: int, damping: float) -> Column:
    """`value` after the word `distance` places before, if that is an intensifier or a negation."""
    there = F.get(F.filter("before", lambda b: b["at"] == F.col("at") - distance), F.lit(0))

    def effect(word: Column) -> Column:
        boost = sent.lookup(word["word"], vocab.BOOSTERS, "double")
        raised = F.when(boost.isNotNull(), sent.boosted(value, boost, F.lit(damping), word["shouted"])).otherwise(value)
        return F.when(word.isNull(), value).otherwise(raised * F.when(sent.negates(word["word"]), F.lit(vocab.NEGATION_SCALE)).otherwise(F.lit(1.0)))
    return sent.let(there, effect)


HEAD = 512  # words of a model that travel with the plan


@dataclass(frozen=True)
class WordModel:
    """Multinomial naive Bayes as a table: `words` (word, n: how often each class has it), stored, of any size, one number
    or two per class, and in `head` the HEAD commonest words with what each adds to the classes' scores."""

    words: DataFrame
    classes: list[int]
    priors: list[float]
    norms: list[float]
    head: dict[str, list[float]]


def tokens_of(text: Column) -> Column:
    """Lower-case words of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TERM_BREAK), lambda w: w != "")


def fit_sentiment_model(df: DataFrame, text: str = "clean_light", rating: str = RATING, classifier=None,
                        features: int = 1 << 20) -> WordModel | PipelineModel:
    """Train a bag-of-words model on the labels the ratings give.

    The default is multinomial naive Bayes with add-one smoothing: a count per word and class, combined before the shuffle
    and stored; no word is left out and none passes through the driver. Any pyspark.ml classifier with a probability
    column can take its place, over words hashed to `features` numbers.
    """
    target = F.array_position(F.lit(vocab.EVALUATION_LABELS), rating_label(F.col(rating))) - 1
    rated = df.where(rating_label(F.col(rating)).isNotNull()).select(F.col(text).alias("_text"), target.cast("int").alias("_target"))
    if classifier is not None:
        stages = [RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=TERM_BREAK),
                  HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=features), classifier]
        classifier.setParams(featuresCol="_features", labelCol="_target", probabilityCol="_probability",
                             rawPredictionCol="_raw", predictionCol="_prediction")
        return Pipeline(stages=stages).fit(rated.withColumn("_text", F.coalesce("_text", F.lit(""))))
    names = range(len(vocab.EVALUATION_LABELS))
    # The outer explode keeps texts without words, which count for the priors.
    spread = rated.select("_target", F.explode_outer(tokens_of(F.col("_text"))).alias("word"))
    by_word = spread.where(F.col("word").isNotNull()).groupBy("word").agg(*[F.count_if(F.col("_target") == c).alias(f"n{c}") for c in names])
    path = fresh_path(df.sparkSession, "word-model")
    by_word.select("word", F.array(*[f"n{c}" for c in names]).alias("n")).write.parquet(path)
    words = df.sparkSession.read.parquet(path)
    total = words.agg(F.count("*").alias("v"), *[F.sum(F.col("n")[c]).alias(f"n{c}") for c in names]).first()
    docs = {r["_target"]: r["count"] for r in rated.groupBy("_target").count().collect()}
    classes = sorted(docs)
    every = math.log(sum(docs.values()) + len(classes)) if classes else 0.0
    norms = [math.log((total[f"n{c}"] or 0) + total["v"]) if total["v"] else 0.0 for c in classes]
    commonest = words.orderBy(F.desc(F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n)), "word").limit(HEAD).collect()
    head = {r["word"]: [math.log(r["n"][c] + 1) - norm for c, norm in zip(classes, norms)] for r in commonest}
    return WordModel(words, classes, [math.log(docs[c] + 1) - every for c in classes], norms, head)


def score_model(df: DataFrame, model: WordModel | PipelineModel, text: str = "clean_light", label: str = "transformer_label",
                confidence: str = "transformer_confidence", key: str | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Add the most probable label and its probability. Null text is scored as ''.

    With a word model, the model's commonest words are scored within the row. Only the other words are shuffled, once, to
    the model's table, so no word that stands in very many texts meets all its copies in one task; their sums, combined
    before the next shuffle, come back by row. `key` names a unique column without nulls of a stored table; without it
    `df` is stored first, so that its rows have keys that do not change. A streaming `df` needs another kind of model.
    With `sums`, the stored `rare_sums` of these rows, small enough for a broadcast, no text is shuffled.
    """
    if not isinstance(model, WordModel):
        scored = model.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
        return (scored.withColumn(label, F.element_at(F.lit(vocab.EVALUATION_LABELS), F.col("_prediction").cast("int") + 1))
                .withColumn(confidence, F.array_max(vector_to_array(F.col("_probability"))))
                .drop("_text", "_tokens", "_features", "_raw", "_probability", "_prediction"))
    if df.isStreaming:
        raise ValueError("a word model joins texts to its table; give a streaming table a pipeline or a model of your own")
    keyed, row = df, key
    if key is None:
        path, row = fresh_path(df.sparkSession, "to-score"), "_doc"
        df.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
        keyed = df.sparkSession.read.parquet(path)
    words, none = tokens_of(F.col(text)), F.array(*[F.lit(0.0) for _ in model.classes])
    sums = rare_sums(keyed, row, model, text) if sums is None else F.broadcast(sums)
    add = lambda total, w: F.zip_with(total, sent.lookup(w, model.head, "array<double>"), lambda a, b: a + b)
    common = F.aggregate(F.filter(words, lambda w: sent.one_of(w, model.head)), none, add) if model.head else none
    scores = F.array(*[F.struct((F.get("_common", F.lit(i)) + F.coalesce(f"_f{i}", F.lit(0.0)) + prior).alias("s"), F.lit(-c).alias("c"))
                       for i, (c, prior) in enumerate(zip(model.classes, model.priors))])
    best = F.array_max("_scores")
    return (keyed.withColumn("_common", common).join(sums, F.col(row) == F.col("_row"), "left").withColumn("_scores", scores).withColumn("_best", best)
            .withColumn(label, F.element_at(F.lit(vocab.EVALUATION_LABELS), 1 - F.col("_best")["c"]))
            .withColumn(confidence, 1 / F.aggregate("_scores", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("_best")["s"])))
            .drop(*([] if key else ["_doc"]), "_row", "_common", "_scores", "_best", *[f"_f{i}" for i in range(len(model.classes))]))


def rare_sums(df: DataFrame, key: str, model: WordModel, text: str = "clean_light") -> DataFrame:
    """What the words outside the model's commonest ones add to the score of each class: `(_row, _f0, _f1, ...)`, for rows with such words."""
    # The outer explode is not preceded by a filter on the list's size, for which Spark would make the list twice.
    rare = df.select(F.col(key).alias("_row"), F.explode_outer(F.filter(tokens_of(F.col(text)), lambda w: ~sent.one_of(w, model.head))).alias("word"))
    fits = [F.sum(F.log(F.col("n")[c] + 1) - norm).alias(f"_f{i}") for i, (c, norm) in enumerate(zip(model.classes, model.norms))]
    return rare.join(model.words, "word").groupBy("_row").agg(*fits)


Scorer = Callable[[Sequence[str]], Iterable[tuple[str, float]]]
loaded: dict[str, Scorer] = {}  # the callers' models of this worker process


def score_external(df: DataFrame, load_model: Callable[[], Scorer], text: str = "clean_light",
                   label: str = "transformer_label", confidence: str = "transformer_confidence",
                   batch_size: int = 32) -> DataFrame:
    """Add label and confidence from a model the caller brings.

    `load_model` runs once per worker process and returns a function from a batch of texts to (label, score) pairs. Label
    names are normalised afterwards. Blank and null texts are passed as ''.
    """
    key = hashlib.sha256(cloudpickle.dumps(load_model)).hexdigest()
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from reviewloom.operators.scoring import loaded
        if key not in loaded:
            loaded[key] = load_model()
        scorer = loaded[key]
        for texts in parts:
            cleaned = [t if isinstance(t, str) and t.strip() else "" for t in texts]
            pairs = [pair for at in range(0, len(cleaned), batch_size) for pair in scorer(cleaned[at:at + batch_size])]
            yield pd.DataFrame(pairs, columns=["label", "score"])

    result = "_result"
    return (df.withColumn(result, run(F.col(text)))
            .withColumn(label, sent.model_label(F.col(result)["label"]))
            .withColumn(confidence, F.col(result)["score"]).drop(result))


def run_sentiment(df: DataFrame, model: WordModel | PipelineModel | None = None,
                  load_model: Callable[[], Scorer] | None = None, key: str | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Both scorers side by side, and the rating's label where a rating column exists.

    The second scorer is a fitted model (`model`, with `key` and `sums` as in `score_model`) or a caller's model (`load_model`); give exactly one.
    """
    if (model is None) == (load_model is None):
        raise ValueError("give either model or load_model")
    out = score_lexicon(df)
    out = score_model(out, model, key=key, sums=sums) if model is not None else score_external(out, load_model)
    if RATING in df.columns:
        out = out.withColumn("rating_sentiment", rating_label(F.col(RATING)))
    return out
