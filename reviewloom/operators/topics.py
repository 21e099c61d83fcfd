"""Topic discovery over embeddings or text, topic keywords, and what the aspect lexicon misses."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.functions.lookup import one_of
from reviewloom.operators.lda import LDA

MIN_DOCUMENTS = 50
NOISE_ACCURACY = 1_000_000
TERM_BREAK = r"[^\p{L}\p{N}_]+"


def enough_documents(df: DataFrame, minimum: int = MIN_DOCUMENTS) -> bool:
    """Whether there are enough documents to cluster; reads no more than `minimum` of them."""
    return df.limit(minimum).count() >= minimum


def squared_distance(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def assign_topics(df: DataFrame, k: int, vector: str = "embedding", seed: int = 17, noise_quantile: float | None = 0.95,
                  topic: str = "topic") -> DataFrame:
    """Cluster an `array<float>` column; add the topic id (-1 for the documents far from their center) and the distance.

    Below `MIN_DOCUMENTS` both columns are null. Only the k centers leave the executors.
    """
    if not enough_documents(df):
        return df.withColumns({topic: F.lit(None).cast("int"), "topic_distance": F.lit(None).cast("double")})
    points = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_point"))
    model = KMeans(k=k, seed=seed, featuresCol="_point").fit(points)
    centers = df.sparkSession.createDataFrame([(i, center.tolist()) for i, center in enumerate(model.clusterCenters())],
                                              f"{topic} int, center array<double>")
    return place_on_centers(df, centers, vector, noise_quantile, topic)


def place_on_centers(df: DataFrame, centers: DataFrame, vector: str = "embedding", noise_quantile: float | None = 0.95,
                     topic: str = "topic") -> DataFrame:
    """The nearest of the given centers `(topic, center)` for every row, ties to the smaller topic, and its distance.

    Rows beyond the `noise_quantile` of their topic's distances get -1. The centers are one row of the plan, so there
    may be as many as fit a row. The limit is exact up to NOISE_ACCURACY rows of a topic, and beyond that off by
    1/NOISE_ACCURACY of them at most.
    """
    values = F.col(vector).cast("array<double>")
    every = F.broadcast(centers.agg(F.sort_array(F.collect_list(F.struct(topic, "center"))).alias("_centers")))
    distances = F.transform("_centers", lambda c: F.struct(squared_distance(values, c["center"]).alias("d"), c[topic].alias("t")))
    placed = (df.withColumn("_one", F.lit(1)).join(every.withColumn("_one", F.lit(1)), "_one").withColumn("_near", F.array_min(distances))
              .withColumn(topic, F.col("_near.t")).withColumn("topic_distance", F.sqrt("_near.d")))
    if noise_quantile is not None:
        limits = F.broadcast(placed.groupBy(topic).agg(F.percentile_approx("topic_distance", noise_quantile, NOISE_ACCURACY).alias("_limit")))
        placed = placed.join(limits, topic).withColumn(topic, F.when(F.col("topic_distance") > F.col("_limit"), -1).otherwise(F.col(topic)))
    return placed.select(*df.columns, topic, "topic_distance")


def assign_topics_from_text(df: DataFrame, k: int, text: str = "clean_light", seed: int = 17, iterations: int = 10,
                            features: int = 1 << 18, topic: str = "topic", stop_words: Sequence[str] | None = None) -> DataFrame:
    """Topics by latent Dirichlet allocation when there is no embedding; the most probable topic of each text.

    Every step of the fit sees all texts, and every term counts: terms are hashed to `features` numbers. Below
    `MIN_DOCUMENTS` the topic is null.
    """
    if not enough_documents(df):
        return df.withColumn(topic, F.lit(None).cast("int"))
    numbers = term_numbers(F.col(text), features, vocab.STOP_WORDS if stop_words is None else stop_words)
    # Every step of the fit reads the numbers, not the texts.
    kept = df.select(numbers.alias("_terms")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = LDA(k, seed, iterations, features).fit(kept)
    finally:
        kept.unpersist()
    sent = df.sparkSession.sparkContext.broadcast(fitted)

    @F.arrow_udf("int")
    def strongest(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.weights(texts).argmax(axis=1), pa.int32())
    return df.withColumn(topic, strongest(numbers))


def term_numbers(text: Column, features: int, stop_words: Sequence[str]) -> Column:
    """The terms of a text hashed to numbers below `features`: a sorted list with repeats. Terms are words of two or more UTF-16
    units that are not stop words."""
    stop = [w.lower() for w in stop_words]
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TERM_BREAK), lambda w: ((F.length(w) >= 2) | (F.octet_length(w) > 3)) & ~one_of(w, stop))
    return F.sort_array(F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(features)).cast("int")))


def topic_terms(df: DataFrame, topic: str = "topic", text: str = "clean_light",
                stop_words: Sequence[str] | None = None) -> DataFrame:
    """Term counts per topic: words of two or more characters that are not stop words."""
    stop = list(vocab.STOP_WORDS if stop_words is None else stop_words)
    words = df.select(topic, F.explode_outer(F.split(F.lower(F.col(text)), TERM_BREAK)).alias("term"))
    kept = words.where((F.length("term") >= 2) & ~one_of(F.col("term"), stop))
    return kept.groupBy(topic, "term").agg(F.count("*").alias("tf"))


def topic_keywords(terms: DataFrame, n: int = 10, topic: str = "topic") -> DataFrame:
    """The `n` terms per topic with the highest class-based TF-IDF, ``tf * ln(1 + A / f)``.

    f is the term's count over all topics and A the mean number of words per topic. `terms` comes from
    `topic_terms`; a term has at most one row per topic, so the window over a term stays small.
    """
    average = terms.agg(F.sum("tf").cast("double") / F.count_distinct(topic)).scalar()
    overall = F.sum("tf").over(Window.partitionBy("term"))
    weighted = terms.withColumn("weight", F.bround(F.col("tf") * F.log(1 + average / overall), 8))
    order = Window.partitionBy(topic).orderBy(F.desc("weight"), "term")
    return (weighted.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
            .select(topic, "position", "term", "tf", "weight"))


def topic_info(assigned: DataFrame, keywords: DataFrame, topic: str = "topic") -> DataFrame:
    """Size, name (id and the first four keywords) and keyword list of every topic, largest first."""
    sizes = assigned.groupBy(topic).agg(F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "term"))), lambda p: p["term"])
    lists = keywords.groupBy(topic).agg(ordered.alias("keywords"))
    name = F.concat_ws("_", F.col(topic).cast("string"), F.slice("keywords", 1, 4))
    return (sizes.join(lists, topic, "left")
            .withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
            .select(topic, "n", name.alias("name"), "keywords").orderBy(F.desc("n"), topic))


def representative_documents(df: DataFrame, key: str, n: int = 3, topic: str = "topic",
                             vector: str = "embedding") -> DataFrame:
    """The `n` documents of each topic nearest to the topic's mean vector."""
    values = F.col(vector).cast("array<double>")
    means = df.groupBy(topic).agg(vector_to_array(Summarizer.mean(array_to_vector(values))).alias("_mean"))
    distance = F.bround(F.sqrt(squared_distance(values, F.col("_mean"))), 6)
    near = df.select(key, topic, vector).join(means, topic).select(key, topic, distance.alias("distance"))
    order = Window.partitionBy(topic).orderBy("distance", key)
    return near.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def keywords_outside_lexicon(keywords: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Topic keywords that the aspect lexicon does not list."""
    known = lexicon.select(F.col("keyword").alias("term"))
    return keywords.join(known, "term", "left_anti")


def topic_lexicon_gap(tagged: DataFrame, keywords: DataFrame, lexicon: DataFrame, topic: str = "topic") -> DataFrame:
    """Per topic: documents, share without any aspect, and how many keywords the lexicon misses."""
    coverage = tagged.groupBy(topic).agg(
        F.count("*").alias("n"), F.avg((F.size("aspects") == 0).cast("double")).alias("share_without_aspect"))
    missed = keywords_outside_lexicon(keywords, lexicon).groupBy(topic).agg(F.count("*").alias("missed_keywords"))
    return coverage.join(missed, topic, "left").withColumn("missed_keywords", F.coalesce("missed_keywords", F.lit(0)))
