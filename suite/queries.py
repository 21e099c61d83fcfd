"""One registered query per operator, each over its whole input tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.functions import sentiment as sent
from reviewloom.functions import text as txt
from reviewloom.functions.numeric import rating_label
from reviewloom.operators import (aspects, cleaning, evaluation, profiling, scoring, strategy, summary, topic_tree, topics)
from reviewloom.plans import batch, datasets
from reviewloom.plans.analyze import analyze
from reviewloom.plans.batch import summary_document
from reviewloom.schema import ColumnMapping
from reviewloom.sources import reviews_csv, stages
from reviewloom.sources.store import ReviewStore
from reviewloom.sources.workspace import fresh_path
from suite.views import reviews, reviews_scale, stored_reviews, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).unionByName(reviews_scale(spark, sf_dir))


def tidy(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles rounded for the comparison with another engine."""
    return df.withColumns({c: F.bround(c, places) for c in columns})


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as a careless export holds them: padded, blank, null and "nan" texts."""
    key = F.col("review_id")
    messy = (F.when(key % 19 == 0, " NaN ").when(key % 23 == 0, " \t ").when(key % 29 == 0, None).when(key % 31 == 0, "N/A")
             .otherwise(F.concat(F.lit("\t "), "review_text", F.lit(" \n"))))
    return reviews(spark, sf_dir).withColumn("review_text", messy).drop("dataset_id")


def uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews under foreign column names, all strings, as read from an upload."""
    return reviews(spark, sf_dir).select(
        F.col("review_id").cast("string").alias("Id"), F.col("dataset_id").alias("Origin"),
        F.col("review_text").alias("Opinion"), F.col("rating").cast("string").alias("Stars"),
        F.col("review_date").alias("Posted_Time"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a strategy writer, one per document: fenced, bare, half fenced, and plain prose."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")

    def item(aspect: str, recommendation: str, priority: str | None) -> list[Column]:
        tail = f'", "recommendation": "{recommendation}"' + (f', "priority": "{priority}"}}' if priority else "}")
        return [F.lit(f'{{"aspect": "{aspect}", "finding": "{aspect[0]}' if aspect != "delivery" else
                      '{"aspect": "delivery", "finding": "f'), number, F.lit(tail)]
    items = [item("delivery", "faster", "low"), item("price", "cheaper", "high"), item("ux", "simpler", None),
             item("quality", "better", "urgent"), item("support", "kinder", "medium")]
    parts = [F.lit('{"executive_summary": "'), F.col("source"), F.lit(" holds "), F.col("n_chars").cast("string"),
             F.lit(' characters", "recommendations": [')]
    for i, fields in enumerate(items):
        parts += ([F.lit(", ")] if i else []) + fields
    body = F.concat(*parts, F.lit("]}"))
    kind = F.col("doc_id") % 4
    answer = (F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, body)
              .when(kind == 2, F.concat(F.lit("  ```\n"), body)).otherwise(F.col("text")))
    created = F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return docs.select(F.col("doc_id").alias("answer_id"), F.col("source").alias("dataset_id"),
                       created.alias("created_at"), answer.alias("answer"))


def joined_aspects(df: DataFrame) -> DataFrame:
    """Lists as strings, so that results compare by value."""
    return df.withColumn("aspects", txt.join_list(F.col("aspects")))


FLAGS = [f"aspect_{a}" for a in vocab.ASPECT_KEYWORDS]


# --- sources and sinks ------------------------------------------------------------------------------------------
@register
def load_reviews_csv(spark, sf_dir):
    path = fresh_path(spark, "reviews-csv")
    (raw_reviews(spark, sf_dir).withColumnsRenamed({"review_text": "Comment", "rating": "Stars", "review_date": "Posted"})
     .write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    loaded = reviews_csv.load_reviews(spark, path, ColumnMapping("Comment", "Stars", "Posted"))
    return loaded.withColumn("review_id", F.col("review_id").cast("bigint"))


@register
def load_reviews_in_file_order(spark, sf_dir):
    """An export of several files, read in small pieces: ids follow files and lines whatever the pieces."""
    path = fresh_path(spark, "ordered-csv")
    export = raw_reviews(spark, sf_dir).withColumnsRenamed({"review_text": "Comment", "rating": "Stars", "review_date": "Posted"})
    # Texts hold line breaks, so a file is read by one task: as many files as keep each at 20,000 reviews.
    ordered = export.repartitionByRange(max(5, -(-export.count() // 20_000)), "review_id").sortWithinPartitions("review_id")
    (ordered.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    loaded = reviews_csv.load_reviews(spark, path, ColumnMapping("Comment", "Stars", "Posted"), line_ids="line")
    return loaded.select("line", F.col("review_id").cast("bigint").alias("review_id"), "rating")


@register
def stage_roundtrip(spark, sf_dir):
    stored = stages.write_stage(cleaning.preprocess(reviews(spark, sf_dir)), fresh_path(spark, "stage"))
    return stored.select("review_id", "clean_light", "clean_deep", "word_count")


@register
def aspect_summary_json(spark, sf_dir):
    """The summary documents are written as JSON text and read back field by field."""
    path = fresh_path(spark, "aspect-summary")
    stored = aspects.add_aspect_flags(stored_reviews(spark, sf_dir).reviews())
    stages.write_documents(summary_document(stored, ("dataset_id",), "sentiment"), path)
    stats = "struct<total: bigint, positive: bigint, neutral: bigint, negative: bigint, negative_share: double, positive_share: double>"
    document = F.from_json("value", f"dataset_id string, aspects map<string, {stats}>, top_complaints array<string>, top_praise array<string>")
    read = spark.read.text(path).select(document.alias("d"))
    return read.select("d.dataset_id", F.array_join("d.top_complaints", ",").alias("top_complaints"),
                       F.array_join("d.top_praise", ",").alias("top_praise"), F.explode("d.aspects").alias("aspect", "stats")
                       ).select("dataset_id", "top_complaints", "top_praise", "aspect", "stats.*")


def batch_paths(spark: SparkSession, sf_dir: str) -> batch.BatchPaths:
    """The first two stages of the batch chain, from raw text to scored reviews."""
    paths = batch.BatchPaths(fresh_path(spark, "batch"))
    batch.clean_stage(reviews(spark, sf_dir), paths)
    batch.sentiment_stage(spark, paths)
    return paths


@register
def batch_report(spark, sf_dir):
    """The batch chain from raw text to the stored report, all tables of it read back as (table, row, name, value)."""
    paths = batch_paths(spark, sf_dir)
    parts = []
    for name, table_ in batch.evaluation_stage(spark, paths).items():
        read = spark.read.schema(table_.schema).json(f"{paths.sentiment_comparison}/{name}")
        keys = [c for c in read.columns if c in ("model", "label", "true_label")]
        row, values = F.concat_ws("/", *keys), [c for c in read.columns if c not in (*keys, "ordinal")]
        entries = F.array(*[F.struct(F.lit(c).alias("name"), F.bround(F.col(c).cast("double"), 6).alias("value")) for c in values])
        parts.append(read.select(F.lit(name).alias("part"), row.alias("row"), F.inline(entries)))
    return reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull())


@register
def batch_aspects(spark, sf_dir):
    """The last stage of the batch chain: the scored reviews tagged and stored, and the summary document made of them, read back."""
    paths = batch_paths(spark, sf_dir)
    batch.aspect_stage(spark, paths)
    entry = "struct<total: bigint, positive: bigint, neutral: bigint, negative: bigint, negative_share: double, positive_share: double>"
    document = spark.read.text(paths.aspect_summary).select(F.from_json(
        "value", f"aspects map<string, {entry}>, top_complaints array<string>, top_praise array<string>").alias("d"))
    return document.select(F.array_join("d.top_complaints", ",").alias("top_complaints"), F.array_join("d.top_praise", ",").alias("top_praise"),
                           F.explode("d.aspects").alias("aspect", "stats")).select("top_complaints", "top_praise", "aspect", "stats.*")


@register
def ingest_upload(spark, sf_dir):
    """An upload with foreign column names: columns guessed, analysed, stored, read back."""
    store = ReviewStore(spark, fresh_path(spark, "uploads"))
    dataset_id = datasets.ingest(store, uploaded(spark, sf_dir), "upload")
    return joined_aspects(store.reviews(dataset_id)).select(
        "review_text", "clean_deep", "sentiment", "confidence", "aspects", "rating", "review_date")


@register
def load_analysis(spark, sf_dir):
    return joined_aspects(stored_reviews(spark, sf_dir).load_analysis("docs_fr")).drop("dataset_id", "source_id")


@register
def review_aspects_normalized(spark, sf_dir):
    return stored_reviews(spark, sf_dir).aspects()


@register
def strategy_latest(spark, sf_dir):
    store = ReviewStore(spark, fresh_path(spark, "strategies"))
    store.save_strategies(answers(spark, sf_dir).withColumnRenamed("answer", "strategy_json"))
    return store.strategies().withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


# --- rows -------------------------------------------------------------------------------------------------------
@register
def clean_rows(spark, sf_dir):
    return cleaning.drop_blank_reviews(raw_reviews(spark, sf_dir)).select("review_id", "review_text")


@register
def column_roles(spark, sf_dir):
    return tidy(profiling.column_roles(uploaded(spark, sf_dir)), "mean_length", "numeric_share", "date_share")


@register
def profile_text_columns(spark, sf_dir):
    return tidy(profiling.text_column_profile(uploaded(spark, sf_dir)), "mean_length")


@register
def column_mapping(spark, sf_dir):
    return ColumnMapping("Opinion", "Stars", "Posted_Time").apply(uploaded(spark, sf_dir))


@register
def sample_head(spark, sf_dir):
    return profiling.first_rows(reviews(spark, sf_dir), 100).select("review_id", "review_text")


@register
def rating_sentiment(spark, sf_dir):
    return reviews_scale(spark, sf_dir).select("review_id", "rating", rating_label(F.col("rating")).alias("rating_sentiment"))


@register
def dataset_exists(spark, sf_dir):
    wanted = spark.createDataFrame([("docs_en",), ("docs_none",), ("2-HIGH",)], "dataset_id string")
    known = stored_reviews(spark, sf_dir).list_datasets().withColumn("found", F.lit(True))
    return wanted.join(known, "dataset_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


@register
def filter_reviews(spark, sf_dir):
    stored = stored_reviews(spark, sf_dir).reviews().where(F.col("dataset_id").startswith("docs_"))
    return joined_aspects(aspects.filter_reviews(stored, ["negative", "neutral"], ["delivery", "ux"]))


@register
def null_counts(spark, sf_dir):
    return profiling.null_counts(both(spark, sf_dir))


@register
def duplicate_reviews(spark, sf_dir):
    return profiling.duplicate_count(both(spark, sf_dir))


@register
def duplicate_review_rows(spark, sf_dir):
    return profiling.duplicate_rows(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


@register
def unmatched_reviews(spark, sf_dir):
    return aspects.unmatched(stored_reviews(spark, sf_dir).reviews()).select("dataset_id", "review_id", "clean_deep")


@register
def unmatched_top_words(spark, sf_dir):
    return summary.top_words(aspects.unmatched(stored_reviews(spark, sf_dir).reviews()))


@register
def dataset_fingerprint(spark, sf_dir):
    return profiling.dataset_fingerprint(both(spark, sf_dir), "reviews", ("dataset_id",))


# --- text -------------------------------------------------------------------------------------------------------
@register
def nfkc_text(spark, sf_dir):
    """Letters and digits are first widened to their full-width forms; normalisation must bring them back."""
    plain = "".join(chr(c) for c in range(0x30, 0x7B) if chr(c).isalnum())
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", txt.nfkc(F.translate("text", plain, wide)).alias("nfkc"))


@register
def clean_light(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", txt.light_clean(F.col("html")).alias("clean_light"))


@register
def deep_prep(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", txt.deep_prepare(F.col("html")).alias("prepared"))


@register
def clean_deep(spark, sf_dir):
    return reviews(spark, sf_dir).select("review_id", txt.deep_clean(F.col("review_text")).alias("clean_deep"))


@register
def clean_deep_tables(spark, sf_dir):
    stops = spark.createDataFrame([(w,) for w in vocab.STOP_WORDS], "word string")
    lemmas = spark.createDataFrame(list(vocab.LEMMAS.items()), "word string, lemma string")
    return cleaning.deep_clean_with_tables(reviews(spark, sf_dir), "review_id", stops, lemmas).select("review_id", "clean_deep")


@register
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", txt.word_count(F.col("text")).alias("word_count"))


@register
def preprocess(spark, sf_dir):
    return cleaning.preprocess(reviews_scale(spark, sf_dir)).select(
        "review_id", "dataset_id", "clean_light", "clean_deep", "word_count")


@register
def aspects_string_roundtrip(spark, sf_dir):
    tagged = aspects.tag_aspects(reviews(spark, sf_dir).select("review_id", txt.deep_clean(F.col("review_text")).alias("clean_deep")))
    joined = tagged.select("review_id", txt.join_list(F.col("aspects")).alias("joined"))
    return joined.withColumn("n_aspects", F.size(txt.split_list(F.col("joined"))))


@register
def strategy_parse(spark, sf_dir):
    return strategy.parse_answers(answers(spark, sf_dir)).select(
        "answer_id", "executive_summary", F.when(F.col("raw").isNull(), F.size("recommendations")).alias("n_recommendations"), "raw")


@register
def normalize_labels(spark, sf_dir):
    numbered = F.concat(F.lit("LABEL_"), (F.col("quality") + F.col("doc_id") % 2).cast("string"))
    raw = F.when(F.col("toxic") == 1, "Negative").otherwise(numbered)
    return table(spark, sf_dir, "labels").select("doc_id", sent.model_label(raw).alias("label"))


# --- sentiment --------------------------------------------------------------------------------------------------
def light_reviews(df: DataFrame) -> DataFrame:
    return df.withColumn("clean_light", txt.light_clean(F.col("review_text")))


@register
def lexicon_sentiment(spark, sf_dir):
    scored = scoring.score_lexicon(light_reviews(reviews(spark, sf_dir)), context=False)
    return scored.select("review_id", "vader_score", "vader_label")


@register
def lexicon_sentiment_tables(spark, sf_dir):
    valences = spark.createDataFrame([(w, float(v)) for w, v in vocab.VALENCES.items()], "word string, valence double")
    scored = scoring.score_lexicon_with_table(light_reviews(reviews(spark, sf_dir)), "review_id", valences)
    return scored.select("review_id", "vader_score", "vader_label")


@register
def lexicon_sentiment_context_tables(spark, sf_dir):
    """The context rules with the valences as a table."""
    valences = spark.createDataFrame([(w, float(v)) for w, v in vocab.VALENCES.items()], "word string, valence double")
    keyed = light_reviews(both(spark, sf_dir)).withColumn("rid", F.concat_ws("#", "dataset_id", "review_id"))
    scored = scoring.score_lexicon_context_with_table(keyed, "rid", valences)
    return scored.select("dataset_id", "review_id", "vader_score", "vader_label")


@register
def lexicon_sentiment_context(spark, sf_dir):
    scored = scoring.score_lexicon(light_reviews(both(spark, sf_dir)))
    return scored.select("dataset_id", "review_id", "vader_score", "vader_label")


@register
def compound_label(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(sent.compound_label(F.col("l_discount") - 0.05).alias("label")).agg(F.count("*").alias("n"))


@register
def model_sentiment(spark, sf_dir):
    df = stages.write_stage(light_reviews(reviews(spark, sf_dir)).withColumn("key", F.monotonically_increasing_id()), fresh_path(spark, "light"))
    scored = scoring.score_model(df, scoring.fit_sentiment_model(df), key="key")
    return scored.select("review_id", F.col("transformer_label").alias("model_label"),
                         F.bround("transformer_confidence", 4).alias("model_confidence"))


def punctuation_model():
    """A stand-in for a model the caller brings: answers with numbered labels, as some models do."""
    def load():
        return lambda texts: [("LABEL_2" if "!" in t else "LABEL_1" if "?" in t else "LABEL_0", 1.0 / (1 + len(t)))
                              for t in texts]
    return load


@register
def external_model_sentiment(spark, sf_dir):
    scored = scoring.score_external(light_reviews(both(spark, sf_dir)), punctuation_model(), label="label", confidence="score")
    return scored.select("review_id", "label", F.bround("score", 8).alias("score"))


@register
def run_sentiment(spark, sf_dir):
    keyed = cleaning.preprocess(reviews(spark, sf_dir)).withColumn("key", F.monotonically_increasing_id())
    cleaned = stages.write_stage(keyed, fresh_path(spark, "clean"))
    scored = scoring.run_sentiment(cleaned, scoring.fit_sentiment_model(cleaned), key="key")
    return tidy(scored, "transformer_confidence", places=4).select(
        "review_id", "vader_score", "vader_label", "transformer_label", "transformer_confidence", "rating_sentiment")


@register
def analyze_reviews(spark, sf_dir):
    return joined_aspects(analyze(both(spark, sf_dir))).select(
        "dataset_id", "review_id", "clean_light", "clean_deep", "word_count", "sentiment", "confidence", "aspects", *FLAGS)


QUERIES["analyze"] = QUERIES.pop("analyze_reviews")


# --- aspects and topics -----------------------------------------------------------------------------------------
@register
def analyze_model(spark, sf_dir):
    """The interactive chain with a model trained on the ratings, over rows that nothing stored before."""
    raw = reviews(spark, sf_dir)
    found = joined_aspects(analyze(raw, model=scoring.fit_sentiment_model(light_reviews(raw))))
    return tidy(found, "confidence", places=4).select("dataset_id", "review_id", "clean_light", "clean_deep", "word_count", "sentiment", "confidence", "aspects", *FLAGS)


def deep_reviews(df: DataFrame) -> DataFrame:
    return df.withColumn("clean_deep", txt.deep_clean(F.col("review_text")))


@register
def tag_aspects(spark, sf_dir):
    return joined_aspects(aspects.tag_aspects(deep_reviews(both(spark, sf_dir)))).select("dataset_id", "review_id", "aspects")


@register
def tag_aspects_tables(spark, sf_dir):
    tagged = aspects.tag_aspects_with_table(deep_reviews(reviews(spark, sf_dir)), "review_id", aspects.lexicon_table(spark))
    return joined_aspects(tagged).select("review_id", "aspects")


@register
def aspect_onehot(spark, sf_dir):
    tagged = aspects.add_aspect_flags(aspects.tag_aspects(deep_reviews(reviews(spark, sf_dir))))
    return tagged.select("review_id", *FLAGS)


@register
def topic_assign(spark, sf_dir):
    placed = topics.assign_topics(table(spark, sf_dir, "embeddings"), k=10)
    return placed.select("vec_id", "topic", F.bround("topic_distance", 6).alias("topic_distance"))


@register
def topic_place(spark, sf_dir):
    """The embeddings placed on given centers, the means of their labels."""
    vectors = table(spark, sf_dir, "embeddings")
    parts = vectors.select(F.col("label").alias("topic"), F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("topic", "at").agg(F.bround(F.avg(F.col("x").cast("double")), 9).alias("x"))
    centers = means.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("center"))
    placed = topics.place_on_centers(vectors, centers)
    return placed.select("vec_id", "topic", F.bround("topic_distance", 6).alias("topic_distance"))


@register
def topic_discover(spark, sf_dir):
    """Vectors that differ by label in one component, each with the smallest id of the topic it is found in."""
    vectors = table(spark, sf_dir, "embeddings")
    parted = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == F.col("label"), 3.0).otherwise(0.0))
    found = topic_tree.discover_topics(vectors.withColumn("embedding", parted), noise_quantile=None)
    first = found.groupBy("topic").agg(F.min("vec_id").alias("first_id"))
    return found.join(first, "topic").select("vec_id", "first_id")


@register
def topic_assign_text(spark, sf_dir):
    stored = stages.write_stage(light_reviews(reviews(spark, sf_dir)), fresh_path(spark, "light"))
    return topics.assign_topics_from_text(stored, k=8, iterations=5).select("review_id", "topic")


def source_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts per document source, the fixed topic assignment of the keyword queries."""
    return topics.topic_terms(light_reviews(reviews(spark, sf_dir, "source")), "source")


@register
def topic_keywords_ctfidf(spark, sf_dir):
    return topics.topic_keywords(source_terms(spark, sf_dir), topic="source").select("source", "position", "term", "tf", "weight")


@register
def topic_info(spark, sf_dir):
    keywords = topics.topic_keywords(source_terms(spark, sf_dir), topic="source")
    info = topics.topic_info(table(spark, sf_dir, "documents"), keywords, "source")
    return info.withColumn("keywords", F.array_join("keywords", ","))


@register
def topic_representatives(spark, sf_dir):
    return topics.representative_documents(table(spark, sf_dir, "embeddings"), "vec_id", topic="label")


@register
def topic_lexicon_gap(spark, sf_dir):
    keywords = topics.topic_keywords(source_terms(spark, sf_dir), topic="source")
    tagged = aspects.tag_aspects(deep_reviews(reviews(spark, sf_dir, "source")))
    return tidy(topics.topic_lexicon_gap(tagged, keywords, aspects.lexicon_table(spark), "source"), "share_without_aspect")


# --- aggregations -----------------------------------------------------------------------------------------------
@register
def sentiment_counts(spark, sf_dir):
    return summary.sentiment_counts(stored_reviews(spark, sf_dir).reviews())


@register
def aspect_sentiment_summary(spark, sf_dir):
    """End to end from the raw text, without the store."""
    return summary.aspect_sentiment_summary(aspects.aspect_rows(analyze(both(spark, sf_dir)), "dataset_id", "sentiment"))


@register
def aspect_summary_zero_filled(spark, sf_dir):
    return summary.aspect_summary(aspects.add_aspect_flags(stored_reviews(spark, sf_dir).reviews()))


@register
def headline_metrics(spark, sf_dir):
    return tidy(summary.headline_metrics(stored_reviews(spark, sf_dir).reviews()), "pct_positive", "pct_negative")


@register
def sentiment_daily(spark, sf_dir):
    return summary.sentiment_daily(stored_reviews(spark, sf_dir).reviews())


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose datasets write their dates in different ways, some with numbers that only one order can read."""
    key, day = F.col("review_id"), F.to_date("review_date")
    styles = {"docs_de": ["dd.MM.yyyy", "d.M.yyyy", "dd-MMM-yyyy"], "docs_fr": ["dd/MM/yyyy", "d/M/yyyy HH:mm", "dd-MM-yyyy"],
              "docs_es": ["yyyy/MM/dd HH:mm", "d MMM yyyy", "yyyyMMdd"], "docs_en": ["MM/dd/yyyy", "M/d/yyyy h:mm a", "MMM d yyyy", "MMMM d, yyyy"]}
    source = reviews(spark, sf_dir).withColumn("day", F.date_add(F.lit("2016-12-01").cast("date"), (key % 90).cast("int")))
    at = source["day"].cast("timestamp") + F.make_dt_interval(hours=(key % 24).cast("int"))
    written = F.lit(None).cast("string")
    for dataset, layouts in styles.items():
        shown = reduce(lambda rest, i: F.when(key % len(layouts) == i, F.date_format(at, layouts[i])).otherwise(rest), range(len(layouts)), F.lit(None).cast("string"))
        written = F.when(F.col("dataset_id") == dataset, shown).otherwise(written)
    return source.withColumn("review_date", F.when(key % 13 == 0, "not a date").otherwise(written)).withColumn(
        "sentiment", F.element_at(F.lit(list(vocab.SENTIMENTS)), (key % 3 + 1).cast("int")))


@register
def sentiment_daily_mixed(spark, sf_dir):
    return summary.sentiment_daily(dated(spark, sf_dir))


@register
def date_layouts(spark, sf_dir):
    return summary.date_layouts(dated(spark, sf_dir))


@register
def dates_present(spark, sf_dir):
    return summary.has_dates(stored_reviews(spark, sf_dir).reviews())


@register
def rating_distribution(spark, sf_dir):
    return profiling.rating_distribution(both(spark, sf_dir))


@register
def loader_profile(spark, sf_dir):
    return profiling.loader_profile(reviews(spark, sf_dir))


@register
def avg_words(spark, sf_dir):
    return profiling.average_words(reviews(spark, sf_dir))


@register
def avg_words_by_rating(spark, sf_dir):
    return profiling.average_words(reviews(spark, sf_dir), ["rating"])


@register
def top_words(spark, sf_dir):
    return summary.top_words(stored_reviews(spark, sf_dir).reviews())


@register
def negative_top_words(spark, sf_dir):
    return summary.top_words(stored_reviews(spark, sf_dir).reviews().where(F.col("sentiment") == "negative"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lexicon scorers and the rating's label."""
    scored = scoring.score_lexicon(light_reviews(both(spark, sf_dir)))
    scored = scoring.score_lexicon(scored, context=False, score="plain_score", label="plain_label")
    return scored.select("review_id", F.col("vader_label").alias("context_label"), "plain_label",
                         rating_label(F.col("rating")).alias("truth"))


JUDGES = {"context": "context_label", "plain": "plain_label"}


@register
def model_agreement(spark, sf_dir):
    return tidy(evaluation.agreement_rate(judged(spark, sf_dir), "context_label", "truth"), "agreement")


@register
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(judged(spark, sf_dir), "truth", "context_label")


@register
def classification_metrics(spark, sf_dir):
    return tidy(evaluation.classification_metrics(judged(spark, sf_dir), "truth", JUDGES),
                "accuracy", "precision_macro", "recall_macro", "f1_macro")


@register
def classification_report(spark, sf_dir):
    return tidy(evaluation.classification_report(judged(spark, sf_dir), "truth", JUDGES), "precision", "recall", "f1")


@register
def word_count_histogram(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").select(txt.word_count(F.col("text")).alias("word_count"))
    return tidy(profiling.word_count_histogram(counted), "bin_start", "bin_end")


@register
def list_datasets(spark, sf_dir):
    return stored_reviews(spark, sf_dir).list_datasets()


# --- joins, rankings, documents ---------------------------------------------------------------------------------
@register
def negative_examples(spark, sf_dir):
    store = stored_reviews(spark, sf_dir)
    return strategy.negative_examples(store.aspects(), store.reviews())


@register
def negative_examples_one_aspect(spark, sf_dir):
    store = stored_reviews(spark, sf_dir)
    return strategy.negative_examples_for_aspect(store.aspects(), store.reviews(), "1-URGENT", "delivery")


@register
def complaint_examples(spark, sf_dir):
    store = stored_reviews(spark, sf_dir)
    return strategy.complaint_examples(store.aspects(), store.reviews())


@register
def top_complaints(spark, sf_dir):
    return summary.rank_aspects(aspect_summary_zero_filled(spark, sf_dir), "negative")


@register
def top_praise(spark, sf_dir):
    return summary.rank_aspects(aspect_summary_zero_filled(spark, sf_dir), "positive")


def stored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.aspect_sentiment_summary(stored_reviews(spark, sf_dir).aspects())


@register
def top5_complaints(spark, sf_dir):
    return tidy(summary.top_aspects(stored_summary(spark, sf_dir), "negative", 5), "negative_share", places=9)


@register
def top5_praise(spark, sf_dir):
    return tidy(summary.top_aspects(stored_summary(spark, sf_dir), "positive", 5), "positive_share", places=9)


@register
def recommendations_ranked(spark, sf_dir):
    return strategy.ranked_recommendations(strategy.parse_answers(answers(spark, sf_dir)), "answer_id")


@register
def aspect_sentiment_long(spark, sf_dir):
    return summary.aspect_sentiment_long(stored_summary(spark, sf_dir))


@register
def aspect_breakdown(spark, sf_dir):
    return strategy.aspect_breakdown(stored_reviews(spark, sf_dir).aspects())


@register
def strategy_context(spark, sf_dir):
    """The nested context, flattened to strings for comparison."""
    store = stored_reviews(spark, sf_dir)
    context = strategy.strategy_context(store.reviews(), store.aspects())
    counts = F.transform(F.map_entries("sentiment_counts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    breakdown = F.transform("aspect_breakdown", lambda a: F.concat_ws(
        "/", a["aspect"], a["total_mentions"], a["positive"], a["neutral"], a["negative"]))
    snippets = F.flatten(F.transform("top_complaint_aspects", lambda a: F.element_at("example_negative_reviews", a)))
    return context.select("dataset_id", "total_reviews", F.array_join(counts, ",").alias("counts"),
                          F.array_join(breakdown, ",").alias("breakdown"),
                          F.array_join("top_complaint_aspects", ",").alias("top"),
                          F.when(F.size(snippets) > 0, F.array_join(snippets, "|")).alias("snippets"))


@register
def strategy_prompt(spark, sf_dir):
    store = stored_reviews(spark, sf_dir)
    return strategy.strategy_prompts(strategy.strategy_context(store.reviews(), store.aspects()))


@register
def strategy_prompt_fields(spark, sf_dir):
    """What the prompts say, read back from the JSON inside them."""
    inside = F.regexp_extract("prompt", r"(?s)Review analytics:\n(.*)\n\nAnswer with one JSON", 1)
    breakdown = "array<struct<aspect: string, total_mentions: bigint, negative_share: double>>"
    document = F.from_json(inside, f"dataset_id string, total_reviews bigint, top_complaint_aspects array<string>, aspect_breakdown {breakdown}")
    lines = F.transform("d.aspect_breakdown", lambda a: F.concat_ws("/", a["aspect"], a["total_mentions"]))
    return strategy_prompt(spark, sf_dir).select(document.alias("d")).select(
        "d.dataset_id", "d.total_reviews", F.array_join("d.top_complaint_aspects", ",").alias("top"), F.array_join(lines, ",").alias("breakdown"))


def quoting_writer():
    """A stand-in for a strategy writer: answers with what its prompt says of the dataset and its first complaint."""
    def load():
        def write(prompt: str) -> str:
            context = json.loads(prompt.split("Review analytics:\n", 1)[1].split("\n\nAnswer with one JSON", 1)[0])
            first = (context["top_complaint_aspects"] or ["nothing"])[0]
            said = {"executive_summary": f"{context['dataset_id']} has {context['total_reviews']} reviews", "recommendations":
                    [{"aspect": first, "finding": "f", "recommendation": "r", "priority": "high"}]}
            return json.dumps(said) if context["total_reviews"] % 2 else f"```json\n{json.dumps(said)}\n```"
        return write
    return load


@register
def strategy_answers(spark, sf_dir):
    """Strategies of all stored datasets, written twice: the second time every answer is there already."""
    store = stored_reviews(spark, sf_dir)
    for _ in range(2):
        datasets.write_strategies(store, quoting_writer(), writer="quoting")
    times = store.answers().agg(F.count("*").alias("asked"))
    parsed = strategy.parse_answers(store.strategies(), "strategy_json")
    return parsed.crossJoin(F.broadcast(times)).select("dataset_id", "executive_summary", F.col("recommendations")[0]["aspect"].alias("aspect"), "asked")
