"""The batch chain: four stages that meet in stored tables, so each can be rerun alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from reviewloom.operators.aspects import add_aspect_flags, tag_aspects
from reviewloom.operators.cleaning import drop_blank_reviews, preprocess, with_review_ids
from reviewloom.operators.evaluation import agreement_rate, classification_metrics, classification_report, confusion_matrix
from reviewloom.operators.profiling import first_rows
from reviewloom.operators.scoring import Scorer, WordModel, fit_sentiment_model, rare_sums, run_sentiment
from reviewloom.operators.summary import aspect_summary
from reviewloom.operators.topics import assign_topics_from_text
from reviewloom.schema import TEXT
from reviewloom.sources.stages import read_stage, write_documents, write_stage
from reviewloom.sources.workspace import fresh_path, remove_path, replace_path, shuffles_removed

ROW_KEY = "row_key"
TEXTS = (TEXT, "clean_light", "clean_deep")
PART_ROWS = 200_000  # whose scores are broadcast at once
ROUNDS = 4  # in which the words of a table are shuffled
MODELS = {"lexicon": "vader_label", "model": "transformer_label"}


@dataclass(frozen=True)
class BatchPaths:
    """Where the stages and reports of one run are kept."""

    folder: str

    def __getattr__(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"


def clean_stage(raw: DataFrame, paths: BatchPaths) -> DataFrame:
    """The cleaned reviews, with a key of every row for the next stage."""
    return write_stage(with_review_ids(preprocess(with_review_ids(drop_blank_reviews(raw))), ROW_KEY), paths.reviews_clean, TEXTS)


def sentiment_stage(spark, paths: BatchPaths, sample: int | None = None, model: PipelineModel | None = None,
                    load_model: Callable[[], Scorer] | None = None) -> DataFrame:
    """Score the cleaned reviews; without a model one is trained on the ratings of the same table."""
    df = read_stage(spark, paths.reviews_clean)
    if sample is not None:
        df = first_rows(df, sample)
    with shuffles_removed(spark):
        if model is None and load_model is None:
            model = fit_sentiment_model(df)
        key = ROW_KEY if isinstance(model, WordModel) and ROW_KEY in df.columns else None
        parts = row_parts(df, key, PART_ROWS) if key and sample is None and df.schema[key].dataType == LongType() else []
        if not parts:
            return write_stage(run_sentiment(df, model, load_model, key).drop(ROW_KEY), paths.reviews_sentiment, TEXTS)
        return _scored_in_parts(spark, df, model, parts, paths)


def row_parts(df: DataFrame, key: str, size: int) -> list[tuple[int, int, int]]:
    """Ranges of a stored table's keys `(first, last, rows)` in order, of `size` rows or fewer each where keys have no gaps.
    One row per piece of the input comes to the driver."""
    piece = F.shiftright(key, 33)
    pieces = df.where(F.col(key).isNotNull()).groupBy(piece).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))
    parts: list[tuple[int, int, int]] = []
    for _, first, last, n in sorted(pieces.collect()):
        if parts and parts[-1][2] + n <= size:
            parts[-1] = (parts[-1][0], last, parts[-1][2] + n)
        elif last - first < size:
            parts.append((first, last, n))
        elif last - first < 2 * n:
            parts += [(at, min(at + size - 1, last), min(size, last - at + 1)) for at in range(first, last + 1, size)]
        else:
            parts.append((first, last, n))
    return parts


def _scored_in_parts(spark, df: DataFrame, model: WordModel, parts: list[tuple[int, int, int]], paths: BatchPaths) -> DataFrame:
    """Score a stored table part by part. The words of a ROUNDS-th of the table are shuffled at once; what they add to each row
    is stored, ordered by row, and broadcast to the rows of one part, so that texts are never shuffled. The table moves to its
    place when it is whole."""
    def rows(some: list[tuple[int, int, int]], key: str) -> Column:
        inside = F.col(key).between(some[0][0], some[-1][1])
        return inside | F.col(key).isNull() if some[0] is parts[0] else inside
    done, whole = 0, sum(n for *_, n in parts)
    rounds: list[list[tuple[int, int, int]]] = []
    for part in parts:
        if not rounds or done * ROUNDS >= whole * len(rounds):
            rounds.append([])
        rounds[-1].append(part)
        done += part[2]
    unfinished = f"{paths.reviews_sentiment}-unfinished"
    remove_path(spark, unfinished)
    for some in rounds:
        stored = fresh_path(spark, "word-sums")
        sums = rare_sums(df.where(rows(some, ROW_KEY)), ROW_KEY, model)
        sums.repartitionByRange(len(some), "_row").sortWithinPartitions("_row").write.parquet(stored)
        sums = spark.read.parquet(stored)
        for part in some:
            scored = run_sentiment(df.where(rows([part], ROW_KEY)), model, key=ROW_KEY, sums=sums.where(rows([part], "_row")))
            write_stage(scored.drop(ROW_KEY), unfinished, TEXTS, "append")
        remove_path(spark, stored)
    replace_path(spark, unfinished, paths.reviews_sentiment)
    return read_stage(spark, paths.reviews_sentiment)


def evaluation_stage(spark, paths: BatchPaths) -> dict[str, DataFrame]:
    """Agreement and, with ratings, metrics of both scorers; each table is also stored as JSON."""
    df = read_stage(spark, paths.reviews_sentiment)
    tables = {"agreement": agreement_rate(df, *MODELS.values())}
    if "rating_sentiment" in df.columns:
        tables["metrics"] = classification_metrics(df, "rating_sentiment", MODELS)
        tables["report"] = classification_report(df, "rating_sentiment", MODELS)
        tables |= {f"confusion_{m}": confusion_matrix(df, "rating_sentiment", c) for m, c in MODELS.items()}
    for name, table in tables.items():
        write_documents(table, f"{paths.sentiment_comparison}/{name}")
    return tables


def aspect_stage(spark, paths: BatchPaths, sample: int | None = None, topics: int = 0) -> DataFrame:
    """Tag the scored reviews, discover `topics` topics if asked to, and store table and summary document."""
    df = read_stage(spark, paths.reviews_sentiment)
    if sample is not None:
        df = first_rows(df, sample)
    tagged = add_aspect_flags(tag_aspects(df))
    if topics:
        tagged = assign_topics_from_text(tagged, topics)
    stored = write_stage(tagged, paths.reviews_aspects, TEXTS)
    write_documents(summary_document(stored), paths.aspect_summary)
    return stored


def summary_document(df: DataFrame, by: tuple[str, ...] = (), label: str = "transformer_label") -> DataFrame:
    """The aspect summary with both rankings as one nested row per group.

    The few aspect rows of a group are gathered once; the rankings are sorted within them.
    """
    stats = ["total", "positive", "neutral", "negative", "negative_share", "positive_share"]
    entry = F.struct("aspect_ord", "aspect", F.struct(*stats).alias("stats"))
    gathered = aspect_summary(df, by, label).groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    mentioned = F.filter("_entries", lambda e: e["stats"]["total"] > 0)

    def ranking(sentiment: str) -> Column:
        keyed = F.transform(mentioned, lambda e: F.struct(
            (-e["stats"][f"{sentiment}_share"]).alias("share"), (-e["stats"][sentiment]).alias("n"), e["aspect_ord"], e["aspect"]))
        return F.transform(F.sort_array(keyed), lambda k: k["aspect"])

    return gathered.select(
        *by, F.map_from_entries(F.transform("_entries", lambda e: F.struct(e["aspect"], e["stats"]))).alias("aspects"),
        ranking("negative").alias("top_complaints"), ranking("positive").alias("top_praise"))
