"""Counts, shares, rankings and trends over analysed reviews. `by` names the dataset columns; all datasets at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.functions.numeric import share
from reviewloom.functions.text import parse_date

DATASET = ("dataset_id",)


def _label_counts(label: str) -> list[Column]:
    return [F.count_if(F.col(label) == s).alias(s) for s in vocab.SENTIMENTS]


def sentiment_counts(df: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Reviews per sentiment; a null sentiment is a group of its own."""
    return df.groupBy(*by, "sentiment").agg(F.count("*").alias("n"))


def headline_metrics(df: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Total and the percentages of positive and negative reviews (0 without reviews)."""
    counted = df.groupBy(*by).agg(F.count("*").alias("total"), *_label_counts("sentiment"))
    return counted.select(*by, "total", (100 * share(F.col("positive"), F.col("total"))).alias("pct_positive"),
                          (100 * share(F.col("negative"), F.col("total"))).alias("pct_negative"))


def aspect_sentiment_summary(children: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Mentions per aspect and sentiment from (review, aspect) rows; only aspects that occur."""
    return children.groupBy(*by, "aspect").agg(F.count("*").alias("total"), *_label_counts("sentiment"))


def aspect_summary(df: DataFrame, by: Sequence[str] = DATASET, label: str = "sentiment",
                   aspects: Sequence[str] | None = None) -> DataFrame:
    """Every aspect, mentioned or not, from the flag columns: counts and shares to four decimals.

    One pass: each flag and label pair is a conditional count, turned into rows after the aggregation.
    """
    names = list(vocab.ASPECT_KEYWORDS) if aspects is None else list(aspects)
    counters = []
    for name in names:
        flag = F.col(f"aspect_{name}")
        counters.append(F.count_if(flag).alias(f"{name}_total"))
        counters += [F.count_if(flag & (F.col(label) == s)).alias(f"{name}_{s}") for s in vocab.SENTIMENTS]
    wide = df.groupBy(*by).agg(*counters)
    entries = F.array(*[F.struct(
        F.lit(i).alias("aspect_ord"), F.lit(name).alias("aspect"), F.col(f"{name}_total").alias("total"),
        *[F.col(f"{name}_{s}").alias(s) for s in vocab.SENTIMENTS]) for i, name in enumerate(names)])
    long = wide.select(*by, F.inline(entries))
    return long.withColumns({f"{s}_share": F.bround(share(F.col(s), F.col("total")), 4)
                             for s in ("negative", "positive")})


def with_shares(summary: DataFrame) -> DataFrame:
    """Unrounded negative and positive shares of a summary."""
    return summary.withColumns({f"{s}_share": share(F.col(s), F.col("total")) for s in ("negative", "positive")})


def rank_aspects(summary: DataFrame, sentiment: str, by: Sequence[str] = DATASET) -> DataFrame:
    """Mentioned aspects by rounded share, then count, of a sentiment; remaining ties in lexicon order.

    `summary` is the result of `aspect_summary`: a handful of rows per dataset.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(f"{sentiment}_share"), F.desc(sentiment), "aspect_ord")
    return (summary.where(F.col("total") > 0).withColumn("position", F.row_number().over(order))
            .select(*by, "position", "aspect", f"{sentiment}_share", sentiment))


def top_aspects(summary: DataFrame, sentiment: str, n: int, by: Sequence[str] = DATASET) -> DataFrame:
    """The `n` aspects with the highest unrounded share of a sentiment, ties by name."""
    order = Window.partitionBy(*by).orderBy(F.desc(f"{sentiment}_share"), "aspect")
    return (with_shares(summary).withColumn("position", F.row_number().over(order))
            .where(F.col("position") <= n).select(*by, "position", "aspect", f"{sentiment}_share"))


def aspect_sentiment_long(summary: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """One row per aspect and sentiment, smallest aspects first."""
    return (summary.unpivot([*by, "aspect", "total"], list(vocab.SENTIMENTS), "sentiment", "n")
            .orderBy(*by, "total", "aspect", "sentiment"))


def date_layouts(df: DataFrame, by: Sequence[str] = DATASET, date: str = "review_date", weight: str | None = None) -> DataFrame:
    """Per dataset how many rows have a date that can be read with the month first, and with the day first, and the `layout`
    that reads more: one aggregation. A tie goes to the month. With `weight`, a row stands for so many."""
    one = F.lit(1) if weight is None else F.col(weight)
    read = lambda day_first: F.coalesce(F.sum(F.when(parse_date(F.col(date), day_first).isNotNull(), one)), F.lit(0)).cast("long")
    return (df.groupBy(*by).agg(read(False).alias("month_first"), read(True).alias("day_first"))
            .withColumn("layout", F.when(F.col("day_first") > F.col("month_first"), "day first").otherwise("month first")))


def read_dates(df: DataFrame, by: Sequence[str] = DATASET, date: str = "review_date", day: str = "day", weight: str | None = None) -> DataFrame:
    """Add the `day` of every row, numbers read in the layout of the row's dataset."""
    chosen = date_layouts(df, by, date, weight).select(*[F.col(c).alias(f"_by_{c}") for c in by], (F.col("layout") == "day first").alias("_day_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return df.join(chosen, same or F.lit(True)).withColumn(day, parse_date(F.col(date), F.col("_day_first"))).drop(*[f"_by_{c}" for c in by], "_day_first")


def sentiment_daily(df: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Reviews per day and sentiment; rows without a readable date or a sentiment are left out. Rows are counted per written
    date first; how a dataset writes its dates is then decided and applied on the counts."""
    written = df.groupBy(*by, "review_date", "sentiment").agg(F.count("*").alias("_rows"))
    return (read_dates(written, by, weight="_rows").na.drop(subset=["day", "sentiment"])
            .groupBy(*by, "day", "sentiment").agg(F.sum("_rows").alias("n")))


def has_dates(df: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Whether a dataset has any date at all: the precondition of a trend."""
    return df.groupBy(*by).agg(F.bool_or(F.col("review_date").isNotNull()).alias("has_dates"))


def word_frequencies(df: DataFrame, by: Sequence[str] = (), text: str = "clean_deep") -> DataFrame:
    """Occurrences of every word; counted before the shuffle, never by joining texts together."""
    return (df.select(*by, F.explode_outer(F.split(F.col(text), " ")).alias("word")).where(F.col("word") != "")
            .groupBy(*by, "word").agg(F.count("*").alias("n")))


def top_words(df: DataFrame, n: int = 20, text: str = "clean_deep") -> DataFrame:
    """The `n` most frequent words, ties in alphabetical order."""
    return word_frequencies(df, text=text).orderBy(F.desc("n"), "word").limit(n)


def list_datasets(df: DataFrame) -> DataFrame:
    return df.select("dataset_id").distinct().orderBy("dataset_id")
