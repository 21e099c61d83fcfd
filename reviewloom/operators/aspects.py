"""Aspect tags, as a list, as flags and as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.functions.aspects import aspect_list
from reviewloom.functions.text import words_of

Lexicon = Mapping[str, Sequence[str]]


def tag_aspects(df: DataFrame, lexicon: Lexicon | None = None, text: str = "clean_deep") -> DataFrame:
    """Add the `aspects` list. No shuffle."""
    return df.withColumn("aspects", aspect_list(words_of(F.col(text)), lexicon))


def add_aspect_flags(df: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Add one boolean column per aspect."""
    names = vocab.ASPECT_KEYWORDS if lexicon is None else lexicon
    return df.withColumns({f"aspect_{a}": F.array_contains("aspects", a) for a in names})


def tag_aspects_with_table(df: DataFrame, key: str, lexicon: DataFrame, text: str = "clean_deep") -> DataFrame:
    """`tag_aspects` for a lexicon table `(aspect_ord, aspect, keyword)` of any size. `key` must be unique.

    A word repeated in a text is joined once, and only hits reach the shuffle on `key`.
    """
    words = df.select(key, F.explode_outer(F.array_distinct(words_of(F.col(text)))).alias("keyword"))
    hits = words.join(lexicon, "keyword")
    ordered = F.sort_array(F.collect_set(F.struct("aspect_ord", "aspect")))
    tags = hits.groupBy(key).agg(F.transform(ordered, lambda a: a["aspect"]).alias("aspects"))
    return df.join(tags, key, "left").withColumn("aspects", F.coalesce("aspects", F.array().cast("array<string>")))


def lexicon_table(spark, lexicon: Lexicon | None = None) -> DataFrame:
    """The keyword lexicon as rows `(aspect_ord, aspect, keyword)`."""
    names = vocab.ASPECT_KEYWORDS if lexicon is None else lexicon
    rows = [(i, aspect, word) for i, (aspect, words) in enumerate(names.items()) for word in words]
    return spark.createDataFrame(rows, "aspect_ord int, aspect string, keyword string")


def aspect_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One row per (review, aspect) with the given columns; reviews without an aspect give none.

    For a plain explode Spark adds a filter on the list's size and pushes it to the scan, where it computes the
    tags a second time. The outer form has no such filter.
    """
    return df.select(*columns, F.explode_outer("aspects").alias("aspect")).where(F.col("aspect").isNotNull())


def unmatched(df: DataFrame) -> DataFrame:
    """Reviews without any aspect: where to look for words the lexicon misses."""
    return df.where(F.size("aspects") == 0)


def filter_reviews(df: DataFrame, sentiments: Sequence[str] = (), aspects: Sequence[str] = ()) -> DataFrame:
    """Reviews with one of the sentiments and any of the aspects, for display; an empty choice does not filter."""
    if sentiments:
        df = df.where(F.col("sentiment").isin(list(sentiments)))
    if aspects:
        df = df.where(F.arrays_overlap("aspects", F.lit(list(aspects))))
    return df.select("review_text", "sentiment", "confidence", "aspects", "rating", "review_date")
