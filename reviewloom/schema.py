"""Column names and schemas shared by every stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXT, RATING, DATE = "review_text", "rating", "review_date"

ANALYZED_REVIEWS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("clean_deep", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("aspects", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("review_date", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
])

REVIEW_ASPECTS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("aspect", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
])

STRATEGY = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("strategy_json", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

ANSWERS = T.StructType([
    T.StructField("prompt_digest", T.StringType()),
    T.StructField("writer", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("asked_at", T.TimestampType()),
])

RECOMMENDATION = T.StructType([
    T.StructField("aspect", T.StringType()),
    T.StructField("finding", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("priority", T.StringType()),
])

STRATEGY_ANSWER = T.StructType([
    T.StructField("executive_summary", T.StringType()),
    T.StructField("recommendations", T.ArrayType(RECOMMENDATION)),
])


@dataclass(frozen=True)
class ColumnMapping:
    """Which source columns hold the text, the rating and the date."""

    text: str = TEXT
    rating: str | None = None
    date: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Rename the source columns to the canonical names; other columns pass through."""
        require_columns(df, self.text)
        renames = {self.text: TEXT}
        if self.rating is not None:
            renames[self.rating] = RATING
        if self.date is not None:
            renames[self.date] = DATE
        taken = [new for old, new in renames.items() if old != new and new in df.columns and new not in renames]
        if taken or len(set(renames)) < sum(x is not None for x in (self.text, self.rating, self.date)):
            raise ValueError(f"column(s) {taken or list(renames)} would be there twice")
        return df.withColumnsRenamed(renames)


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail before any job runs when a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing column(s) {missing}; found {df.columns}")
