"""Row validation and the two-track text cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import text as txt
from reviewloom.schema import TEXT, require_columns


def drop_blank_reviews(df: DataFrame, text: str = TEXT) -> DataFrame:
    """Trim the text; drop rows whose text is null, empty or the word "nan"."""
    require_columns(df, text)
    trimmed = df.withColumn(text, txt.strip(F.col(text)))
    return trimmed.where(F.col(text).isNotNull() & (F.col(text) != "") & (F.lower(text) != "nan"))


def with_review_ids(df: DataFrame, key: str = "review_id") -> DataFrame:
    """Add unique ids when the source has none. They tell rows apart and nothing else: ids in the order of lines come from
    `read_csv(line_ids=...)`. Write the result before using it: the ids depend on how the input was split."""
    return df if key in df.columns else df.withColumn(key, F.monotonically_increasing_id())


def preprocess(df: DataFrame, text: str = TEXT, stop_words: Iterable[str] | None = None,
               lemmas: Mapping[str, str] | None = None) -> DataFrame:
    """Add `clean_light`, `clean_deep` and `word_count`; a narrow projection of the raw text."""
    require_columns(df, text)
    raw = F.col(text)
    return df.withColumns({
        "clean_light": txt.light_clean(raw),
        "clean_deep": txt.deep_clean(raw, stop_words, lemmas),
        "word_count": txt.word_count(raw),
    })


def deep_clean_with_tables(df: DataFrame, key: str, stop_words: DataFrame, lemmas: DataFrame,
                           text: str = TEXT) -> DataFrame:
    """`clean_deep` for dictionaries too large for a plan constant.

    `stop_words(word)` and `lemmas(word, lemma)` are tables. Only (key, position, word) is shuffled; the words
    of one text meet again in one row, which is as large as the text was. `key` must be unique.
    """
    words = df.select(key, F.posexplode_outer(F.split(txt.deep_prepare(F.col(text)), " ")).alias("position", "word"))
    kept = (words.where(F.col("word") != "")
            .join(stop_words.select("word"), "word", "left_anti")
            .join(lemmas.select("word", "lemma"), "word", "left"))
    ordered = F.sort_array(F.collect_list(F.struct("position", F.coalesce("lemma", "word").alias("lemma"))))
    joined = kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["lemma"]), " ").alias("clean_deep"))
    return df.join(joined, key, "left").withColumn("clean_deep", F.coalesce("clean_deep", F.lit("")))
