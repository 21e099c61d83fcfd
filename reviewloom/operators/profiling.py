"""Profiles of a raw table: column roles, nulls, duplicates, ratings, lengths, and its fingerprint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom import vocab
from reviewloom.functions.text import parse_date, word_count
from reviewloom.schema import RATING, TEXT, ColumnMapping


def name_score(name: str, any_of: Sequence[str], all_of: Sequence[str] = ()) -> int:
    """2 when the lower-cased name holds every word of `all_of`, 1 when it holds a word of `any_of`, else 0."""
    low = name.lower()
    if all_of and all(word in low for word in all_of):
        return 2
    return int(any(word in low for word in any_of))


def pick_column(names: Sequence[str], any_of: Sequence[str], all_of: Sequence[str] = ()) -> str | None:
    """First column with the highest name score, or None when no name matches."""
    best = max(names, key=lambda n: name_score(n, any_of, all_of), default=None)
    return best if best is not None and name_score(best, any_of, all_of) else None


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_column_profile(df: DataFrame) -> DataFrame:
    """Mean length of every string column, longest first, ties in column order. One pass over the table."""
    names = _string_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column_name string, mean_length double")
    row = df.agg(*[F.avg(F.length(_quoted(n))).alias(f"m{i}") for i, n in enumerate(names)])
    entries = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column_name"),
                                 F.col(f"m{i}").alias("mean_length")) for i, n in enumerate(names)])
    return (row.select(F.inline(entries)).where(F.col("mean_length").isNotNull())
            .orderBy(F.desc("mean_length"), "ordinal"))


def guess_text_column(df: DataFrame) -> str | None:
    """The text column by name, else the string column with the longest mean length."""
    named = pick_column(df.columns, vocab.TEXT_KEYWORDS, vocab.TEXT_PREFERRED)
    if named is not None:
        return named
    longest = text_column_profile(df).first()
    return None if longest is None else longest["column_name"]


def guess_mapping(df: DataFrame) -> ColumnMapping:
    """Which columns hold text, rating and date, judged by name and, for the text, by length if no name fits."""
    text = guess_text_column(df)
    if text is None:
        raise KeyError(f"no column can hold the review text; found {df.columns}")
    return ColumnMapping(text, pick_column(df.columns, vocab.RATING_KEYWORDS), pick_column(df.columns, vocab.DATE_KEYWORDS))


def column_roles(df: DataFrame) -> DataFrame:
    """One row per column: name scores, mean length, shares that parse as number and date, and the role it gets.

    Everything is measured in one aggregation; the roles are then decided within its single result row.
    """
    names = df.columns
    strings = set(_string_columns(df))
    picks = {"rating": pick_column(names, vocab.RATING_KEYWORDS), "date": pick_column(names, vocab.DATE_KEYWORDS)}
    text_pick = pick_column(names, vocab.TEXT_KEYWORDS, vocab.TEXT_PREFERRED)

    measures = []
    for i, name in enumerate(names):
        value = _quoted(name).cast("string")
        measures += [F.avg(F.length(value)).alias(f"length{i}"),
                     F.avg(value.try_cast("double").isNotNull().cast("double")).alias(f"numeric{i}"),
                     F.avg(parse_date(value).isNotNull().cast("double")).alias(f"date{i}")]
    row = df.agg(*measures)

    ranked = [F.when(F.col(f"length{i}").isNotNull(),
                     F.struct(F.col(f"length{i}").alias("length"), F.lit(-i).alias("back"), F.lit(n).alias("name")))
              for i, n in enumerate(names) if n in strings]
    longest = F.array_max(F.array(*ranked))["name"] if ranked else F.lit(None).cast("string")
    text_name = F.lit(text_pick) if text_pick is not None else longest

    def role(name: str) -> Column:
        by_name = [r for r in ("rating", "date") if picks[r] == name]
        other = F.lit(by_name[0]) if by_name else F.lit(None).cast("string")
        return F.when(text_name == name, "text").otherwise(other)

    entries = F.array(*[F.struct(
        F.lit(i).alias("ordinal"), F.lit(n).alias("column_name"),
        F.lit(name_score(n, vocab.TEXT_KEYWORDS, vocab.TEXT_PREFERRED)).alias("text_score"),
        F.lit(name_score(n, vocab.RATING_KEYWORDS)).alias("rating_score"),
        F.lit(name_score(n, vocab.DATE_KEYWORDS)).alias("date_score"),
        F.col(f"length{i}").alias("mean_length"), F.col(f"numeric{i}").alias("numeric_share"),
        F.col(f"date{i}").alias("date_share"), role(n).alias("role")) for i, n in enumerate(names)])
    return row.select(F.inline(entries))


def null_counts(df: DataFrame) -> DataFrame:
    """Number of nulls per column, in column order."""
    row = df.agg(*[F.count_if(_quoted(n).isNull()).alias(f"n{i}") for i, n in enumerate(df.columns)])
    entries = [F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column_name"), F.col(f"n{i}").alias("nulls"))
               for i, n in enumerate(df.columns)]
    return row.select(F.inline(F.array(*entries)))


def _text_key(text: str) -> Column:
    # A digest instead of the text: the shuffle moves 32 bytes per distinct text, not the text.
    return F.coalesce(F.unhex(F.sha2(F.col(text), 256)), F.lit(b"null"))


def duplicate_count(df: DataFrame, text: str = TEXT) -> DataFrame:
    """How many rows repeat an earlier row's text (nulls equal each other)."""
    copies = df.groupBy(_text_key(text).alias("key")).agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).cast("bigint").alias("duplicates"))


def duplicate_rows(df: DataFrame, key: str, text: str = TEXT) -> DataFrame:
    """Rows whose text occurs with a smaller `key` (unique) as well.

    The first row of every text comes from a map-side combined minimum, and the rows are matched on `key`, so a
    text with very many copies never gathers in one task.
    """
    firsts = df.groupBy(_text_key(text).alias("text_key")).agg(F.min(key).alias(key)).select(key)
    return df.join(firsts, key, "left_anti")


def first_rows(df: DataFrame, n: int, key: str = "review_id") -> DataFrame:
    """The first `n` rows by `key`."""
    return df.orderBy(key).limit(n)


def rating_distribution(df: DataFrame, rating: str = RATING) -> DataFrame:
    return df.where(F.col(rating).isNotNull()).groupBy(rating).agg(F.count("*").alias("n")).orderBy(rating)


def average_words(df: DataFrame, by: Sequence[str] = (), text: str = TEXT) -> DataFrame:
    """Mean word count of the raw text to one decimal, overall or per group; null groups are left out."""
    for name in by:
        df = df.where(F.col(name).isNotNull())
    return df.groupBy(*by).agg(F.bround(F.avg(word_count(F.col(text))), 1).alias("avg_words"))


def word_count_histogram(df: DataFrame, column: str = "word_count", bins: int = 20) -> DataFrame:
    """Equal-width histogram between minimum and maximum; the last bin includes its upper edge.

    Rows are first counted per value. The range and the bins come from that small table, so the texts behind
    `column` are read once. Every bin is returned, with 0 when empty.
    """
    values = df.groupBy(F.col(column).alias("v")).agg(F.count(column).alias("n"))
    bounds = values.agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"), F.sum("n").alias("rows"))
    widen = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    bounds = bounds.where(F.col("rows") > 0).select(
        (F.col("lo") - widen).alias("lo"), ((F.col("hi") - F.col("lo") + 2 * widen) / bins).alias("width"))
    lo, width = bounds.select("lo").scalar(), bounds.select("width").scalar()
    counts = (values.select(F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / width)).alias("bin"), "n")
              .groupBy("bin").agg(F.sum("n").alias("n")))
    edges = bounds.select("lo", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")).alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


def dataset_fingerprint(df: DataFrame, stem: str, by: Sequence[str] = ()) -> DataFrame:
    """`dataset_id` derived from the content: `stem` and ten hex digits.

    Row digests are combined by count, xor and sum, so the order of the rows does not matter, copies of a row
    do, and every group needs a single partial aggregate per task.
    """
    fields = [F.coalesce(_quoted(n).cast("string"), F.lit("\\N")) for n in df.columns if n not in by]
    digest = F.md5(F.concat_ws("\x1f", *fields))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    combined = df.select(*by, number.alias("h")).groupBy(*by).agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    content = F.md5(F.concat_ws("|", "n", "x", "s"))
    return combined.select(*by, F.concat(F.lit(stem + "_"), F.substring(content, 1, 10)).alias("fingerprint"))


def summarize_reviews(df: DataFrame, key: str = "review_id", samples: int = 3) -> dict[str, DataFrame]:
    """The loader's profile: row count, mean words, ratings and the first few texts."""
    parts = {"rows": df.agg(F.count("*").alias("rows")), "avg_words": average_words(df),
             "samples": first_rows(df, samples, key).select(key, TEXT)}
    if RATING in df.columns:
        parts["ratings"] = rating_distribution(df)
    return parts


def loader_profile(df: DataFrame, key: str = "review_id", samples: int = 3) -> DataFrame:
    """The loader's profile as one table of (part, ordinal, name, value): the number of rows, the columns, the mean number of
    words, how often each rating occurs, and the first texts by `key`.

    Everything but the samples comes from one aggregation per rating; the texts are read a second time for the first few.
    """
    by_rating = df.groupBy(F.col(RATING).alias("rating") if RATING in df.columns else F.lit(None).cast("double").alias("rating")).agg(
        F.count("*").alias("n"), F.sum(word_count(F.col(TEXT))).alias("words"), F.count(TEXT).alias("texts"))
    ratings = F.sort_array(F.collect_list(F.when(F.col("rating").isNotNull(), F.struct("rating", "n"))))
    whole = by_rating.agg(F.sum("n").alias("n"), F.bround(F.sum("words") / F.sum("texts"), 1).alias("mean"), ratings.alias("ratings"))
    line = lambda part, ordinal, name, value: F.struct(
        F.lit(part).alias("part"), ordinal.alias("ordinal"), name.alias("name"), value.cast("string").alias("value"))
    fixed = [line("rows", F.lit(0), F.lit("rows"), F.coalesce("n", F.lit(0))), line("words", F.lit(0), F.lit("mean"), F.col("mean")),
             *[line("column", F.lit(i), F.lit(c), F.lit(df.schema[c].dataType.simpleString())) for i, c in enumerate(df.columns)]]
    counted = F.transform("ratings", lambda r, i: line("rating", i, r["rating"].cast("string"), r["n"]))
    first = first_rows(df, samples, key).select(key, TEXT)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1
    texts = first.select(F.lit("sample").alias("part"), place.alias("ordinal"), F.col(key).cast("string").alias("name"), F.col(TEXT).alias("value"))
    return whole.select(F.inline(F.concat(F.array(*fixed), counted))).unionByName(texts)
