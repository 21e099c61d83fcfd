"""Reading review files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.operators.cleaning import drop_blank_reviews
from reviewloom.schema import RATING, TEXT, ColumnMapping, require_columns
from reviewloom.sources.sample import sample_reviews
from reviewloom.sources.workspace import fresh_path, path_exists


def fields_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field holds a line break: then some line has an odd number of quotes. One scan that can be split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None, line_ids: str | None = None) -> DataFrame:
    """A headed CSV with every column a string and the usual null spellings turned into nulls.

    Quoted fields may hold line breaks and doubled quotes. Files with line breaks in fields cannot be split, so a large
    export of that kind should come as many files; all others are split. Which kind they are is looked up, unless
    `multi_line` says so. `line_ids` names a column for the place of each record among all records, from 0, files in the
    order of their paths; the records are stored once to count them.
    """
    if multi_line is None:
        multi_line = fields_span_lines(spark, path)
    raw = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
           .option("enforceSchema", False).option("nullValue", "").option("emptyValue", "").csv(path))

    def real(name: str) -> Column:
        column = F.col("`" + name.replace("`", "``") + "`")
        return F.when(~column.isin(vocab.CSV_NULLS), column).alias(name)
    columns = [real(n) for n in raw.columns]
    return raw.select(*columns) if line_ids is None else numbered(raw, columns, line_ids)


def numbered(raw: DataFrame, columns: list[Column], key: str) -> DataFrame:
    """`columns` of a file scan and `key`, the place of each record in the order of files and lines.

    A scan reads a piece of a file from its first line to its last, so the numbers it gives are gapless within a piece.
    Counts per piece (file and first byte) and their prefix sums make them global; one row per piece is all that is
    ordered. The records are stored with their numbers, so a record that is read again keeps its own.
    """
    spark, path = raw.sparkSession, fresh_path(raw.sparkSession, "numbered")
    raw.select(*columns, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                  F.monotonically_increasing_id().alias("at")).alias("_place")).write.parquet(path)
    stored = spark.read.parquet(path)
    ahead = Window.partitionBy(F.lit(0)).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (stored.groupBy("_place.file", "_place.start").agg(F.min("_place.at").alias("first"), F.count("*").alias("n"))
              .select("file", "start", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("_shift")))
    same = (F.col("_place.file") == F.col("file")) & (F.col("_place.start") == F.col("start"))
    # A join by file would bring all rows of a file to one task.
    return stored.join(F.broadcast(pieces), same).withColumn(key, F.col("_place.at") + F.col("_shift")).drop("_place", "file", "start", "_shift")


def load_reviews(spark: SparkSession, path: str, mapping: ColumnMapping = ColumnMapping(),
                 multi_line: bool | None = None, line_ids: str | None = None) -> DataFrame:
    """Reviews of a CSV under their canonical names, without blank texts; the built-in sample if nothing is there.

    `multi_line` and `line_ids` as in `read_csv`; blank texts leave after the lines were counted. Raises KeyError, before
    any job, when the text column is missing.
    """
    if not path_exists(spark, path):
        return drop_blank_reviews(sample_reviews(spark))
    multi_line = fields_span_lines(spark, path) if multi_line is None else multi_line
    raw = read_csv(spark, path, multi_line)
    require_columns(raw, mapping.text)
    named = drop_blank_reviews(mapping.apply(raw if line_ids is None else read_csv(spark, path, multi_line, line_ids)), TEXT)
    return named.withColumn(RATING, F.col(RATING).try_cast("double")) if RATING in named.columns else named
