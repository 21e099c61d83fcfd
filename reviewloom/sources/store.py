"""Analysed datasets as Parquet tables, partitioned by dataset.

Reviews and their aspects belong together, so both are written into folders of one run, and the run counts from the moment its
marker is there: an empty file, created at once. Readers follow the markers: of each dataset they see what the last marked run
wrote, in both tables, or nothing of a run that ended early.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from reviewloom.functions.text import join_list, split_list
from reviewloom.operators.cleaning import with_review_ids
from reviewloom.schema import ANALYZED_REVIEWS, ANSWERS, DATE, RATING, REVIEW_ASPECTS, STRATEGY, TEXT, require_columns
from reviewloom.sources.workspace import create_marker, fresh_path, names_in, path_exists, remove_path

PARTITION, RUN, MARKERS = "dataset_id=", "run=", "committed"
NO_DATASET = "__HIVE_DEFAULT_PARTITION__"  # fixed value: Spark's name for rows without a partition value


def _dataset_of(folder: str) -> str | None:
    name = unquote(folder.removeprefix(PARTITION))
    return None if name == NO_DATASET else name


class ReviewStore:
    """Three tables under one folder: reviews, their aspects as rows, and the strategies; and the answers strategies are made of.

    Saving replaces exactly the datasets it writes, so saving twice leaves one copy.
    """

    TABLES: dict[str, StructType] = {
        "analyzed_reviews": ANALYZED_REVIEWS, "review_aspects": REVIEW_ASPECTS, "strategy": STRATEGY}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table_path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def create_tables(self, database: str = "default") -> None:
        """Declare the tables in the catalog, so that SQL can name them. Repeating it finds new and replaced datasets."""
        current = self._current()
        for table, schema in self.TABLES.items():
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
            quoted = lambda text: text.replace("\\", "\\\\").replace("'", "\\'")
            name = f"{database}.{table}"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (dataset_id) "
                           f"LOCATION '{quoted(self.table_path(table))}'")
            if table == "strategy":
                if path_exists(self.spark, self.table_path(table)):
                    self.spark.sql(f"MSCK REPAIR TABLE {name}")
                continue
            for folder, run in current.items():
                dataset = _dataset_of(folder)
                spec = f"PARTITION (dataset_id = {'NULL' if dataset is None else chr(39) + quoted(dataset) + chr(39)})"
                place = quoted(f"{self.table_path(table)}/{run}/{folder}")
                self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {spec} LOCATION '{place}'")
                self.spark.sql(f"ALTER TABLE {name} {spec} SET LOCATION '{place}'")

    def _current(self) -> dict[str, str]:
        """Folder of each dataset and the run folder it counts in, from names of files and folders alone."""
        out: dict[str, str] = {}
        for marker in names_in(self.spark, f"{self.folder}/{MARKERS}"):
            run = RUN + marker.split("-", 1)[1]
            for folder in names_in(self.spark, f"{self.table_path('analyzed_reviews')}/{run}"):
                if folder.startswith(PARTITION):
                    out[folder] = run
        return out

    def _datasets(self) -> list[str | None]:
        return [_dataset_of(folder) for folder in self._current()]

    def _read(self, table: str, dataset_id: str | None = None) -> DataFrame:
        """The rows that count of a table of runs, of all datasets or of one."""
        path, schema = self.table_path(table), self.TABLES[table]
        folders = [f"{path}/{run}/{folder}" for folder, run in self._current().items()
                   if dataset_id is None or _dataset_of(folder) == dataset_id]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)

    def _write(self, df: DataFrame, table: str, path: str) -> None:
        """Replace the datasets in `df`. What does not fit a column's type becomes null."""
        columns = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in self.TABLES[table].fields]
        df.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)

    def save_analysis(self, df: DataFrame, dataset_id: str | None = None) -> None:
        """Store analysed reviews under `dataset_id`, or each under the value of its own `dataset_id` column.

        The text is analysed once, on the way to the reviews of this run; their aspects are made of the reviews as written, so
        a save never reads what was stored before. Readers see both tables of the run or neither, even if it ends half way.
        Ids that are no numbers are kept as `source_id`, and the rows get ids of their own, which are stored before anything
        is shuffled by them. Rows of several datasets are gathered per dataset first, in pieces of even size however large one
        dataset is.
        """
        require_columns(df, TEXT, "sentiment", "confidence", "aspects")
        if dataset_id is not None:
            df = df.withColumn("dataset_id", F.lit(dataset_id))
        require_columns(df, "dataset_id")
        if "review_id" in df.columns and not isinstance(df.schema["review_id"].dataType, IntegralType):
            df = df.drop("source_id").withColumnRenamed("review_id", "source_id")
        numbered, df = "review_id" in df.columns, with_review_ids(df)
        for optional in ("clean_deep", RATING, DATE, "source_id"):
            if optional not in df.columns:
                df = df.withColumn(optional, F.lit(None).cast("string"))
        names = [f.name for f in ANALYZED_REVIEWS.fields]
        stage, run = fresh_path(self.spark, "save"), uuid.uuid4().hex
        rows = df.withColumn("aspects", F.coalesce(join_list(F.col("aspects")), F.lit(""))).select(*names)
        if not numbered:
            rows.write.parquet(stage)
            rows = self.spark.read.schema(rows.schema).parquet(stage)
        even = (lambda part: part) if dataset_id is not None else (lambda part: part.hint("rebalance", F.col("dataset_id")))
        path = f"{self.table_path('analyzed_reviews')}/{RUN}{run}"
        self._write(even(rows), "analyzed_reviews", path)
        written = self.spark.read.schema(ANALYZED_REVIEWS).parquet(path)
        # A review without aspects keeps a row with a null aspect, so that every dataset of a run stands in both tables.
        children = written.select("dataset_id", "review_id", "sentiment", F.explode_outer(split_list(F.col("aspects"))).alias("aspect"))
        self._write(even(children), "review_aspects", f"{self.table_path('review_aspects')}/{RUN}{run}")
        self._commit(run)
        remove_path(self.spark, stage)

    def _commit(self, run: str) -> None:
        """Let a run count, after all runs that count now."""
        last = names_in(self.spark, f"{self.folder}/{MARKERS}")[-1:] or ["0-"]
        create_marker(self.spark, f"{self.folder}/{MARKERS}/{int(last[0].split('-')[0]) + 1:012d}-{run}")

    def remove_replaced(self) -> int:
        """Remove the datasets of marked runs that a later run has replaced, and return how many. Jobs that began to read them fail."""
        current, removed = self._current(), 0
        for marker in names_in(self.spark, f"{self.folder}/{MARKERS}"):
            run = RUN + marker.split("-", 1)[1]
            for folder in names_in(self.spark, f"{self.table_path('analyzed_reviews')}/{run}"):
                if folder.startswith(PARTITION) and current[folder] != run:
                    for table in ("analyzed_reviews", "review_aspects"):
                        remove_path(self.spark, f"{self.table_path(table)}/{run}/{folder}")
                    removed += 1
        return removed

    def reviews(self, dataset_id: str | None = None) -> DataFrame:
        """Stored reviews with `aspects` as a list."""
        df = self._read("analyzed_reviews", dataset_id).withColumn("aspects", split_list(F.col("aspects")))
        return df if dataset_id is None else df.where(F.col("dataset_id") == dataset_id)

    def load_analysis(self, dataset_id: str) -> DataFrame:
        """One dataset in id order."""
        return self.reviews(dataset_id).orderBy("review_id")

    def aspects(self, dataset_id: str | None = None) -> DataFrame:
        """Stored (review, aspect) rows."""
        df = self._read("review_aspects", dataset_id).where(F.col("aspect").isNotNull())
        return df if dataset_id is None else df.where(F.col("dataset_id") == dataset_id)

    def dataset_exists(self, dataset_id: str) -> bool:
        """Whether a dataset is stored; reads names of folders only."""
        return dataset_id is not None and dataset_id in self._datasets()

    def list_datasets(self) -> DataFrame:
        """The stored datasets, in order; reads names of folders only."""
        return self.spark.createDataFrame([(name,) for name in self._datasets()], "dataset_id string").orderBy("dataset_id")

    def answers(self) -> DataFrame:
        """The answers of strategy writers, by the digest of the prompt and the writer's name."""
        path = self.table_path("answers")
        return self.spark.read.schema(ANSWERS).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], ANSWERS)

    def save_answers(self, answers: DataFrame) -> None:
        """Add answers to those stored before."""
        answers.select(*ANSWERS.names).write.mode("append").parquet(self.table_path("answers"))

    def save_strategies(self, answers: DataFrame) -> None:
        """Insert or replace strategies `(dataset_id, strategy_json[, created_at])`; the latest per dataset wins."""
        stamped = answers if "created_at" in answers.columns else answers.withColumn("created_at", F.current_timestamp())
        self._write(latest_strategies(stamped), "strategy", self.table_path("strategy"))

    def strategies(self) -> DataFrame:
        path = self.table_path("strategy")
        return self.spark.read.schema(STRATEGY).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], STRATEGY)

    def load_strategy(self, dataset_id: str) -> str | None:
        row = self.strategies().where(F.col("dataset_id") == dataset_id).select("strategy_json").first()
        return None if row is None else row["strategy_json"]


def latest_strategies(answers: DataFrame) -> DataFrame:
    """The latest answer per dataset: a map-side combined maximum, not a sort of each dataset's history."""
    newest = F.max(F.struct("created_at", "strategy_json")).alias("newest")
    return answers.groupBy("dataset_id").agg(newest).select(
        "dataset_id", "newest.strategy_json", "newest.created_at")
