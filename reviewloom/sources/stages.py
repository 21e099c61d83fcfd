"""Stage tables between batch steps, and JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TOGETHER = "_together"


def write_stage(df: DataFrame, path: str, together: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    """Write a stage and return it as stored: later steps read files and do not repeat the work.

    Strings of `together` that nearly repeat each other in a row, as a text and its cleaned forms do, are stored side by side
    in one column, where the codec finds the repeats; `read_stage` gives them back as columns.
    """
    side = [c for c in together if c in df.columns]
    if len(side) > 1:
        joined = F.array(*side).alias(TOGETHER, metadata={"columns": df.columns, "together": side})
        df = df.select(*[c for c in df.columns if c not in side], joined)
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return read_stage(df.sparkSession, path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if TOGETHER not in df.columns:
        return df
    stored = df.schema[TOGETHER].metadata
    return df.select(*[F.get(TOGETHER, F.lit(stored["together"].index(c))).alias(c) if c in stored["together"] else c for c in stored["columns"]])


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
