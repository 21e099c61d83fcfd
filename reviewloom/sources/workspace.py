"""Where jobs may write intermediate tables, and small file-system questions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_base: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only when Spark runs in a single process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_base:
        _local_base[app] = tempfile.mkdtemp(prefix="reviewloom-")
    return _local_base[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_folder(spark).rstrip('/')}/reviewloom/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_staged(spark: SparkSession) -> int:
    """Remove everything this application wrote to paths of `fresh_path`, and return how many paths that were. Results that
    were not stored elsewhere can no longer be read."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove_path(spark, path)
    return len(paths)


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as that file system takes it."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on any file system Spark can read."""
    files, hadoop_path = _file_system(spark, path)
    found = files.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, in order; none if there is no such folder."""
    files, hadoop_path = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(hadoop_path)) if files.exists(hadoop_path) else []


def create_marker(spark: SparkSession, path: str) -> None:
    """An empty file that must not be there yet."""
    files, hadoop_path = _file_system(spark, path)
    files.create(hadoop_path, False).close()


def remove_path(spark: SparkSession, path: str) -> None:
    files, hadoop_path = _file_system(spark, path)
    files.delete(hadoop_path, True)


def replace_path(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to where another may stand."""
    files, hadoop_path = _file_system(spark, target)
    files.delete(hadoop_path, True)
    if not files.rename(_file_system(spark, source)[1], hadoop_path):
        raise OSError(f"{source} could not be moved to {target}")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables made and evaluated inside, once each, leave no shuffle files; else those stay until the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def read_table(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """A Parquet table as it is stored. How it is split is the scan's business (`spark.sql.files.maxPartitionBytes`); a row group
    is never split. `tasks` deals the rows into so many tasks by a shuffle, for small files of a single row group."""
    df = spark.read.parquet(path)
    return df if tasks is None else df.repartition(tasks)
