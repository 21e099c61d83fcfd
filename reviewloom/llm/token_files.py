"""Token ids as compressed files: documents in ascending doc_id order, in independent blocks of `rans`.

A folder holds three Parquet containers, so that any file system Spark reaches will do and a write is committed as a whole:
`table` (symbol, frequency, bits), one row per symbol; `blocks` (part, local_start, doc_ids, lengths, payload), one row per block of
whole documents, in order of part and local_start; `parts` (part, base), the ids before each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewloom.llm import rans
from reviewloom.llm.common import staged
from reviewloom.llm.packing import part_bases
from reviewloom.llm.tokens import id_type, tokenize_and_count

BLOCK = 1 << 20  # a block ends with the document that reaches so many ids


def symbol_counts(rows: DataFrame, vocabulary_size: int) -> np.ndarray:
    """How often each symbol occurs, from the tasks' counts: one number per symbol reaches the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size, np.uint64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                total += np.frombuffer(counts, np.uint64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], names=["symbol", "n"])

    found = rows.select("ids").mapInArrow(add, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary_size, np.int64)
    out[found["symbol"].to_numpy(np.int64)] = found["n"]
    return out


def _encoder(table: rans.Table, doc_type: pa.DataType, kind: str):
    """Blocks of whole documents, of (doc_id, n_tokens, ids) in order; a task is a part."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held, waiting = TaskContext.get().partitionId(), 0, 0, []

        def block() -> pa.RecordBatch:
            docs, lengths = (pa.concat_arrays([w[c] for w in waiting]) for c in (0, 1))
            payload = rans.encode(np.concatenate([w[2] for w in waiting]), table)
            whole = [pa.array([0, len(docs)], pa.int32())]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.ListArray.from_arrays(*whole, docs),
                 pa.ListArray.from_arrays(*whole, lengths), pa.array([payload], pa.binary())],
                names=["part", "local_start", "doc_ids", "lengths", "payload"])

        for batch in batches:
            ends, at = np.cumsum(batch.column(1).to_numpy()), 0
            while at < batch.num_rows:
                # Up to the document with which the block is full.
                done = int(ends[at - 1]) if at else 0
                upto = min(batch.num_rows, int(np.searchsorted(ends, done + BLOCK - held, side="left")) + 1)
                some = batch.slice(at, upto - at)
                waiting.append((some.column(0), some.column(1), np.frombuffer(b"".join(some.column(2).to_pylist()), kind)))
                held, at = held + int(ends[upto - 1]) - done, upto
                if held >= BLOCK:
                    yield block()
                    start, held, waiting = start + held, 0, []
        if waiting:
            yield block()

    return encode


def write_tokens(docs: DataFrame, vocabulary: str, path: str, *, vocabulary_size: int, end_id: int) -> None:
    """Encode every text (null: empty), append `end_id`, and write the folder described above.

    Texts become ids, counted at once, before anything is shuffled; the ids are then range-partitioned by doc_id, nulls first, rows
    with one doc_id by their number of ids and their content, and each range is one part. The frequency table comes from the
    ids of all documents. It has `vocabulary_size` rows at most and is the only thing that passes through the driver.
    """
    spark = docs.sparkSession
    stored = staged(tokenize_and_count(docs, vocabulary, end_id, vocabulary_size), "token-ids")
    table = rans.scaled(symbol_counts(stored.filter("n_tokens < 0"), vocabulary_size))
    rows = [(int(s), int(table.frequency[s]), table.bits) for s in np.flatnonzero(table.frequency)]
    spark.createDataFrame(rows, "symbol int, frequency long, bits int").coalesce(1).write.parquet(f"{path}/table")
    kind, order = docs.schema["doc_id"].dataType, ["doc_id", "n_tokens", "_content"]
    ordered = (stored.filter("n_tokens >= 0").withColumn("_content", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order)
               .select("doc_id", "n_tokens", "ids"))
    blocks = ordered.mapInArrow(_encoder(table, to_arrow_type(kind), id_type(vocabulary_size)),
                                f"part int, local_start long, doc_ids array<{kind.simpleString()}>, lengths array<long>, payload binary")
    blocks.write.option("compression", "snappy").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").select("part", F.explode("lengths").alias("n_tokens"))
    part_bases(sizes).select("part", "base").coalesce(1).write.parquet(f"{path}/parts")


def read_table(spark: SparkSession, path: str, vocabulary_size: int) -> rans.Table:
    rows = spark.read.parquet(f"{path}/table").toPandas()
    frequency = np.zeros(vocabulary_size, np.int64)
    frequency[rows["symbol"]] = rows["frequency"]
    return rans.Table(frequency, int(rows["bits"].iloc[0]) if len(rows) else 16)


def read_tokens(spark: SparkSession, path: str, *, vocabulary_size: int) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, decoded from the files alone.
    A block whose checksum or end does not fit raises ValueError."""
    table = read_table(spark, path, vocabulary_size)
    blocks = spark.read.parquet(f"{path}/blocks")
    doc_type = blocks.schema["doc_ids"].dataType.elementType
    bases = F.broadcast(spark.read.parquet(f"{path}/parts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                lengths = one.column(2).flatten().to_numpy()
                ids = rans.decode(one.column(3)[0].as_py(), table).astype("<u4")
                ends = np.cumsum(lengths)
                if (int(ends[-1]) if len(ends) else 0) != len(ids):
                    raise ValueError("the directory of a block does not fit its ids")
                raw, starts = memoryview(ids).cast("B"), ends - lengths
                ids_of = [bytes(raw[s * 4: e * 4]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [one.column(1).flatten(), pa.array(starts + one.column(0)[0].as_py()), pa.array(lengths), pa.array(ids_of, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(bases, "part").select((F.col("local_start") + F.col("base")).alias("start"), "doc_ids", "lengths", "payload")
    return placed.mapInArrow(decode, f"doc_id {doc_type.simpleString()}, start long, n_tokens long, ids binary")
