"""Concatenate-and-cut packing of token ids into fixed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import staged
from reviewloom.llm.tokens import tokenize


def part_bases(stored: DataFrame) -> DataFrame:
    """part, tokens, base (tokens of all earlier parts): one row per part, so the prefix sum over parts is small."""
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (stored.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
            .withColumn("base", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))))


def boundary_records(stored: DataFrame, length: int = 2048) -> DataFrame:
    """How each part meets its neighbours: part, base, tokens, `window` (the first one it gives ids to), `opened` (the ids earlier
    parts gave to that window), the ids the part gives to it to complete it (`head`), the whole windows it holds (`whole`), and
    the ids of the window it leaves open (`tail`). One row per part."""
    bases = part_bases(stored)
    head = F.least(F.col("tokens"), F.pmod(-F.col("base"), F.lit(length)))
    rest = F.col("tokens") - head
    return bases.select("part", "base", "tokens", F.floor(F.col("base") / length).alias("window"), (F.col("base") % length).alias("opened"),
                        head.alias("head"), F.floor(rest / length).alias("whole"), (rest % length).alias("tail"))


def pack(stored: DataFrame, length: int = 2048) -> DataFrame:
    """The pieces of all documents, laid end to end and cut every `length` ids.

    `stored` is a stored table as `tokenize` makes it. First pass: token totals per part, their prefix sums, and from them a boundary
    record per part. Second pass: a document's place in the windows of its part follows from the record and from the ids before
    it in the part, and it is cut where it meets a window's edge. Windows are full but for the last one. Per piece: doc_id, start,
    length, ids, doc_tokens, sequence_id, offset. Documents without ids give no piece. The records are broadcast: one row per
    task of the first pass.
    """
    records = boundary_records(stored, length).select("part", "window", "opened")
    placed = stored.join(F.broadcast(records), "part").withColumn("_g", F.col("opened") + F.col("local_start"))
    end = F.col("_g") + F.col("n_tokens")

    def piece(window):
        first = F.greatest(F.col("_g"), window * length)
        size = F.least(end, (window + 1) * length) - first
        start = first - F.col("_g")
        return F.struct(start.alias("start"), size.alias("length"),
                        F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"),
                        (F.col("window") + window).alias("sequence_id"), (first - window * length).alias("offset"))

    windows = F.sequence(F.floor(F.col("_g") / length), F.floor((end - 1) / length))
    cut = placed.filter("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return cut.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids in order. A group holds at most one window of ids."""
    run = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(run.alias("_run")).select("sequence_id", F.aggregate(F.col("_run"), F.lit(b""), lambda have, p: F.concat(have, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, *, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of `docs` (doc_id, text). Null and empty texts give the end id alone; repeated rows are packed each."""
    return pack(staged(tokenize(docs, vocabulary, end_id), "packing"), length)
