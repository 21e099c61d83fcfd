"""Balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import staged

# Items of the differencing: at most BUNDLES sums of small groups, and HEAVY_PER_SHARD single groups a shard.
BUNDLES = 12_000
HEAVY_PER_SHARD = 200


def differencing(sizes: Sequence[int], shards: int) -> np.ndarray:
    """The shard of each item. Every item starts as a partition of its own with one filled part; the two partial
    partitions with the largest spread are combined, the largest part of one with the smallest of the other, until
    one is left. Ties go to the earlier item."""
    labels = np.zeros(len(sizes), np.int64)
    if not len(sizes) or shards < 2:
        return labels
    # A partial partition: its sums in descending order, and for each part the chain of items in it.
    heap = []
    for i, size in enumerate(int(s) for s in sizes):
        heap.append((-size, i, [size] + [0] * (shards - 1), [[i]] + [[] for _ in range(shards - 1)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, sums, parts = heapq.heappop(heap)
        _, j, other_sums, other_parts = heapq.heappop(heap)
        merged = []
        for s, p, t, q in zip(sums, parts, reversed(other_sums), reversed(other_parts)):
            large, small = (p, q) if len(p) >= len(q) else (q, p)
            large.extend(small)
            merged.append((s + t, large))
        merged.sort(key=lambda x: -x[0])
        sums, parts = [s for s, _ in merged], [p for _, p in merged]
        heapq.heappush(heap, (sums[-1] - sums[0], min(i, j), sums, parts))
    for shard, part in enumerate(heap[0][3]):
        labels[part] = shard
    return labels


def assign_shards(rows: DataFrame, *, group: str, size: str, shards: int) -> DataFrame:
    """`rows` with `shard` (int, from 0): equal values of `group` share a shard, and the sums of `size` are near equal.

    A group larger than 1/HEAVY_PER_SHARD of a shard is an item of its own; there are at most shards x HEAVY_PER_SHARD
    of them. All other groups are summed into BUNDLES bundles by hash. The differencing therefore sees a bounded
    number of items at any input size, and a bundle shrinks relative to a shard as its groups do. Rows are
    never shuffled: both item tables are bounded and broadcast. Null is a group; sizes must not be null. `rows` is read three
    times, so it should be a stored table.
    """
    spark = rows.sparkSession
    key, amount = F.col(group), F.col(size)
    total = rows.agg(F.coalesce(F.sum(amount), F.lit(0)).alias("t")).first()["t"]
    groups = rows.groupBy(key.alias("_g")).agg(F.sum(amount).alias("_s"))
    bundle = F.pmod(F.xxhash64("_g"), F.lit(BUNDLES))
    heavy = F.col("_s") > F.lit(total / (shards * HEAVY_PER_SHARD))
    items = (groups.groupBy(F.when(heavy, F.col("_g")).alias("_g"), F.when(heavy, -1).otherwise(bundle).cast("long").alias("_b"))
             .agg(F.sum("_s").alias("_s")).orderBy("_b", "_g").toPandas())
    items["shard"] = differencing(items["_s"].tolist(), shards).astype("int32")
    single, bundled = items[items["_b"] < 0], items[items["_b"] >= 0]
    group_type = rows.schema[group].dataType.simpleString()
    singles = spark.createDataFrame(single[["_g", "shard"]].rename(columns={"_g": "_hg", "shard": "_hs"}),
                                    f"_hg {group_type}, _hs int") if len(single) else None
    bundles = spark.createDataFrame(bundled[["_b", "shard"]].rename(columns={"shard": "_bs"}), "_b long, _bs int") \
        if len(bundled) else spark.createDataFrame([], "_b long, _bs int")
    placed = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(BUNDLES))).join(F.broadcast(bundles), "_b", "left")
    if singles is None:
        return placed.withColumn("shard", F.col("_bs")).drop("_b", "_bs")
    placed = placed.join(F.broadcast(singles), key.eqNullSafe(F.col("_hg")), "left")
    return placed.withColumn("shard", F.coalesce("_hs", "_bs")).drop("_b", "_bs", "_hg", "_hs")


def add_slots(rows: DataFrame, order: str) -> DataFrame:
    """`slot` (long): the place in the shard, gapless from 0. Each shard is numbered in many buckets: counts per bucket,
    their prefix sums, then the place in the bucket."""
    from pyspark.sql import Window
    count = rows.count()
    buckets = max(1, int(count ** 0.5))
    dealt = rows.withColumn("_k", F.pmod(F.xxhash64(order), F.lit(buckets)))
    ahead = Window.partitionBy("shard").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    bases = (dealt.groupBy("shard", "_k").agg(F.count("*").alias("_n"))
             .withColumn("_base", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n"))
    place = F.row_number().over(Window.partitionBy("shard", "_k").orderBy(order))
    return (dealt.withColumn("_r", place).join(bases, ["shard", "_k"])
            .withColumn("slot", F.col("_base") + F.col("_r") - 1).drop("_k", "_r", "_base"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    Equal texts stay together; a null text counts as empty. Rows repeated in `docs` are kept apart, each with a slot of
    its own. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                        F.unhex(F.md5(text)).alias("text_key"))
    placed = assign_shards(staged(keyed, "sharding"), group="text_key", size="size", shards=shards)
    return (add_slots(placed.drop("text_key"), "doc_id").withColumn("law", F.lit("bytes"))
            .withColumn("grown_shard", F.lit(None).cast("int"))
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents as one folder per shard (`shard=…`), in as many files as their size asks for."""
    (docs.join(placed.select("doc_id", "shard", "slot"), "doc_id").hint("rebalance", "shard")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
