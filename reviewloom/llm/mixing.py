"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import staged, word_total


def _everything():
    return Window.partitionBy(F.lit(0))


def source_targets(sizes: DataFrame, *, weights: Sequence[int], cap: int) -> DataFrame:
    """`sizes` (source, source_size) with `target`.

    Sources in order of code points, null last, take the weights in turn and share the sum of all sizes. A target above
    `cap` times its source stops there and the rest is shared anew. The sources that end up capped are those with the
    smallest size per weight, so one ordered pass finds the level: source i is capped if the share of weight that
    the earlier capped ones leave exceeds its cap. One row per source.
    """
    everything = _everything()
    named = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = (F.row_number().over(named) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    leveled = (sizes.withColumn("_w", weight).withColumn("_total", F.sum("source_size").over(everything))
               .withColumn("_cap", (F.col("source_size") * cap).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
               .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
               .withColumn("_place", F.row_number().over(by_ratio))
               .withColumn("_free", F.when(F.col("_level") <= F.col("_ratio"), F.col("_place"))))
    level = F.min_by("_level", "_free").over(everything)
    first_free = F.min("_free").over(everything)
    target = F.when(F.col("_place") >= first_free, level * F.col("_w")).otherwise(F.col("_cap"))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def sainte_lague(parties: DataFrame, *, within: Sequence[str], order: str, votes: str, seats: str, most: str) -> DataFrame:
    """`parties` with `quota`: the seats of each group `within` go to the highest quotients votes / (2k - 1), k = 1, 2, ..

    No party gets more than `most`. A divisor too large by half a seat per party gives every party seats that it has for
    certain; only the few quotients between that divisor and one too small are listed and ranked. Ties go by `order`.
    """
    group = Window.partitionBy(*[F.col(c) for c in within]) if within else _everything()
    n, all_votes = F.count("*").over(group), F.sum(votes).over(group)
    bounded = (parties.withColumn("_n", n).withColumn("_v", all_votes)
               .withColumn("_high", F.when(F.col(seats) > F.col("_n"), F.col("_v") / (F.col(seats) - F.col("_n"))))
               .withColumn("_low", F.col("_v") / (F.col(seats) + F.col("_n"))))
    share = lambda divisor: F.floor(F.col(votes) / F.nullif(divisor, F.lit(0.0)) + 0.5)
    sure = F.least(F.col(most), F.coalesce(share(F.col("_high")), F.lit(0)))
    bounded = (bounded.withColumn("_sure", sure.cast("long"))
               .withColumn("_upto", F.least(F.col(most), F.coalesce(share(F.col("_low")), F.lit(0))).cast("long"))
               .withColumn("_rest", F.col(seats) - F.sum("_sure").over(group)))
    listed = F.when(F.col("_upto") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_upto"))).otherwise(F.array(F.lit(None).cast("long")))
    named = bounded.withColumn("_k", F.explode(listed)).withColumn("_q", F.col(votes) / (2 * F.col("_k") - 1))
    best = (Window.partitionBy(*[F.col(c) for c in within]) if within else Window.partitionBy(F.lit(0))) \
        .orderBy(F.col("_q").desc_nulls_last(), order)
    won = F.col("_k").isNotNull() & (F.row_number().over(best) <= F.col("_rest"))
    return (named.withColumn("_won", won.cast("long")).groupBy(*parties.columns, "_sure").agg(F.sum("_won").alias("_more"))
            .withColumn("quota", F.col("_sure") + F.col("_more")).drop("_sure", "_more"))


def mix(rows: DataFrame, *, weights: Sequence[int] = (5, 2, 1), cap: int = 3, block: int = 256, seed: int = 17,
        keep: Sequence[str] = ()) -> DataFrame:
    """How many words a mix takes of every row of `rows` (doc_id, source, size): adds source_size, target and taken.

    The words of each source, in the order of a hash of doc_id, are cut into blocks of equal size (at most `block`, less
    where all sources together have under 100,000 blocks). Sainte-Lague gives each source its number of blocks, and each
    shard of a source its part of them; in a shard, every block is taken quota div n times and the blocks that come first
    in a seeded order once more. No block is taken more than `cap` times, so no row exceeds `cap` times its size.

    `keep` names columns that pass through. A source may hold any share of the rows: positions are sums over square-root-many buckets, so no task holds a source.
    Null sources form the last source. Rows of size 0 take 0. Equal rows are kept, each with its own words.
    """
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    base = staged(rows.select("doc_id", "source", F.col("size").cast("long").alias("size"), *keep).withColumn("_row", F.monotonically_increasing_id()), "mixing")
    found = base.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()
    buckets, length = max(1, math.isqrt(found["n"])), max(1, min(block, found["t"] // 100_000))
    dealt = base.withColumn("_key", key).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)))

    cells = dealt.groupBy("_key", "source", "_bucket").agg(F.sum("size").alias("_cell"))
    sources = source_targets(cells.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights=weights, cap=cap)
    held = (sources.withColumn("_key", key).withColumn("_blocks", F.ceil(F.col("source_size") / length))
            .withColumn("_most", F.col("_blocks") * cap).withColumn("_seats", F.lit(round(found["t"] / length))))
    quotas = staged(sainte_lague(held, within=[], order="_key", votes="target", seats="_seats", most="_most")
                    .withColumnRenamed("quota", "_quota"), "mixing-quotas")

    per_shard = F.ceil(F.sqrt("_blocks"))
    shards = (quotas.filter("_blocks > 0").select("_key", "_quota", "_blocks", per_shard.alias("_per"))
              .withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_blocks") - 1) / F.col("_per")))))
              .withColumn("_in", F.least(F.col("_per"), F.col("_blocks") - F.col("_shard") * F.col("_per")))
              .withColumn("_shard_most", F.col("_in") * cap))
    dealt_seats = sainte_lague(shards, within=["_key"], order="_shard", votes="_in", seats="_quota", most="_shard_most")
    first = F.col("_shard") * F.col("_per")
    seeded = Window.partitionBy("_key", "_shard").orderBy(F.xxhash64(F.lit(seed), "_key", "_block"), "_block")
    blocks = (dealt_seats.withColumn("_block", F.explode(F.sequence(first, first + F.col("_in") - 1)))
              .withColumn("_place", F.row_number().over(seeded))
              .select("_key", "_block", (F.floor(F.col("quota") / F.col("_in")) + (F.col("_place") <= F.col("quota") % F.col("_in")).cast("long")).alias("_times")))

    ahead = Window.unboundedPreceding, -1
    in_source = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(*ahead)
    in_cell = Window.partitionBy("_key", "_bucket").orderBy("doc_id", "size", "_row").rowsBetween(*ahead)
    starts = (cells.withColumn("_base", F.coalesce(F.sum("_cell").over(in_source), F.lit(0)))
              .join(quotas.select("_key", "source_size", "target"), "_key").select("_key", "_bucket", "_base", "source_size", "target"))
    placed = (dealt.withColumn("_local", F.coalesce(F.sum("size").over(in_cell), F.lit(0))).join(starts, ["_key", "_bucket"])
              .withColumn("_start", F.col("_base") + F.col("_local")).withColumn("_end", F.col("_start") + F.col("size")))
    covered = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("_start") / length), F.floor((F.col("_end") - 1) / length)))
    kept = ["_row", "doc_id", "source", "size", "source_size", "target", *keep]
    pieces = placed.select(*kept, "_key", "_start", "_end", F.explode(F.coalesce(covered, F.array(F.lit(None).cast("long")))).alias("_block"))
    overlap = F.least(F.col("_end"), (F.col("_block") + 1) * length) - F.greatest(F.col("_start"), F.col("_block") * length)
    # Blocks grow with the words, though they are made from a few rows: without the hint they would look small.
    return (pieces.join(blocks.hint("merge"), ["_key", "_block"], "left").groupBy(*kept)
            .agg(F.coalesce(F.sum(overlap * F.col("_times")), F.lit(0)).cast("long").alias("taken")).drop("_row"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document; a null text has size 0. Other columns are not read."""
    sized = docs.select("doc_id", "source", word_total(F.col("text")).alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def draw(docs: DataFrame, *, seed: int = 17) -> DataFrame:
    """The mix as documents: each row repeated so often that its words come near those the mix takes of it.

    taken / size copies, the fraction decided by a hash of doc_id; texts stay whole. Rows without words stay as they are,
    since they take no part in any quota. The columns of `docs` are kept.
    """
    kept = staged(docs.select("doc_id", "source", word_total(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("_doc"),
                              F.struct(*[F.col(c) for c in docs.columns]).alias("_own")), "mixing-draw")
    shares = mix(kept.select("doc_id", "source", "size", "_doc"), seed=seed, keep=["_doc"])
    ratio = F.col("taken") / F.nullif(F.col("size"), F.lit(0))
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.coalesce(F.floor(ratio) + (chance < ratio - F.floor(ratio)).cast("int"), F.lit(1))
    times = shares.select("_doc", copies.cast("int").alias("_times")).filter("_times > 0")
    return (kept.join(times, "_doc").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_own.*"))
