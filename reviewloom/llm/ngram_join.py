"""Similarity join of documents by n-gram Jaccard, bounded by an R-tree over vectors of group counts.

Every set of shingles is also a point: its tokens hashed into groups, and the count of each group. Two sets share at most the
sum of the smaller counts, which bounds a whole node of the tree at once (`count_tree`). One tree over a corpus would be
searched by every document, so the points are routed first: two similar sets must meet in one of their first n - needed + 1
tokens, in any order of tokens that both use. Tokens that a sample finds frequent come last in that order, so that passages many
documents share do not route. Points that meet in a token are linked in steps that are exact together:

1. equal sets are linked by a digest, and every point is bounded against the smallest one of its bucket (a star, linear in the bucket);
2. what these bounds connect is a family; a family's sets are brought together once, and its links found on them;
3. buckets that hold several families are joined by trees, in blocks, and only across families. A block names each point that may be
   similar to one of another family once, with the first point that such pairs connect it to;
4. what these pairs connect is brought together and linked as in step 2.

A block, which may be one of several that a large bucket or family is dealt into, gives fewer rows than it has points: links that
close a circle are left out, and pairs that links connect already are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import staged
from reviewloom.llm.components import connected_components
from reviewloom.llm.count_tree import coarse_counts, forest, group_counts, needed, packed, shared_bound, spanning, unpacked
from reviewloom.llm.shingles import mixed, shingle_sets
from reviewloom.llm.token_counts import slices

SAMPLE = 32        # one document in so many is looked at for frequent tokens, which only settles the order of tokens
FREQUENT = 3       # times a frequent token occurs in the sample
MARKS = 26         # frequent tokens are marked in a bitmap of 2 ** MARKS bits, by their leading bits
BLOCK = 2_000      # points of a bucket in one block of the tree join
FAMILY = 250_000   # tokens of all sets in one block of a family, about


def _longs(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """node, n, tokens (sorted distinct shingle hashes) of each document."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                found = shingle_sets(some.column(1), width)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(f) for f in found], pa.int64()), _lists([_longs(f) for f in found])],
                                                 names=["node", "n", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(sets, "node long, n long, tokens array<long>")


def frequent_tokens(docs: DataFrame, width: int) -> np.ndarray:
    """A bitmap of fixed size that marks the tokens a sample finds frequent. A rare token that shares a mark counts as frequent too,
    in all documents alike."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counted = shingled(sample, width).select(F.explode("tokens").alias("t")).groupBy("t").count().filter(F.col("count") >= FREQUENT)
    place = f"shiftrightunsigned(t, {64 - MARKS})"
    marks = (counted.select(F.expr(f"cast({place} >> 6 AS int)").alias("at"), F.expr(f"shiftleft(1L, cast({place} & 63 AS int))").alias("bit"))
             .groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas())
    bitmap = np.zeros(1 << (MARKS - 6), np.int64)
    bitmap[marks["at"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64)
    return bitmap.view(np.uint8)


def marked(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    place = (tokens >> np.uint64(64 - MARKS)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _whole(tokens: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return np.array([mixed(tokens + np.uint64(1)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(tokens ^ np.uint64(0x5555)))], np.uint64).tobytes()


def points(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, counts, coarse (counts in fewer groups) and whole (a digest) of each document's set, and rare, common: the tokens of its prefix, frequent ones apart."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                found = shingle_sets(some.column(1), width)
                rare, common = [], []
                for tokens in found:
                    length = len(tokens) - (-(-percent * len(tokens) // 100)) + (len(tokens) > 0)
                    hot = marked(tokens, shared.value)
                    first = tokens[~hot][:length]
                    rare.append(_longs(first))
                    common.append(_longs(tokens[hot][: length - len(first)]))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([packed(group_counts(f)) for f in found], pa.binary()),
                     pa.array([packed(coarse_counts(f)) for f in found], pa.binary()), pa.array([_whole(f) for f in found], pa.binary()), _lists(rare), _lists(common)],
                    names=["doc_id", "n", "counts", "coarse", "whole", "rare", "common"])

    return docs.select("doc_id", "text").mapInArrow(route, "doc_id long, n long, counts binary, coarse binary, whole binary, rare array<long>, common array<long>")


def _meetings(routed: DataFrame) -> DataFrame:
    """token, node, n, leader (node, n) for all tokens that two or more nodes have in their prefix."""
    some = routed.filter(F.col("doc_id").isNotNull())
    rows = lambda c: some.select(F.col("doc_id").alias("node"), "n", F.explode(c).alias("token"))
    leader = F.min(F.struct("node", "n"))
    bucket = Window.partitionBy("token")
    rare = (rows("rare").withColumn("leader", leader.over(bucket)).withColumn("last", F.max("node").over(bucket))
            .filter("leader.node <> last").select("token", "node", "n", "leader"))
    # Buckets of frequent tokens can be of any size: minima are combined before the shuffle, and the join may be split.
    common = rows("common")
    least = common.groupBy("token").agg(leader.alias("leader"), F.max("node").alias("last")).filter("leader.node <> last").drop("last")
    return rare.unionByName(common.join(least, "token").select("token", "node", "n", "leader"))


def _copies(routed: DataFrame) -> DataFrame:
    """a, b: every node with the smallest node that has the same set."""
    some = routed.filter("doc_id IS NOT NULL AND n > 0").select(F.col("doc_id").alias("a"), "whole")
    first = some.groupBy("whole").agg(F.min("a").alias("b"), F.max("a").alias("last")).filter("b <> last").drop("last")
    return some.join(first, "whole").filter("a <> b").select("a", "b").distinct()


def _bounded(stars: DataFrame, routed: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs whose counts allow enough shared tokens."""
    one, two = (routed.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("counts").alias(f"c{s}")) for s in "ab")
    pairs = stars.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ca", "cb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = needed(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            read = (unpacked(x.as_py()) for c in (4, 5) for x in batch.column(c))
            counts = list(read)
            good = pa.array([shared_bound(x, y) >= n for x, y, n in zip(counts[: batch.num_rows], counts[batch.num_rows:], least.tolist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(keep, "a long, b long").distinct()


def _family_links(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links that connect the similar sets of each family. `members` (family, node, label, settled) are stored: what `label` joins is
    connected already, pairs with one value of `settled` have been compared.

    A family's sets, made again from the texts, meet in blocks of about FAMILY tokens: in one, or in every two.
    """
    nodes = members.select("node").distinct()
    sets = staged(shingled(docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi"), width).filter("n > 0"), "sets")
    blocks = (members.join(sets.select("node", "n"), "node").groupBy("family").agg(F.sum("n").alias("tokens"))
              .select("family", F.ceil(F.col("tokens") / FAMILY).cast("int").alias("blocks")))
    rows = (members.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, 3):
            nodes, labels, settled = (held.column(c).to_numpy() for c in ("node", "label", "settled"))
            tokens = held.column("tokens").combine_chunks()
            flat, ends = tokens.flatten().to_numpy().view(np.uint64), np.cumsum(held.column("n").to_numpy())
            links = np.array(forest(np.split(flat, ends[:-1]), settled, labels, percent), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[links].max(axis=1)), pa.array(nodes[links].min(axis=1))], names=["a", "b"])

    keys = ["family", "i", "j"]
    dealt = rows.select(*keys, "node", "label", "settled").join(sets, "node").select(*keys, "node", "label", "settled", "n", "tokens")
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(connect, "a long, b long").filter("a <> b").distinct()


def _across_families(meetings: DataFrame, families: DataFrame, copies: DataFrame, routed: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that may be similar, from buckets that hold more than one family, by their trees. Copies stand for nothing new."""
    labeled = (meetings.join(copies.select(F.col("a").alias("node")), "node", "left_anti").join(families, "node", "left")
               .select("token", "node", F.coalesce("family", "node").alias("label")))
    state = labeled.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("c"),
                                         F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 20)).alias("y"))
    # Tokens of one passage often have the same members; one of them is enough.
    open_tokens = (state.filter("l <> h").groupBy("c", "x", "y").agg(F.min("token").alias("token")).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
                   .select("token", "blocks"))
    rows = (labeled.join(open_tokens, "token").join(routed.select(F.col("doc_id").alias("node"), "n", F.col("coarse").alias("counts")), "node")
            .withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("token", "node", "label", "n", "counts", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, 3):
            nodes, sizes, labels = (held.column(c).to_numpy() for c in ("node", "n", "label"))
            found = np.array(spanning([unpacked(c) for c in held.column("counts").to_pylist()], sizes, labels, percent), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[found].max(axis=1)), pa.array(nodes[found].min(axis=1))], names=["a", "b"])

    keys = ["token", "i", "j"]
    dealt = rows.select(*keys, "node", "label", "n", "counts").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(join, "a long, b long").filter("a <> b").distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns (numbers), of sorted batches."""
    rest: pa.Table | None = None
    for batch in batches:
        here = pa.Table.from_batches([batch])
        here = pa.concat_tables([rest, here]).combine_chunks() if rest is not None else here
        columns = [here.column(k).to_numpy() for k in range(keys)]
        changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        cuts = [0, *changes.tolist()]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            yield here.slice(begin, end - begin)
        rest = here.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def similar_documents(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text).

    Words are runs of anything but the six ASCII white-space characters, A-Z in lower case. Two documents link when 100 * shared
    shingles >= `percent` * all their shingles; component_id is the smallest doc_id that links reach. Null, empty and blank
    texts have no shingles and no links. Rows with one doc_id count as one document for links; each keeps its own count.
    Rows without doc_id have no links and a null component. Shingles are told apart by 64-bit hashes.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    routed = staged(points(own, width, percent, frequent_tokens(own, width)), "points")
    meetings = staged(_meetings(routed), "meetings")
    near = (100 * F.col("n") >= percent * F.col("leader.n")) & (100 * F.col("leader.n") >= percent * F.col("n"))
    stars = meetings.filter(near & (F.col("node") != F.col("leader.node"))).select(F.col("node").alias("a"), F.col("leader.node").alias("b")).distinct()
    copies = staged(_copies(routed), "copies")
    families = staged(connected_components(staged(_bounded(stars, routed, percent), "bounded").unionByName(copies)).withColumnRenamed("component", "family"), "families")
    one_each = families.join(copies.select(F.col("a").alias("node")), "node", "left_anti")
    members = staged(one_each.withColumns({"label": F.col("node"), "settled": F.col("node")}), "members")
    links = staged(_family_links(members, own, width, percent).unionByName(copies), "family-links")
    labels = staged(connected_components(links), "labels")
    across = connected_components(_across_families(meetings, families, copies, routed, percent)).withColumnRenamed("component", "family")
    apart = (across.join(labels.withColumnRenamed("component", "label"), "node", "left").join(families.withColumnRenamed("family", "settled"), "node", "left")
             .select("family", "node", F.coalesce("label", "node").alias("label"), F.coalesce("settled", "node").alias("settled")))
    more = _family_links(staged(apart, "apart"), own, width, percent)
    final = connected_components(links.unionByName(more))
    return (routed.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each_group(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs` for each group of rows that links connect: the one with the smallest doc_id, rows without doc_id last.
    Every row counts by itself, whatever ids it shares; rows without words all stay. The columns of `docs` are kept."""
    own = F.struct(*[F.col(c) for c in docs.columns])
    rows = staged(docs.select(F.monotonically_increasing_id().alias("_row"), own.alias("_own")), "rows")
    groups = similar_documents(rows.select(F.col("_row").alias("doc_id"), "_own.text"), width=width, percent=percent)
    placed = groups.filter("n_shingles > 0").select(F.col("doc_id").alias("_node"), "component_id")
    many = placed.groupBy("component_id").count().filter("count > 1").select("component_id")
    copies = rows.select("_row", F.col("_own.doc_id").alias("_id")).join(placed.join(many, "component_id", "left_semi"), F.col("_row") == F.col("_node"))
    first = copies.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).getField("_row").alias("_first"))
    gone = staged(copies.join(first, "component_id").filter("_row <> _first").select(F.col("_row").alias("_gone")), "gone")
    return rows.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select("_own.*")
