"""Exact top-k search by inner product: no-random-access aggregation over sorted component lists."""

from __future__ import annotations

import heapq
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VECTORS, QUERIES, BATCH = 4096, 4096, 256  # vectors and queries of one block, queries that read the lists together
LONGEST = 2.0 ** 31  # of a vector times 256; the product of two shorter ones fits 64 bits


class SortedLists:
    """The vectors of one block as one list per component, in ascending order of the component."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()  # list, place -> vector
        self.values = np.take_along_axis(vectors, self.order.T, axis=0).T.copy()
        self.place = np.empty(vectors.shape, np.int32)
        np.put_along_axis(self.place, self.order.T, np.arange(len(vectors), dtype=np.int32)[:, None], axis=0)

    def top(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[np.ndarray]:
        """For each query the vectors that may be among its k best, never fewer than those that are. own: the vectors that
        are the query's own, one row per query (bool), which take no part.

        All lists are read from the end where the query's component makes the product largest, one stretch at a
        time. What has been read of a vector is summed; what has not lies between the smallest product of the list and
        the last one read. A vector whose upper bound is below the k-th largest lower bound is out, whether it has been
        seen or not. A query stops when at most 4k vectors are left; its scores are settled by the caller.
        """
        count = len(self.vectors)
        alive, result = np.arange(len(queries)), [np.empty(0, np.int64)] * len(queries)
        # A list is read from the top for positive components of a query, from the bottom for negative ones.
        rising, falling = np.maximum(queries, 0).T.astype(np.float64), np.minimum(queries, 0).T.astype(np.float64)
        lowest, highest = self.values[:, :1].astype(np.float64), self.values[:, -1:].astype(np.float64)
        points, seen, read = self.vectors.astype(np.float64), np.zeros((count, len(queries))), 0
        for depth in sorted({max(1, count * part // 16) for part in (8, 11, 13, 14, 15, 16)}):
            from_top, from_bottom = count - 1 - self.place, self.place  # when a list comes to the vector
            # The next stretch of every list, for all queries at once: what it does not hold counts as 0.
            seen += np.where((from_top >= read) & (from_top < depth), points, 0) @ rising
            seen += np.where((from_bottom >= read) & (from_bottom < depth), points, 0) @ falling
            read = depth
            # The last products read bound all that is unread.
            unread = np.hstack([from_top >= depth, from_bottom >= depth]).astype(np.float64)
            upper = seen + unread @ np.vstack([self.values[:, count - depth, None] * rising, self.values[:, depth - 1, None] * falling])
            lower = seen + unread @ np.vstack([lowest * rising, highest * falling])
            upper += 1e-12 * (np.maximum(-lowest, highest) * (rising - falling)).sum(axis=0)  # for sums beyond 2^53
            lower[own.T] = -np.inf
            upper[own.T] = -np.inf
            bar = np.partition(lower, count - k, axis=0)[count - k] if count > k else -np.inf
            left = (upper >= bar) & (upper > -np.inf)
            done = (left.sum(axis=0) <= 4 * k) | (depth == count)
            for column in np.flatnonzero(done):
                result[alive[column]] = np.flatnonzero(left[:, column])
            if done.all():
                break
            keep = ~done
            alive, own = alive[keep], own[keep]
            rising, falling, seen = rising[:, keep], falling[:, keep], seen[:, keep]
        return result


SCHEMA = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.bool_())])


def _dealt(queries: pa.Table, vectors: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(t.column(c).to_numpy() for t, c in ((queries, "query_id"), (queries, "query"), (vectors, "vec_id")))


def _search(k: int):
    def matrix(column) -> np.ndarray:
        lists = column.combine_chunks()
        return lists.flatten().to_numpy().reshape(len(lists), -1)

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return SCHEMA.empty_table()
        asked, which, ids = _dealt(queries, vectors)
        points, wanted = matrix(vectors.column("x")), matrix(queries.column("x"))
        lists, out = SortedLists(points), []
        for at in range(0, len(asked), BATCH):
            some = asked[at: at + BATCH]
            for n, found in enumerate(lists.top(wanted[at: at + BATCH], k, some[:, None] == ids)):
                scores = points[found] @ wanted[at + n]
                best = np.lexsort((ids[found], -scores))[:k]
                out.append((np.full(len(best), some[n]), np.full(len(best), which[at + n]), ids[found][best], scores[best], np.zeros(len(best), bool)))
        return pa.table([np.concatenate([o[c] for o in out]) for c in range(5)], schema=SCHEMA)

    return search


def whole(x: float) -> int:
    """floor(256 * x) of any finite number; from 2^53 on a double is a whole number."""
    return int(x) * 256 if abs(x) >= 2.0 ** 53 else math.floor(x * 256)


def _search_exactly(k: int):
    """The same for vectors too long for 64-bit sums: whole numbers of any size, one product after the other."""
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        asked, which, ids = _dealt(queries, vectors)
        points = [[whole(x) for x in v] for v in vectors.column("raw").to_pylist()]
        rows, low, high = [], -(1 << 63), (1 << 63) - 1
        for query, number, vector in zip(asked.tolist(), which.tolist(), queries.column("raw").to_pylist()):
            wanted = [whole(x) for x in vector]
            scored = ((-sum(map(operator.mul, wanted, p)), i) for p, i in zip(points, ids.tolist()) if i != query)
            for score, i in heapq.nsmallest(k, scored):
                rows.append((query, number, i, min(max(-score, low), high), not low <= -score <= high))
        return pa.table([pa.array([r[c] for r in rows], SCHEMA.types[c]) for c in range(5)], schema=SCHEMA)

    return search


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it has components, and all are finite numbers."""
    return (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` highest inner products of each query, ties to smaller vec_id.

    Components count as floor(256 * x). Queries are the rows of `vectors` (vec_id, embedding) whose vec_id is divisible by
    `every`; candidates are all rows but those with the query's vec_id. Rows without vec_id, and vectors that are null or empty or
    hold null or non-finite components, take no part; vectors of different lengths are not compared. Queries and
    vectors are dealt into blocks of bounded size, every block of queries meets every block of vectors once, and each
    meeting returns at most k rows a query. Repeated rows are candidates each, and one query; different vectors under one
    vec_id are queries by themselves, with ranks of their own. The products of a vector longer than LONGEST, which may not fit
    64 bits, are made one by one in whole numbers of any size; a score among the best that no long can hold is an error.
    """
    kept = (vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("raw"))
            .filter(usable(F.col("raw"))))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x)) * 256
    valid = kept.withColumns({"dims": F.size("raw"), "long": length >= LONGEST}).withColumn(
        "x", F.when(~F.col("long"), F.transform("raw", lambda x: F.floor(x * 256))))
    asked = (valid.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "raw"])
             .withColumnsRenamed({"vec_id": "query_id"}).withColumn("query", F.xxhash64("raw")))
    sizes = valid.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.count_if("long").alias("long")).first()
    block = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["dims", "qb", "vb"]

    def met(wanted: DataFrame, points: DataFrame, vector: str, search) -> DataFrame:
        v_blocks, q_blocks = -(-sizes["n"] // VECTORS) or 1, -(-sizes["q"] // QUERIES) or 1
        dealt = points.select("vec_id", "dims", vector).withColumn("vb", block(v_blocks, "vec_id", vector)).withColumn("qb", every_block(q_blocks))
        some = wanted.select("query_id", "query", "dims", vector).withColumn("qb", block(q_blocks, "query")).withColumn("vb", every_block(v_blocks))
        return some.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(search, "query_id long, query long, vec_id long, score long, beyond boolean")

    found = met(asked.filter("NOT long"), valid.filter("NOT long"), "x", _search(k))
    if sizes["long"]:
        found = (found.unionByName(met(asked.filter("long"), valid, "raw", _search_exactly(k)))
                 .unionByName(met(asked.filter("NOT long"), valid.filter("long"), "raw", _search_exactly(k))))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    score = F.when(F.col("beyond"), F.raise_error(F.lit("a score is too large for a long")).cast("long")).otherwise(F.col("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
