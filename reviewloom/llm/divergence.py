"""Audit of how the sources of a language diverge: term profiles of (lang, source) groups, compared in pairs and with their language.

Profiles are whole numbers, so every comparison is exact. The terms that set a group apart are found by a dominance skyband: a term
whose group count is no higher, whose count in the language is no lower and whose spelling comes later than that of `top` other terms
of its group cannot be among the first `top`, whatever the totals are. Partitions leave out such terms, what is left is merged by
group in the same way, and only the rest is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import staged
from reviewloom.llm.token_counts import slices, text_bytes

MIN_DOCS = 30           # documents of a language that hold a kept term
TOP = 50                # ranks reported of a group's terms
SCALE, PRIOR = 1_000_000_000, 5
TERMS, SOURCES = 2_048, 128  # terms and sources of a block of profiles, about
CHUNK = 1_024           # terms that are compared with each other at once

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For every term of the texts: its row and its place in the list of different terms, which is the last result."""
    data, first = text_bytes(texts)
    inside = _LETTER[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
    return np.searchsorted(first, starts, side="right") - 1, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.cast(pa.string())


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) of every group and term; a row with a null term stands for
    the group itself. Texts are counted a few megabytes at a time, so that little is left to combine and shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2):
                lang, source = (some.column(c).dictionary_encode() for c in (0, 1))
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                row, term, terms = _terms(some.column(2))
                pair, times = np.unique(row * max(1, len(terms)) + term, return_counts=True)
                cell, at = np.unique(group[pair // max(1, len(terms))] * max(1, len(terms)) + pair % max(1, len(terms)), return_inverse=True)
                groups, rows = np.unique(group, return_counts=True)
                of = np.concatenate([groups, cell // max(1, len(terms))])
                n = np.concatenate([np.zeros(len(groups), np.int64), np.bincount(at, times, len(cell)).astype(np.int64)])
                held = np.concatenate([rows, np.bincount(at, minlength=len(cell))])
                spelled = pa.concat_arrays([pa.nulls(len(groups), pa.string()), terms.take(pa.array(cell % max(1, len(terms))))])
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))),
                                                  spelled, pa.array(n), pa.array(held)], names=["lang", "source", "term", "n", "docs"])

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return (read.mapInArrow(count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)) in whole numbers of any size."""
    parts = [F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)"), (total + PRIOR * terms.cast("long")).cast("decimal(20,0)")]
    return F.when(terms > 0, 1 + F.call_function("div", *parts))


def dominated(c: np.ndarray, low: np.ndarray, before_c: np.ndarray, before_low: np.ndarray) -> np.ndarray:
    """How many rows stand before each row, `before_*` or above it, with no lower c and no higher low."""
    above = (c[None, :] >= c[:, None]) & (low[None, :] <= low[:, None])
    times = np.tril(above, -1).sum(axis=1)
    return times + ((before_c[None, :] >= c[:, None]) & (before_low[None, :] <= low[:, None])).sum(axis=1)


def skyband(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The rows (lang, source, term, c, low; sorted by the first three) that fewer than `top` rows of their group are seen to
    dominate. A row is compared with those of its chunk and with at most CHUNK earlier ones that were kept, those with the highest
    c for their low; comparing with fewer can only keep more."""
    key, kept = None, (np.empty(0, np.int64), np.empty(0, np.int64))
    for batch in batches:
        codes = [batch.column(c).dictionary_encode() for c in (0, 1)]
        numbers = [c.indices.to_numpy() for c in codes]
        cuts = [0, *(np.flatnonzero((np.diff(numbers[0]) != 0) | (np.diff(numbers[1]) != 0)) + 1).tolist(), batch.num_rows]
        count, low = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        good = np.zeros(batch.num_rows, bool)
        for begin, end in zip(cuts[:-1], cuts[1:]):
            here = tuple(c.dictionary[int(n[begin])].as_py() for c, n in zip(codes, numbers)) if end > begin else key
            if here != key:
                key, kept = here, (np.empty(0, np.int64), np.empty(0, np.int64))
            for at in range(begin, end, CHUNK):
                c, q = count[at: min(end, at + CHUNK)], low[at: min(end, at + CHUNK)]
                stays = dominated(c, q, *kept) < top
                good[at: at + len(c)] = stays
                both = np.concatenate([kept[0], c[stays]]), np.concatenate([kept[1], q[stays]])
                best = np.argsort(-(both[0] / both[1]), kind="stable")[:CHUNK]
                kept = both[0][best], both[1][best]
        yield batch.filter(pa.array(good))


def telling_terms(cells: DataFrame, stats: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: the first `top` terms of each group by how far their share lies above the language's."""
    keys = ["lang", "source", "term"]
    schema = "lang string, source string, term string, c long, low long"
    keep = lambda rows: rows.sortWithinPartitions(*keys).mapInArrow(lambda batches: skyband(batches, top), schema)
    merged = keep(keep(cells.select(*keys, "c", "low")).repartition("lang", "source"))
    value = share(F.col("c"), F.col("total"), F.col("terms")) - share(F.col("low"), F.col("lang_total"), F.col("terms"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (merged.join(stats.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), value.alias("value"))
            .filter("value > 0").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top))


def _distances(rows: pa.Table) -> pa.Table:
    """Sums of differences between the sources of one block, over the terms in it. Rows without a term give each source's share of
    terms that it lacks."""
    source, tile = rows.column("source").combine_chunks().dictionary_encode(), rows.column("tile").to_numpy()
    at, names, p = source.indices.to_numpy(), source.dictionary, rows.column("p").to_numpy()
    term = rows.column("term").combine_chunks().dictionary_encode()
    absent = term.indices.is_null().to_numpy(zero_copy_only=False)
    lacking, of = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    lacking[at[absent]], of[at] = p[absent], tile
    profile = np.tile(lacking, (len(term.dictionary), 1))
    profile[term.indices.fill_null(0).to_numpy()[~absent], at[~absent]] = p[~absent]
    crossing = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    a, b, value = [], [], []
    for s in range(len(names) - 1):
        others = np.arange(s + 1, len(names))
        others = others[of[others] != of[s]] if crossing else others
        a.append(np.full(len(others), s))
        b.append(others)
        value.append(np.abs(profile[:, s: s + 1] - profile[:, others]).sum(axis=0))
    a, b, value = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (a, b, value))
    lang = pa.array([rows.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": value,
                     "seen": np.full(len(a), len(term.dictionary), np.int64), "rest": np.abs(lacking[a] - lacking[b])})


def source_distances(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: for each group the other sources of its language by the sum of differences of shares.

    Terms are dealt into blocks, and sources into tiles where a language has very many; a task holds the profiles of one block
    and of two tiles. Terms of a block that no source of the two tiles has count by their number, times the difference of the
    shares of absent terms.
    """
    lacking = F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0))
    size = stats.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int"), "tiles": F.ceil(F.col("sources") / SOURCES).cast("int"),
                              "tile": F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / SOURCES)).cast("int")})
    present = (cells.join(size, ["lang", "source"])
               .select("lang", "source", "term", share(F.col("c"), F.col("total"), F.col("terms")).alias("p"), "tile", "tiles", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block")))
    absent = size.select("lang", "source", F.lit(None).cast("string").alias("term"), lacking.alias("p"), "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = present.unionByName(absent).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = met.select("lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "source", "tile", "term", "p")
    parts = rows.groupBy("lang", "block", "i", "j").applyInArrow(_distances, "lang string, a string, b string, value long, seen long, rest long")
    sums = parts.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("rest").alias("rest"))
    whole = sums.join(stats.select("lang", "terms").distinct(), "lang").withColumn("value", F.col("value") + (F.col("terms") - F.col("seen")) * F.col("rest"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    near = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return whole.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", "w.item", "value").withColumn("rank", F.row_number().over(near))


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank for the (lang, source) groups of `docs` (text, lang, source).

    Terms are runs of letters and non-ASCII characters, A-Z in lower case; a language keeps those in at least `min_docs` of its
    documents. 'pair' ranks the other sources of the language by the summed difference of their shares, 'term' the first `top`
    terms whose share lies above the language's. Null text, language or source reads as ''. Groups without kept terms take
    part in pairs; a language without kept terms has distances of 0, one with a single source no pairs. Repeated rows count
    each; ties go to the earlier item in UTF-8; no documents give no rows. Very long texts are counted alone.
    """
    counts = staged(term_counts(docs), "term-counts")
    kept = staged(counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("low"))
                  .filter(F.col("docs") >= min_docs).select("lang", "term", "low"), "kept-terms")
    cells = staged(counts.filter("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", F.col("n").alias("c"), "low"), "cells")
    groups = counts.filter("term IS NULL").select("lang", "source")
    langs = (groups.groupBy("lang").agg(F.count("*").alias("sources"))
             .join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("low").alias("lang_total")), "lang", "left"))
    stats = staged(groups.join(cells.groupBy("lang", "source").agg(F.sum("c").alias("total")), ["lang", "source"], "left").join(langs, "lang")
                   .fillna(0, ["total", "terms", "lang_total"]), "groups")
    parts = [source_distances(cells, stats).withColumn("part", F.lit("pair")), telling_terms(cells, stats, top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS low FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS terms, sum(low) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, low FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
n AS (SELECT lang, source, sum(c) AS total FROM f GROUP BY ALL),
p AS (SELECT f.*, 1 + ({SCALE}::HUGEINT * (c + {PRIOR})) // (total + {PRIOR} * terms) AS p, 1 + ({SCALE}::HUGEINT * (low + {PRIOR})) // (lang_total + {PRIOR} * terms) AS q
      FROM f JOIN n USING (lang, source) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
