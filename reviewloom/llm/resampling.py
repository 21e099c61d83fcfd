"""Importance resampling towards a target: documents drawn without replacement by hashed n-gram weights with Gumbel noise."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import staged
from reviewloom.llm.token_counts import slices, text_bytes

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 25, 7
ERROR = 0.001  # of the quantile sketch, as a share of the rows
LONG_WORD = 64  # bytes; longer words are hashed one by one


def _crc_steps() -> np.ndarray:
    """The table of the reflected CRC-32: what eight steps of its polynomial make of each byte."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> np.uint32(1)) ^ np.uint32(0xEDB88320), state >> np.uint32(1))
    return state


_STEPS = _crc_steps()
_START = np.uint32(0xFFFFFFFF)
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC register of each run data[start : start + length], begun with `state`; all short runs advance together."""
    order = np.argsort(-lengths, kind="stable")
    at, size, now = starts[order], lengths[order], state[order].copy()
    long = int(np.searchsorted(-size, -LONG_WORD, side="left"))
    for i in range(long):
        now[i] = np.uint32(zlib.crc32(data[at[i]: at[i] + size[i]].tobytes(), int(now[i] ^ _START))) ^ _START
    at, size, short = at[long:], size[long:], now[long:]
    for step, n in enumerate(np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right").tolist()):
        short[:n] = _STEPS[(short[:n] ^ data[at[:n] + step]) & np.uint32(255)] ^ (short[:n] >> np.uint32(8))
    out = np.empty_like(now)
    out[order] = now
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and row and bucket of every feature: all words, then all pairs of neighbours joined by a space."""
    data, first = text_bytes(texts)
    data = _LOWER[data]
    edge = np.diff(np.concatenate([[False], _INSIDE[data], [False]]).astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    lengths = np.flatnonzero(edge == -1) - starts
    row = np.searchsorted(first, starts, side="right") - 1
    words = advanced(np.full(len(starts), _START), data, starts, lengths)
    pair = np.flatnonzero(row[1:] == row[:-1])
    spaced = _STEPS[(words[pair] ^ np.uint32(32)) & np.uint32(255)] ^ (words[pair] >> np.uint32(8))
    pairs = advanced(spaced, data, starts[pair + 1], lengths[pair + 1])
    crc = np.concatenate([words, pairs]) ^ _START
    return np.bincount(row, minlength=len(texts)), np.concatenate([row, row[pair]]), (crc % np.uint32(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of features by bucket, over all `texts` (text). Every task sends one row per bucket at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for some in slices(batch, 0):
                total += np.bincount(features(some.column(0))[2], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths of a natural logarithm, rounded down."""
    totals = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(((t + 1.0) * totals[0]) / ((s + 1.0) * totals[1]))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row: the floored mean of its features' gains, read from one array."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                words, row, bucket = features(some.column(1))
                count = np.bincount(row, minlength=some.num_rows)
                total = np.zeros(some.num_rows, np.int64)
                np.add.at(total, row, gain[bucket])
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(words), pa.array(count), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document in thousandths, rounded down, from a hash of the seed and doc_id (null: '')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawing_order() -> list[Column]:
    """Highest scores first, ties to the smaller doc_id. Rows that agree in all but _key are alike in the result."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("_key")]


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with _rank, gapless from 1 in drawing order: ranges of the order are sorted by themselves, and the rows of all
    earlier ranges are added. One number per range is broadcast."""
    order = drawing_order()
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    ahead = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_part").withColumn("_rank", F.col("_base") + F.col("_pos") + 1).drop("_part", "_pos", "_base")


def bracket(rows: DataFrame, wanted: int, total: int, error: float = ERROR) -> tuple[int, int, int]:
    """Scores (low, high) that hold the `wanted`-th highest score between them, and how many rows lie above `high`.

    A quantile sketch proposes them. Whether they hold it is decided by exact counts; if not, they are widened and counted again,
    in the end to all scores.
    """
    aim = 1 - wanted / total
    while True:
        low, high = (int(q) for q in rows.approxQuantile("score", [max(0.0, aim - 2 * error), min(1.0, aim + 2 * error)], min(error, 0.01)))
        if error >= 1:
            low, high = (int(x) for x in rows.agg(F.min("score"), F.max("score")).first())
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < wanted <= above + inside:
            return low, high, above
        error *= 8


def drawn_and_rest(scored: DataFrame, percent: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """The `percent` per cent (rounded down) of the rows with enough words that score highest, and all other rows."""
    able = scored.filter(F.col("n_words") >= min_words)
    total = able.count()
    wanted = percent * total // 100
    if not wanted:
        return scored.limit(0), scored
    low, high, above = bracket(able, wanted, total)
    last = in_order(able.filter(F.col("score").between(low, high)), "bracket").filter(F.col("_rank") == wanted - above).first()
    later = F.lit(False)
    for name in ("_key", "weight", "n_features"):
        later = (F.col(name) > last[name]) | ((F.col(name) == last[name]) & later)
    if last["doc_id"] is None:
        later = F.col("doc_id").isNull() & later
    else:
        later = F.col("doc_id").isNull() | (F.col("doc_id") > last["doc_id"]) | ((F.col("doc_id") == last["doc_id"]) & later)
    out = (F.col("n_words") < min_words) | (F.col("score") < last["score"]) | ((F.col("score") == last["score"]) & later)
    return scored.filter(~out), scored.filter(out)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of `docs` (doc_id, text), drawn towards `target` (text).

    A feature is a word or a pair of neighbouring words, hashed into BUCKETS buckets; a document's weight is the floored mean of its
    features' log-ratios, target against all documents, 0 without features. score adds Gumbel noise, so that the highest scores
    are a draw without replacement by weight. Of the rows with `min_words` words, `percent` per cent are drawn; rank counts them
    from the highest score, ties to the smaller doc_id, and is null for all others. Null text reads as empty. Rows without
    doc_id share one hash and come last among equal scores; repeated rows are drawn each. An empty target, or no documents, is
    allowed. Two narrow passes over whole texts; very long texts are worked on alone.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = staged(weighted(docs, gain).withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "_key": F.monotonically_increasing_id()}), "scored")
    drawn, rest = drawn_and_rest(scored, percent, min_words)
    columns = ["doc_id", "n_features", "weight", "score"]
    return (in_order(drawn, "drawn").select(*columns, F.col("_rank").alias("rank"))
            .unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank"))))


RESAMPLE_SQL = rf"""
WITH steps AS (SELECT [{', '.join(str(s) for s in _STEPS.tolist())}] AS x),
words AS (SELECT kind, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM (SELECT 's' AS kind, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 't', 0, text FROM benchmark)),
f AS (SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS f FROM words),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
bytes AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM hexed),
b AS (SELECT f, (xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda s, y: xor(s >> 8, x[(xor(s, y) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS})::INT AS b FROM bytes, steps),
n AS (SELECT b, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM f JOIN b USING (f) GROUP BY b),
a AS (SELECT sum(s)::DOUBLE + {BUCKETS} AS s, sum(t)::DOUBLE + {BUCKETS} AS t FROM n),
gain AS (SELECT b, floor(1000 * ln(((n.t + 1.0::DOUBLE) * a.s) / ((n.s + 1.0::DOUBLE) * a.t)))::BIGINT AS gain FROM n, a),
weights AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN gain USING (b) WHERE kind = 's' GROUP BY r),
h AS (SELECT row_number() OVER () AS r, doc_id, ('0x' || substr(sha256(concat('{SEED}:', doc_id)), 1, 8))::BIGINT AS h FROM documents),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h JOIN words ON words.r = h.r AND kind = 's' LEFT JOIN weights ON weights.r = h.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= {MIN_WORDS}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {MIN_WORDS} AND place <= {PERCENT} * able // 100 THEN place END AS rank FROM ranked"""
