"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between trusted and raw text. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import SPACES, staged, word_list

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
WINDOW = 8  # words; made by joining runs of 1, 2 and 4

BUCKETS = 10_000
SCALE = 1 << 20  # ratios are summed as whole numbers of 1/SCALE, so that the verdict depends on no order of additions


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def joined(runs: Column, step: int) -> Column:
    """The hashes of runs of `step` words, each joined with the run after it: the hashes of all runs of twice as many words."""
    left = F.greatest(F.size(runs) - step, F.lit(0))
    return F.zip_with(F.slice(runs, F.lit(1), left), F.slice(runs, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b))


def bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def base_columns(docs: DataFrame) -> DataFrame:
    """`docs` (with a non-null `text`, `hashes` of its words and `pairs` of neighbours) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.col("text")
    count = F.size("hashes")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    with_lines = docs.withColumns({
        "n_words": count.cast("long"), "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"), "_lines": lines, "_fours": joined(F.col("pairs"), 2)})
    with_windows = with_lines.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_windows": joined(F.col("_fours"), 4)})
    repeats = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), repeated_words(F.col("_windows"))).otherwise(0)
    counted = with_windows.withColumn("n_repeat_words", F.coalesce(repeats, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("_lines", "_fours", "_windows")


def repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs more than once in the list of the text's windows, by position."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    def starts(p: Column) -> Column:
        same = lambda i, at: F.coalesce(F.get(p, at)["h"] == F.get(p, i)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.array_sort(F.transform(twice, lambda i: F.get(p, i)["i"]))
    def covered(s: Column) -> Column:
        nxt = F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.lit(1 << 30)))
        return F.aggregate(F.zip_with(s, nxt, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda x, y: x + y)
    return bound(placed, lambda p: bound(starts(p), covered))


def bound(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trusted_ids(labels: DataFrame, bound_rows: int) -> DataFrame:
    """The doc_ids of at most `bound_rows` trusted documents (quality 1), the first in the order of a hash. This is the
    bounded sample of labelled rows that the target is fitted on."""
    return (labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound_rows))


def log_ratios(docs: DataFrame, labels: DataFrame, *, target_rows: int) -> list[int]:
    """log(p_target / p_raw) of each bucket, in 1/SCALE. Raw counts cover every document, target counts the trusted
    ones; both are smoothed by one. The result has one number per bucket."""
    trusted = F.broadcast(trusted_ids(labels, target_rows).withColumn("_trusted", F.lit(1)))
    grams = (docs.select("doc_id", hashes(word_list(F.col("text"))).alias("h")).join(trusted, "doc_id", "left")
             .select("_trusted", F.explode(F.concat("h", joined(F.col("h"), 1))).alias("g"))
             .select(bucket(F.col("g")).alias("g"), F.coalesce("_trusted", F.lit(0)).alias("t")))
    counts = {r["g"]: (r["t"], r["n"]) for r in grams.groupBy("g").agg(F.sum("t").alias("t"), F.count("*").alias("n")).collect()}
    target, raw = sum(t for t, _ in counts.values()), sum(n for _, n in counts.values())
    if not target:
        return [0] * BUCKETS
    ratio = lambda t, n: math.log((t + 1) / (target + BUCKETS)) - math.log((n + 1) / (raw + BUCKETS))
    return [round(SCALE * ratio(*counts.get(g, (0, 0)))) for g in range(BUCKETS)]


def judge(docs: DataFrame, labels: DataFrame, *, threshold: float = -0.05, target_rows: int = 20_000, own: Column | None = None) -> DataFrame:
    """Every row of `docs` with base counts, base_failed, score and kept.

    score is the mean log-likelihood ratio of the text's hashed words and word pairs, trusted target against raw corpus.
    A row is kept if no base rule fails and score >= `threshold`; null, empty and short texts fail the base rules. Without
    trusted documents all ratios are 0. Repeated rows are judged alike. Two narrow passes over the texts; only
    bucket counts are shuffled. A column `own` is passed through as `_own`.
    """
    ratios = F.expr("array(" + ", ".join(f"{r}L" for r in log_ratios(docs, labels, target_rows=target_rows)) + ")")
    body = F.coalesce(F.col("text"), F.lit(""))
    more = [] if own is None else [own.alias("_own")]
    read = (docs.select("doc_id", body.alias("text"), hashes(word_list(F.col("text"))).alias("hashes"), *more)
            .withColumn("pairs", joined(F.col("hashes"), 1)))
    scored = base_columns(read)
    add = lambda s, g: s + F.get(ratios, bucket(g))
    total = F.aggregate("pairs", F.aggregate("hashes", F.lit(0).cast("long"), add), add)
    score = total / F.nullif(F.size("hashes") + F.size("pairs"), F.lit(0)) / SCALE
    judged = scored.withColumn("score", F.coalesce(score, F.lit(0.0)))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score",
                         *["_own" for _ in more])


def keep_good(docs: DataFrame, labels: DataFrame, **rules) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with the columns of `docs`. The verdicts are stored first: a filter on them
    would be copied below every projection they are made in."""
    own = F.struct(*[F.col(c) for c in docs.columns])
    return staged(judge(docs, labels, own=own, **rules).select("_own", "kept"), "quality").filter("kept").select("_own.*")
