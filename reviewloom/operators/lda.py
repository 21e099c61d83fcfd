"""Latent Dirichlet allocation by online variational Bayes (Hoffman, Blei & Bach, 2010) over lists of term numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.sources.workspace import shuffles_removed

CHANGE = 1e-3  # a text has settled when a step moves its topic weights by less than this on average
PLAIN = 10  # steps before slow texts get amplified ones
AMPLIFY, SHORTER, LONGER = 1e4, 8.0, 2.0  # of a step along one direction, at most
CELLS = 16_384  # terms that are settled at once
MOVING = 0.75  # of the texts of a block: when fewer have not settled, the others leave the arrays
TASKS_PER_CORE = 2
DELAY, FORGET = 1024.0, 0.51  # weights of the steps of the fit


def polygammas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln gamma and its first two derivatives, for x > 0: shifted by six, then asymptotic."""
    y, log, first, second = x + 6.0, 1.0, 0.0, 0.0
    for i in range(6):
        part = 1.0 / (x + i)
        log, first, second = log * part, first - part, second + part * part
    f, ln = 1.0 / (y * y), np.log(y)
    log = np.log(log) + (y - 0.5) * ln - y + 0.9189385332046728 + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / y
    first = first + ln - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))
    return log, first, second + (1 + 0.5 / y + f * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))) / y


def digamma(x: np.ndarray) -> np.ndarray:
    y, total = x + 6.0, -1.0 / x
    for i in range(1, 6):
        total -= 1.0 / (x + i)
    f = 1.0 / (y * y)
    return total + np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def expected_logs(weights: np.ndarray) -> np.ndarray:
    """Expected logarithm of shares with these Dirichlet weights, along the last axis."""
    return digamma(weights) - digamma(weights.sum(-1, keepdims=True))


def lengths_of(texts: pa.Array) -> np.ndarray:
    return pc.list_value_length(texts).to_numpy(zero_copy_only=False)


def grouped(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers, how often each text has them, and where each text begins, from sorted lists."""
    lengths = lengths_of(texts)
    terms = texts.flatten().to_numpy()
    text = np.repeat(np.arange(len(lengths)), lengths)
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    begins = np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=len(lengths)))])
    return terms[at], np.diff(np.append(at, len(terms))).astype(float), begins


def blocks(begins: np.ndarray) -> Iterator[np.ndarray]:
    """Texts with any term, longest first, in blocks of similar length and about CELLS terms."""
    sizes = np.diff(begins)
    order = np.argsort(-sizes, kind="stable")[:np.count_nonzero(sizes)]
    at = 0
    while at < len(order):
        n = max(1, CELLS // int(sizes[order[at]]))
        yield order[at:at + n]
        at += n


def settle(seen: np.ndarray, counts: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Topic weights of texts: `seen` (texts, topics, terms) is how much topics favour the texts' terms, `counts` (texts, terms).

    The plain step maps weights g to F(g); F(g) - g is the natural gradient of the bound, and near a maximum the step leaves
    over a share of the error along each eigenvector of S A: A the Fisher information of g, S the covariance of the terms'
    topics. Where topics still resemble each other that share is close to one, and a text takes hundreds of steps. After PLAIN
    of them the step is divided, along each eigenvector, by what is missing to one. The bound never falls: if it would, the
    plain step is taken instead. A text has settled when a plain step moves it by less than CHANGE, and the result is that step's.
    """
    n, k = counts.shape[0], len(alpha)
    result, left, moving = np.empty((n, k)), np.arange(n), np.ones(n, bool)
    at, plain, least, reach = np.ones((n, k)), np.empty((n, k)), np.full(n, -np.inf), np.full(n, AMPLIFY)
    step = 0
    while True:
        every = np.concatenate([at, at.sum(1, keepdims=True)], 1)
        log, first, second = polygammas(every) if step >= PLAIN else (None, digamma(every), None)
        logs = first[:, :k] - first[:, k:]
        theta = np.exp(logs)
        norm = np.matmul(theta[:, None, :], seen)[:, 0, :] + 1e-100
        share = counts / norm
        new = theta * np.matmul(seen, share[:, :, None])[:, :, 0] + alpha
        settled, following = np.abs(new - at).sum(1) <= CHANGE * k, new
        if step >= PLAIN:
            bound = (counts * np.log(norm)).sum(1) + ((alpha - at) * logs + log[:, :k]).sum(1) - log[:, k]
            fell = bound < least - 1e-10 * np.abs(least)
            settled &= ~fell
            reach = np.where(fell, np.maximum(reach / SHORTER, 1.0), np.minimum(reach * LONGER, AMPLIFY))
            following = _amplified(at, new, alpha, seen, share / norm, theta, second, reach)
            following, least = np.where(fell[:, None], plain, following), np.where(fell, -np.inf, bound)
            plain = new
        settled &= moving
        if settled.any():
            result[left[settled]] = new[settled]
            moving &= ~settled
            if not moving.any():
                return result
            if np.count_nonzero(moving) <= MOVING * len(moving):
                left, seen, counts, following, plain, least, reach = (x[moving] for x in (left, seen, counts, following, plain, least, reach))
                moving = np.ones(len(left), bool)
        at, step = following, step + 1


def _amplified(at: np.ndarray, new: np.ndarray, alpha: np.ndarray, seen: np.ndarray, share: np.ndarray, theta: np.ndarray,
               second: np.ndarray, reach: np.ndarray) -> np.ndarray:
    k = at.shape[1]
    diagonal = np.eye(k)
    by_topic = theta[:, :, None] * seen
    spread = (new - alpha)[:, :, None] * diagonal - np.matmul(by_topic * share[:, None, :], by_topic.transpose(0, 2, 1))
    root = np.linalg.cholesky(second[:, :k, None] * diagonal - second[:, k:, None])
    lower = root.transpose(0, 2, 1)
    values, vectors = np.linalg.eigh(np.matmul(np.matmul(lower, spread), root))
    moved = np.matmul(vectors.transpose(0, 2, 1), np.matmul(lower, (new - at)[:, :, None]))
    moved = np.matmul(vectors, moved / np.maximum(np.abs(1 - values), 1 / reach[:, None])[:, :, None])
    move = np.linalg.solve(lower, moved)[:, :, 0]
    # No weight falls by more than nine tenths in a step.
    fits = 0.9 / np.maximum(np.max(-move / at, axis=1, keepdims=True), 0.9)
    return at + fits * move


@dataclass(frozen=True)
class Inference:
    """What a text's topics are found from: exp(E[ln]) of every term under each topic `(terms, topics)`, and the prior."""

    terms: np.ndarray
    alpha: np.ndarray

    def weights(self, texts: pa.Array, stats: np.ndarray | None = None) -> np.ndarray:
        """Topic weights of each text; `stats` (topics, terms) collects how much of each term went to each topic. Texts without a term get zeros."""
        ids, counts, begins = grouped(texts)
        found = np.zeros((len(texts), len(self.alpha)))
        for block in blocks(begins):
            sizes = begins[block + 1] - begins[block]
            inside = np.arange(sizes[0]) < sizes[:, None]
            at = np.where(inside, begins[block][:, None] + np.arange(sizes[0]), 0)
            own, held = ids[at], np.where(inside, counts[at], 0.0)
            seen = np.ascontiguousarray(self.terms[own].transpose(0, 2, 1))
            found[block] = settle(seen, held, self.alpha)
            if stats is not None:
                theta = np.exp(expected_logs(found[block]))
                norm = np.matmul(theta[:, None, :], seen)[:, 0, :] + 1e-100
                part = theta[:, :, None] * (held / norm)[:, None, :]
                for topic, sums in enumerate(stats):
                    np.add.at(sums, own[inside], part[:, topic][inside])
        return found


def counted(batches: Iterable[pa.RecordBatch], inference: Inference) -> Iterator[pa.RecordBatch]:
    """Of all texts of a task: a row per term with what went to each topic; as term -1 the sums of the expected logarithms of the
    texts' topic shares, and as term -2 the number of texts."""
    stats, logs, n = np.zeros(inference.terms.shape[::-1]), np.zeros(len(inference.alpha)), 0
    for batch in batches:
        texts = batch.column(0)
        weights = inference.weights(texts, stats)[lengths_of(texts) > 0]
        logs, n = logs + expected_logs(weights).sum(0), n + len(weights)
    if n:
        at = np.flatnonzero(stats.any(axis=0))
        names = ["term", *(f"s{i}" for i in range(len(logs)))]
        rows = [(np.array([-1, -2], np.int32), np.array([logs, np.full(len(logs), float(n))]).T), (at.astype(np.int32), stats[:, at])]
        for terms, values in rows:
            for i in range(0, len(terms), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(terms[i:i + 10_000]), *map(pa.array, values[:, i:i + 10_000])], names)


class LDA:
    """`iterations` steps over all texts. A text is a sorted list of term numbers below `features`, in the only column of a table.

    In a step every task settles the topics of its texts and sums what goes to each topic by term; the sums are combined by
    term, and only they, one row per term, come to the driver. So that they do not grow with the texts there is a fixed number
    of tasks per core. Nothing is sampled, and beyond rounding the result does not depend on how the texts are dealt out.
    """

    def __init__(self, k: int, seed: int, iterations: int, features: int):
        self.k, self.seed, self.iterations, self.features = k, seed, iterations, features

    def fit(self, df: DataFrame) -> Inference:
        spark, k = df.sparkSession, self.k
        context = spark.sparkContext
        columns = [f"s{i}" for i in range(k)]
        texts = df.coalesce(TASKS_PER_CORE * context.defaultParallelism)
        topics = np.random.default_rng(self.seed).gamma(100.0, 0.01, (k, self.features))
        alpha, eta = np.full(k, 1.0 / k), 1.0 / k
        inference = Inference(np.ascontiguousarray(np.exp(expected_logs(topics)).T), alpha)
        for step in range(1, self.iterations + 1):
            sent = context.broadcast(inference)
            parts = texts.mapInArrow(lambda batches, sent=sent: counted(batches, sent.value), "term int, " + ", ".join(f"{c} double" for c in columns))
            with shuffles_removed(spark):
                sums = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
            sent.destroy()
            terms, values = sums["term"].to_numpy(), np.column_stack([sums[c].to_numpy() for c in columns])
            if not len(terms):
                break
            weight, stats = (DELAY + step) ** -FORGET, np.zeros((k, self.features))
            stats[:, terms[terms >= 0]] = values[terms >= 0].T
            topics = (1 - weight) * topics + weight * (stats * inference.terms.T + eta)
            alpha = _prior(alpha, values[terms == -1][0], values[terms == -2][0, 0], weight)
            inference = Inference(np.ascontiguousarray(np.exp(expected_logs(topics)).T), alpha)
        return inference


def _prior(alpha: np.ndarray, logs: np.ndarray, n: float, weight: float) -> np.ndarray:
    """The prior after one Newton step of its likelihood (Blei, Ng & Jordan, 2003, A.4.2), unless that is no prior."""
    gradient = n * (logs / n - expected_logs(alpha))
    q, z = -n * polygammas(alpha)[2], n * polygammas(alpha.sum())[2]
    b = (gradient / q).sum() / (1 / z + (1 / q).sum())
    moved = alpha - weight * (gradient - b) / q
    return moved if (moved > 0).all() else alpha
