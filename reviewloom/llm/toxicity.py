"""Toxicity of whole texts: the worst of all overlapping windows, by a network trained on labelled documents."""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from reviewloom.llm import gru
from reviewloom.llm.common import SPACES
from reviewloom.llm.shingles import _LOWER, _power_tables, mixed
from reviewloom.llm.token_counts import slices, text_bytes, word_spans

BEGINNINGS = (4, 5, 6, 7, 8)
PIECES = 16  # of a long toxic text in training at most
SLOTS = 1 + len(BEGINNINGS)
IS_EDGE = np.zeros(256, bool)  # marks that are not part of a word when they stand at its edge
IS_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_features(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(words, SLOTS) hashes: the word in lower case without marks at its edges, and its beginnings; 0 where it is too short."""
    starts, ends = starts.copy(), starts + lengths
    for _ in range(4):  # up to four marks at either side
        starts += (starts < ends) & IS_EDGE[data[np.minimum(starts, len(data) - 1)]]
        ends -= (starts < ends) & IS_EDGE[data[ends - 1]]
    lengths = ends - starts
    powers, inverse = _power_tables(len(data) + 1)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[data] * powers[: len(data)], dtype=np.uint64)])
    base, unit = running[starts], inverse[starts]
    out = np.zeros((len(starts), SLOTS), np.uint64)
    out[:, 0] = np.where(lengths > 0, mixed((running[ends] - base) * unit), 0)
    for slot, size in enumerate(BEGINNINGS, 1):
        long = lengths >= size
        upto = np.where(long, starts + size, starts)
        out[:, slot] = np.where(long, mixed((running[upto] - base) * unit + np.uint64(slot)), 0)
    return out


def _windows(words_per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of consecutive texts: the place of each of its words (words, windows), the mask, and its text."""
    first = np.cumsum(words_per_text) - words_per_text
    starts = [gru.window_starts(n) for n in words_per_text.tolist()]
    text = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    begin = (np.concatenate(starts) if starts else np.empty(0, np.int64)) + first[text]
    place = begin + np.arange(gru.WIDTH)[:, None]
    inside = place < (first + words_per_text)[text]
    return np.where(inside, place, begin), inside.astype(np.float32), text


class Model:
    """The features with their rows in the network; row 0 is no feature."""

    def __init__(self, known: np.ndarray, net: gru.Network | None):
        self.known, self.net = known, net

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0).astype(np.int32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text: the largest over its windows, 0 without words."""
        data, first = text_bytes(texts)
        starts, lengths = word_spans(data)
        words = np.diff(np.searchsorted(starts, np.append(first, len(data))))
        out = np.zeros(len(texts), np.float32)
        if self.net is None or not len(starts):
            return out
        hashes = word_features(data, starts, lengths)
        _, once, again = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
        rows = self.rows(hashes[once])
        forward, backward = (table[rows].sum(axis=1) for table in self.tables)
        place, mask, text = _windows(words)
        for at in range(0, place.shape[1], 2048):
            some = again[place[:, at: at + 2048]]
            p = gru.sigmoid(self.net.logits(forward[some], backward[some], mask[:, at: at + 2048]))
            np.maximum.at(out, text[at: at + 2048], p)
        return out

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each row adds to the gates, made once per process."""
        if "_tables" not in self.__dict__:
            self._tables = (self.net.inputs("f"), self.net.inputs("b"))
        return self._tables

    def __getstate__(self):
        return {"known": self.known, "net": self.net}


class Looked:
    """Features of windows as rows of a table of words, looked up when asked for."""

    def __init__(self, table: np.ndarray, index: np.ndarray):
        self.table, self.index, self.shape = table, index, (*index.shape, table.shape[1])

    def __getitem__(self, key) -> np.ndarray:
        return self.table[self.index[key]]


def _steps(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, up to 500,000 characters at a time: the arrays of a step are some fifty times as large as its texts."""
    size = np.cumsum([len(t or "") for t in texts]) // 500_000
    for step in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1):
        yield [texts[i] for i in step]


def fit(texts: list[str | None], labels: np.ndarray, *, features: int, least: int, epochs: int, seed: int) -> Model:
    """A model of labelled texts. Features are those of at least `least` texts, the `features` most common ones."""
    if len(set(labels.tolist())) < 2:
        return Model(np.empty(0, np.uint64), None)
    words, keys, hashes, places = [], [], [], []
    for step in _steps(texts):
        data, first = text_bytes(pa.array(step, pa.string()))
        starts, lengths = word_spans(data)
        words.append(np.diff(np.searchsorted(starts, np.append(first, len(data)))))
        some = word_features(data, starts, lengths)
        key, once, again = np.unique(some[:, 0], return_index=True, return_inverse=True)
        keys.append(key)
        hashes.append(some[once])
        places.append(again.astype(np.int32))
    words = np.concatenate(words)
    _, once, again = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    hashes, ends = np.concatenate(hashes)[once], np.cumsum([len(k) for k in keys])
    word = np.concatenate([again[end - len(k): end].astype(np.int32)[at] for k, end, at in zip(keys, ends, places)])
    del keys, places
    pairs = np.unique(np.repeat(np.arange(len(texts)), words) * max(1, len(hashes)) + word)
    of_text, of_word = pairs // max(1, len(hashes)), pairs % max(1, len(hashes))
    found, counts = [], []
    for slot in range(SLOTS):  # hashes of different slots are different, so each slot is counted by itself
        one, at = np.unique(hashes[:, slot], return_inverse=True)
        once = np.unique(at[of_word] * len(texts) + of_text)
        found.append(one[one != 0])
        counts.append(np.bincount(once // len(texts), minlength=len(one))[one != 0])
    found, counts = np.concatenate(found), np.concatenate(counts)
    found, counts = found[counts >= least], counts[counts >= least]
    model = Model(np.sort(found[np.lexsort((found, -counts))[:features]]), None)
    place, mask, text = _windows(words)
    # Windows without any known word, labelled 0, so that no evidence counts as clean.
    blank = max(8, len(texts) // 50)
    table = np.concatenate([model.rows(hashes), np.zeros((1, SLOTS), np.int32)])
    index = np.concatenate([word[place], np.full((gru.WIDTH, blank), len(hashes), np.int32)], axis=1)
    del place
    mask = np.concatenate([mask, np.ones((gru.WIDTH, blank), mask.dtype)], axis=1)
    text, labels = np.concatenate([text, len(texts) + np.arange(blank)]), np.concatenate([labels, np.zeros(blank, labels.dtype)])
    model.net = gru.train(Looked(table, index), mask, text, labels.astype(np.int64), len(model.known) + 1, epochs=epochs, seed=seed)
    return model


def room(sizes: np.ndarray, total: int, longest: int, most: int) -> int:
    """How many bytes each text may bring, a multiple of `longest`, so that all together stay within `total`: `longest` at least, `most` times that at most."""
    for times in range(most, 1, -1):
        if np.minimum(sizes, times * longest).sum() <= total:
            return times * longest
    return longest


def training_rows(docs: DataFrame, labels: DataFrame, *, per_label: int, longest: int) -> pd.DataFrame:
    """The rows of `training_sample`, by doc_id."""
    return training_sample(docs, labels, per_label=per_label, longest=longest).toPandas().sort_values("doc_id")


def training_sample(docs: DataFrame, labels: DataFrame, *, per_label: int, longest: int) -> DataFrame:
    """`per_label` labelled texts of `docs` of each label (all, if there are fewer), in the order of a hash: the bounded sample that the
    network is fitted on. A text longer than its label's `room` brings pieces of about `longest` bytes, chosen by a hash,
    from anywhere in it. Rows whose crc32(doc_id) mod 5 is 0 are never among them; neither are null and blank texts."""
    known = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    texts = docs.select("doc_id", "text").filter(F.btrim("text", F.lit(SPACES)) != "")
    present = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes")).join(known, "doc_id")
    parts = [present.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).toPandas() for t in (0, 1)]
    # Any piece of a clean text is clean; what makes a text toxic may stand anywhere in it, so those bring more.
    for part, most in zip(parts, (1, PIECES)):
        part["room"] = room(part["bytes"].to_numpy(), per_label * longest, longest, most)
    rows = [(i, int(t), int(r)) for part in parts for i, t, r in zip(part["doc_id"].tolist(), part["toxic"], part["room"])]
    chosen = docs.sparkSession.createDataFrame(rows, StructType([present.schema["doc_id"], *StructType.fromDDL("toxic int, room int").fields]))
    chars = F.ceil(F.char_length("text") / F.ceil(F.octet_length("text") / longest)).cast("int")
    count = F.ceil(F.char_length("text") / chars).cast("int")
    order = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.xxhash64("doc_id", i).alias("h"), i.alias("i")))
    taken = F.array_sort(F.transform(F.slice(F.array_sort(order), F.lit(1), (F.col("room") / longest).cast("int")), lambda x: x["i"]))
    pieces = F.array_join(F.transform(taken, lambda i: F.substring("text", i * chars + 1, chars)), "\n")
    cut = F.when(F.octet_length("text") <= F.col("room"), F.col("text")).otherwise(pieces)
    return (texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", cut.alias("text"))
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, *, per_label: int = 5_000, longest: int = 2_500, features: int = 60_000, least: int = 5,
           epochs: int = 8, seed: int = 17) -> Model:
    """The model of a bounded sample of the labelled rows of `docs`: `per_label` texts of each label, `longest` bytes of each on average at most.
    It is trained in a task, so that neither the sample nor the memory of the training is the driver's."""
    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [part for part in parts if len(part)]
        if known:
            rows = pd.concat(known).sort_values("doc_id")
            model = fit(rows["text"].tolist(), rows["toxic"].to_numpy(), features=features, least=least, epochs=epochs, seed=seed)
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    sample = training_sample(docs, labels, per_label=per_label, longest=longest)
    row = sample.repartition(1).mapInPandas(learn, "model binary").first()
    model = Model(np.empty(0, np.uint64), None) if row is None else pickle.loads(row["model"])
    if model.net is None:
        warnings.warn("toxicity: no labelled texts of both kinds among the documents, every score is 0 and nothing is filtered", stacklevel=2)
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` (text first, then any columns) without the text and with `_score`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 0):
                scores = shared.value.scores(some.column(0)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(scores)], names=[*some.schema.names[1:], "_score"])

    return rows.mapInArrow(score, StructType([*rows.schema.fields[1:], StructField("_score", DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    The score looks at the text alone: all its windows of WIDTH words, each overlapping the next by half. Null and
    blank texts score 0; without labels of both kinds every score is 0, with a warning. Repeated
    rows score alike; rows without doc_id count as not held out. `training` goes to `fitted`.
    """
    return scored(docs.select("text", "doc_id"), fitted(docs, labels, **training)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """The rows of `docs` whose score is below 0.5, with the columns of `docs`."""
    own = docs.select("text", F.struct(*[F.col(c) for c in docs.columns]).alias("_own"))
    return scored(own, fitted(docs, labels, **training)).filter("_score < 0.5").select("_own.*")
