"""A class-based bigram language model: exchange clustering puts words into classes, class transitions and word emissions score texts.

Texts are read once into slices: a slice holds some megabytes of tokens as numbers into its own sorted list of word hashes. The
lists are cut by ranges of hashes into parts. Two tables thus hold everything: tokens by slice and word lists by part, each
stored in buckets of its key. A round of clustering goes from slices to parts (what stands before and after each word, by class)
and back (the new class of each word), so that neither the vocabulary nor the tokens are ever in one place, and only those
two small messages are shuffled. Classes are few, so their transitions are one small matrix.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import staged
from reviewloom.llm.shingles import word_hashes
from reviewloom.llm.token_counts import slices, text_bytes, word_spans
from reviewloom.sources.workspace import fresh_path

SLICE = 8 << 20      # bytes of text in a slice, about; a longer text is a slice by itself
PART = 1 << 17       # listed words in a part, about, counted once per slice that lists them
END_WORD = np.uint64(0x9D39247E33776D41)  # stands for the end of a text
END, OTHERS = 0, 1   # classes: the end alone, and all words that are in no other class yet
PSEUDO = 5.0         # counts added to a pair of classes, shared out by their sizes, when classes are compared
PRIOR = 32.0         # weight of the class frequencies in a row of transitions
UNSEEN = 0.5         # occurrences of unseen words that each class is given beside its words seen once


def pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers, byte by byte of all of them, so that high bytes shrink to nothing."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return planes.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes, numbered in order."""
    return ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text followed by END_WORD, and the number of tokens of each text."""
    data, first = text_bytes(texts)
    starts, lengths = word_spans(data)
    words = np.diff(np.searchsorted(starts, np.append(first, len(data))))
    tokens = np.full(len(starts) + len(texts), END_WORD, np.uint64)
    ends = np.cumsum(words + 1) - 1
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = word_hashes(data, starts, lengths)
    return tokens, words + 1


ENCODED = "slice long, doc_id array<long>, held array<boolean>, sizes array<int>, codes binary, words binary, train binary, n_words long"


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of (doc_id, held, text): tokens as places in the sorted list of the slice's words, and how often each word occurs in
    its training texts."""
    base, made, room, waiting = TaskContext.get().partitionId() << 32, 0, 0, []

    def one() -> pa.RecordBatch:
        tokens, sizes = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
        held = pa.concat_arrays([w[3] for w in waiting])
        words, codes = np.unique(tokens, return_inverse=True)
        learned = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), sizes)
        train = np.bincount(codes[learned], minlength=len(words))
        row = {"slice": [base + made], "doc_id": [pa.concat_arrays([w[2] for w in waiting]).to_pylist()], "held": [held.to_pylist()], "sizes": [sizes.tolist()],
               "codes": [pack(codes)], "words": [pack(np.diff(words, prepend=np.uint64(0)), "<u8")], "train": [pack(train)], "n_words": [len(words)]}
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], names=list(row))

    for batch in batches:
        for some in slices(batch, 2):
            waiting.append((*tokens_of(some.column(2)), some.column(0), some.column(1)))
            room += some.column(2).nbytes
            if room >= SLICE:
                yield one()
                made, room, waiting = made + 1, 0, []
    if waiting:
        yield one()


def split_lists(parts: int):
    """The word lists of slices cut into parts: part, slice, words (hashes), train."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, train in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words, train = np.cumsum(unpack(words, "<u8"), dtype=np.uint64), unpack(train)
                part = part_of(words, parts)
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                runs = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cuts[:-1]]), pa.array([number] * len(runs), pa.int64()), pa.array([pack(np.diff(words[r], prepend=np.uint64(0)), "<u8") for r in runs], pa.binary()),
                     pa.array([pack(train[r]) for r in runs], pa.binary())], names=["part", "slice", "words", "train"])
    return split


def in_buckets(rows: DataFrame, key: str, name: str) -> str:
    """`rows` stored in the shared folder in buckets of `key`, one file each; the name under which the session knows them."""
    spark, table = rows.sparkSession, f"llm_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartition(buckets, key).write.bucketBy(buckets, key).option("path", fresh_path(spark, f"llm-{name}"))
     .option("compression", "zstd").saveAsTable(table))
    return table


def _columns(rows: pa.Table, *names: str) -> list[list]:
    return [rows.column(n).to_pylist() for n in names]


def _lists(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The different words of a part, where each slice's words stand among them, and their training counts."""
    lists = [np.cumsum(unpack(w, "<u8"), dtype=np.uint64) for w in rows.column("words").to_pylist()]
    words, at = np.unique(np.concatenate(lists), return_inverse=True)
    counts = np.bincount(at, np.concatenate([unpack(t) for t in rows.column("train").to_pylist()]), len(words)).astype(np.int64)
    return words, np.split(at, np.cumsum([len(x) for x in lists])[:-1]), counts


def commonest(lists: DataFrame, most: int) -> tuple[list[int], int, int]:
    """The `most` commonest words, and the numbers of training tokens and of different training words."""
    def count(rows: pa.Table) -> pa.Table:
        words, _, counts = _lists(rows)
        first = np.lexsort((words, -counts))[:most]
        first = first[(counts[first] > 0) & (words[first] != END_WORD)]
        return pa.table({"tokens": [int(counts.sum())], "types": [int((counts > 0).sum())], "word": [words[first].view(np.int64).tolist()],
                         "n": [counts[first].tolist()]}, schema=pa.schema([("tokens", pa.int64()), ("types", pa.int64()), ("word", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))

    found = staged(lists.groupBy("part").applyInArrow(count, "tokens long, types long, word array<long>, n array<long>"), "commonest")
    total = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    first = found.select(F.explode(F.arrays_zip("word", "n")).alias("w")).select("w.word", "w.n").orderBy(F.desc("n"), "word").limit(most - 1).collect()
    return [r["word"] for r in first], total[0], total[1]


ANSWER = "slice long, part long, classes binary, counts binary"


def _answers(rows: pa.Table, at: list[np.ndarray], classes: np.ndarray, counts: np.ndarray) -> pa.Table:
    return pa.table({"slice": rows.column("slice"), "part": rows.column("part"), "classes": pa.array([pack(classes[a], "<u1") for a in at], pa.binary()),
                     "counts": pa.array([pack(counts[a], "<u8") for a in at], pa.binary())})


def first_classes(lists: DataFrame, seeds: list[int]) -> DataFrame:
    """To begin with, every seed is a class by itself and all other words are one class."""
    order = np.argsort(np.array(seeds, np.int64).view(np.uint64))
    known = np.array(seeds, np.int64).view(np.uint64)[order]

    def answer(rows: pa.Table) -> pa.Table:
        words, at, counts = _lists(rows)
        place = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
        classes = np.where(known[place] == words, OTHERS + 1 + order[place], OTHERS) if len(known) else np.full(len(words), OTHERS)
        classes[words == END_WORD] = END
        return _answers(rows, at, classes, counts)

    return lists.groupBy("part").applyInArrow(answer, ANSWER)


class _Slice:
    """The tokens of a slice with the class and count of each word."""

    def __init__(self, rows: pa.Table, answers: pa.Table):
        codes, self.doc_id, self.held, sizes = (rows.column(c)[0].as_py() for c in ("codes", "doc_id", "held", "sizes"))
        order = np.argsort(answers.column("part").to_numpy())
        classes, counts, self.part = _columns(answers, "classes", "counts", "part")
        runs = [unpack(classes[i], "<u1") for i in order]
        self.part, self.bounds = [self.part[i] for i in order], np.cumsum([0, *(len(r) for r in runs)])
        self.codes, self.sizes = unpack(codes).astype(np.int64), np.array(sizes, np.int64)
        self.of_word, self.counts = np.concatenate(runs).astype(np.int64), np.concatenate([unpack(counts[i], "<u8") for i in order]).astype(np.int64)
        self.classes = self.of_word[self.codes]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.concatenate([[END], self.classes[:-1]])
        self.before[self.starts] = END
        self.learned = np.repeat(~np.array(self.held, bool), self.sizes)

    def transitions(self, classes: int) -> np.ndarray:
        """Counts of pairs of classes, and as a last row how many of the words of each class occur once, in training texts."""
        once = self.classes[self.learned & (self.counts[self.codes] == 1)]
        pairs = np.bincount(self.before[self.learned] * classes + self.classes[self.learned], minlength=classes * classes)
        return np.concatenate([pairs, np.bincount(once, minlength=classes)])

    def contexts(self, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys word * 2 * classes + class before, or + classes + class after, of training tokens, in order, and their counts."""
        after = np.concatenate([self.classes[1:], [END]])
        inner = self.learned.copy()
        inner[self.starts + self.sizes - 1] = False
        own = self.codes[inner] * (2 * classes)
        return np.unique(np.concatenate([own + self.before[inner], own + classes + after[inner]]), return_counts=True)


def send_contexts(tokens: DataFrame, answers: DataFrame, classes: int) -> DataFrame:
    """From slices to parts: for each part of a slice's list the classes of its words, and what stands around them (keys, counts);
    a row without a part has the slice's transitions."""
    def send(rows: pa.Table, given: pa.Table) -> pa.Table:
        own = _Slice(rows, given)
        keys, counts = own.contexts(classes)
        cuts = np.searchsorted(keys, own.bounds * (2 * classes))
        of = [own.of_word[a:b] for a, b in zip(own.bounds[:-1], own.bounds[1:])]
        runs = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({
            "part": pa.array([*own.part, None], pa.int64()), "slice": pa.array([rows.column("slice")[0].as_py()] * (len(of) + 1), pa.int64()),
            "classes": pa.array([*(pack(c, "<u1") for c in of), pack(own.transitions(classes), "<u8")], pa.binary()),
            "keys": pa.array([*(pack(np.diff(keys[r], prepend=lo * 2 * classes)) for r, lo in zip(runs, own.bounds)), None], pa.binary()),
            "counts": pa.array([*(pack(counts[r]) for r in runs), None], pa.binary())})

    return tokens.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(send, "part long, slice long, classes binary, keys binary, counts binary")


def summed(rows: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of transitions and the words seen once by class, of packed rows (`classes`)."""
    size = classes * classes + classes

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += unpack(data, "<u8").astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    out = np.zeros(size, np.int64)
    for r in rows.mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out[: classes * classes].reshape(classes, classes), out[classes * classes:]


def _ratio(counts: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Logarithm of counts over what sizes let expect, both raised a little, so that few counts say little."""
    extra = PSEUDO * expected / (expected + PSEUDO)
    return np.log((counts + extra) / (expected + extra))


def exchanged(contexts: np.ndarray, current: np.ndarray, pairs: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """The class of each word that its neighbours point to most; to its own class they point without what it brings there itself.
    Words without neighbours and `fixed` ones stay. `contexts` counts the classes before and after each word, side by side."""
    classes = len(pairs)
    left, right, total = pairs.sum(axis=1) + 1e-9, pairs.sum(axis=0) + 1e-9, max(1.0, float(pairs.sum()))
    points = _ratio(pairs, np.outer(left, right) / total)
    before, after = contexts[:, :classes], contexts[:, classes:]
    score = before @ points + after @ points.T
    score[:, END] = -np.inf
    without = lambda own, size, others, cells: (
        own * _ratio(np.maximum(cells - own, 0), np.maximum(size - own.sum(axis=1, keepdims=True), 1e-9) * others / total)).sum(axis=1)
    for c in range(classes):
        here = np.flatnonzero((current == c) & ~fixed)
        score[here, c] = without(before[here], right[c], left, pairs[:, c]) + without(after[here], left[c], right, pairs[c])
    best = score.argmax(axis=1)
    rows = np.arange(len(best))
    moves = ~fixed & (contexts.sum(axis=1) > 0) & (score[rows, best] > score[rows, current])
    return np.where(moves, best, current)


def next_classes(lists: DataFrame, sent: DataFrame, pairs: np.ndarray, fixed_classes: frozenset[int]) -> DataFrame:
    """From parts back to slices: every word's class after a round of exchanges."""
    classes = len(pairs)

    def answer(rows: pa.Table, given: pa.Table) -> pa.Table:
        words, at, counts = _lists(rows)
        place = dict(zip(rows.column("slice").to_pylist(), at))
        current, keys, weights = np.full(len(words), OTHERS), [], []
        for number, of, key, n in zip(*_columns(given, "slice", "classes", "keys", "counts")):
            current[place[number]] = unpack(of, "<u1")
            key = np.cumsum(unpack(key).astype(np.int64))
            keys.append(place[number][key // (2 * classes)] * (2 * classes) + key % (2 * classes))
            weights.append(unpack(n))
        contexts = np.bincount(np.concatenate(keys), np.concatenate(weights), len(words) * 2 * classes).reshape(len(words), 2 * classes)
        fixed = np.isin(current, [END, *fixed_classes])
        return _answers(rows, at, exchanged(contexts, current, pairs, fixed), counts)

    return lists.groupBy("part").cogroup(sent.filter("part IS NOT NULL").groupBy("part")).applyInArrow(answer, ANSWER)


class Model:
    """Smoothed class transitions, and for each class what its words share with unseen ones. All probabilities after any
    class, those of all known words and of one unseen word, add up to one."""

    def __init__(self, pairs: np.ndarray, once: np.ndarray, tokens: int, types: int):
        self.tokens, self.types = tokens, types
        size = pairs.sum(axis=0).astype(float)
        frequency = size / max(1.0, size.sum())
        follows = (pairs + PRIOR * frequency) / (pairs.sum(axis=1, keepdims=True) + PRIOR)
        follows = np.vstack([follows, frequency])  # the last row: after an unseen word
        self.mass = size + once + UNSEEN
        with np.errstate(divide="ignore"):
            self.follows = np.log10(follows)
            self.unseen = np.log10(follows @ ((once + UNSEEN) / self.mass))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def scores(self, before: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each token (class and training count; 0: unseen) after a class, len(mass) for an unseen word."""
        if not self.tokens:
            return self.base(counts)
        known = self.follows[before, classes] + np.log10(np.maximum(counts, 1) / self.mass[classes])
        return np.where(counts > 0, known, self.unseen[before])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(tokens: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    def score(rows: pa.Table, given: pa.Table) -> pa.Table:
        own = _Slice(rows, given)
        counts = own.counts[own.codes]
        last = np.where(counts > 0, own.classes, len(model.mass))
        before = np.concatenate([[END], last[:-1]])
        before[own.starts] = END
        add = lambda x: np.add.reduceat(x, own.starts)
        return pa.table([pa.array(own.doc_id, pa.int64()), pa.array(own.held, pa.bool_()), pa.array(own.sizes), pa.array(add((counts > 0).astype(np.int64))),
                         pa.array(np.full(len(own.sizes), model.tokens, np.int64)), pa.array(add(model.base(counts))), pa.array(add(model.scores(before, own.classes, counts)))],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return tokens.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, SCORED)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def score_documents(docs: DataFrame, *, classes: int = 64, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs` (doc_id, text).

    Tokens are words, A-Z in lower case, and an end after each text. The model learns from the rows that are not held out:
    class bigrams with `classes` classes (255 at most), found in `rounds` rounds of exchanges over all training words, the commonest
    ones as first classes. score is the log10 probability of the whole text; words unseen in training count as one word, which
    every class gives as much room as its words seen once. base_score is that of the smoothed word frequencies. Null, empty and
    blank texts have the end alone; repeated rows count and are scored each; rows without doc_id are learned from. Without
    training rows score is base_score. Words are told apart by 64-bit hashes. A very long text is a slice by itself.
    """
    if not 3 <= classes <= 255:
        raise ValueError("classes must be between 3 and 255")
    spark: SparkSession = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    stored = in_buckets(read.mapInArrow(encode, ENCODED), "slice", "slices")
    slices_table = spark.table(stored)
    parts = max(1, -(-(slices_table.agg(F.sum("n_words")).first()[0] or 0) // PART))
    named = in_buckets(slices_table.select("slice", "words", "train").mapInArrow(split_lists(parts), "part long, slice long, words binary, train binary"), "part", "lists")
    tokens, lists = slices_table.select("slice", "doc_id", "held", "sizes", "codes"), spark.table(named)
    seeds, n, v = commonest(lists, classes - 1)
    answers = staged(first_classes(lists, seeds), "classes")
    for step in range(rounds):
        sent = staged(send_contexts(tokens, answers, classes), "contexts")
        pairs, _ = summed(sent.filter("part IS NULL").select("classes"), classes)
        answers = staged(next_classes(lists, sent, pairs, frozenset(range(OTHERS + 1, classes)) if not step else frozenset()), "classes")

    def count(rows: pa.Table, given: pa.Table) -> pa.Table:
        return pa.table({"classes": pa.array([pack(_Slice(rows, given).transitions(classes), "<u8")], pa.binary())})

    final = tokens.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(count, "classes binary")
    result = staged(scored(tokens, answers, Model(*summed(final, classes), n, v)), "scores")
    for table in (stored, named):
        spark.sql(f"DROP TABLE {table}")
    return result
