"""Token ids of whole texts, by the tokenizers library, at the cost of a dictionary lookup for most words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from reviewloom.llm.token_counts import slices

# Letters of one byte in Latin-1: every version of Unicode and every library takes these for letters.
LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+").fullmatch
# Letters and then marks, without the apostrophe: both patterns break between them and nowhere in the marks.
MARKED = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch
GENERATION = 300_000  # words kept by each of the two generations of the dictionary


class _Words(dict):
    """word -> its ids as bytes. When it holds GENERATION words it becomes the old generation, from which words
    in use come back; the memory of a worker is bounded for any number of distinct words."""

    def __init__(self, encode: Callable[[str], bytes], marks: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.marks, self.old = encode, marks, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            marked = MARKED(word)
            ids = self[marked[1]] + self.marks(marked[2]) if marked else self.encode(word)
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64 and "\n" not in word:
            self[word] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, equal to `Tokenizer.encode(text, add_special_tokens=False)`.

    The pattern of both kinds of vocabulary always breaks before a space that a non-space follows, so the words between
    spaces are encoded one by one and remembered; it also breaks around a single line break and between letters and marks. Texts where
    that does not hold (runs of white space, names of special tokens) are encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [t for t in added if t]
        # Word-end vocabularies drop white space; byte-level ones make it the first byte of a word.
        self.spaced = bool(self._plain(" "))
        self.lower = not self.spaced
        self.model = self.tokenizer.model
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: "".join(x[0] for x in spell(chr(c))) for c in range(32, 256)}
        self.space = self.spelling[32] if self.spaced else ""
        marks = lru_cache(maxsize=10_000)(self._plain)
        self.words = _Words(self._after_space, marks)
        self.starts = _Words(self._plain, marks) if self.spaced else self.words
        self.line = self._plain("\n")

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _after_space(self, word: str) -> bytes:
        if not word:
            return b""
        if "\n" in word:
            first, *others = word.split("\n")
            if first and all(others) and not any(c.isspace() for c in first + "".join(others)):
                return self.words[first] + b"".join([self.line + self.starts[x] for x in others])
        if LETTERS(word):  # one pre-token: the model alone will do
            form = word.lower() if self.lower else word
            if not form.isascii():
                form = form.translate(self.spelling)
            return array("I", [t.id for t in self.model.tokenize(self.space + form)]).tobytes()
        return self._plain((" " if self.spaced else "") + word)

    def _breaks_at_spaces(self, text: str) -> bool:
        if any(name in text for name in self.special):
            return False
        if not self.spaced:
            return True
        return "  " not in text and not text.endswith(" ") and all(" " + c not in text for c in _OTHER_SPACES)

    def encode(self, text: str) -> bytes:
        if not self._breaks_at_spaces(text):
            return self._plain(text)
        if self.lower and not text.isascii():
            text = text.lower() if max(text) < "Ā" else text
        elif self.lower:
            text = text.lower()
        head, *rest = text.split(" ")
        first = (self._plain(head) if any(c.isspace() for c in head) else self.starts[head]) if head else b""
        return first + b"".join(map(self.words.__getitem__, rest))


# White space, in the widest sense of any library, other than the plain space.
_OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32] + ["᠎", "​", "﻿"]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def _binary(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of `flat`, `counts` numbers each, as binary values."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
    return pa.array([flat[a: b].tobytes() for a, b in zip(ends[:-1] // flat.itemsize, ends[1:] // flat.itemsize)], pa.binary())


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of (doc_id, text), a few megabytes of texts at a time: the doc_ids, all ids one after the other, and how many each text has."""
    own, end = encoder(vocabulary), np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        for some in slices(batch, 1):
            ids = [(own.encode(text) if text else b"") + end for text in some.column(1).to_pylist()]
            yield some.column(0), np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def tokenize(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, part, local_start, n_tokens, ids for every row of `docs`, each text followed by `end_id`.

    `ids` holds little-endian unsigned 32-bit integers; a null text counts as empty. `part` is the task and `local_start`
    the ids before the row in it; both are meant to be stored with the ids, since a plan that runs again may deal rows anew.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, local_start long, n_tokens long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for doc_id, flat, counts in _encoded(batches, vocabulary, end_id):
            starts = start + np.cumsum(counts) - counts
            start += int(counts.sum())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.full(len(counts), part, np.int32)), pa.array(starts), pa.array(counts), _binary(flat, counts)],
                                             names=["doc_id", "part", "local_start", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def tokenize_and_count(docs: DataFrame, vocabulary: str, end_id: int, vocabulary_size: int) -> DataFrame:
    """doc_id, n_tokens, ids for every row of `docs`, and one more row per task with n_tokens -1 whose ids are the task's counts of all
    symbols (unsigned 64-bit). Ids are little-endian, as wide as `id_type` says."""
    kind = id_type(vocabulary_size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs_type = np.zeros(vocabulary_size, np.uint64), None
        for doc_id, flat, counts in _encoded(batches, vocabulary, end_id):
            seen += np.bincount(flat, minlength=vocabulary_size).astype(np.uint64)
            docs_type = doc_id.type
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts), _binary(flat.astype(kind), counts)], names=["doc_id", "n_tokens", "ids"])
        if docs_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, docs_type), pa.array([-1], pa.int64()), pa.array([seen.tobytes()], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def id_type(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"
