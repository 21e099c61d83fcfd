"""Greedy word-piece counts by a linear-time longest-match automaton."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

STATE_BITS = 20
CHUNK = 2 << 20  # bytes of text worked on at once; a longer text is worked on alone


class Automaton:
    """A trie of the vocabulary with failure links, unrolled into one transition table.

    When no child fits, the pieces that are certain by then are popped and the failure link is followed; following the
    links, the number of pieces popped on the way is stored with each transition, so a text costs one table access a byte
    and no piece is ever built. Every single byte must be a piece, so that any text can be split.
    """

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    is_piece.append(False)
                node = children[node][byte]
            is_piece[node] = node > 0
        if len(children) >= 1 << STATE_BITS:
            raise ValueError("the vocabulary has too many prefixes")
        if not all(is_piece[children[0].get(b, 0)] for b in range(256)):
            raise ValueError("every single byte must be a piece")
        table = np.zeros((len(children), 256), np.uint32)  # popped << STATE_BITS | next
        link, popped = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
        self.rest = np.zeros(len(children), np.int64)  # pieces left to pop when the word ends here
        mask, order = (1 << STATE_BITS) - 1, [(0, 0, 0)]
        for node, parent, byte in order:  # grows while it is read: breadth first, so links are always complete
            if node:
                if is_piece[node]:
                    link[node], popped[node] = 0, 1
                else:
                    step = int(table[link[parent], byte])
                    link[node], popped[node] = step & mask, popped[parent] + (step >> STATE_BITS)
                table[node] = table[link[node]] + np.uint32(popped[node] << STATE_BITS)
                self.rest[node] = popped[node] + self.rest[link[node]]
            for b, child in children[node].items():
                table[node, b] = child
                order.append((child, node, b))
        self.table, self.mask = table.reshape(-1), np.uint32(mask)
        self.after_space = int(table[0, 32]) & mask

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start : start + length], read after a space; all words advance together."""
        order = np.argsort(-lengths, kind="stable")
        at, length = starts[order], lengths[order]
        state = np.full(len(at), self.after_space, np.int64)
        found = np.zeros(len(at), np.int64)
        longest = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
        for step, n in enumerate(alive.tolist()):
            move = self.table[state[:n] * 256 + data[at[:n] + step]]
            state[:n] = move & self.mask
            found[:n] += move >> STATE_BITS
        out = np.empty(len(at), np.int64)
        out[order] = found + self.rest[state]
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """The automaton of a rank file (one base64 piece and its rank a line), once per worker process."""
    with open(path, "rb") as lines:
        return Automaton(base64.b64decode(line.split()[0]) for line in lines if line.strip())


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in UTF-8 bytes."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends - starts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, a space after each text, and where each text starts (null: empty)."""
    texts = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), np.cumsum(sizes) - sizes


def slices(batch: pa.RecordBatch, text_column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about CHUNK bytes of text."""
    sizes = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column(text_column)).to_pylist()])
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, done + CHUNK, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_bytes for every row: the pieces that greedy longest match gives for the words of the
    whole text, each word read with one space before it. Null, empty and blank texts have no words and no tokens. Repeated rows are
    counted each; a very long text is worked on alone."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_bytes long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocabulary)
        for batch in batches:
            for some in slices(batch, 1):
                data, first = text_bytes(some.column(1))
                starts, lengths = word_spans(data)
                row = np.searchsorted(first, starts, side="right") - 1
                pieces = machine.counts(data, starts, lengths)
                words = np.bincount(row, minlength=some.num_rows)
                tokens = np.bincount(row, pieces, minlength=some.num_rows).astype(np.int64)
                sizes = np.diff(np.append(first, len(data))) - 1
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(words), pa.array(tokens), pa.array(sizes)],
                                                 names=["doc_id", "n_words", "n_tokens", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(count, schema)
