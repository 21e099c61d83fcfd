"""A static range asymmetric numeral system over interleaved lanes, in numpy.

A block is a sequence of symbols; symbol t belongs to lane t mod `lanes`, so one step codes one symbol of every lane. Every
`interval` steps the block holds a checkpoint: the states of all lanes and the place in the stream, from which a
decoder can start. All segments between checkpoints are decoded side by side.

Layout of a block, little-endian: HEADER (magic, version, scale bits, lanes, interval, symbols, words, checkpoints, crc32 of all
that follows, crc32 of the table), then per checkpoint its word offset (uint64) and lane states (uint64), then the words (uint32).
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

MAGIC, VERSION = b"RLTB", 1
HEADER = struct.Struct("<4sHHIIQQIII")
LOW = 1 << 31  # states stay in [LOW, 2^63); renormalising moves 32 bits
LANES, INTERVAL = 2048, 128


@dataclass
class Table:
    """Frequencies of all symbols, scaled to a sum of 2^bits. Symbols that occur keep at least 1."""
    frequency: np.ndarray
    bits: int
    start: np.ndarray = field(init=False)
    slots: np.ndarray = field(init=False)
    check: int = field(init=False)

    def __post_init__(self):
        self.frequency = self.frequency.astype(np.uint64)
        self.start = np.cumsum(self.frequency, dtype=np.uint64) - self.frequency
        self.slots = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))
        self.check = zlib.crc32(self.frequency.astype("<u4").tobytes()) ^ self.bits


def scaled(counts: np.ndarray, bits: int | None = None) -> Table:
    """The table for symbol counts: shares of 2^bits rounded down but not to 0; the most frequent symbols settle the rest."""
    counts = np.asarray(counts, np.int64)
    present = np.flatnonzero(counts)
    bits = bits or max(16, int(len(counts)).bit_length() + 2)
    if bits > 30 or len(present) > 1 << bits:
        raise ValueError("too many symbols")
    frequency = np.zeros(len(counts), np.int64)
    if not len(present):
        return Table(frequency, bits)
    total = int(counts.sum())
    exact = counts[present].astype(np.float64) * ((1 << bits) / total)
    share = np.maximum(1, np.floor(exact).astype(np.int64))
    order, left = np.argsort(-counts[present], kind="stable"), (1 << bits) - int(share.sum())
    if left > 0:
        share[order[0]] += left
    for i in order if left < 0 else []:
        give = min(share[i] - 1, -left)
        share[i] -= give
        left += give
        if not left:
            break
    frequency[present] = share
    return Table(frequency, bits)


def encode(symbols: np.ndarray, table: Table, lanes: int | None = None, interval: int = INTERVAL) -> bytes:
    symbols = np.asarray(symbols, np.int64)
    count = len(symbols)
    lanes = lanes or max(1, min(LANES, count // 256))
    steps = -(-count // lanes)
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    frequency, start = table.frequency[symbols], table.start[symbols]
    if count and not frequency.all():
        raise ValueError("a symbol is not in the table")
    limit = frequency << top
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    checkpoints: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        part = slice(step * lanes, min(count, step * lanes + lanes))
        f, x = frequency[part], state[: part.stop - part.start]
        full = x >= limit[part]
        words[step] = x[full].astype(np.uint32)
        x[full] >>= np.uint64(32)
        quotient = x // f
        x -= quotient * f
        x += (quotient << bits) + start[part]
        if step % interval == 0:
            checkpoints.append((step, state.copy()))
    sizes = np.fromiter((len(w) for w in words), np.uint64, steps)
    before = np.cumsum(sizes, dtype=np.uint64) - sizes
    stream = np.concatenate(words) if steps else np.empty(0, np.uint32)
    body = b"".join([np.uint64(before[s]).tobytes() + x.astype("<u8").tobytes() for s, x in reversed(checkpoints)] + [stream.astype("<u4").tobytes()])
    return HEADER.pack(MAGIC, VERSION, table.bits, lanes, interval, count, len(stream), len(checkpoints), zlib.crc32(body), table.check) + body


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The symbols of segments first .. last - 1 of a block (default: all). Raises ValueError if a checksum, the end of a
    segment or the table does not fit."""
    magic, version, bits, lanes, interval, count, words, points, crc, check = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size:]
    if magic != MAGIC or version != VERSION or check != table.check or zlib.crc32(body) != crc:
        raise ValueError("damaged block or wrong table")
    last = points if last is None else last
    if first >= last:
        return np.empty(0, np.uint32)
    heads = np.frombuffer(body, "<u8", points * (lanes + 1)).reshape(points, lanes + 1)
    stream = np.append(np.frombuffer(body, "<u4", words, points * (lanes + 1) * 8), np.uint32(0))
    steps = -(-count // lanes)
    out = np.empty((last - first) * interval * lanes, np.uint32)
    inner = last - first if last < points else last - first - 1  # segments that have all their steps and lanes
    grid = out.reshape(-1, interval, lanes)
    states, at = heads[first:last, 1:].copy(), heads[first:last, 0].astype(np.int64)

    def advance(x: np.ndarray, place: np.ndarray, into: np.ndarray) -> None:
        """One step of all lanes of the given segments (rows)."""
        slot = x & mask
        symbol = table.slots[slot]
        into[...] = symbol
        x >>= width
        x *= table.frequency[symbol]
        x += slot - table.start[symbol]
        short = x < low
        rank = np.cumsum(short, axis=1)
        need = short.nonzero()
        x[need] = (x[need] << np.uint64(32)) | stream[place[need[0]] + rank[need] - 1]
        place += rank[:, -1]

    mask, width, low = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(LOW)
    if inner:
        x, place = states[:inner], at[:inner]
        for step in range(interval):
            advance(x, place, grid[:inner, step])
    if inner < last - first:
        x, place, begin = states[inner:], at[inner:], (points - 1) * interval
        for step in range(begin, steps):
            active = min(count - step * lanes, lanes)
            advance(x[:, :active], place, grid[inner:, step - begin, :active])
        if not (x == low).all():
            raise ValueError("the block does not end where it should")
    following = heads[first + 1: first + 1 + inner, 1:]
    if not (states[: len(following)] == following).all():
        raise ValueError("a segment does not end at the next checkpoint")
    return out[: min(count, last * interval * lanes) - first * interval * lanes]
