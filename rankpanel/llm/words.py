"""Words of Arrow text batches as arrays: byte spans, 64-bit hashes, hashes of word windows.

A batch is handled as one byte buffer, so no Python loop runs over words, and in
pieces of bounded size, so memory follows the longest document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from rankpanel.llm.tables import in_bitmap

PIECE = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words of letters and digits only: ASCII punctuation separates too.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True

_random = np.random.default_rng(20240917)
_BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _GRAM = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n, kept between calls."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[base] = known = (out[0], out[1])
    return known[0][:n], known[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each row (one more entry than rows)."""
    inside = ~separators[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _long_hash(word: np.ndarray) -> np.uint64:
    total = 0
    for at in range(0, len(word), PIECE):
        part = word[at : at + PIECE]
        total += int((_BYTES[part] * powers(_STEP, len(part))[0]).sum(dtype=np.uint64)) * pow(_STEP, at, 1 << 64)
    return np.uint64(total % (1 << 64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every batch."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = int(np.searchsorted(ends, base + PIECE, side="right"))
        if b <= a:
            out[a] = _long_hash(data[base : ends[a]])
            a += 1
            continue
        part = data[base : ends[b - 1]]
        up, down = powers(_STEP, len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[part] * up[:-1], out=total[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        out[a:b] = (total[e] - total[s]) * down[s]
        a = b
    return mixed(out + (ends - starts).astype(np.uint64) * np.uint64(_GRAM))


class Windows:
    """Hashes of any word ranges of a sequence, from prefix sums."""

    def __init__(self, word_hashes: np.ndarray):
        self.up, self.down = powers(_GRAM, len(word_hashes) + 1)
        self.total = np.zeros(len(word_hashes) + 1, dtype=np.uint64)
        np.cumsum(word_hashes * self.up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.down[start])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, body): texts compressed before they are shuffled."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        body = [press.compress(data[a:b]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], ["row", "body"])


def packed_where(rows, bits: int):
    """Like ``packed`` for the rows that a broadcast bitmap lets through; a join decides about the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(rows.value, batch.column(0).to_numpy(zero_copy_only=False), bits)
            yield from packed(iter([batch.filter(pa.array(hit))]))

    return run


PACKED = "row long, body binary"
