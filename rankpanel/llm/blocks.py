"""Counts of keys over all documents, brought back to blocks of documents.

Several operators need, per document, values of keys (words, byte contexts, id
pairs) that depend on the key's total count in the corpus. Texts stay in blocks
of bounded size; a block sends every distinct key once, with its count, packed
by part of the key space. A part's task adds up all blocks' counts, and later
answers every block with the values of just the keys it asked for. So rows that
travel are bounded by the distinct keys per block, a key that makes a third of
all rows costs one entry per block, and no task or driver holds all keys.

Packed keys are sorted 64-bit integers, stored as compressed differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of one part that are kept before equal keys are added up.
COMPACT = 1 << 21
TOTALS = "part int, key long, n long"


_FAR = zstandard.ZstdCompressionParameters.from_level(1, window_log=23, enable_ldm=True)


def pack(values: np.ndarray, ordered: bool = True, far: bool = False) -> bytes:
    """Integers, or their differences if they are ordered, as compressed byte planes; ``far`` looks for repeats far back."""
    v = np.ascontiguousarray(values, dtype=np.int64)
    planes = (np.diff(v, prepend=np.int64(0)) if ordered else v).view(np.uint8).reshape(len(v), 8).T
    press = zstandard.ZstdCompressor(compression_params=_FAR) if far else zstandard.ZstdCompressor(level=1)
    return press.compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, ordered: bool = True) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(values) if ordered else values


def pack_few(values: np.ndarray) -> bytes:
    """Integers of which few are distinct, as places in their list."""
    distinct, which = np.unique(values, return_inverse=True)
    return pack(np.concatenate([[len(distinct)], distinct, which]), False)


def unpack_few(data: bytes) -> np.ndarray:
    values = unpack(data, False)
    first = int(values[0]) + 1
    return values[1:first][values[first:]]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


class Counter:
    """Adds up (keys, counts) pieces; memory follows the distinct keys."""

    def __init__(self, limit: int = COMPACT):
        self.limit, self.held, self.pieces = limit, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pieces.append((keys.astype(np.int64, copy=False), counts.astype(np.int64, copy=False)))
        self.held += len(keys)
        if self.held > self.limit:
            self.pieces = [self.total()]
            self.held = len(self.pieces[0][0])
            self.limit = max(self.limit, 2 * self.held)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        none = [np.zeros(0, np.int64)]
        return summed(np.concatenate([p[0] for p in self.pieces] or none), np.concatenate([p[1] for p in self.pieces] or none))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """An even spread of keys over parts."""
    h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (((h ^ (h >> np.uint64(29))) >> np.uint64(11)) % np.uint64(parts)).astype(np.int32)


def by_part(keys: np.ndarray, counts: np.ndarray, parts: int, base: int = 0) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, packed keys, packed counts) of sorted keys; parts are numbered from ``base``."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        at = order[edge[p] : edge[p + 1]]
        if len(at):
            yield base + p, pack(keys[at]), pack(counts[at])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, counter = None, Counter()

    def done() -> pa.RecordBatch:
        keys, n = counter.total()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), current, np.int32)), pa.array(keys), pa.array(n)], ["part", "key", "n"])

    for batch in batches:
        for part, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if part != current:
                if current is not None:
                    yield done()
                current, counter = part, Counter()
            counter.add(unpack(keys.as_py()), unpack(counts.as_py()))
    if current is not None:
        yield done()


def totals(packed: DataFrame, partitions: int) -> DataFrame:
    """(part, key, n) over all blocks, from rows with ``part``, ``keys`` and ``counts``."""
    rows = packed.select("part", "keys", "counts").repartition(partitions, "part").sortWithinPartitions("part")
    return rows.mapInArrow(_totals, TOTALS)


def _answers(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[list[np.ndarray]] = []
        table: list[np.ndarray] | None = None
        current = None
        for batch in batches:
            place = batch.column(0).to_numpy()
            for lo, hi in zip(edges := np.flatnonzero(np.append(True, place[1:] != place[:-1])), np.append(edges[1:], len(place))):
                part, asks = divmod(int(place[lo]), 2)
                if part != current:
                    current, known, table = part, [], None
                rows = batch.slice(lo, hi - lo)
                if not asks:
                    known.append([rows.column(3 + i).to_numpy(zero_copy_only=False) for i in range(width + 1)])
                    continue
                if table is None:
                    joined = [np.concatenate([k[i] for k in known]) if known else np.zeros(0) for i in range(width + 1)]
                    order = np.argsort(joined[0], kind="stable")
                    table, known = [c[order] for c in joined], []
                out = []
                for keys in rows.column(2):
                    asked = unpack(keys.as_py())
                    at = np.searchsorted(table[0], asked)
                    known_here = at < len(table[0])
                    known_here[known_here] = table[0][at[known_here]] == asked[known_here]
                    found = np.zeros((width, len(asked)))
                    found[:, known_here] = [c[at[known_here]] for c in table[1:]]
                    out.append(found.tobytes())
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(np.full(hi - lo, current, np.int32)), rows.column(2), pa.array(out, pa.binary())], ["block", "part", "keys", "answer"])

    return run


def answers(packed: DataFrame, values: DataFrame, columns: list[str], partitions: int) -> DataFrame:
    """Rows (block, part, keys, answer): the values of each block's keys, as doubles, column after column.

    ``values`` has a row for each known key: part, key, and the columns. Other keys get zeros.
    """
    known = values.select(
        (F.col("part") * F.lit(2)).alias("place"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("keys"), "key",
        *[F.col(c).cast("double").alias(c) for c in columns],
    )
    asked = packed.select(
        (F.col("part") * F.lit(2) + F.lit(1)).alias("place"), "block", "keys", F.lit(None).cast("long").alias("key"),
        *[F.lit(None).cast("double").alias(c) for c in columns],
    )
    both = known.unionByName(asked).repartition(partitions, F.floor(F.col("place") / 2)).sortWithinPartitions("place")
    return both.mapInArrow(_answers(len(columns)), "block long, part int, keys binary, answer binary")


def _frequent(least: int, parts: int, values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, counter = None, [], Counter()

        def done() -> Iterator[pa.RecordBatch]:
            keys, n = counter.total()
            keys, n = keys[n >= least], n[n >= least]
            for block, packed in rows:
                asked = unpack(packed)
                here = np.flatnonzero(np.isin(keys, asked))
                if len(here):
                    answer = pack(np.concatenate([n[here], here * parts + current]), False) if values else b""
                    yield pa.RecordBatch.from_pylist([{"block": block, "part": current, "keys": pack(keys[here]), "answer": answer}], _ANSWER)

        for batch in batches:
            for part, block, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if part != current:
                    if current is not None:
                        yield from done()
                    current, rows, counter = part, [], Counter()
                rows.append((block, keys.as_py()))
                counter.add(unpack(rows[-1][1]), unpack(counts.as_py()))
        if current is not None:
            yield from done()

    return run


_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("answer", pa.binary())])


def frequent(packed: DataFrame, parts: int, least: int, values: bool = True) -> DataFrame:
    """Rows (block, part, keys, answer): of each block's keys those that reach ``least`` over all blocks, with count and number if asked for.

    Numbers are unique and dense up to the unevenness of the parts. One shuffle:
    a part's task keeps its packed rows until the part is counted.
    """
    rows = packed.select("part", "block", "keys", "counts").repartition(parts, "part").sortWithinPartitions("part")
    return rows.mapInArrow(_frequent(least, parts, values), "block long, part int, keys binary, answer binary")


def answered_frequent(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent keys of a block in order, their counts and numbers (zeros where none were asked for)."""
    keys = [unpack(k) for k, _ in rows]
    values = [unpack(a, False).reshape(2, -1) if a else np.zeros((2, len(k)), np.int64) for (_, a), k in zip(rows, keys)]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = np.concatenate(keys)
    order = np.argsort(joined, kind="stable")
    both = np.concatenate(values, axis=1)[:, order]
    return joined[order], both[0], both[1]


def answered(rows: list[tuple[bytes, bytes]], width: int) -> list[np.ndarray]:
    """The keys of a block in order and their values, from its answers of all parts."""
    keys = [unpack(k) for k, _ in rows]
    values = [np.frombuffer(a, np.float64).reshape(width, -1) for _, a in rows]
    if not keys:
        return [np.zeros(0, np.int64), *[np.zeros(0)] * width]
    joined = np.concatenate(keys)
    order = np.argsort(joined, kind="stable")
    return [joined[order], *np.concatenate(values, axis=1)[:, order]]
