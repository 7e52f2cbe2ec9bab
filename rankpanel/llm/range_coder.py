"""Token ids as bytes: an adaptive context-mixing range coder over independent blocks.

Ids are cut into blocks of ``BLOCK``. A block starts from the file's reset state
and can be decoded alone; its checksum covers its ids. For each id three
predictions are mixed:

* order 2: the id that last followed the two ids before, with how often it held;
* order 1: the same after one id;
* order 0: the id frequencies of the file, kept in its header.

The weights of the predictions adapt to their success inside the block, per
confidence. The mixture drives a carry-less range coder with 64-bit state and
32-bit output words. All blocks of a file advance together, one id per step, as
numpy lanes, so the cost of the interpreter is shared by all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RPID1\0"
BLOCK = 2048
#: Bits of the order-0 scale and of the mixing weights; distinct ids of a file must fit the first.
SCALE, WEIGHT = 18, 8
TOTAL = SCALE + WEIGHT
SLOTS1, SLOTS2, RATE = 9, 10, 4
#: What a weight tends to where its guess is right or wrong; both leave room for the other orders.
RIGHT, WRONG = np.int32(64000), np.int32(512)
LOW32 = np.uint64(0xFFFFFFFF)
U32 = np.uint64(32)


class _Model:
    """Predictions of all lanes; encoder and decoder update it alike.

    A slot holds the id that followed its context and, in two bits, how firmly.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=np.int64)
        self.base1, self.base2, self.base_q = lane << SLOTS1, lane << SLOTS2, lane * 4
        self.slots1 = np.full(lanes << SLOTS1, -4, dtype=np.int32)
        self.slots2 = np.full(lanes << SLOTS2, -4, dtype=np.int32)
        self.rate1 = np.tile(np.array([WRONG, 6000, 20000, 40000], dtype=np.int32), lanes)
        self.rate2 = np.tile(np.array([WRONG, 16000, 36000, 56000], dtype=np.int32), lanes)
        self.last = np.zeros(lanes, dtype=np.int64)
        self.before = np.zeros(lanes, dtype=np.int64)

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """Guesses and weights of the first n lanes; weights of the three orders sum to 2**WEIGHT."""
        last = self.last[:n]
        self.at1 = self.base1[:n] + (last & ((1 << SLOTS1) - 1))
        self.at2 = self.base2[:n] + ((last * 40503 + self.before[:n]) & ((1 << SLOTS2) - 1))
        self.s1, self.s2 = self.slots1.take(self.at1), self.slots2.take(self.at2)
        self.h1, self.h2 = self.s1 & 3, self.s2 & 3
        self.q1, self.q2 = self.base_q[:n] + self.h1, self.base_q[:n] + self.h2
        self.r1, self.r2 = self.rate1.take(self.q1), self.rate2.take(self.q2)
        w2 = self.r2 >> (16 - WEIGHT)
        rest = (1 << WEIGHT) - w2
        w1 = rest * (self.r1 >> (16 - WEIGHT)) >> WEIGHT
        return self.s2 >> 2, self.s1 >> 2, w2, w1, rest - w1

    def update(self, ids: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        n = len(ids)
        fresh = ((ids << 2) | 1).astype(np.int32)
        for right, at, slots, rates, q, s, h, old in (
            (right1, self.at1, self.slots1, self.rate1, self.q1, self.s1, self.h1, self.r1),
            (right2, self.at2, self.slots2, self.rate2, self.q2, self.s2, self.h2, self.r2),
        ):
            rates[q] = old + ((np.where(right, RIGHT, WRONG) - old) >> RATE)
            slots[at] = np.where(right, s + (h != 3), np.where(h > 1, s - 1, fresh))
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and their order-0 frequencies, which sum to 2**SCALE."""
    present, count = np.unique(ids, return_counts=True)
    if len(present) > 1 << (SCALE - 1):
        raise ValueError("too many distinct ids for one file")
    f = np.maximum(1, count * ((1 << SCALE) - len(present)) // max(len(ids), 1)).astype(np.int64)
    if len(f):
        f[np.argmax(f)] += (1 << SCALE) - f.sum()
    return present.astype(np.int64), f


def _intervals(ids, right2, right1, w2, w1, w0, freq, cum) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of every id in the mixture: the order-2 guess, the order-1 guess, all ids by frequency."""
    by1 = right1 & (w1 > 0)
    start = cum.take(ids) * w0 + ((w2 + w1).astype(np.int64) << SCALE)
    width = freq.take(ids) * w0
    at = np.flatnonzero(right2 | by1)
    two = right2[at]
    start[at] = np.where(two, 0, w2[at].astype(np.int64) << SCALE)
    width[at] = np.where(two, w2[at], w1[at]).astype(np.int64) << SCALE
    return start.view(np.uint64), width.view(np.uint64)


def _settle(low: np.ndarray, size: np.ndarray, at: np.ndarray) -> None:
    """Make the top 32 bits of the lanes ``at`` final."""
    lo, sz = low[at], size[at]
    cut = (lo >> U32) != ((lo + (sz - np.uint64(1))) >> U32)
    size[at] = np.where(cut, np.uint64(1 << 32) - (lo & LOW32), sz) << U32
    low[at] = lo << U32


def _lanes(n: int, block: int) -> tuple[int, int]:
    lanes = -(-n // block)
    return lanes, n - (lanes - 1) * block


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file of ids."""
    n = len(ids)
    present, f = frequencies(ids)
    table = zlib.compress(np.diff(present, prepend=0).astype("<u4").tobytes() + f.astype("<u4").tobytes(), 6)
    head = MAGIC + struct.pack("<QIII", n, block, len(present), len(table)) + table
    if not n:
        return head
    freq = np.zeros(int(present[-1]) + 1, dtype=np.int64)
    freq[present] = f
    cum = np.cumsum(freq) - freq
    lanes, short = _lanes(n, block)
    flat = np.zeros(lanes * block, dtype=np.int64)
    flat[:n] = ids
    steps = np.ascontiguousarray(flat.reshape(lanes, block).T)
    model = _Model(lanes)
    low = np.zeros(lanes, dtype=np.uint64)
    size = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    out_lane, out_word = [], []
    for t in range(min(block, n)):
        a = lanes if t < short else lanes - 1
        x = steps[t, :a]
        g2, g1, w2, w1, w0 = model.predict(a)
        right2, right1 = x == g2, x == g1
        start, width = _intervals(x, right2, right1, w2, w1, w0, freq, cum)
        r = size[:a] >> np.uint64(TOTAL)
        low[:a] += r * start
        size[:a] = r * width
        at = np.flatnonzero(size[:a] <= LOW32)
        if len(at):
            out_lane.append(at)
            out_word.append((low[at] >> U32).astype(np.uint32))
            _settle(low, size, at)
        model.update(x, right2, right1)
    every = np.arange(lanes)
    out_lane += [every, every]
    out_word += [(low >> U32).astype(np.uint32), (low & LOW32).astype(np.uint32)]
    lane = np.concatenate(out_lane)
    words = np.concatenate(out_word)[np.argsort(lane, kind="stable")]
    raw = np.asarray(ids, dtype="<u4")
    index = np.empty((lanes, 2), dtype="<u4")
    index[:, 0] = np.bincount(lane, minlength=lanes)
    index[:, 1] = [zlib.crc32(raw[i * block : (i + 1) * block].tobytes()) for i in range(lanes)]
    return head + index.tobytes() + words.astype("<u4").tobytes()


def decode(data: bytes, blocks: np.ndarray | None = None) -> np.ndarray:
    """The ids of a file, or of the given blocks of it; raises ValueError where a checksum fails."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of ids")
    at = len(MAGIC)
    n, block, distinct, size_of_table = struct.unpack_from("<QIII", data, at)
    at += struct.calcsize("<QIII")
    table = np.frombuffer(zlib.decompress(data[at : at + size_of_table]), dtype="<u4").astype(np.int64)
    at += size_of_table
    if not n:
        return np.zeros(0, dtype=np.uint32)
    present, f = np.cumsum(table[:distinct]), table[distinct:]
    freq = np.zeros(int(present[-1]) + 1, dtype=np.int64)
    freq[present] = f
    cum = np.cumsum(freq) - freq
    lookup = np.repeat(present, f)
    lanes, short = _lanes(n, block)
    index = np.frombuffer(data, dtype="<u4", count=2 * lanes, offset=at).reshape(lanes, 2).astype(np.int64)
    words = np.append(np.frombuffer(data, dtype="<u4", offset=at + 8 * lanes), [0, 0]).astype(np.uint64)
    chosen = np.arange(lanes) if blocks is None else np.asarray(blocks)
    lengths = np.where(chosen == lanes - 1, short, block)
    order = np.argsort(-lengths, kind="stable")
    chosen, lengths = chosen[order], lengths[order]
    begin = np.cumsum(index[:, 0]) - index[:, 0]
    pos = begin[chosen].copy()
    model = _Model(len(chosen))
    low = np.zeros(len(chosen), dtype=np.uint64)
    size = np.full(len(chosen), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    code = (words[pos] << U32) | words[pos + 1]
    pos += 2
    out = np.zeros((int(lengths.max()), len(chosen)), dtype=np.uint32)
    for t in range(len(out)):
        a = int((lengths > t).sum())
        g2, g1, w2, w1, w0 = model.predict(a)
        r = size[:a] >> np.uint64(TOTAL)
        v = np.minimum((code[:a] - low[:a]) // r, np.uint64((1 << TOTAL) - 1)).astype(np.int64)
        split2, split1 = w2.astype(np.int64) << SCALE, (w2 + w1).astype(np.int64) << SCALE
        x = np.where(v < split2, g2, g1).astype(np.int64)
        miss = np.flatnonzero(v >= split1)
        x[miss] = lookup[np.minimum((v[miss] - split1[miss]) // w0[miss], (1 << SCALE) - 1)]
        right2, right1 = x == g2, x == g1
        start, width = _intervals(x, right2, right1, w2, w1, w0, freq, cum)
        low[:a] += r * start
        size[:a] = r * width
        need = np.flatnonzero(size[:a] <= LOW32)
        if len(need):
            _settle(low, size, need)
            code[need] = (code[need] << U32) | words[pos[need]]
            pos[need] += 1
        model.update(x, right2, right1)
        out[t, :a] = x
    parts = [None] * len(chosen)
    for i, k in enumerate(order):
        parts[k] = np.ascontiguousarray(out[: lengths[i], i])
        if zlib.crc32(parts[k].astype("<u4").tobytes()) != index[chosen[i], 1]:
            raise ValueError(f"checksum of block {chosen[i]} fails")
    return np.concatenate(parts)
