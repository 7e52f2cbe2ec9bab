"""Weighted acyclic automata over word sequences: counts of phrases as shared prefixes.

A state stands for a phrase prefix of two words or more, its weight for how often
that prefix occurs. The first transition reads a word pair (by its 64-bit key),
every further one a word. States of a level are ordered by (parent, word), so
automata are a few sorted arrays:

* ``build`` adds sorted windows one after another: each adds just the states
  behind the prefix it shares with the one before;
* ``cut`` splits an automaton by ranges of its first transition;
* ``union`` merges automata of a range level by level and sums their weights;
* ``walk`` composes an automaton with a set of phrases and gives their weights.

Words are places in a table of the automaton's own (``labels``): key, and any
columns that describe the word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard

from rankpanel.llm import blocks


@dataclass
class Labels:
    """Words in order of their keys: total count, language key, spelling."""

    keys: np.ndarray
    counts: np.ndarray
    langs: np.ndarray
    words: np.ndarray  # of bytes objects

    def take(self, at: np.ndarray) -> Labels:
        return Labels(self.keys[at], self.counts[at], self.langs[at], self.words[at])


@dataclass
class Automaton:
    labels: Labels
    first: np.ndarray  # uint64 keys of the first transitions, ascending
    pair: np.ndarray  # two label places for each of them
    arcs: list[np.ndarray]  # per further level: parent state << 32 | label place, ascending
    weights: list[np.ndarray]  # per level, the first included


def build(labels: Labels, first: np.ndarray, pair: np.ndarray, rest: np.ndarray) -> Automaton:
    """From windows: key and label places of their first two words, places of the words behind (-1: none)."""
    order = np.lexsort((*rest.T[::-1], first))
    first, pair, rest = first[order], pair[order], rest[order]
    new = np.append(True, first[1:] != first[:-1]) if len(first) else np.zeros(0, bool)
    state = np.cumsum(new) - 1
    arcs, weights = [], [np.bincount(state, minlength=0).astype(np.int64)]
    out_first, out_pair = first[new], pair[new]
    for level in range(rest.shape[1]):
        # Windows that end here drop out; the others stay sorted.
        there = rest[:, level] >= 0
        rest, state = rest[there], state[there]
        arc = (state << 32) | rest[:, level]
        new = np.append(True, arc[1:] != arc[:-1]) if len(arc) else np.zeros(0, bool)
        state = np.cumsum(new) - 1
        arcs.append(arc[new])
        weights.append(np.bincount(state, minlength=0).astype(np.int64))
    return Automaton(labels, out_first, out_pair, arcs, weights)


def _subset(a: Automaton, keep: list[np.ndarray]) -> Automaton:
    """The states of ``keep`` (ascending places per level; parents included), with the labels they use."""
    arcs = []
    for level, arc in enumerate(a.arcs):
        chosen = arc[keep[level + 1]]
        arcs.append((np.searchsorted(keep[level], chosen >> 32) << 32) | (chosen & 0xFFFFFFFF))
    pair = a.pair[keep[0]]
    used = np.unique(np.concatenate([pair.ravel(), *[x & 0xFFFFFFFF for x in arcs]]))
    arcs = [(x >> 32 << 32) | np.searchsorted(used, x & 0xFFFFFFFF) for x in arcs]
    return Automaton(a.labels.take(used), a.first[keep[0]], np.searchsorted(used, pair), arcs, [w[k] for w, k in zip(a.weights, keep)])


def prune(a: Automaton, least: int) -> Automaton:
    """Without the states below a weight; no state weighs more than its parent."""
    return _subset(a, [np.flatnonzero(w >= least) for w in a.weights])


def range_of(first: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a first transition: equal parts of the key space, in order."""
    return (((first >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)


def cut(a: Automaton, ranges: int):
    """(range, automaton) for every range that has states."""
    edges = [np.searchsorted(range_of(a.first, ranges), np.arange(ranges + 1))]
    for arc in a.arcs:
        edges.append(np.searchsorted(arc >> 32, edges[-1]))
    for r in range(ranges):
        if edges[0][r] < edges[0][r + 1]:
            yield r, _subset(a, [np.arange(e[r], e[r + 1]) for e in edges])


def union(parts: list[Automaton]) -> Automaton:
    """One automaton with the summed weights of all."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([p.labels.keys for p in parts]), return_index=True)
    labels = Labels(keys, *[np.concatenate([getattr(p.labels, c) for p in parts])[at] for c in ("counts", "langs", "words")])
    place = [np.searchsorted(keys, p.labels.keys) for p in parts]
    first, index, state = np.unique(np.concatenate([p.first for p in parts]), return_index=True, return_inverse=True)
    pair = np.concatenate([pl[p.pair] for p, pl in zip(parts, place)])[index]
    arcs, weights = [], [_sums(state, [p.weights[0] for p in parts])]
    for level in range(len(parts[0].arcs)):
        begin = np.cumsum([0, *[len(p.weights[level]) for p in parts]])
        joined = np.concatenate([(state[b + (p.arcs[level] >> 32)] << 32) | pl[p.arcs[level] & 0xFFFFFFFF] for p, pl, b in zip(parts, place, begin)])
        arc, state = np.unique(joined, return_inverse=True)
        arcs.append(arc)
        weights.append(_sums(state, [p.weights[level + 1] for p in parts]))
    return Automaton(labels, first, pair, arcs, weights)


def _sums(state: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(int(state.max()) + 1 if len(state) else 0, np.int64)
    np.add.at(out, state, np.concatenate(weights))
    return out


def walk(a: Automaton, first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and state of phrases, given the key of their first pair and the keys of the words behind; -1 where there is none.

    ``rest`` has word keys in columns; zero marks the end.
    """
    state = _find(a.first, first)
    level = np.zeros(len(first), np.int64)
    for i, arc in enumerate(a.arcs):
        goes = (rest[:, i] != 0) & (state >= 0)
        label = _find(a.labels.keys, rest[goes, i])
        state[goes] = np.where(label < 0, -1, _find(arc, (state[goes] << 32) | np.maximum(label, 0)))
        level[goes] += 1
    return level, state


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, keys)
    found = at < len(table)
    found[found] = table[at[found]] == keys[found]
    return np.where(found, at, -1)


def paths(a: Automaton):
    """Per level from the second word on: label places of all states' phrases, and the weights along them."""
    words, weights = a.pair, a.weights[0][:, None]
    yield words, weights
    for arc, weight in zip(a.arcs, a.weights[1:]):
        parent = arc >> 32
        words = np.column_stack([words[parent], arc & 0xFFFFFFFF])
        weights = np.column_stack([weights[parent], weight])
        yield words, weights


def dump(a: Automaton) -> list[bytes]:
    text = zstandard.ZstdCompressor(level=3).compress(b" ".join(a.labels.words.tolist()))
    head = [blocks.pack(a.labels.keys.view(np.int64)), blocks.pack(a.labels.counts, False), blocks.pack_few(a.labels.langs), text]
    body = [blocks.pack(a.first.view(np.int64)), blocks.pack(a.pair.ravel(), False), blocks.pack(a.weights[0], False)]
    return [*head, *body, *[x for arc, w in zip(a.arcs, a.weights[1:]) for x in (blocks.pack(arc), blocks.pack(w, False))]]


def spelled(n: int, packed: bytes) -> np.ndarray:
    out = np.empty(n, dtype=object)
    if n:
        out[:] = zstandard.ZstdDecompressor().decompress(packed).split(b" ")
    return out


def load(data: list[bytes]) -> Automaton:
    keys = blocks.unpack(data[0]).view(np.uint64)
    labels = Labels(keys, blocks.unpack(data[1], False), blocks.unpack_few(data[2]), spelled(len(keys), data[3]))
    tail = data[7:]
    return Automaton(
        labels, blocks.unpack(data[4]).view(np.uint64), blocks.unpack(data[5], False).reshape(-1, 2), [blocks.unpack(x) for x in tail[::2]],
        [blocks.unpack(data[6], False), *[blocks.unpack(x, False) for x in tail[1::2]]],
    )
