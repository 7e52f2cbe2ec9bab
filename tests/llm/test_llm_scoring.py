"""Language-model scores against a direct PPM over dictionaries."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankpanel.llm import blocks, ppm

SHAPE = "doc_id long, text string, score string, id int, part int"


class Direct:
    """Escapes and exclusions by sets of symbols, order by order."""

    def __init__(self, texts, order=ppm.ORDER):
        self.order, self.after = order, defaultdict(Counter)
        for text in texts:
            raw = b"\xff" * order + (text or "").encode().lower() + b"\xff"
            for i in range(order, len(raw)):
                for k in range(order + 1):
                    self.after[raw[i - k : i]][raw[i]] += 1

    def probability(self, context, symbol):
        p, gone = 1.0, set()
        for k in range(self.order, -1, -1):
            here = self.after.get(context[len(context) - k :])
            if not here:
                continue
            left = {s: c for s, c in here.items() if s not in gone}
            n = sum(left.values())
            if symbol in left:
                return p * (left[symbol] - 0.5) / n
            if left:
                p *= len(left) / 2 / n
            gone |= set(here)
        return p / (256 - len(gone))

    def score(self, text):
        raw = b"\xff" * self.order + (text or "").encode().lower() + b"\xff"
        return sum(math.log10(self.probability(raw[i - self.order : i], raw[i])) for i in range(self.order, len(raw)))


def words_of(text):
    out, word = [], ""
    for c in (text or ""):
        c = c.lower() if c.isascii() else c
        if c in " \t\n\x0b\x0c\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def expected(rows):
    held = [zlib.crc32(str(k).encode()) % 5 == 1 if k is not None else False for k, _ in rows]
    train = [t for (_, t), h in zip(rows, held) if not h]
    model, count = Direct(train), Counter(w for t in train for w in [*words_of(t), None])
    n, v = sum(count.values()), len(count)
    out = []
    for (k, t), h in zip(rows, held):
        own = [*words_of(t), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((k, h, len(own), sum(count[w] > 0 for w in own), n, base, model.score(t)))
    return out


def compare(spark, rows):
    # More columns, with names that the operator uses itself.
    docs = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], SHAPE)
    got = sorted((tuple(r) for r in ppm.score(docs, ppm.held_out()).collect()), key=repr)
    want = sorted(expected(rows), key=repr)
    assert len(got) == len(want)
    key = lambda r: (repr(r[:5]), round(r[6], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-8) and g[6] == pytest.approx(w[6], abs=1e-8)


def test_ppm_equals_the_direct_model(spark):
    texts = ["the cat sat on the mat", "The CAT sat", "aé中 b", "", None, " ", "zzzz zz\x00\x0bq", "the cat sat on the mat", "x" * 300, "the hat\nsat on the cat"]
    compare(spark, [(i, t) for i, t in enumerate(texts * 3)])


def test_ppm_null_and_repeated_keys(spark):
    compare(spark, [(None, "one two"), (None, "one two"), (7, "two three"), (7, "two three"), (4, None)])


def test_ppm_without_training_rows_or_rows(spark):
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1][:3]
    compare(spark, [(k, "ab c") for k in held])
    none = spark.createDataFrame([], SHAPE)
    assert ppm.score(none, ppm.held_out()).collect() == []


def test_strings_are_counted_alike_in_chunks(monkeypatch):
    raw, lengths = b"abracadabra" * 20, np.array([100, 0, 120])
    found = []
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(ppm, "CHUNK", chunk)
        counter = blocks.Counter()
        ppm._count_strings(raw, lengths, counter, True)
        found.append([x.tolist() for x in counter.total()])
    assert found[0] == found[1] and sum(found[0][1]) == 223


def test_ppm_long_texts_and_text_keys(spark):
    text = "ab ra ca da bra " * 40
    docs = spark.createDataFrame([(f"d{i}", text[i:]) for i in range(12)], "name string, text string")
    got = {r["name"]: r["score"] for r in ppm.score(docs, F.col("name") == "d3", "name").collect()}
    model = Direct([text[i:] for i in range(12) if i != 3])
    assert all(got[f"d{i}"] == pytest.approx(model.score(text[i:]), abs=1e-7) for i in range(12))


def test_probabilities_sum_to_one():
    model = Direct(["abab", "abc", "bü"])
    for context in (b"\xff" * 5, b"\xff\xffaba", b"zzzzz"):
        assert sum(model.probability(context, s) for s in range(256)) == pytest.approx(1.0)


def test_packed_keys_round_trip():
    keys = np.sort(np.array([-(2**63), -5, 0, 1, 2**63 - 1]))
    assert (blocks.unpack(blocks.pack(keys)) == keys).all()
    assert len(blocks.unpack(blocks.pack(np.zeros(0, np.int64)))) == 0
    counter = blocks.Counter(limit=3)
    for _ in range(4):
        counter.add(np.array([3, 1, 3]), np.array([1, 2, 3]))
    assert [x.tolist() for x in counter.total()] == [[1, 3], [8, 16]]
