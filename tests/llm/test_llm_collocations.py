"""Frequent phrases against direct counting, and the automata against dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pytest

from rankpanel.llm import automata, collocations
from rankpanel.llm.automata import Labels
from rankpanel.session import materialize

SHAPE = "doc_id long, text string, lang string, words int, range int, id long"


def direct(rows, least, longest=5):
    """Every phrase counted; the rules applied literally."""
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, longest + 1):
                    if i + k <= len(ws):
                        count[lang, tuple(ws[i : i + k])] += 1
    out = {}
    found = {p: n for p, n in count.items() if len(p[1]) > 1 and n >= least}
    for (lang, p), a in found.items():
        cuts = [(1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        longer = any(
            q != p and n >= a and other == lang and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), n in found.items() if len(q) > len(p)
        )
        out[lang, " ".join(p)] = (a, count[lang, p[:k]], count[lang, p[k:]], total[lang], score, k, longer)
    return out


def compare(spark, rows, least=3):
    docs = spark.createDataFrame([(i, t, lang, 1, 2, 3) for i, (t, lang) in enumerate(rows)], SHAPE)
    got = collocations.phrases(docs, least).collect()
    want = direct(rows, least)
    assert {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"], r["cut"], r["contained"]) for r in got} == want
    assert len(got) == len(want)
    return docs, want


def test_phrases_equal_direct_counts(spark):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "new", "york", "é", "中文", "x1", "a"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "\x1f "]) for _ in range(rng.randrange(0, 25)))
        rows.append((text, rng.choice(["en", "de", None, ""])))
    rows += [("new york city hall of fame", "en")] * 7 + [("one whole text\nOne whole text", "fr")] * 4 + [(None, "en"), ("", "en"), ("only", None)]
    docs, want = compare(spark, rows)
    top = collocations.top_phrases(collocations.phrases(docs, 3), 5).collect()
    for lang in {k for k, _ in want}:
        ranked = sorted((-w[4], -w[0], p.encode()) for (k, p), w in want.items() if k == lang and not w[6])[:5]
        assert [r["phrase"].encode() for r in sorted(top, key=lambda r: r["rank"]) if r["lang"] == lang] == [p for *_, p in ranked]


def test_phrases_of_one_word_repeated(spark):
    compare(spark, [("ha " * 40, "en"), ("ha " * 40, "en"), ("ha ha. ha", None)])


def test_finished_tables_and_shuffles_are_dropped(spark, monkeypatch):
    written = []

    def noted(df, label, partition_by=()):
        out = materialize(df, label, partition_by)
        written.append((label, [Path(urlsplit(f).path) for f in out.inputFiles()]))
        return out

    monkeypatch.setattr(collocations, "materialize", noted)
    compare(spark, [("to be or not to be", "en")] * 5 + [("to be", "de"), (None, None)])
    left = {label for label, files in written if any(f.exists() for f in files)}
    assert "candidates" in left and not left & {"shards", "reduced", "told-words", "told-pairs"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_shards_carry_words_once():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(20000)).encode()
    shard = collocations._Shard()
    shard.add(text, np.array([0, len(text)]), ["en"])
    row = next(shard.rows(0, 4))
    keys, langs, spelled = collocations.known_words(*row["shard"][:2])
    assert (np.diff(keys) > 0).all() and len(keys) == len(set(text.split())) and set(langs) == {collocations.lang_key("en")}
    assert set(spelled) == set(text.split()) and set(keys) == set(np.concatenate(shard.keys))
    # Without keys, and languages as places, words cost about their spelling.
    assert sum(map(len, row["shard"][:2])) < 4 * len(keys)


def test_phrases_of_empty_and_rare_tables(spark):
    assert collocations.phrases(spark.createDataFrame([], SHAPE), 2).collect() == []
    compare(spark, [("all words differ here", "en"), (None, None)], 2)


def automaton(windows, longest=5):
    keys = np.arange(1, 50, dtype=np.uint64)
    words = np.array([str(int(k)).encode() for k in keys], dtype=object)
    none = np.zeros(len(keys), np.int64)
    rows = np.array([[*w, *[-1] * (longest - len(w))] for w in windows], np.int64).reshape(-1, longest)
    first = collocations.pair_keys(keys[rows[:, 0]], keys[rows[:, 1]])
    return automata.build(Labels(keys, none, none, words), first, rows[:, :2], rows[:, 2:])


def counts(a):
    return {tuple(a.labels.keys[p].tolist()): w[-1] for places, weights in automata.paths(a) for p, w in zip(places, weights.tolist())}


def test_automata_union_cut_prune_and_walk():
    rng = random.Random(9)
    shards = [[tuple(rng.randrange(4) for _ in range(rng.randrange(2, 6))) for _ in range(200)] for _ in range(5)]
    want = Counter(tuple(x + 1 for x in w[:k]) for s in shards for w in s for k in range(2, len(w) + 1))
    whole = automata.union([automata.load(automata.dump(automaton(s))) for s in shards])
    assert counts(whole) == want
    pieces = [(r, p) for s in shards for r, p in automata.cut(automaton(s), 7)]
    merged = {}
    for r in {r for r, _ in pieces}:
        part = automata.prune(automata.union([p for q, p in pieces if q == r]), 4)
        assert not merged.keys() & counts(part).keys()
        merged |= counts(part)
    assert merged == {p: n for p, n in want.items() if n >= 4}
    phrases = [p for p in want if len(p) > 1] + [(9, 9), (1, 2, 40)]
    pad = np.zeros((len(phrases), 5), np.uint64)
    for i, p in enumerate(phrases):
        pad[i, : len(p)] = p
    level, state = automata.walk(whole, collocations.pair_keys(pad[:, 0], pad[:, 1]), pad[:, 2:])
    found = [whole.weights[x][s] if s >= 0 else 0 for x, s in zip(level, state)]
    assert found == [want.get(p, 0) for p in phrases]


@pytest.mark.parametrize("a, total", [(100, 10**6), (10**12, 10**14)])
def test_scores_beyond_64_bits(spark, a, total):
    row = spark.createDataFrame([([1, 2], [a + 7, a + 9], [a], total, {0: 0})], "words array<long>, counts array<long>, weights array<long>, total long, tails map<int,long>")
    best = row.select(collocations._best_cut().alias("b")).first()["b"]
    assert best["score"] == 1000 * a * total // ((a + 7) * (a + 9))
