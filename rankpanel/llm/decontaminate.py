"""Find benchmark items in documents by edit distance, through random-walk embedding and bit sampling.

An item of n words is in a document if a run of the document's words can be
turned into it with at most (1 - ``least``) * n word edits. Words are runs of
letters and digits in lower case, so punctuation and case do not matter.

* Windows as long as the items are taken at every word of the document, one per
  length class (classes grow by a quarter). A window that matches keeps all
  but two pairs of neighbouring words per edit, so windows with fewer pairs
  known from any item are passed over; that test loses nothing.
* The other windows are embedded by a random walk: step j puts out the word
  under the pointer and moves on if a random bit of (j, word) says so. Texts at
  a small edit distance get embeddings at a small Hamming distance. Each of
  ``REPEATS`` walks is sampled at ``SAMPLED`` coordinates; items and windows
  that agree in one sample are joined.
* Candidates are verified by the exact edit distance of the item to the best
  run of words in the window.

The filters that tasks hold are bitmaps of fixed size, whatever the benchmark's;
items themselves are joined as a table. Items of fewer than ``MIN_WORDS`` words
are not searched for.

Rows: one per (document, item) found, with its best place. Null and empty texts
hold nothing; repeated items are each found; repeated rows of one key are
merged; null keys are matched as one key; ties take the first place; empty
tables give an empty result; other columns are ignored by ``matches`` and kept
by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpanel.llm import words
from rankpanel.llm.tables import bitmap, in_bitmap, ship_package
from rankpanel.session import materialize

LEAST, MIN_WORDS, GROWTH = 0.8, 8, 1.25
REPEATS, SAMPLED = 24, 2
PAIR_BITS, SAMPLE_BITS = 22, 22


def length_class(n: int, growth: float = GROWTH) -> tuple[int, int]:
    """The class [low, high) of an item of n words."""
    low = MIN_WORDS
    while True:
        high = max(low + 1, int(low * growth))
        if n < high:
            return low, high
        low = high


def _walk_plan(low: int) -> tuple[np.ndarray, np.ndarray]:
    """Salts of the walk's steps and the sampled coordinates, per repeat."""
    random = np.random.default_rng([31, low])
    salts = random.integers(1, 1 << 63, (2 * low, REPEATS, 1), dtype=np.uint64)
    coordinates = np.stack([random.choice(2 * low, SAMPLED, replace=False) for _ in range(REPEATS)])
    return salts, coordinates


def samples(h: np.ndarray, start: np.ndarray, stop: np.ndarray, low: int) -> np.ndarray:
    """REPEATS sampled values of the walks that begin at ``start`` and end at ``stop``."""
    salts, coordinates = _walk_plan(low)
    at = np.repeat(start[None, :], REPEATS, axis=0)
    out = np.repeat(np.arange(REPEATS, dtype=np.uint64)[:, None] + np.uint64(low * 1000), len(start), axis=1)
    padded = np.append(h, np.uint64(0))
    for j in range(int(coordinates.max()) + 1):
        inside = at < stop
        word = padded[np.where(inside, at, len(h))]
        picked = (coordinates == j).any(axis=1)
        if picked.any():
            out[picked] = words.mixed(out[picked] * np.uint64(0x9E3779B97F4A7C15) + word[picked])
        bit = (words.mixed(word ^ salts[j]) & np.uint64(1)).astype(np.int64)
        at += bit * inside
    return out


def _piece(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = words.spans(part, offsets, words.PUNCTUATION)
    return words.hashes(part, starts, ends), first, starts, ends


def _neighbours(h: np.ndarray) -> np.ndarray:
    at = np.arange(max(len(h) - 1, 0))
    return words.Windows(h).of(at, at + 2)


def _item_values(kind: str):
    """Per item its word pairs (kind "pairs") or sampled values with its length class (kind "samples")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch.column(1))
            h, first, _, _ = _piece(data, offsets)
            values, sizes, lows, highs = [], [], [], []
            for a, b in zip(first, first[1:]):
                own = h[a:b]
                low, high = length_class(max(len(own), MIN_WORDS))
                if len(own) < MIN_WORDS:
                    values.append(np.zeros(0, np.int64))
                elif kind == "pairs":
                    values.append(_neighbours(own).view(np.int64))
                else:
                    values.append(samples(own, np.array([0]), np.array([len(own)]), low)[:, 0].view(np.int64))
                sizes.append(len(own))
                lows.append(low)
                highs.append(high)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(values, pa.list_(pa.int64()))],
                ["item", "n", "low", "high", "values"],
            )

    return run


def _regions(pairs, sampled, classes: list[tuple[int, int]], least: float):
    """Stretches of documents whose windows share a sample with an item: row, first word, words, samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair_map, sample_map = pairs.value, sampled.value
        for batch in batches:
            data, offsets = words.buffers(batch.column(1))
            rows, begins, texts, values = [], [], [], []
            for lo, hi in words.pieces(offsets, 1 << 22):
                part = data[offsets[lo] : offsets[hi]]
                h, first, starts, ends = _piece(part, offsets[lo : hi + 1] - offsets[lo])
                if len(h) < MIN_WORDS // 2:
                    continue
                count = np.diff(first)
                doc = np.repeat(np.arange(hi - lo), count)
                stop = np.repeat(first[1:], count)
                known = np.append(in_bitmap(pair_map, _neighbours(h), PAIR_BITS), False)
                known &= np.arange(1, len(h) + 1) < stop
                total = np.append(0, np.cumsum(known))
                for low, high in classes:
                    edits = int((1 - least) * (high - 1) + 1e-9)
                    last = np.minimum(np.arange(len(h)) + low - 1, stop - 1)
                    s = np.flatnonzero(total[np.maximum(last, 0)] - total[:-1] >= low - 1 - 2 * edits)
                    if not len(s):
                        continue
                    got = samples(h, s, stop[s], low)
                    hit = in_bitmap(sample_map, got, SAMPLE_BITS)
                    found = hit.any(axis=0)
                    s, got, hit = s[found], got[:, found], hit[:, found]
                    if not len(s):
                        continue
                    cut = np.flatnonzero((np.diff(s) > 4) | (np.diff(doc[s]) != 0)) + 1
                    for group in np.split(np.arange(len(s)), cut):
                        a = max(int(s[group[0]]) - edits, int(first[doc[s[group[0]]]]))
                        b = min(int(s[group[-1]]) + high + edits, int(stop[s[group[0]]]))
                        rows.append(lo + int(doc[s[group[0]]]))
                        begins.append(a - int(first[doc[s[group[0]]]]))
                        texts.append(b" ".join(part[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b])).decode())
                        values.append(np.unique(got[:, group][hit[:, group]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(begins, pa.int64()), pa.array(texts, pa.string()), pa.array(values, pa.list_(pa.int64()))],
                ["row", "begin", "region", "values"],
            )

    return run


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to a run of the text's words, and where the first such run ends."""
    n = len(item)
    steps = np.arange(n + 1)
    column, best, end = steps.copy(), n, 0
    for j, word in enumerate(text):
        fresh = np.empty(n + 1, dtype=np.int64)
        fresh[0] = 0
        np.minimum(column[:-1] + (item != word), column[1:] + 1, out=fresh[1:])
        column = np.minimum.accumulate(fresh - steps) + steps
        if column[n] < best:
            best, end = int(column[n]), j + 1
    return best, end


def place(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """The least edit distance to a run of the text and the run's end, or None if it is more than ``most``.

    An exact run is looked for first; then the words that the text lacks, each
    of which costs an edit; only what passes both is aligned.
    """
    n = len(item)
    for at in np.flatnonzero(text[: max(len(text) - n + 1, 0)] == item[0]):
        if (text[at : at + n] == item).all():
            return 0, int(at) + n
    if (~np.isin(item, text)).sum() > most:
        return None
    best, end = best_run(item, text)
    return (best, end) if best <= most else None


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = []
            for k in (3, 4):
                data, offsets = words.buffers(batch.column(k))
                h, first, _, _ = _piece(data, offsets)
                split.append([h[a:b] for a, b in zip(first, first[1:])])
            size = np.array([len(item) for item in split[1]], dtype=np.int64)
            got = [place(item, text, int((1 - least) * len(item) + 1e-9)) for text, item in zip(*split)]
            keep = pa.array([g is not None for g in got], pa.bool_())
            edits = np.array([g[0] if g else 0 for g in got], dtype=np.int64)
            end = pa.array(np.array([g[1] if g else 0 for g in got], dtype=np.int64) + batch.column(1).to_numpy())
            columns = [batch.column(0), batch.column(2), pa.array(edits), pa.array(1 - edits / np.maximum(size, 1)), end]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["row", "item", "edits", "similarity", "end_word"])

    return run


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", least: float = LEAST) -> DataFrame:
    """(key, item_key, edits, similarity, end_word) for every item found in a document."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = items.where(F.col("text").isNotNull()).select(F.col(item_key).cast("long").alias("item"), F.lower("text").alias("text"))
    shape = "item long, n int, low int, high int, values array<long>"
    pairs = texts.mapInArrow(_item_values("pairs"), shape).select(F.explode("values").alias("pair"))
    sampled = texts.mapInArrow(_item_values("samples"), shape).where(f"n >= {MIN_WORDS}")
    sampled = materialize(sampled.select("item", "low", "high", F.explode("values").alias("value")), "item-samples")
    classes = [tuple(r) for r in sampled.select("low", "high").distinct().orderBy("low").collect()]
    pair_map = spark.sparkContext.broadcast(bitmap(pairs, "pair", PAIR_BITS))
    sample_map = spark.sparkContext.broadcast(bitmap(sampled, "value", SAMPLE_BITS))
    lowered = docs.where(F.col("text").isNotNull()).select(F.col(key).cast("long").alias("row"), F.lower("text").alias("text"))
    regions = lowered.mapInArrow(_regions(pair_map, sample_map, classes, least), "row long, begin long, region string, values array<long>")
    regions = materialize(regions, "regions")
    keyed = regions.select("row", "begin", "region", F.explode("values").alias("_value"))
    met = keyed.join(sampled.select("item", "value"), F.col("_value") == F.col("value")).select("row", "begin", "region", "item").distinct()
    wanted = met.join(texts.select(F.col("item").alias("_item"), "text"), F.col("item") == F.col("_item")).select("row", "begin", "item", "region", "text")
    found = wanted.mapInArrow(_verified(least), "row long, item long, edits long, similarity double, end_word long")
    best = F.min(F.struct("edits", "end_word", "similarity")).alias("best")
    return found.groupBy(F.col("row").alias(key), F.col("item").alias(item_key)).agg(best).select(key, item_key, "best.edits", "best.similarity", "best.end_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", least: float = LEAST) -> DataFrame:
    """The documents in which no item was found, with all their columns."""
    bad = matches(docs, items, key, item_key, least).select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, F.col(key).eqNullSafe(F.col("_bad")), "left_anti")
