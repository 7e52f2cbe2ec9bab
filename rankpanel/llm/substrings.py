"""Remove repeated passages of words: seed with winnowed anchors, extend both ways, keep maximal repeats.

A window is ``length`` consecutive words. Its anchor is the least-hashed run of
``gram`` words inside it (winnowing), so two equal windows hold the same anchor
at the same place. Consecutive windows with one anchor form an occurrence: the
anchor with all context, left and right, that its windows reach.

* Seeds: anchors that occur at least twice, found by one aggregate and joined
  back to the occurrences.
* Extension: if all occurrences of an anchor have the same context, they extend
  each other fully and every window repeats. Otherwise each occurrence is
  extended word by word, as far as its windows reach to the left and right, and
  the extensions meet by hash: an occurrence matches another one iff some
  extension of it has a partner. No pair of occurrences is ever formed, so a
  passage shared by a third of all documents costs its number of occurrences.
* Overlapping matched windows join to maximal repeats of at least ``length`` words.

The result is exact up to 64-bit hash collisions. Words are runs of other
characters than space and the controls from tab to carriage return, unchanged.

Rows: one per input row. Null and empty texts have no words; texts shorter than
a window keep all words; a window that repeats inside one text is removed at
both places; repeated rows remove each other's windows; null or repeated keys
are told apart by a row number; an empty table gives an empty result; other
columns are ignored by ``repeats`` and kept by ``remove_repeats``, whose added
columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpanel.llm import words
from rankpanel.llm.tables import row_key, ship_package
from rankpanel.session import materialize

LENGTH, GRAM = 35, 8
#: An occurrence's first window and number of windows share one long.
RUN = 1 << 12


def _occurrences(length: int, gram: int):
    """Per document the occurrences of anchors: anchor hash, context hash, row, first window * RUN + windows."""
    reach = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = words.buffers(batch.column(1))
            for lo, hi in words.pieces(offsets):
                part = data[offsets[lo] : offsets[hi]]
                starts, ends, first = words.spans(part, offsets[lo : hi + 1] - offsets[lo])
                n = len(starts)
                if n < length:
                    continue
                h = words.hashes(part, starts, ends)
                over = words.Windows(h)
                at = np.arange(n - gram + 1)
                grams = over.of(at, at + gram)
                anchor = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1) + np.arange(n - length + 1)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                inside = doc[: n - length + 1] == doc[length - 1 :]
                window = np.flatnonzero(inside)
                if not len(window):
                    continue
                a, d = anchor[window], doc[window]
                new = np.empty(len(window), dtype=bool)
                new[0] = True
                new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
                begin = np.flatnonzero(new)
                count = np.diff(np.append(begin, len(window)))
                s = window[begin]
                context = words.mixed(over.of(s, s + count + length - 1) + (a[begin] - s).astype(np.uint64))
                row = lo + d[begin]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[a[begin]].view(np.int64)),
                        pa.array(context.view(np.int64)),
                        pa.array(ids[row].astype(np.int64)),
                        pa.array((s - first[d[begin]]) * RUN + count),
                    ],
                    ["anchor", "context", "row", "run"],
                )

    return run


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number in the batch, bytes, runs."""
    plain = zstandard.ZstdDecompressor()
    runs = batch.column(2)
    for i, body in enumerate(batch.column(1)):
        found = runs[i].values
        yield i, np.frombuffer(plain.decompress(body.as_py()), np.uint8), np.zeros(0, np.int64) if found is None else found.to_numpy(zero_copy_only=False)


def _extensions(length: int):
    """Every window of the given runs with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for i, data, runs in _unpacked(batch):
                starts, ends, _ = words.spans(data, np.array([0, len(data)]))
                over = words.Windows(words.hashes(data, starts, ends))
                count = runs % RUN
                s = np.repeat(runs // RUN - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(over.of(s, s + length).view(np.int64)),
                        pa.array(np.full(len(s), rows[i].as_py(), dtype=np.int64)),
                        pa.array(s * RUN + 1),
                    ],
                    ["window", "row", "run"],
                )

    return run


def _kept(length: int):
    """The text without the words covered by the given runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts, cut = [], [], [], []
            for _, data, runs in _unpacked(batch):
                starts, ends, _ = words.spans(data, np.array([0, len(data)]))
                edge = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(edge, runs // RUN, 1)
                np.add.at(edge, runs // RUN + runs % RUN + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                n_words.append(len(starts))
                n_removed.append(int(gone.sum()))
                cut.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])])
                raw = data.tobytes()
                texts.append(b" ".join(raw[a:b] for a, b in zip(starts[~gone], ends[~gone])).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(cut, _SPANS), pa.array(texts, pa.string())],
                ["_kept_row", "n_words", "n_removed", "repeats", "kept"],
            )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def repeated_runs(docs: DataFrame, row: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs of windows whose word sequence starts elsewhere too: row, first window * RUN + windows."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(row).cast("long").alias("row"), "text")
    found = materialize(texts.mapInArrow(_occurrences(length, gram), "anchor long, context long, row long, run long"), "anchors")
    seeds = (
        found.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
        .where("n > 1")
        .select(F.col("anchor").alias("_anchor"), (F.col("a") == F.col("b")).alias("whole"))
    )
    seeded = materialize(found.join(seeds, F.col("anchor") == F.col("_anchor")).select("row", "run", "whole"), "seeds")
    partly = seeded.where(~F.col("whole")).groupBy("row").agg(F.collect_list("run").alias("runs"))
    extended = (
        texts.mapInArrow(words.packed, words.PACKED)
        .join(partly, "row")
        .mapInArrow(_extensions(length), "window long, row long, run long")
    )
    extended = materialize(extended, "extensions")
    partnered = extended.groupBy("window").count().where("count > 1").select(F.col("window").alias("_window"))
    matched = extended.join(partnered, F.col("window") == F.col("_window")).select("row", "run")
    return seeded.where("whole").select("row", "run").unionByName(matched)


def remove_repeats(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: key, n_words, n_removed, ``repeats`` (word ranges of maximal repeats), ``kept`` (remaining words)."""
    numbered, row = row_key(docs, key)
    runs = repeated_runs(numbered, row, length, gram).groupBy("row").agg(F.collect_list("run").alias("runs"))
    texts = numbered.select(F.col(row).cast("long").alias("row"), "text").mapInArrow(words.packed, words.PACKED)
    kept = texts.join(runs, "row", "left").mapInArrow(
        _kept(length), "_kept_row long, n_words long, n_removed long, repeats array<struct<start:long,end:long>>, kept string"
    )
    if row == key:
        return kept.withColumnRenamed("_kept_row", key)
    return kept.join(numbered.select(row, key), F.col("_kept_row") == F.col(row)).drop("_kept_row", row)


#: The digest of ``remove_repeats`` over the documents as DuckDB SQL: every window is compared.
ORACLE_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
    d AS (SELECT doc_id, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT doc_id, i + o AS p FROM d, range(35) r(o)),
    runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE q IS NULL OR q < p - 1) AS r FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone) GROUP BY 1),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
    SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(r, 0) AS n_repeats
    FROM w LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""
