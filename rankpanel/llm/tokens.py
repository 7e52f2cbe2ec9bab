"""Write documents as range-coded token-id files, and read the files back.

Documents are range-sorted by id, tokenised, ended with the end id and collected
to files of about ``FILE_IDS`` ids. A file is the byte string of ``range_coder``
(header, checksummed blocks) in the ``payload`` of one row of a Parquet table,
beside its place (``part``, ``file``) and its documents' keys and lengths: so
any store that Spark writes will do, and files are read back in parallel.

Tokenising works on the distinct pieces of a file: texts are cut before single
spaces, around single line ends between other characters and between a Latin
letter and a mark, where a byte-level BPE with the usual word pattern always
cuts, so the ids are those of the whole text. New pieces that are one Latin word are given to the tokenizer's model
as they are, others to the whole tokenizer. Ids of pieces are kept between the files
of a worker, up to ``KEPT`` pieces.

Rows: one per input row. Null and empty texts have the end id only; rows of one
key are ordered by a hash of the text; null keys come first; very long texts
make a longer file; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankpanel.llm import range_coder, words
from rankpanel.llm.tables import ship_package
from rankpanel.session import scratch_path, shuffle_partitions

END = 2
FILE_BYTES, FILE_IDS = 2 << 20, 1 << 21
KEPT, PIECES = 1_000_000, 8192
FILES = "part int, file int, n_ids long, keys array<long>, counts array<long>, payload binary"

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: Lead bytes of the characters outside ASCII that count as white space.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Second bytes of the signs of multiplication and division, which stand among the letters U+00C0 to U+00FF.
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[[0x97, 0xB7]] = True
MARKS = b".,;:!?)*#$%"


def _byte_letters() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def marks_table(marks: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(marks)] = True
    return table


def cut_points(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Starts of pieces that can be tokenised alone, row starts included; ``marks`` are the bytes before which a letter ends a piece."""
    n = len(data)
    rows = offsets[:-1][np.diff(offsets) > 0]
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 2) & (at < n - 1)]
    at = at[~np.isin(at, offsets) & ~np.isin(at + 1, offsets)]
    p1, p2, p3 = data[at - 1], data[at - 2], data[at - 3]
    wide = ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p2 == 0x80) & ((p3 == 0xE2) | (p3 == 0xE3))) | ((p3 == 0xE2) & (p2 == 0x81)) | ((p3 == 0xE1) & (p2 == 0x9A))
    at = at[~_WHITE[p1] & ~wide & ~_WHITE[data[at + 1]] & ~_LEAD[data[at + 1]]]
    cuts = np.zeros(n + 1, dtype=bool)
    if marks is not None and n > 2:
        latin = (data[:-2] == 0xC3) & ~_SIGNS[data[1:-1]]
        cuts[2:n] = marks[data[2:]] & (_LETTER[data[1:-1]] | latin)
    cuts[rows] = cuts[at] = cuts[at[data[at] == 0x0A] + 1] = True
    return np.flatnonzero(cuts[:n])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, a place of each, and every row's number among them."""
    coded = pa.array(keys).dictionary_encode()
    which, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.empty(len(found), dtype=np.int64)
    first[which] = np.arange(len(keys))
    order = np.argsort(found)
    number = np.empty(len(found), dtype=np.int32)
    number[order] = np.arange(len(found), dtype=np.int32)
    return found[order], first[order], number[which]


class PieceTokenizer:
    """Ids of texts through a tokenizer file, piece by piece."""

    def __init__(self, path: str):
        # One thread per task: cores belong to Spark, and every thread of the tokenizer would keep memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A mark that stands in an added token does not end a piece.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = marks_table(bytes(b for b in MARKS if b not in "".join(added).encode()))
        self.by_word = self._by_word(added)
        self.known = np.zeros(0, dtype=np.uint64)
        self.begin, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def _by_word(self, added: list[str]) -> bool:
        """Whether a word of letters reaches the model as one unchanged piece."""
        from tokenizers import models, pre_tokenizers

        cut = self.tokenizer.pre_tokenizer
        plain = self.tokenizer.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        return plain and isinstance(self.tokenizer.model, models.BPE) and not any(t.strip().isalpha() for t in added)

    def _whole(self, some: list[bytes]) -> list[list[int]]:
        return [d.ids for d in self.tokenizer.encode_batch_fast([b.decode() for b in some], add_special_tokens=False)]

    def _words(self, some: list[bytes]) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(b.decode("latin-1").translate(_BYTE_LETTERS))] for b in some]

    def _fresh(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces in an order of their own, where each piece's begin, and how many they are."""
        raw = data.tobytes()
        # Words: letters up to U+00FF, with at most one space in front.
        lead = np.append(data[:-1] == 0xC3, False) & np.append(~_SIGNS[data[1:]], False)
        letter = _LETTER[data] | lead
        letter[1:] |= lead[:-1]
        other = np.concatenate([[0], np.cumsum(~letter)])
        head = start + (data[start] == 0x20)
        word = (other[end] == other[head]) & (head < end) & self.by_word
        order = np.argsort(~word, kind="stable")
        split = int(word.sum())
        ids, counts = [], []
        for a, b, ids_of in ((0, split, self._words), (split, len(start), self._whole)):
            for lo in range(a, b, PIECES):  # what the tokenizer returns is large beside the ids
                some = order[lo : min(lo + PIECES, b)]
                got = ids_of([raw[s:e] for s, e in zip(start[some].tolist(), end[some].tolist())])
                counts.append(np.fromiter(map(len, got), dtype=np.int64, count=len(got)))
                ids.append(np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(counts[-1].sum())))
        count = np.empty(len(start), dtype=np.int64)
        begin = np.empty(len(start), dtype=np.int64)
        count[order] = placed = np.concatenate([np.zeros(0, np.int64), *counts])
        begin[order] = np.cumsum(placed) - placed
        return np.concatenate([np.zeros(0, np.int32), *ids]), begin, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the number of ids of each row."""
        start = cut_points(data, offsets, self.marks)
        if not len(start):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets) - 1, dtype=np.int64)
        end = np.append(start[1:], len(data))
        key, first, which = _distinct(words.hashes(data, start, end))
        at = np.searchsorted(self.known, key)
        have = np.zeros(len(key), dtype=bool)
        inside = at < len(self.known)
        have[inside] = self.known[at[inside]] == key[inside]
        new = np.flatnonzero(~have)
        ids, begin, count = self._fresh(data, start[first[new]], end[first[new]])
        pool = np.concatenate([self.ids, ids])
        begin_of, count_of = np.empty(len(key), dtype=np.int64), np.empty(len(key), dtype=np.int64)
        begin_of[have], count_of[have] = self.begin[at[have]], self.count[at[have]]
        begin_of[new], count_of[new] = len(self.ids) + begin, count
        long = count_of[which]
        source = np.repeat(begin_of[which] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        per_row = np.add.reduceat(np.append(long, 0), np.minimum(np.searchsorted(start, offsets[:-1]), len(long))) * (np.diff(offsets) > 0)
        out = pool[source]
        room = KEPT - len(self.known)
        if room > 0 and len(new):
            kept = new[:room]
            order = np.argsort(np.concatenate([self.known, key[kept]]), kind="stable")
            self.known = np.concatenate([self.known, key[kept]])[order]
            self.begin = np.concatenate([self.begin, begin_of[kept]])[order]
            self.count = np.concatenate([self.count, count_of[kept]])[order]
            self.ids = pool
        return out, per_row


_tokenizers: dict[str, PieceTokenizer] = {}


def _written(path: str | None, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("byte_bpe_50k.json")
        if where not in _tokenizers:
            _tokenizers[where] = PieceTokenizer(where)
        tokenizer = _tokenizers[where]
        part = TaskContext.get().partitionId()
        keys: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        number = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, keys, counts, ids
            flat = np.concatenate(ids)
            row = {"part": part, "file": number, "n_ids": len(flat), "keys": keys, "counts": np.concatenate(counts), "payload": range_coder.encode(flat, block)}
            number, keys, counts, ids = number + 1, [], [], []
            return pa.RecordBatch.from_pylist([row], schema=_FILES_ARROW)

        for batch in batches:
            data, offsets = words.buffers(batch.column(1))
            for lo, hi in words.pieces(offsets, FILE_BYTES):
                got, per = tokenizer.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids.append(np.insert(got, np.cumsum(per), end))
                counts.append(per + 1)
                keys += batch.column(0).slice(lo, hi - lo).to_pylist()
                if sum(map(len, ids)) >= FILE_IDS:
                    yield flush()
        if keys:
            yield flush()

    return run


_FILES_ARROW = pa.schema([
    ("part", pa.int32()), ("file", pa.int32()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def write_ids(docs: DataFrame, target: str, key: str = "doc_id", tokenizer: str | None = None, end: int = END, block: int = range_coder.BLOCK) -> None:
    """Write the files of ids, in ascending order of ``key``. ``tokenizer`` is a path that every executor can read."""
    ship_package(docs.sparkSession)
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    texts = docs.select(F.col(key).cast("long").alias("key"), "text").repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
    texts.sortWithinPartitions(*order).mapInArrow(_written(tokenizer, end, block), FILES).write.parquet(target)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = range_coder.decode(batch.column(2)[r].as_py()).astype("<u4")
                counts = batch.column(1)[r].values.to_numpy()
                stop = np.cumsum(counts)
                begin = stop - counts
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist())]
                columns = [batch.column(0)[r].values, pa.array(begin + batch.column(3)[r].as_py()), pa.array(counts), pa.array(crc, pa.int64())]
                names = ["key", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_ids(spark: SparkSession, source: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents of the files: key, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids.

    Starts come from a running total over one small row per file.
    """
    ship_package(spark)
    files = spark.read.schema(FILES).parquet(source)
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "file", "n_ids").withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    starts = starts.select(F.col("part").alias("_part"), F.col("file").alias("_file"), "first")
    placed = files.join(starts, (F.col("part") == F.col("_part")) & (F.col("file") == F.col("_file"))).select("keys", "counts", "payload", "first")
    shape = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return placed.mapInArrow(_read(with_ids), shape).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Write the documents' ids to a scratch folder and describe what is read back."""
    target = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, target, key, tokenizer)
    return read_ids(docs.sparkSession, target, key, with_ids=False)
