"""Align the tokens of two tokenizers over the bytes of each text, by interval coalescing.

Both token sequences of a text are intervals on one number line. All of them are
lexsorted by start; ``maximum.accumulate`` of the ends tells how far the
intervals so far reach, and a new group begins where a start reaches that
maximum: there tokens of both sides end. Inside the groups overlapping A and B
tokens are linked. How often two ids are linked is counted over all documents
(``blocks``), and every document gets the sums over its own links.

Tokens of A cover a space and the text, as B's do, which puts that space before
the text itself. Texts are cut before single spaces and around single line ends,
where both tokenizers always cut; equal pieces are aligned once per worker and
remembered, up to ``KEPT`` pieces. The cuts assume a byte-level BPE with the usual
word pattern (A) and a sentence-piece BPE without pieces that hold a space
behind another character (B).

Rows: one per input row, keys of any type, null and repeated keys included.
Texts that are null, empty, or whose joined token bytes differ from space + text
have no tokens: zeros and an empty digest; ids of tied counts are all best; an
empty table gives an empty result; very long texts make one large piece list,
nothing is cut off; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from rankpanel.llm import blocks, words
from rankpanel.llm.tables import arrow_rows, ship_package
from rankpanel.llm.tokens import cut_points
from rankpanel.session import materialize, shuffle_partitions

#: Bytes of a unit (handled at once) and of a block (asks for counts once); pieces a worker remembers.
UNIT, BLOCK, KEPT = 4 << 20, 32 << 20, 300_000
#: Pieces that are tokenised at once; rows of an Arrow batch of documents, and of units.
BATCH, ROWS, UNITS = 8192, 2048, 8
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a: str | None = None, b: str | None = None):
        # One thread per task: cores belong to Spark.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        if a is None or b is None:
            import public_tokenizers

            a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = SentencePieceProcessor(model_file=b)
        self.line = self.b.encode("\n")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))
        ]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a, b = [], []
        for lo in range(0, len(texts), BATCH):
            some = texts[lo : lo + BATCH]
            a += [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            # B puts a space before a text. Pieces bring their own; others hide behind a line end, which is always a token.
            spaced = [t[1:] if t[0] == " " else "\n" + t for t in some]
            b += [x if t[0] == " " else x[len(self.line) :] for t, x in zip(some, self.b.encode(spaced, num_threads=1))]
        return a, b


def coalesce(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of intervals by start, and in that order the number of each one's group."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    return order, np.cumsum(np.append(False, start[order][1:] >= reach[:-1]))


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all overlapping pairs of two tilings, in order of A."""
    first = np.searchsorted(end_b, start_a, side="right")
    count = np.searchsorted(start_b, end_a, side="left") - first
    left = np.repeat(np.arange(len(start_a)), count)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Aligned:
    """What is known about pieces: token counts, groups as text, linked pairs."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        a, b = (max(t) + 1 if isinstance(t, dict) else len(t) for t in (tokenizers.bytes_a, tokenizers.bytes_b))
        self.size = max(a, b)
        self.length = [np.zeros(self.size, np.int64) for _ in range(2)]
        for length, of in zip(self.length, (tokenizers.bytes_a.items(), enumerate(tokenizers.bytes_b))):
            for i, x in of:
                length[i] = len(x)
        # An id as text with each of the four signs that may follow it.
        self.signed = [f"{i}{sign}" for sign in (",", "|", ";", "\n") for i in range(self.size)]
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.stats = np.zeros((5, 0), np.int64)  # n_a, n_b, n_groups, n_links, right
        self.texts: list[str] = []
        self.uses = np.zeros(0, np.int64)  # units that had the piece
        self.begin, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that most units had."""
        least = 2
        while (keep := np.flatnonzero(self.uses >= least)).size > KEPT // 2:
            least *= 2
        links, count = self.links_of(keep)
        place = np.full(len(self.texts), -1)
        place[keep] = np.arange(len(keep))
        here = place[self.slot] >= 0
        self.key, self.slot = self.key[here], place[self.slot[here]]
        self.stats, self.uses, self.texts = self.stats[:, keep], self.uses[keep], [self.texts[i] for i in keep.tolist()]
        self.begin, self.links = np.cumsum(count) - count, links

    def slots(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of every piece among the known ones, after the new ones are aligned."""
        key, first, which = np.unique(words.hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.key) > KEPT:
            self._forget()
        at = np.searchsorted(self.key, key)
        new = np.ones(len(key), dtype=bool)
        inside = at < len(self.key)
        new[inside] = self.key[at[inside]] != key[inside]
        if new.any():
            raw = data.tobytes()
            spans = list(zip(start[first[new]].tolist(), end[first[new]].tolist()))
            for lo in range(0, len(spans), BATCH):
                self._learn([raw[a:b] for a, b in spans[lo : lo + BATCH]])
            keys = np.concatenate([self.key, key[new]])
            order = np.argsort(keys, kind="stable")
            self.key, self.slot = keys[order], np.append(self.slot, np.arange(len(self.texts) - len(spans), len(self.texts)))[order]
            at = np.searchsorted(self.key, key)
        slots = self.slot[at]
        self.uses[slots] += 1
        return slots[which]

    def _right(self, pieces: list[bytes], flat: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
        """Which pieces are the joined bytes of both sides' tokens."""
        sizes = np.array([len(p) for p in pieces])
        whole, of = b"".join(pieces), (self.tokenizers.bytes_a, self.tokenizers.bytes_b)
        right = np.ones(len(pieces), dtype=bool)
        for ids, edge, length, table in zip(flat, edges, self.length, of):
            total = np.append(0, np.cumsum(length[ids]))
            if (np.diff(total[edge]) == sizes).all() and b"".join(map(table.__getitem__, ids.tolist())) == whole:
                continue
            right &= [b"".join(map(table.__getitem__, ids[x:y].tolist())) == p for p, x, y in zip(pieces, edge.tolist(), edge[1:].tolist())]
        return right

    def _learn(self, pieces: list[bytes]) -> None:
        flat, edges = [], []
        for ids in self.tokenizers.encode([p.decode() for p in pieces]):
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(count.sum())))
            edges.append(np.append(0, np.cumsum(count)))
        right = self._right(pieces, flat, edges)
        n = len(pieces)
        owner = [np.repeat(np.arange(n), np.diff(e)) for e in edges]
        if not right.all():
            flat = [f[right[o]] for f, o in zip(flat, owner)]
            owner = [o[right[o]] for o in owner]
        ends = [np.cumsum(length[f]) for f, length in zip(flat, self.length)]
        starts = [np.append(0, e)[:-1] for e in ends]
        n_a = len(flat[0])
        order, group = coalesce(np.concatenate(starts), np.concatenate(ends))
        left, right_at = overlaps(starts[0], ends[0], starts[1], ends[1])
        link_owner = owner[0][left]
        both = np.concatenate(owner)
        group_first = np.append(True, np.diff(group) > 0) if len(group) else np.zeros(0, bool)
        stats = [np.bincount(owner[0], minlength=n), np.bincount(owner[1], minlength=n), np.bincount(both[order][group_first], minlength=n), np.bincount(link_owner, minlength=n), right.astype(np.int64)]
        self.begin = np.append(self.begin, len(self.links) + np.searchsorted(link_owner, np.arange(n)))
        self.links = np.append(self.links, (flat[0][left] << 32) | flat[1][right_at])
        self.stats = np.concatenate([self.stats, np.array(stats)], axis=1)
        self.uses = np.append(self.uses, np.zeros(n, np.int64))
        # Tokens by group and side; the sign behind each tells what comes next.
        of = np.empty(len(order), np.int64)
        of[order] = group
        place = of * 2 + (np.arange(len(of)) >= n_a)
        line = np.argsort(place, kind="stable")
        place, who = place[line], both[line]
        step = np.append(place[1:] - place[:-1], 2) if len(place) else place
        sign = np.where(np.append(who[1:] != who[:-1], True), 3, np.where(step == 0, 0, np.where(place % 2 == 0, 1, 2))) if len(place) else place
        written = "".join(map(self.signed.__getitem__, (sign * self.size + np.concatenate(flat)[line]).tolist())).split("\n")
        if right.all():
            self.texts += written[:n]
        else:
            lines = iter(written)
            self.texts += [next(lines) if r else "" for r in right.tolist()]

    def links_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of the given pieces one after another, and their numbers."""
        count = self.stats[3][slots]
        at = np.repeat(self.begin[slots] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return self.links[at], count


_aligned: dict[tuple, Aligned] = {}


def _units(parts: int, a: str | None, b: str | None, texts: bool):
    """Documents to units (numbers and digests of documents, their pieces' links) and packed pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a, b) not in _aligned:
            _aligned[a, b] = Aligned(Tokenizers(a, b))
        known = _aligned[a, b]
        number, size, counter, schema = TaskContext.get().partitionId() << 20, 0, blocks.Counter(), None

        def flush() -> Iterator[pa.RecordBatch]:
            for part, keys, counts in blocks.by_part(*counter.total(), parts):
                yield pa.RecordBatch.from_pylist([{"block": number, "part": part, "keys": keys, "counts": counts}], schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([
                    ("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(batch.schema.field(0).type)),
                    ("unit", pa.list_(pa.binary())), ("digests", pa.list_(pa.string())), ("groups", pa.list_(pa.string())),
                ])
            data, offsets = words.buffers(batch.column(1))
            for lo, hi in words.pieces(offsets, UNIT):
                unit, digests, groups, pairs, count = _unit(known, data[offsets[lo] : offsets[hi]].tobytes(), offsets[lo : hi + 1] - offsets[lo], texts)
                counter.add(pairs, count)
                row = {"block": [number], "ids": batch.column(0).slice(lo, hi - lo), "unit": [unit], "digests": [digests], "groups": [groups]}
                row["ids"] = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), row["ids"])
                yield pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) if f.name in row and f.name != "ids" else row.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)
                size += int(offsets[hi] - offsets[lo])
                if size >= BLOCK:
                    yield from flush()
                    number, size, counter = number + 1, 0, blocks.Counter()
        if schema is not None:
            yield from flush()

    return run


def _unit(known: Aligned, raw: bytes, offsets: np.ndarray, texts: bool):
    """Packed arrays of a unit, digests, groups as text, and the counts of its linked pairs."""
    stop = offsets.tolist()
    full = b"".join(b" " + raw[x:y] for x, y in zip(stop, stop[1:]) if y > x)
    lengths = np.diff(offsets)
    at = np.append(0, np.cumsum(np.where(lengths > 0, lengths + 1, 0)))
    data = np.frombuffer(full, np.uint8)
    start = cut_points(data, at) if len(data) else np.zeros(0, np.int64)
    slots = known.slots(data, start, np.append(start[1:], len(data))) if len(start) else np.zeros(0, np.int64)
    edge = np.searchsorted(start, at)
    per = np.diff(edge)
    doc = np.repeat(np.arange(len(per)), per)
    wrong = np.bincount(doc[known.stats[4][slots] == 0], minlength=len(per)) > 0
    here = (per > 0) & ~wrong
    slots, per = slots[here[doc]], np.where(here, per, 0)
    doc = np.repeat(np.arange(len(per)), per)
    numbers = [np.bincount(doc, known.stats[i][slots], minlength=len(per)).astype(np.int64) for i in range(4)]
    digests, groups, first = [], [], 0
    for n, ok in zip(per.tolist(), here.tolist()):
        text = ";".join([known.texts[s] for s in slots[first : first + n].tolist()]) if ok else ""
        first += n
        digests.append(hashlib.sha256(text.encode()).hexdigest() if ok else "")
        if texts:
            groups.append(text)
    # Frequent pieces get small numbers, which pack well.
    distinct, which, often = np.unique(slots, return_inverse=True, return_counts=True)
    rank = np.argsort(-often, kind="stable")
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    links, count = known.links_of(distinct[rank])
    pairs, total = blocks.summed(links, np.repeat(often[rank], count))
    unit = [np.array(numbers).tobytes(), blocks.pack(per), blocks.pack(place[which], False), blocks.pack(count, False), blocks.pack(links, False)]
    return unit, digests, groups or None, pairs, total


def _summed(texts: bool):
    """Units of a block with the counts of its pairs, to one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, told, table = None, [], None
        for batch in batches:
            place = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                block, is_unit = divmod(int(place[i]), 2)
                if block != current:
                    current, told, table = block, [], None
                if not is_unit:
                    told.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
                    continue
                if table is None:
                    table, told = blocks.answered(told, 2), []
                    table = [table[0], table[1].astype(np.int64), table[2].astype(np.int64)]
                numbers, per, which, count, links = (x.as_py() for x in batch.column(4)[i].values)
                per, which, count = blocks.unpack(per), blocks.unpack(which, False), blocks.unpack(count, False)
                at = np.searchsorted(table[0], blocks.unpack(links, False))
                edges = np.append(0, np.cumsum(count))
                sums = []
                for value in (table[2], table[1]):
                    piece = np.append(0, np.cumsum(value[at]))
                    occurrence = np.append(0, np.cumsum((piece[edges[1:]] - piece[edges[:-1]])[which]))
                    stop = np.cumsum(per)
                    sums.append(occurrence[stop] - occurrence[stop - per])
                columns = [pa.array(x) for x in (*np.frombuffer(numbers, np.int64).reshape(4, -1), *sums)]
                out = [batch.column(3)[i].values, *columns, batch.column(5)[i].values]
                names = ["id", *COLUMNS, "groups_sha256"]
                if texts:
                    out, names = [*out, batch.column(6)[i].values], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def align(docs: DataFrame, key: str = "doc_id", a: str | None = None, b: str | None = None, texts: bool = False) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and ``groups`` if asked for.

    ``a`` is a file of the tokenizers library, ``b`` a sentence-piece model, both
    as paths that every executor can read. ``groups`` is the text of a row's
    groups, ``a1,a2|b1;a3|b2,b3``, whose digest is ``groups_sha256``. ``n_best``
    counts links whose pair is as frequent as the most frequent pair of its B id,
    ``count_sum`` adds up the pair counts over the links.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(key).alias("id"), F.col("text"))
    shape = StructType([
        StructField("block", LongType()), StructField("part", IntegerType()), StructField("keys", BinaryType()), StructField("counts", BinaryType()),
        StructField("ids", ArrayType(rows.schema["id"].dataType)), StructField("unit", ArrayType(BinaryType())), StructField("digests", ArrayType(StringType())), StructField("groups", ArrayType(StringType())),
    ])
    with arrow_rows(spark, ROWS):
        packed = materialize(rows.mapInArrow(_units(parts, a, b, texts), shape), "aligned")
    keys = packed.where(F.col("part").isNotNull())
    told = blocks.answers(keys, pair_counts(keys, parts), ["n", "best"], parts)
    units = packed.where(F.col("part").isNull())
    both = told.select((F.col("block") * 2).alias("place"), "keys", "answer").unionByName(
        units.select((F.col("block") * 2 + 1).alias("place"), "ids", "unit", "digests", "groups"), allowMissingColumns=True
    )
    both = both.repartition(parts, F.floor(F.col("place") / 2)).sortWithinPartitions("place")
    result = StructType([StructField("id", rows.schema["id"].dataType)])
    for c in COLUMNS:
        result = result.add(c, "long")
    result = result.add("groups_sha256", "string")
    if texts:
        result = result.add("groups", "string")
    with arrow_rows(spark, UNITS):
        return materialize(both.mapInArrow(_summed(texts), result), "sums").withColumnRenamed("id", key)


def pair_counts(keys: DataFrame, parts: int) -> DataFrame:
    """(part, key, n, best) of all linked pairs: A id * 2**32 + B id, its links, 1 where no pair of the B id has more."""
    counted = materialize(blocks.totals(keys, parts), "pairs")
    b = F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    most = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counted.join(most, b == F.col("b")).select("part", "key", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
