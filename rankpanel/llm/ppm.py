"""Score texts by prediction by partial matching over bytes, pretrained on the training documents.

The model is a trie of byte contexts of up to ``ORDER`` bytes: every node has
its number of occurrences n and of distinct following symbols q. A symbol is
coded in the longest known context that has it, after escapes from the longer
ones. Half an occurrence of every distinct symbol goes to the escape: a symbol
seen c times has (c - 1/2) / n, the escape q / 2n. Symbols that a longer context has are excluded from the shorter ones; since whatever follows a
context also follows its end, the excluded part of a node depends only on the
node one byte longer. Symbols that no context has share what is left evenly.
The symbols are the 256 byte values; 0xFF, which UTF-8 never uses, ends a text
and fills the contexts before its first byte. So the probabilities of all texts
sum to 1.

The probability of a symbol after ``ORDER`` bytes is one value per string of
``ORDER`` + 1 bytes. Blocks of documents send their distinct strings and counts;
the trie is a set of tables, one per length, made from the summed counts, and
its values are joined to the strings and sent back to the blocks (``blocks``).
A unigram model of words is computed along with it.

Rows: one per input row, keys of any type, null keys included. Null and empty
texts are scored as the end alone; very long texts are cut for counting only;
an empty table gives an empty result; without training rows all symbols are
equally likely; other columns are ignored, whatever their names. Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from rankpanel.llm import blocks, words
from rankpanel.llm.tables import ship_package
from rankpanel.session import materialize, shuffle_partitions

ORDER = 5
#: Bytes of text in a block; positions that are handled at once.
BLOCK, CHUNK = 32 << 20, 1 << 21
STOP = b"\xff"
#: The key of the end token among the word hashes.
END = 0
GRAMS, WORDS, TEXTS = 0, 1, 2


def stream(raw: bytes, lengths: np.ndarray) -> bytes:
    """Texts one after another, each with its fill before it and its end behind it."""
    stop = np.cumsum(lengths).tolist()
    return b"".join(part for a, b in zip([0, *stop], stop) for part in (STOP * ORDER, raw[a:b], STOP))


def strings(flow: np.ndarray, a: int, b: int) -> np.ndarray:
    """The ORDER + 1 bytes from each position in [a, b) on, as integers."""
    out = flow[a:b].astype(np.int64)
    for i in range(1, ORDER + 1):
        out <<= 8
        out |= flow[a + i : b + i]
    return out


def scored_positions(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and first position past the strings of each text in its stream."""
    begin = np.cumsum(lengths + ORDER + 1) - (lengths + ORDER + 1)
    return begin, begin + lengths + 1


def _count_strings(raw: bytes, lengths: np.ndarray, counter: blocks.Counter, train: bool) -> None:
    flow = np.frombuffer(stream(raw, lengths), np.uint8)
    fill = np.zeros(len(flow), dtype=bool)
    fill[(scored_positions(lengths)[1][:, None] + np.arange(ORDER)).ravel()] = True
    last = len(flow) - ORDER
    for a in range(0, last, CHUNK):
        b = min(a + CHUNK, last)
        found = np.sort(strings(flow, a, b)[~fill[a:b]])
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
        counter.add(found[first], np.diff(np.append(first, len(found))) * int(train))


def _word_keys(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, first = words.spans(data, np.append(0, np.cumsum(lengths)))
    return words.hashes(data, starts, ends).view(np.int64), np.diff(first)


def _block_schema(key: StructField) -> StructType:
    return StructType([
        StructField("block", LongType()), StructField("kind", IntegerType()), StructField("part", IntegerType()), StructField("keys", BinaryType()), StructField("counts", BinaryType()),
        StructField("ids", ArrayType(key.dataType)), StructField("held", ArrayType(BooleanType())), StructField("body", BinaryType()),
    ])


def _blocks(parts: int):
    """Documents to rows of packed texts and rows of packed keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        press = zstandard.ZstdCompressor(level=3)
        size, counters, schema = 0, [blocks.Counter(), blocks.Counter()], None

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, counter in enumerate(counters):
                for part, keys, counts in blocks.by_part(*counter.total(), parts, kind * parts):
                    yield pa.RecordBatch.from_pylist([{"block": number, "kind": kind, "part": part, "keys": keys, "counts": counts}], schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([
                    ("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
                    ("ids", pa.list_(batch.schema.field(0).type)), ("held", pa.list_(pa.bool_())), ("body", pa.binary()),
                ])
            data, offsets = words.buffers(batch.column(2))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in words.pieces(offsets):
                # bytes.lower changes ASCII letters only.
                raw, lengths = data[offsets[lo] : offsets[hi]].tobytes().lower(), np.diff(offsets[lo : hi + 1])
                doc = np.repeat(held[lo:hi], lengths)
                flat = np.frombuffer(raw, np.uint8)
                for train in (True, False):
                    mine = held[lo:hi] != train
                    if mine.any():
                        some, long = flat[doc != train].tobytes(), lengths[mine]
                        _count_strings(some, long, counters[GRAMS], train)
                        found, count = np.unique(_word_keys(some, long)[0], return_counts=True)
                        counters[WORDS].add(np.append(found, END), np.append(count, len(long)) * int(train))
                row = [pa.array([number]), pa.array([TEXTS], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([blocks.pack(lengths)], pa.binary())]
                one = pa.array([0, hi - lo], pa.int32())
                row += [pa.ListArray.from_arrays(one, batch.column(0).slice(lo, hi - lo)), pa.ListArray.from_arrays(one, pa.array(held[lo:hi]))]
                yield pa.RecordBatch.from_arrays([*row, pa.array([press.compress(raw)], pa.binary())], schema=schema)
                size += len(raw)
                if size >= BLOCK:
                    yield from flush()
                    number, size, counters = number + 1, 0, [blocks.Counter(), blocks.Counter()]
        if schema is not None:
            yield from flush()

    return run


def _tail(column: str, length: int) -> Column:
    """The last ``length`` bytes of a string."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * length) - 1))


def trie(counted: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Arcs (string, n) and nodes (context, n, q, den, novel) per order 0 to ORDER.

    ``den`` and ``novel`` are n and q of the context one byte shorter, the symbols of this context; order 0 has none.
    """
    arcs: list[DataFrame] = [materialize(counted.select("key", "n").where("n > 0"), f"arcs-{ORDER}")]
    for k in range(ORDER - 1, -1, -1):
        arcs.insert(0, materialize(arcs[0].groupBy(_tail("key", k + 1).alias("key")).agg(F.sum("n").alias("n")), f"arcs-{k}"))
    nodes: list[DataFrame] = []
    for k, arc in enumerate(arcs):
        context = F.shiftright("key", 8).alias("context")
        if k == 0:
            node = arc.groupBy(context).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("q"))
            nodes.append(materialize(node.withColumns({"den": F.lit(0).cast("long"), "novel": F.lit(0).cast("long")}), "nodes-0"))
            continue
        shorter = arcs[k - 1].select(F.col("key").alias("tail"), F.col("n").alias("m"))
        node = arc.join(shorter, _tail("key", k) == F.col("tail")).groupBy(context).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("q"), F.sum("m").alias("gone"))
        below = nodes[k - 1].select(F.col("context").alias("tail"), F.col("n").alias("n1"), F.col("q").alias("q1"))
        node = node.join(below, _tail("context", k - 1) == F.col("tail")).select(
            "context", "n", "q", (F.col("n1") - F.col("gone")).alias("den"), (F.col("q1") - F.col("q")).alias("novel")
        )
        nodes.append(materialize(node, f"nodes-{k}"))
    return arcs, nodes


def log_probabilities(counted: DataFrame) -> DataFrame:
    """(part, key, value): log10 of the probability of a string's last byte after the others, from (part, key, n)."""
    arcs, nodes = trie(counted)
    top = nodes[ORDER].select(F.col("context").alias("c"), F.col("n").alias("total"))
    seen = counted.where("n > 0").join(top, F.shiftright("key", 8) == F.col("c")).select("part", "key", F.log10((F.col("n") - 0.5) / F.col("total")).alias("value"))
    # What was never seen whole escapes from context to context until one has the symbol.
    rest = counted.where("n = 0").select("part", "key")
    one, zero = F.lit(1.0), F.lit(0.0)
    escaped, found = zero, F.lit(None).cast("double")
    den, novel = F.lit(None).cast("long"), F.lit(None).cast("long")  # of the node at hand where a longer one excludes symbols
    for k in range(ORDER, -1, -1):
        arc = arcs[k].select(F.col("key").alias(f"a{k}"), F.col("n").alias(f"an{k}"))
        node = nodes[k].select(F.col("context").alias(f"c{k}"), *[F.col(x).alias(f"{x}{k}") for x in ("n", "q", "den", "novel")])
        if k < ORDER:
            rest = rest.join(arc, _tail("key", k + 1) == F.col(f"a{k}"), "left")
        rest = rest.join(node, F.shiftright(_tail("key", k + 1), 8) == F.col(f"c{k}"), "left")
        whole, kinds = F.coalesce(den, F.col(f"n{k}")), F.coalesce(novel, F.col(f"q{k}"))
        if k < ORDER:
            here = F.when(F.col(f"an{k}").isNotNull(), escaped + F.log10((F.col(f"an{k}") - 0.5) / whole))
            found = F.coalesce(found, here)
        # A context that is unknown, or whose symbols are all excluded, has nothing to escape from.
        escaped = escaped + F.when(F.col(f"c{k}").isNotNull() & (whole > 0), F.log10(kinds / (2 * whole))).otherwise(zero)
        rest = rest.withColumns({f"e{k}": escaped, f"f{k}": found, f"d{k}": F.when(F.col(f"c{k}").isNotNull(), F.col(f"den{k}")), f"v{k}": F.when(F.col(f"c{k}").isNotNull(), F.col(f"novel{k}"))})
        escaped, found, den, novel = F.col(f"e{k}"), F.col(f"f{k}"), F.col(f"d{k}"), F.col(f"v{k}")
    left = F.lit(256) - F.coalesce(F.col("q0"), F.lit(0))
    value = F.coalesce(found, escaped - F.log10(F.when(left > 0, left).otherwise(one)))
    return seen.unionByName(rest.select("part", "key", value.alias("value")))


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table; near keys are looked up together."""
    order = np.argsort(keys)
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.searchsorted(table, keys[order])
    return out


def _scored(parts: int, total: int, distinct: int):
    """Texts of a block with the values of its keys, to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, answers, grams, known = None, [], None, None
        for batch in batches:
            place = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                block, is_text = divmod(int(place[i]), 2)
                if block != current:
                    current, answers, grams = block, [], None
                if not is_text:
                    answers.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
                    continue
                if grams is None:
                    grams, known = (blocks.answered([a[1:] for a in answers if a[0] // parts == kind], 1) for kind in (GRAMS, WORDS))
                    answers = []
                raw = zstandard.ZstdDecompressor().decompress(batch.column(6)[i].as_py())
                lengths = blocks.unpack(batch.column(7)[i].as_py())
                yield _rows(raw, lengths, batch.column(4)[i].values, batch.column(5)[i].values, grams, known, total, distinct)

    return run


def _rows(raw: bytes, lengths: np.ndarray, ids: pa.Array, held: pa.Array, grams: list, known: list, total: int, distinct: int) -> pa.RecordBatch:
    flow = np.frombuffer(stream(raw, lengths), np.uint8)
    begin, stop = scored_positions(lengths)
    score = np.zeros(len(lengths))
    last = len(flow) - ORDER
    for a in range(0, last, CHUNK):
        b = min(a + CHUNK, last)
        at = _lookup(grams[0], strings(flow, a, b))
        value = np.append(grams[1], 0.0)[at]
        lo, hi = np.searchsorted(stop, a, side="right"), np.searchsorted(begin, b)
        sums = np.append(0.0, np.cumsum(value))
        score[lo:hi] += sums[np.clip(stop[lo:hi], a, b) - a] - sums[np.clip(begin[lo:hi], a, b) - a]
    keys, per = _word_keys(raw, lengths)
    all_keys = np.insert(keys, np.cumsum(per), END)
    count = known[1][np.searchsorted(known[0], all_keys)]
    first = np.cumsum(per + 1) - (per + 1)
    base = np.add.reduceat(np.log10((count + 0.5) / (total + 0.5 * (distinct + 1))), first)
    n_known = np.add.reduceat((count > 0).astype(np.int64), first)
    n = len(lengths)
    return pa.RecordBatch.from_arrays(
        [ids, held, pa.array(per + 1), pa.array(n_known), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score)],
        ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def score(docs: DataFrame, held: Column, key: str = "doc_id") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held`` is true for rows that are scored only; the model learns from all
    others. Scores are log10 probabilities; ``n_known`` counts words, and the
    end, that the training rows have.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col("text"))
    packed = materialize(rows.mapInArrow(_blocks(parts), _block_schema(rows.schema["id"])), "text-blocks")
    keys = packed.where(F.col("kind") < TEXTS)
    counted = materialize(blocks.totals(keys, parts), "counted")
    tokens = counted.where(F.col("part") >= parts)
    size = tokens.where("n > 0").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    values = log_probabilities(counted.where(F.col("part") < parts)).unionByName(tokens.select("part", "key", F.col("n").cast("double").alias("value")))
    told = blocks.answers(keys, values, ["value"], parts)
    texts = packed.where(F.col("kind") == TEXTS)
    both = told.select((F.col("block") * 2).alias("place"), "part", "keys", "answer").unionByName(
        texts.select((F.col("block") * 2 + 1).alias("place"), "ids", "held", "body", F.col("counts").alias("lengths")), allowMissingColumns=True
    )
    both = both.repartition(parts, F.floor(F.col("place") / 2)).sortWithinPartitions("place")
    shape = StructType([StructField("id", rows.schema["id"].dataType), StructField("held_out", BooleanType())])
    shape = shape.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return both.mapInArrow(_scored(parts, size["total"] or 0, size["distinct"]), shape).withColumnRenamed("id", key)


def held_out(key: str = "doc_id") -> Column:
    """Whether the checksum of the key's text leaves 1 modulo 5."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 1
