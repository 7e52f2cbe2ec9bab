"""Phrases of a language whose parts occur together more often than by chance.

Texts are cut into pieces at punctuation and line ends and the pieces into
words. A phrase of 2 to ``MAX_WORDS`` words with at least ``least`` occurrences
is a candidate; its score compares its count with those of its two parts, at the
cut where that is lowest. All counts are exact.

A phrase can only be frequent if its words and its word pairs are, and these are
counted first (``blocks``), so that only windows of frequent pairs go on; no
other phrase can reach the bound. Every shard of documents builds a count
transducer from its sorted windows (``automata``), cuts it by ranges of the first
transition, and the cuts of a range are united and their weights summed. What
reaches the bound are the candidates. Their parts are looked up by composing the
automaton of a range with the tails that start in it. A hot word is one entry
per shard, its pairs spread over all ranges, and no task holds all words.

Rows: documents of null language count as ``und``; null and empty texts have no
words; repeated rows count as often as they are there; texts longer than a shard
make a shard of their own; an empty table gives an empty result; other columns
are ignored, whatever their names; equal scores are ordered by count and phrase,
equal cuts by the shorter first part. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpanel.llm import automata, blocks, words
from rankpanel.llm.automata import Labels
from rankpanel.llm.tables import arrow_rows, discard, ship_package, short_shuffles
from rankpanel.session import join_small, materialize, shuffle_partitions

MAX_WORDS, LEAST, TOP = 5, 100, 2000
#: Bytes of text that are handled at once, and in a shard; rows of an Arrow batch of documents, and of shards.
UNIT, SHARD, ROWS, BATCH = 4 << 20, 16 << 20, 2048, 4

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_LANG, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)

SHARDS = "block long, part int, keys binary, counts binary, shard array<binary>, langs array<struct<lang:long,name:string,words:long>>"
REDUCED = "block long, part int, keys binary, counts binary, shard array<binary>"
CANDIDATES = "id long, range int, lang long, phrase string, words array<long>, counts array<long>, weights array<long>, contained boolean"


def lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little", signed=True)


def pack_sequence(sequence: np.ndarray, distinct: int) -> list[bytes]:
    """A sequence of word places, as ranks by frequency, which pack well, and the places by rank."""
    often = np.bincount(sequence, minlength=distinct + 1)
    by_rank = np.argsort(-often, kind="stable")
    rank = np.empty(len(by_rank), np.int64)
    rank[by_rank] = np.arange(len(by_rank))
    return [blocks.pack(rank[sequence], False, True), blocks.pack(by_rank, False)]


def unpack_sequence(ranks: bytes, by_rank: bytes) -> np.ndarray:
    return blocks.unpack(by_rank, False)[blocks.unpack(ranks, False)]


def word_keys(hashes: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """The keys of words, given their hashes and the codes of their languages."""
    key = words.mixed(hashes ^ words.mixed(langs.view(np.uint64) ^ _LANG))
    key[key == 0] = 1  # zero marks the end of a phrase
    return key


def known_words(langs: bytes, spelled: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, language codes and spellings of a shard's words, in the order of their keys, which are made again."""
    codes = blocks.unpack_few(langs)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(spelled), np.uint8)
    begin, end, _ = words.spans(data, np.array([0, len(data)]))
    return word_keys(words.hashes(data, begin, end), codes), codes, automata.spelled(len(codes), spelled)


class _Shard:
    """The word sequence of a shard, gathered text unit by text unit."""

    def __init__(self) -> None:
        self.size = 0
        self.keys: list[np.ndarray] = []
        self.new: list[np.ndarray] = []
        self.known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.langs: dict[str, int] = {}  # words per language

    def add(self, raw: bytes, offsets: np.ndarray, langs: list[str]) -> None:
        data = np.frombuffer(raw, np.uint8)
        begin, end, first = words.spans(data, offsets, _APART)
        per = np.diff(first)
        for lang, n in zip(langs, per.tolist()):
            self.langs[lang] = self.langs.get(lang, 0) + n
        self.size += len(raw)
        if not len(begin):
            return
        doc = np.repeat(np.arange(len(per)), per)
        code = np.array([lang_key(x) for x in langs], dtype=np.int64)
        key = word_keys(words.hashes(data, begin, end), code[doc])
        breaks = np.searchsorted(np.flatnonzero(_BREAK[data]), begin)
        self.new.append(np.append(True, (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])))
        self.keys.append(key)
        distinct, at = np.unique(key, return_index=True)
        spelled = np.empty(len(at), dtype=object)
        spelled[:] = [raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())]
        self.known.append((distinct, code[doc[at]], spelled))

    def rows(self, number: int, parts: int) -> Iterator[dict]:
        key = np.concatenate(self.keys or [np.zeros(0, np.uint64)])
        new = np.concatenate(self.new or [np.zeros(0, bool)])
        distinct, which, often = np.unique(key, return_inverse=True, return_counts=True)
        found = [np.concatenate(c) for c in zip(*self.known)] or [np.zeros(0, t) for t in (np.uint64, np.int64, object)]
        at = np.unique(found[0], return_index=True)[1]
        spelled = zstandard.ZstdCompressor(level=3).compress(b" ".join(found[2][at].tolist()))
        # Zero before each piece; words count from 1.
        sequence = np.insert(which + 1, np.flatnonzero(new), 0)
        shard = [blocks.pack_few(found[1][at]), spelled, *pack_sequence(sequence, len(distinct))]
        langs = [{"lang": lang_key(k), "name": k, "words": n} for k, n in self.langs.items()]
        yield {"block": number, "shard": shard, "langs": langs}
        for part, keys, counts in blocks.by_part(*blocks.summed(distinct.view(np.int64), often), parts):
            yield {"block": number, "part": part, "keys": keys, "counts": counts}


def _shards(parts: int):
    """(lang, text) to shards of word sequences and packed word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 20, _Shard()
        for batch in batches:
            data, offsets = words.buffers(batch.column(1))
            langs = batch.column(0).to_pylist()
            for lo, hi in words.pieces(offsets, UNIT):
                # bytes.lower changes ASCII letters only.
                shard.add(data[offsets[lo] : offsets[hi]].tobytes().lower(), offsets[lo : hi + 1] - offsets[lo], langs[lo:hi])
                if shard.size >= SHARD:
                    for row in shard.rows(number, parts):
                        yield pa.RecordBatch.from_pylist([row], _SHARDS_ARROW)
                    number, shard = number + 1, _Shard()
        if shard.langs:
            for row in shard.rows(number, parts):
                yield pa.RecordBatch.from_pylist([row], _SHARDS_ARROW)

    return run


_PACKED = [("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("shard", pa.list_(pa.binary()))]
_SHARDS_ARROW = pa.schema([*_PACKED, ("langs", pa.list_(pa.struct([("lang", pa.int64()), ("name", pa.string()), ("words", pa.int64())])))])
_REDUCED_ARROW = pa.schema(_PACKED)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], pa.RecordBatch, int]]:
    """Each shard of (place, keys, answer, shard, ...) with the answers its block got before it."""
    current, told = None, []
    for batch in batches:
        place = batch.column(0).to_numpy()
        for i in range(batch.num_rows):
            block, is_shard = divmod(int(place[i]), 2)
            if block != current:
                current, told = block, []
            if is_shard:
                answers, told = blocks.answered_frequent(told), []
                yield block, answers, batch, i
            else:
                told.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return words.mixed(a * _PAIR + b)


def _reduced(parts: int):
    """Shards with the counts and numbers of their frequent words to shards of these only, and packed counts of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (known, count, number), batch, i in _told(batches):
            shard = [x.as_py() for x in batch.column(3)[i].values]
            keys, langs, spellings = known_words(*shard[:2])
            kept = np.isin(keys, known.view(np.uint64))
            # Answers come in signed order, words in unsigned order.
            at = np.searchsorted(known, keys[kept].view(np.int64))
            count, number = count[at], number[at]
            place = np.append(0, np.where(kept, np.cumsum(kept), 0))
            sequence = place[unpack_sequence(*shard[2:4])]
            spelled = b" ".join(spellings[kept].tolist())
            # Runs of zeros part the sequence as one zero does.
            sequence = sequence[np.append(sequence[:-1] | sequence[1:], 1) > 0] if len(sequence) else sequence
            at = np.flatnonzero((sequence[:-1] > 0) & (sequence[1:] > 0))
            pairs, often = np.unique(pair_codes(number, sequence, at), return_counts=True)
            small = [blocks.pack_few(langs[kept]), zstandard.ZstdCompressor(level=3).compress(spelled), blocks.pack(count, False), blocks.pack(number, False), *pack_sequence(sequence, len(number))]
            yield pa.RecordBatch.from_pylist([{"block": block, "shard": small}], _REDUCED_ARROW)
            for part, packed, counts in blocks.by_part(pairs, often, parts):
                yield pa.RecordBatch.from_pylist([{"block": block, "part": part, "keys": packed, "counts": counts}], _REDUCED_ARROW)

    return run


def pair_codes(number: np.ndarray, sequence: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One integer for the words at the given places and behind them."""
    return (number[sequence[at] - 1] << 32) | number[sequence[at + 1] - 1]


def windows(sequence: np.ndarray, keys: np.ndarray, codes: np.ndarray, frequent: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per position that begins a frequent pair: its key, its label places, and the places of the words behind while pairs are frequent.

    ``codes`` has the pair numbers of the positions where two words of the sequence meet.
    """
    n = len(sequence)
    both = np.zeros(n, dtype=bool)
    at = np.flatnonzero((sequence[:-1] > 0) & (sequence[1:] > 0))
    at = at[np.isin(codes, frequent)]
    both[at] = True
    pair = np.zeros(n, np.uint64)
    pair[at] = pair_keys(keys[sequence[at] - 1], keys[sequence[at + 1] - 1])
    begin = np.flatnonzero(both)
    rest = np.full((len(begin), longest - 2), -1, np.int64)
    goes = np.ones(len(begin), dtype=bool)
    for i in range(longest - 2):
        next_pair = np.minimum(begin + i + 1, n - 1)
        goes &= both[next_pair]
        rest[goes, i] = sequence[next_pair[goes] + 1] - 1
    return pair[begin], np.column_stack([sequence[begin] - 1, sequence[begin + 1] - 1]), rest


def _transducers(ranges: int, longest: int):
    """Reduced shards with their frequent pairs to cuts of their automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (pairs, _, _), batch, i in _told(batches):
            shard = [x.as_py() for x in batch.column(3)[i].values]
            keys, langs, spellings = known_words(*shard[:2])
            labels = Labels(keys, blocks.unpack(shard[2], False), langs, spellings)
            number, sequence = blocks.unpack(shard[3], False), unpack_sequence(*shard[4:6])
            at = np.flatnonzero((sequence[:-1] > 0) & (sequence[1:] > 0))
            built = automata.build(labels, *windows(sequence, keys, pair_codes(number, sequence, at), pairs, longest))
            for r, part in automata.cut(built, ranges):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([automata.dump(part)], pa.list_(pa.binary()))], ["range", "automaton"])

    return run


#: Automata that are held before they are united.
HELD = 16


def _united(least: int):
    """Cuts of automata, ordered by range, to the paths that reach the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != current:
                    if held:
                        yield from _rows(current, automata.prune(automata.union(held), least))
                    current, held = r, []
                held.append(automata.load(data.as_py()))
                if len(held) >= HELD:
                    held = [automata.union(held)]
        if held:
            yield from _rows(current, automata.prune(automata.union(held), least))

    return run


def _rows(r: int, a: automata.Automaton) -> Iterator[pa.RecordBatch]:
    """The phrases of an automaton; a phrase is contained where a longer one of equal count begins with it."""
    levels = list(automata.paths(a))
    for level, (places, weights) in enumerate(levels):
        if not len(places):
            continue
        contained = np.zeros(len(places), dtype=bool)
        if level < len(a.arcs):
            parent = a.arcs[level] >> 32
            contained[parent[a.weights[level + 1] >= a.weights[level][parent]]] = True
        key = a.labels.keys.view(np.int64)[places]
        columns = [
            pa.array([(r << 40 | level << 36) + i for i in range(len(places))]), pa.array(np.full(len(places), r, np.int32)), pa.array(a.labels.langs[places[:, 0]]),
            pa.array([b" ".join(x).decode() for x in a.labels.words[places]]), pa.array(list(key)), pa.array(list(a.labels.counts[places])), pa.array(list(weights)), pa.array(contained),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", "range", "lang", "phrase", "words", "counts", "weights", "contained"])


def _padded(phrases: list[list[int]], longest: int) -> np.ndarray:
    out = np.zeros((len(phrases), longest), np.int64)
    for i, p in enumerate(phrases):
        out[i, : len(p)] = p
    return out.view(np.uint64)


def _tails(ranges: int, longest: int):
    """Candidates to the tails whose counts they need: range, candidate, cut, tail, count of the candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, phrases, last = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [w[-1] for w in batch.column(2).to_pylist()]
            rows = [(i, k, p[k:], n) for i, p, n in zip(ids, phrases, last) for k in range(1, len(p) - 1)]
            if rows:
                pad = _padded([t for _, _, t, _ in rows], longest)
                r = automata.range_of(pair_keys(pad[:, 0], pad[:, 1]), ranges)
                ids, cuts, tails, counts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(ids), pa.array(cuts, pa.int32()), pa.array(tails), pa.array(counts)], ["range", "id", "cut", "tail", "n"])

    return run


def _composed(longest: int):
    """Candidates of a range, then tails that start in it: the tails' counts, and which candidates a longer phrase contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, automaton, names = None, [], None, []
        for batch in batches:
            place = batch.column(0).to_numpy()
            for lo, hi in zip(edges := np.flatnonzero(np.append(True, place[1:] != place[:-1])), np.append(edges[1:], len(place))):
                r, asks = divmod(int(place[lo]), 2)
                if r != current:
                    current, rows, automaton = r, [], None
                part = batch.slice(lo, hi - lo)
                if not asks:
                    rows += zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(4).to_pylist())
                    continue
                if automaton is None:
                    automaton, names = _from_rows(rows, longest)
                    rows = []
                tails = _padded(part.column(2).to_pylist(), longest)
                level, state = automata.walk(automaton, pair_keys(tails[:, 0], tails[:, 1]), tails[:, 2:])
                n = np.array([automaton.weights[x][s] for x, s in zip(level.tolist(), state.tolist())])
                own, cut = part.column(4).to_numpy(), part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(cut), pa.array(n)], ["id", "cut", "n"])
                # Without its first word a candidate of equal count contains the tail.
                inside = (cut == 1) & (own >= n)
                gone = [names[x][s] for x, s in zip(level[inside].tolist(), state[inside].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64()), pa.array(np.zeros(len(gone), np.int32)), pa.array(np.zeros(len(gone), np.int64))], ["id", "cut", "n"])

    return run


def _from_rows(rows: list[tuple[int, list[int], int]], longest: int) -> tuple[automata.Automaton, list[list[int]]]:
    """The automaton of (id, phrase, count) rows, and the ids of its states."""
    keys = np.unique(np.array([w for _, p, _ in rows for w in p], np.int64).view(np.uint64))
    none = np.zeros(len(keys), np.int64)
    pad = _padded([p for _, p, _ in rows], longest)
    place = np.where(pad == 0, -1, np.searchsorted(keys, pad))
    first = pair_keys(pad[:, 0], pad[:, 1])
    a = automata.build(Labels(keys, none, none, none), first, place[:, :2], place[:, 2:])
    level, state = automata.walk(a, first, pad[:, 2:])
    ids = [[0] * len(w) for w in a.weights]
    for (i, _, n), x, s in zip(rows, level.tolist(), state.tolist()):
        ids[x][s], a.weights[x][s] = i, n
    return a, ids


def phrases(docs: DataFrame, least: int = LEAST, longest: int = MAX_WORDS) -> DataFrame:
    """All candidates: lang, phrase, a, l, r, n, score, cut (words of the first part), contained (in a longer one of equal count).

    Needs the columns ``lang`` and ``text``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = shuffle_partitions(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    asks = F.col("part").isNotNull()
    # What a step no longer needs goes before the next one writes.
    with arrow_rows(spark, ROWS):
        shards = materialize(rows.mapInArrow(_shards(parts), SHARDS).withColumn("asks", asks), "shards", ("asks",))
    with arrow_rows(spark, BATCH), short_shuffles(spark):
        told = materialize(blocks.frequent(shards.where("asks"), parts, least), "told-words")
        discard(shards, "/asks=true")
        sequences = shards.where("NOT asks")
        met = _meet(told, sequences.select("block", "shard"), parts)
        reduced = materialize(met.mapInArrow(_reduced(parts), REDUCED).withColumn("asks", asks), "reduced", ("asks",))
        langs = materialize(_languages(sequences), "languages")
        discard(shards)
        discard(told)
        told = materialize(blocks.frequent(reduced.where("asks"), parts, least, values=False), "told-pairs")
        discard(reduced, "/asks=true")
        cuts = _meet(told, reduced.where("NOT asks").select("block", "shard"), parts).mapInArrow(_transducers(parts, longest), "range int, automaton array<binary>")
        found = materialize(cuts.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_united(least), CANDIDATES), "candidates")
        discard(reduced)
        discard(told)
    tails = found.where(F.size("words") > 2).select("id", "words", "weights").mapInArrow(_tails(parts, longest), "range int, id long, cut int, tail array<long>, n long")
    known = found.select((F.col("range") * 2).alias("place"), "id", "words", F.lit(0).alias("cut"), F.element_at("weights", -1).alias("n"))
    both = known.unionByName(tails.select((F.col("range") * 2 + 1).alias("place"), "id", F.col("tail").alias("words"), "cut", "n"))
    both = both.repartition(parts, F.floor(F.col("place") / 2)).sortWithinPartitions("place")
    answers = both.mapInArrow(_composed(longest), "id long, cut int, n long")
    per = answers.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("cut") > 0, F.struct("cut", "n")))).alias("tails"), (F.min("cut") == 0).alias("inside")
    )
    scored = join_small(found.join(per, "id", "left"), langs, ["lang"], "langs", "inner")
    return scored.select("name", "phrase", _best_cut().alias("best"), "total", (F.col("contained") | F.coalesce("inside", F.lit(False))).alias("contained")).select(
        F.col("name").alias("lang"), "phrase", F.col("best.a").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("total").alias("n"),
        F.col("best.score").alias("score"), F.col("best.cut").alias("cut"), "contained",
    )


def _meet(told: DataFrame, shards: DataFrame, parts: int) -> DataFrame:
    both = told.select((F.col("block") * 2).alias("place"), "keys", "answer").unionByName(
        shards.withColumn("block", F.col("block") * 2 + 1).withColumnRenamed("block", "place"), allowMissingColumns=True
    )
    return both.repartition(parts, F.floor(F.col("place") / 2)).sortWithinPartitions("place")


def _languages(shards: DataFrame) -> DataFrame:
    """(lang, name, total): words per language."""
    per = shards.where(F.col("langs").isNotNull()).select(F.inline("langs"))
    return per.groupBy("lang", "name").agg(F.sum("words").alias("total"))


def _best_cut() -> Column:
    """The lowest score over all cuts, ties to the first: exact, since 38 digits hold the products."""
    a, size = F.element_at("weights", -1), F.size("words")
    top = a.cast("decimal(15,0)") * F.lit(1000).cast("decimal(4,0)") * F.col("total").cast("decimal(18,0)")

    def at(k: Column) -> Column:
        left = F.when(k == 1, F.element_at("counts", 1)).otherwise(F.element_at("weights", F.greatest(k - 1, F.lit(1))))
        right = F.when(k == size - 1, F.element_at("counts", -1)).otherwise(F.element_at("tails", k))
        score = F.call_function("div", top, left.cast("decimal(18,0)") * right.cast("decimal(18,0)"))
        return F.struct(score.alias("score"), k.alias("cut"), left.alias("l"), right.alias("r"), a.alias("a"))

    return F.array_min(F.transform(F.sequence(F.lit(1), size - 1), at))


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """Per language the phrases of the highest scores that no longer phrase of equal count contains, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.where(~F.col("contained")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The top phrases over the documents as DuckDB SQL: every phrase is counted.
ORACLE_SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT row_number() OVER () AS piece, lang, x FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
    w AS (SELECT piece, lang, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM (SELECT piece, lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM p)),
    v AS MATERIALIZED (SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
    g AS MATERIALIZED (SELECT lang, 1 AS k, a AS phrase, count(*) AS f FROM v GROUP BY ALL
      UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM v WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM v WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d, count(*) FROM v WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, 5, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e, count(*) FROM v WHERE e IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
    n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY 1),
    c AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 100),
    cuts AS MATERIALIZED (SELECT lang, k, phrase, f, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:k], ' ') AS rest FROM c, range(1, 5) t(j) WHERE j < k),
    sl AS MATERIALIZED (SELECT cuts.*, g.f AS l FROM cuts JOIN g ON g.lang = cuts.lang AND g.k = cuts.j AND g.phrase = cuts.first),
    sr AS MATERIALIZED (SELECT sl.*, g.f AS r FROM sl JOIN g ON g.lang = sl.lang AND g.k = sl.k - sl.j AND g.phrase = sl.rest),
    s AS (SELECT sr.*, n.n AS n, (1000::HUGEINT * sr.f::HUGEINT * n.n::HUGEINT) // (sr.l::HUGEINT * sr.r::HUGEINT) AS score FROM sr JOIN n ON n.lang = sr.lang),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) AS o FROM s) WHERE o = 1),
    inner_parts AS (SELECT lang, m AS k, array_to_string(ws[o:o + m - 1], ' ') AS phrase, max(f) AS longer FROM c, range(2, 5) a(m), range(1, 5) b(o) WHERE m < k AND o + m - 1 <= k GROUP BY ALL),
    kept AS (SELECT best.* FROM best LEFT JOIN inner_parts i ON i.lang = best.lang AND i.phrase = best.phrase AND i.k = best.k WHERE longer IS NULL OR 100 * longer < 100 * f),
    ranked AS (SELECT lang, phrase, f AS a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""
