"""Find secrets with a trigram inverted index over the documents.

From every rule's regular expression a Boolean trigram query is derived: an AND
of clauses, each an OR of trigram sets that must occur together. The index
holds, for the trigrams any rule asks for, a posting per document; a rule's
candidates are the documents whose postings satisfy its query, and only they
are matched against the expression. Rules without a mandatory trigram scan
every document. All of it is DataFrame expressions.

Rows: one per input row. A null text is empty and has no span; repeated rows
and null ids are each answered; an empty table gives an empty result. Spans
count code points, end exclusive. Other columns are kept by ``scan``; the
columns it adds replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLUSH_AT = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost without overlap; matches with fewer than ``least`` characters in ``group`` are dropped.

    ``guard``, where given, has the same kept matches and no others.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    guard: str = ""


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE + MORE

Clause = frozenset[frozenset[str]]


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that every matching text satisfies, over lower-case trigrams; empty if nothing is mandatory."""
    clauses: list[Clause] = []

    def clause(strings: set[str]) -> Clause | None:
        if any(len(s) < 3 for s in strings):
            return None
        return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)

    def flush(strings: set[str]) -> set[str]:
        made = clause(strings)
        if made:
            clauses.append(made)
        return {""}

    def product(left: set[str], right: set[str]) -> set[str] | None:
        return {a + b for a in left for b in right} if len(left) * len(right) <= FLUSH_AT else None

    def exact(items) -> set[str] | None:
        """All strings of a short literal expression, else None."""
        out: set[str] | None = {""}
        for kind, value in items:
            if kind is op.LITERAL:
                nxt: set[str] | None = {chr(value).lower()}
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
                nxt = {chr(v).lower() for _, v in value}
            elif kind is op.SUBPATTERN:
                nxt = exact(value[3])
            elif kind is op.BRANCH:
                parts = [exact(p) for p in value[1]]
                nxt = None if any(p is None for p in parts) else set().union(*parts)
            elif kind is op.MAX_REPEAT and value[1] == 1:
                inner = exact(value[2])
                nxt = None if inner is None else (inner | {""} if value[0] == 0 else inner)
            elif kind is op.MAX_REPEAT and value[0] == value[1] and value[0] <= 8:
                nxt = exact(list(value[2]) * value[0])
            else:
                nxt = None
            out = None if out is None or nxt is None else product(out, nxt)
            if out is None:
                return None
        return out

    def walk(items, strings: set[str]) -> set[str]:
        for item in items:
            kind, value = item
            known = exact([item])
            joined = None if known is None else product(strings, known)
            if joined is not None:
                strings = joined
            elif known is not None:
                strings = product(flush(strings), known) or {""}
            elif kind is op.SUBPATTERN:
                strings = walk(value[3], strings)
            elif kind is op.MAX_REPEAT and value[0] >= 1:
                flush(walk(value[2], strings))
                strings = {""}
            else:
                strings = flush(strings)
        return strings

    flush(walk(_parser.parse(pattern), {""}))
    return clauses


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams any rule asks for; their number depends on the rules alone."""
    return sorted({t for r in rules for c in trigram_query(r.pattern) for s in c for t in s})


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id") -> DataFrame:
    """The inverted index restricted to ``trigrams``: a row (trigram number, key) per document that has it."""
    low = docs.select(F.col(key).alias(key), F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    found = F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])
    return low.select(F.explode(F.array_compact(found)).alias("trigram"), key)


def candidates(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str], key: str = "doc_id") -> DataFrame:
    """Intersect postings: per document a flag for every rule with a query; documents that fail all are left out.

    Postings of a document meet as bits; they combine before the shuffle.
    """
    words = range((len(trigrams) + 62) // 63)
    bit = F.expr("shiftleft(cast(1 as bigint), trigram % 63)")
    sets = index.groupBy(key).agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in words])

    def holds(wanted: frozenset[str]) -> Column:
        masks = [0 for _ in words]
        for t in wanted:
            i = trigrams.index(t)
            masks[i // 63] |= 1 << (i % 63)
        return reduce(Column.__and__, [F.col(f"_w{w}").bitwiseAND(F.lit(m)) == m for w, m in enumerate(masks) if m])

    flags = {}
    for r in rules:
        query = trigram_query(r.pattern)
        if query:
            flags[f"_is_{r.kind}"] = reduce(Column.__and__, [reduce(Column.__or__, [holds(s) for s in sorted(c, key=sorted)]) for c in query])
    out = sets.select(key, *[c.alias(n) for n, c in flags.items()])
    return out.where(reduce(Column.__or__, [F.col(n) for n in flags]))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the matches that pass, from the texts between the matches and the matches."""
    pattern = F.lit(rule.guard or rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(F.split(text, rule.guard or rule.pattern, -1).alias("gap"), whole.alias("hit"), tested.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,number:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end"))
        keep = F.length(x["part"]) >= rule.least
        return F.struct(F.coalesce(end, a["at"]).alias("at"), F.when(keep, F.array_append(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.aggregate(zipped, start, step)["out"]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """Add ``spans``: all spans of the rules as (start, number, end), by start and then by the rule's number."""
    trigrams = vocabulary(rules)
    hits = candidates(postings(docs, trigrams, key), rules, trigrams, key).withColumnRenamed(key, "_key")
    flagged = docs.withColumn("_text", F.coalesce("text", F.lit(""))).join(hits, F.col(key).eqNullSafe(F.col("_key")), "left")
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    found = []
    for i, r in enumerate(rules):
        seen = F.col("_text").rlike(r.guard or r.pattern)
        asked = F.col(f"_is_{r.kind}") if f"_is_{r.kind}" in hits.columns else F.lit(True)
        found.append(F.when(F.coalesce(asked, F.lit(False)) & seen, spans(F.col("_text"), r, i)).otherwise(none))
    return flagged.withColumn("spans", F.array_sort(F.flatten(F.array(*found)))).drop("_text", *hits.columns)


def joined(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"], s["end"])), ",")


def summary(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row the number of base spans by kind, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    numbers = F.transform("spans", lambda s: s["number"])
    counts = [(F.size("spans") - F.size(F.array_remove(numbers, F.lit(i)))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return scanned.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """``summary`` of ``scan`` over the documents as DuckDB SQL, without an index."""

    def text(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    parts, spans_of = [], []
    for i, r in enumerate(rules):
        p = text(r.guard or r.pattern)
        parts.append(f"regexp_extract_all(text, {p}, 0) AS h{i}, regexp_extract_all(text, {p}, {r.group}) AS g{i}, string_split_regex(text, {p}) AS s{i}")
        upto = f"CAST(list_sum(list_transform(s{i}[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h{i}[1:k-1], lambda x: length(x))), 0) AS BIGINT)"
        one = f"{{'start': {upto}, 'number': {i}, 'end': {upto} + length(h{i}[k]), 'size': length(g{i}[k])}}"
        spans_of.append(f"list_filter(list_transform(range(1, len(h{i}) + 1), lambda k: {one}), lambda x: x.size >= {r.least})")
    kinds = "[" + ", ".join(text(r.kind) for r in rules) + "]"

    def joined_of(found: str) -> str:
        return f"array_to_string(list_transform({found}, lambda s: {kinds}[s.number + 1] || ':' || s.start || ':' || s.end), ',')"

    counts = ", ".join(f"len(list_filter(found, lambda x: x.number = {i})) AS n_{r.kind}" for i, r in enumerate(BASE))
    base = f"list_filter(found, lambda x: x.number < {len(BASE)})"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (SELECT doc_id, {", ".join(parts)} FROM t),
        f AS (SELECT doc_id, list_sort(flatten([{", ".join(spans_of)}])) AS found FROM m)
        SELECT doc_id, {counts}, sha256({joined_of(base)}) AS base_sha256, {joined_of("found")} AS spans FROM f"""
