"""Cross-tokenizer alignment against whole texts encoded without cuts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rankpanel.llm import alignment
from rankpanel.llm.tables import table

from tests.conftest import SF


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers()


def direct(tokenizers, text):
    """Groups and links of one text: boundaries where both sides end, overlaps by comparing all tokens."""
    if not text:
        return None
    from sentencepiece import SentencePieceProcessor

    if not hasattr(tokenizers, "plain"):
        import public_tokenizers

        tokenizers.plain = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids
    b = tokenizers.plain.encode(text)
    sides = []
    for ids, of in ((a, tokenizers.bytes_a), (b, tokenizers.bytes_b)):
        if b"".join(of[i] for i in ids) != (" " + text).encode():
            return None
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of[i]), i))
            at += len(of[i])
        sides.append(out)
    cuts = sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]})
    groups, last = [], 0
    for c in cuts:
        groups.append("|".join(",".join(str(i) for s, e, i in side if last <= s and e <= c) for side in sides))
        last = c
    links, j = [], 0
    for s, e, i in sides[0]:
        while sides[1][j][1] <= s:
            j += 1
        k = j
        while k < len(sides[1]) and sides[1][k][0] < e:
            links.append((i, sides[1][k][2]))
            k += 1
    return a, b, groups, links


def expected(tokenizers, texts):
    known = [direct(tokenizers, t) for t in texts]
    count = Counter(x for d in known if d for x in d[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (len(d[0]), len(d[1]), len(d[2]), len(d[3]), sum(count[x] == most[x[1]] for x in d[3]), sum(count[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest())
        if d else (0, 0, 0, 0, 0, 0, "")
        for d in known
    ]


def compare(spark, tokenizers, rows):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, part int, unit string")
    got = alignment.align(docs, texts=True).collect()
    want = expected(tokenizers, [t for _, t in rows])
    assert sorted(((r[0], *r[1:8]) for r in got), key=repr) == sorted(((k, *w) for (k, _), w in zip(rows, want)), key=repr)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_a"])


ODD = [
    None, "", " ", "  ", "\n", "a", "The cat's hat", "  two  spaces ", "tab\tand\nline\r\nend ", "\n\nfirst", "x \n y", "<|endoftext|> <s> </s> <unk> <0x0A>", "under▁score", "▁",
    "naïve café — “quoted” … 中文字符 日本語 😀👍🏽 é", "a b　c d   e", "1234567890 3.14 1,000", "\x00 zero \x01", "don't  we'll\nThey're", "a" * 2000, "word " * 500, ");\r\n}\r } \r x",
    "The cat's hat", "def f(x):\n    return x  # ok\n", "﻿bom ​zero", "éa ä̈  x  y",
]


def test_alignment_equals_whole_texts(spark, tokenizers):
    rng = random.Random(5)
    alphabet = list("ab c  \n\n\t\r.,'s1é中▁😀") + [" ", " ", " the", " of", "ing"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    compare(spark, tokenizers, list(enumerate(ODD + made)))


def test_alignment_of_repeated_and_null_keys(spark, tokenizers):
    compare(spark, tokenizers, [(None, "one two"), (None, "one two"), (3, "two three"), (3, None)])


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id string, text string"), "doc_id").collect() == []


def test_alignment_of_documents(spark, tokenizers):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r[0]: tuple(r[1:8]) for r in alignment.align(docs).collect()}
    assert got == {k: w for (k, _), w in zip(rows, expected(tokenizers, [t for _, t in rows]))}


def test_groups_break_where_both_sides_end():
    start, end = np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 6, 3, 5, 6])
    order, group = alignment.coalesce(start, end)
    of = np.empty(6, int)
    of[order] = group
    assert of.tolist() == [0, 0, 1, 0, 0, 1]
    left, right = alignment.overlaps(start[:3], end[:3], start[3:], end[3:])
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2)]
