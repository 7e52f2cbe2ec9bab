"""Operators against brute force, round trips, planted cases and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankpanel.llm import decontaminate, licenses, order_minhash, pii, quality, range_coder, secrets, sorted_projections, substrings, words
from rankpanel.llm.queries import ORACLES, QUERIES
from rankpanel.llm.tables import table
from tests.conftest import SF
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark):
    assert compare(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df()) is None


def test_secret_spans(spark, docs):
    planted = [(10_000, "token: secret: abcdefghijkl x"), (10_001, "PassWord = 'abcdefghijkl' AKIAAKIA0123456789 é deadbeefdeadbeef01"), (10_002, "api-key=abcdefghijklm api_key:abcdefghijklm")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = [("assign", assign, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    found = 0
    for r in secrets.summary(secrets.scan(both)).join(both, "doc_id").collect():
        want = sorted((m.start(), i, m.end()) for i, (_, p, g, n) in enumerate(kinds) for m in p.finditer(r.text) if len(m[g]) >= n)
        line = ",".join(f"{kinds[i][0]}:{a}:{b}" for a, i, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == i for w in want) for i in range(3))
        found += len(want)
    assert found > 5


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == []
    assert secrets.trigram_query("AKIA[A-Z]+") == [frozenset([frozenset(["aki", "kia"])])]
    assert secrets.trigram_query("(abc|bcd)+x?") == [frozenset([frozenset(["abc"]), frozenset(["bcd"])])]
    assert all(secrets.trigram_query(r.pattern) for r in secrets.RULES if r.kind != "hex")


def test_pseudonyms(spark):
    line = "a.b1@c.org 4111 1111 1111 1111 +1 (212) 555-0100 10.0.0.1 2020-02-29 31.12.1999 123-45-6789 DE89370400440532013000"
    bad = "4111 1111 1111 1112 999.1.1.1 2021-02-29 000-12-3456 DE88370400440532013000"
    df = spark.createDataFrame([(1, line), (2, f"again {line}"), (3, bad)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert got[1].found == ["email", "card", "phone", "ip", "iso_date", "day_date", "ssn", "iban"]
    assert got[2].text == f"again {got[1].text}"
    assert got[3].text == bad and got[3].found == []
    assert pii.pseudonymise(df, "other").first().text != got[1].text
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[1].text)[0].replace(" ", "")
    assert sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(card))) % 10 == 0
    assert set(line.split()) & set(got[1].text.split()) == {"+1"}
    assert pii.pseudonymise(pii.pseudonymise(df, "k").drop("found"), "k").first().found == got[1].found


def test_more_formats(spark):
    line = "(415) 555-2671 then 415-555-2671 then 12/31/1999 and +49 151 12345678, not 123-456-78901 or 13/32/1999 or 1.415-555-2671"
    got = pii.pseudonymise(spark.createDataFrame([(1, line)], "doc_id long, text string"), "k").first()
    assert got.found == ["phone", "phone", "day_date", "phone"]
    assert re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4} then [2-9]\d\d-[2-9]\d\d-\d{4} then [01]\d/[0-3]\d/\d{4} and \+49 \d{3} \d{8}, not .*", got.text)
    assert got.text.endswith("not 123-456-78901 or 13/32/1999 or 1.415-555-2671")
    assert re.sub(r"\D", "", got.text[:14]) == re.sub(r"\D", "", got.text[20:32])


def test_feistel_is_a_permutation(spark):
    n = 17 * 23
    out = spark.range(n).select(pii.feistel(F.col("id"), F.lit(17).cast("long"), F.lit(23).cast("long"), "k", "t").alias("v"))
    assert sorted(r.v for r in out.collect()) == list(range(n))


def test_quality_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    marks = table(spark, folder, "labels")
    got = quality.score(table(spark, folder, "documents"), marks).join(marks, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_repeats(docs, texts):
    length = 35
    seen = Counter(" ".join(w[i : i + length]) for t in texts.values() for w in [WORD.findall(t)] for i in range(len(w) - length + 1))
    for r in substrings.remove_repeats(docs).collect():
        w = WORD.findall(texts[r.doc_id])
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[" ".join(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        assert (r.n_words, r.n_removed) == (len(w), sum(gone))
        assert r.kept == " ".join(x for x, g in zip(w, gone) if not g)


def _shingles(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    a, b, _ = words.spans(raw, np.array([0, len(raw)]))
    return order_minhash.labelled(words.hashes(raw, a, b))


def _lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_banded_similarity():
    pick = random.Random(5)
    base = [pick.choice("abcdefgh") * pick.randint(1, 3) for _ in range(90)]
    for edits in range(8):
        other = list(base)
        for _ in range(edits):
            other[pick.randrange(len(other))] = "z"
        if edits == 3:
            other = other[40:] + other[:40]
        x, y = _shingles(" ".join(base)), _shingles(" ".join(other))
        m = _lcs(x.tolist(), y.tolist())
        want = m / (len(x) + len(y) - m)
        got = order_minhash.similarity(x, y)
        assert (got >= 0.8) == (want >= 0.8) and (got < 0.8 or got == pytest.approx(want))


def test_near_copies(spark):
    pick = random.Random(9)
    base = [f"v{pick.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # a large group around one base, some of them too far from it
        text = list(base)
        for _ in range(1 + i // 10):
            text[pick.randrange(200)] = f"u{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(f"q{pick.randrange(10**6)}" for _ in range(200))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in order_minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in s}
    for _ in range(4):
        for i in s:
            for j in s:
                if i < j and order_minhash.similarity(s[i], s[j]) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    assert got == root


def test_copies_of_copies(spark):
    """Half are a base with few edits, half are copies of one of those, too far from the base for its hub."""
    pick = random.Random(4)
    base = [f"v{pick.randrange(10**6)}" for _ in range(200)]

    def edited(text: list[str], n: int) -> list[str]:
        text = list(text)
        for at in pick.sample(range(200), n):
            text[at] = f"u{pick.randrange(10**6)}"
        return text

    first = [edited(base, pick.randint(1, 3)) for _ in range(400)]
    rows = [*first, *(edited(pick.choice(first), 4) for _ in range(400))]
    s = [_shingles(" ".join(w)) for w in rows]
    ids, counts = np.unique(np.concatenate(s), return_counts=True)
    ids = ids[counts > 1]
    holds = np.array([np.isin(ids, x) for x in s], dtype=np.float32)
    shared = holds @ holds.T
    size = np.array([len(x) for x in s])
    near = shared >= 0.8 * (size[:, None] + size - shared)  # words are replaced in place, so order agrees
    seen = np.arange(len(rows)) == 0
    while (grown := seen | near[seen].any(axis=0)).sum() > seen.sum():
        seen = grown
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    apart = [r.doc_id for r in order_minhash.groups(frame).collect() if (r.component_id == 0) != seen[r.doc_id]]
    assert seen.sum() > 760 and len(apart) <= 1


def test_comparisons_follow_a_groups_size(spark, monkeypatch):
    """Edited copies of one text, many of them too far from it: links are found without meeting all others."""
    pick = random.Random(6)
    base = [f"v{pick.randrange(10**6)}" for _ in range(140)]
    rows = []
    for _ in range(500):
        text = list(base)
        for at in pick.sample(range(140), pick.randint(1, 6)):
            text[at] = f"u{pick.randrange(10**6)}"
        rows.append(text)
    rows += [[*rows[i][:70], "y", *rows[i][71:]] for i in range(0, 500, 25)]  # one edit from a copy
    compared = []
    pairs = order_minhash._pairs

    def counted(*args):
        out = pairs(*args)
        compared.append(out[0].count())
        return out

    monkeypatch.setattr(order_minhash, "_pairs", counted)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in order_minhash.groups(frame).collect()}
    s = [set(_shingles(" ".join(w)).tolist()) for w in rows]
    root = list(range(len(rows)))
    while True:
        before = list(root)
        for i in range(len(rows)):
            for j in range(i):
                if root[i] != root[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    assert sum(got[i] != root[i] for i in got) <= 1
    assert sum(compared) <= 10 * len(rows)


def test_needed_is_what_near_texts_share():
    pick = random.Random(3)
    met = 0
    for _ in range(4000):
        hub = set(range(90))
        cut = pick.sample(range(90), pick.randint(1, 30))
        a = hub - set(cut) | set(range(100, 100 + pick.randint(0, 25)))
        b = hub - set(cut[: pick.randint(0, len(cut))]) | set(range(100, 100 + pick.randint(0, 25)))

        def near(x, y):
            return len(x & y) >= 0.8 * len(x | y)

        if near(a, b) and not near(a, hub):
            met += 1
            assert len((a ^ hub) & (b ^ hub)) >= order_minhash.needed(len(b ^ hub), len(b), 90)
    assert met > 100


def test_vector_links(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(32)
    x = np.vstack([rng.standard_normal((300, 32)), centre + 0.25 * rng.standard_normal((400, 32))]).astype(np.float32)
    x[:20] = x[20:40]
    frame = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(700)[:, None] % 2 == np.arange(700) % 2)
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in sorted_projections.groups(frame).collect()}
    want = near.sum(axis=1)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.97 * want.sum()


def test_items_with_edits(spark):
    folder = "/root/testdata/sf0.001"
    items = table(spark, folder, "benchmark")
    pick = random.Random(3)
    pool = WORD.findall(" ".join(r.text for r in table(spark, folder, "documents").limit(40).collect()))
    rows, want = [], set()
    for r in items.collect():
        for share in (0.0, 0.1, 0.2):
            w = WORD.findall(r.text)
            for _ in range(int(share * len(w))):
                at = pick.randrange(len(w))
                w[at : at + pick.randint(0, 1)] = [pick.choice(pool)]
            want.add((len(rows), r.item_id))
            text = " ".join(pick.choices(pool, k=60) + w + pick.choices(pool, k=60))
            rows.append((len(rows), "".join(c.upper() if c.isascii() else c for c in text)))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert len(got & want) >= 0.98 * len(want)


def test_best_run():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8])
    assert decontaminate.best_run(a, np.array([9, 9, 1, 2, 3, 5, 6, 0, 8, 9])) == (2, 9)


def test_range_coder():
    rng = np.random.default_rng(1)
    for n in (0, 1, 15, 16, 17, 400):
        ids = rng.zipf(1.4, n) % 50_000
        data = range_coder.encode(ids, 16)
        assert (range_coder.decode(data) == ids).all()
    part = range_coder.decode(data, np.array([3, 24]))
    assert (part == np.concatenate([ids[48:64], ids[384:400]])).all()
    broken = bytearray(data)
    broken[-9] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode(bytes(broken))
    same = np.zeros(10_000, dtype=int)
    assert len(range_coder.encode(same)) < 400


def test_token_files(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for r in sorted(QUERIES["op6_range_coded_ids"](spark, SF).collect(), key=lambda r: r.doc_id):
        ids = np.array([*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pieces_tokenise_like_the_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    from rankpanel.llm.tokens import PieceTokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    hard = ["", " ", "  a  b", "x  y  z", "　 a 　b", "a\n\nb \n c", "don't we'll  ", "<|endoftext|> a <|endoftext|>", "é à  q", "t\t x\r\n c"]
    raw = [t.encode() for t in hard]
    ids, count = PieceTokenizer(path).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    at = 0
    for t, n in zip(hard, count):
        assert ids[at : at + n].tolist() == Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
        at += n


def test_new_pieces_are_words_without_their_marks():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from rankpanel.llm.tokens import PieceTokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, pieces = Tokenizer.from_file(path), PieceTokenizer(path)
    rng = random.Random(3)
    parts = [" ", " ", "a", "word", "Über", "élan", "×", "÷", "ß", "\u0301", "'s", "'ll", ".", ",", "!!", "***", "?)", "3", "x2", "\n", "\t", "<|endoftext|>", "—", "日本", "\u00a0", "$", "%%", "|", "Ā", ":"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    ids, count = pieces.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    fresh = PieceTokenizer(path)
    whole, met = fresh._whole, []
    fresh._whole = lambda some: met.extend(some) or whole(some)
    text = b"one two, two. Two! \xc3\xa9lan, \xc3\xa9lan one, one?"
    fresh.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert sorted(met) == [b"!", b",", b".", b"?"] and len(fresh.known) == 9


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x", "text\nReleased under the MIT License.\nmore text"), (3, "a/b/y", "nothing"),
        (4, "a/c/z", "nothing"), (5, "d/w", "nothing to license here"), (6, "a/b/e/f/g", "words"),
    ]
    got = {r.doc_id: (r.license, r.inherited_from, r.license_in_force) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "path").collect()}
    assert got[1] == ("Apache-2.0", None, "Apache-2.0")
    assert got[2] == ("MIT", None, "MIT")
    assert got[3] == (None, "a/b", "MIT")
    assert got[4] == (None, "a", "Apache-2.0")
    assert got[5] == (None, None, None)
    assert got[6] == (None, "a/b", "MIT")


def test_mix_targets(spark, docs):
    got = QUERIES["op7_curriculum_mix"](spark, SF).toPandas()
    again = QUERIES["op7_curriculum_mix"](spark, SF).toPandas()
    assert compare(got, again) is None
    size = docs.select("doc_id", "source").toPandas().merge(got, on="doc_id")
    per = size.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.source_size).all() and (abs(per.taken - per.target) <= 1).all()
    assert (got.taken <= 2 * got["size"]).all()
    want = dict(zip(sorted(per.index), [5.0, 2.0, 1.0] * 20))
    target, left, open_ = {}, 1.5 * per["size"].sum(), dict(want)
    while True:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > 2 * per["size"][s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * per["size"][s]
            left -= target[s]
            del open_[s]
    target |= {s: level * w for s, w in open_.items()}
    assert all(per.target[s] == pytest.approx(target[s]) for s in target)


def test_pipeline(spark, docs, texts):
    import corpus_pipeline as p

    good = {r.doc_id for r in quality.score(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    kept = docs
    for name, stage in p.STAGES[:3]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    first = {r.component_id for r in order_minhash.groups(docs.where(F.col("doc_id").isin(list(good)))).collect()}
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    left = {r.doc_id for r in kept.collect()}
    assert left <= first and all(any(i in texts[d] for i in items) for d in first - left)
    out = p.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= left
    ends = sorted((r.start, r.start + r.n_tokens) for r in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
