"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rankpanel.llm import curriculum, decontaminate, licenses, order_minhash, pii, quality, secrets, sorted_projections, substrings, tokens

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, found string, score string, position string, n_words string, repeats string, kept string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, LONG), (6, "same words here and there"), (7, "same words here and there"),
             (7, "same words here and there"), (None, "no id"), (None, None)]
    rows = [(i, t, None, (None, "a", "b")[k % 3], None, *("x" * 8)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, " ".join(f"w{i}x{i}" for i in range(3, 15)))], "item_id long, text string")


def test_secrets(odd):
    got = secrets.summary(secrets.scan(odd)).collect()
    assert len(got) == 10
    assert {r.n_hex for r in got} == {0}
    assert secrets.scan(odd.limit(0)).count() == 0


def test_pii(odd):
    got = pii.pseudonymise(odd, "k")
    assert got.count() == 10
    assert got.where("text is null").count() == 2
    assert got.where("size(found) > 0").count() == 0
    assert pii.pseudonymise(odd.limit(0), "k").count() == 0


def test_quality(odd, labels):
    got = quality.score(odd, labels).collect()
    assert len(got) == 10
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score(odd.limit(0), labels).count() == 0
    assert {r.score for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_curriculum(odd):
    got = curriculum.by_position(curriculum.plan(odd)).collect()
    assert len(got) == 10
    assert all(r.taken <= 2 * r["size"] for r in got)
    mixed = curriculum.apply_plan(odd)
    assert mixed.columns == odd.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert curriculum.by_position(curriculum.plan(odd.limit(0))).count() == 0


def test_substrings(odd):
    got = substrings.remove_repeats(odd).collect()
    assert len(got) == 10
    assert sorted(r.n_words for r in got) == [0, 0, 0, 0, 1, 2, 5, 5, 5, 120_000]
    assert {r.n_removed for r in got if r.n_words < 35} == {0}
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


def test_order_minhash(odd):
    got = order_minhash.groups(odd).collect()
    assert len(got) == 10
    assert sum(not r.kept for r in got) == 3
    kept = order_minhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert order_minhash.groups(odd.limit(0)).count() == 0


def test_decontaminate(odd, items):
    got = decontaminate.matches(odd, items).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(5, 4, 0)]
    clean = decontaminate.drop_contaminated(odd, items)
    assert clean.columns == odd.columns and clean.count() == 9
    assert decontaminate.matches(odd.limit(0), items).count() == 0
    assert decontaminate.matches(odd, items.limit(0)).count() == 0


def test_licenses(odd):
    got = licenses.scan(odd.withColumn("path", F.expr("if(doc_id = 4, null, concat('a/', doc_id))")), "path").collect()
    assert len(got) == 10
    assert {r.license_in_force for r in got} == {None}
    assert licenses.scan(odd.limit(0).withColumn("path", F.lit("a/b")), "path").count() == 0


def test_tokens(odd):
    got = tokens.round_trip(odd).collect()
    assert len(got) == 10
    assert sorted(r.n_tokens for r in got)[:3] == [1, 1, 1]
    assert [r.start for r in sorted(got, key=lambda r: r.start)][0] == 0
    assert tokens.round_trip(odd.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
            (8, [inf, 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [None, 1.0], 1), (12, [1.0, 0.0], 2), (12, [1.0, 0.0], 2), (None, [0.0, 1.0], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, component_id string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in sorted_projections.groups(table).collect())
    assert got[1:4] == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]
    assert [g[1] for g in got[4:12]] == [0] * 8
    assert sorted(g[1:] for g in got if g[0] == 12) == [(1, 12, False), (1, 12, True)]
    assert sorted_projections.groups(table.limit(0)).count() == 0
