"""Snapshots against features over the whole history; upserts that read only what they may touch; keyed form."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rankpanel.catalog.base import panel
from rankpanel.operators import features as ft
from rankpanel.operators import snapshots, store
from rankpanel.session import scratch_path
from rankpanel.streaming import ingest
from rankpanel.streaming.ingest import LEAF, DealtFormProcessor, FormProcessor
from tests.conftest import SF


def lags(entity):
    windows = {"short": 3, "long": 10}
    return ft.rolling_lags(entity, ["Quali_Pos"], windows) + ft.ewm_lags(entity, ["Quali_Pos"], windows) + ft.sprint_lags(entity) + ft.championship_lags(entity) + ft.cluster_lags(entity)


def same(a, b, key):
    columns = sorted(c for c in a.columns if c not in key)
    left, right = ({tuple(r[k] for k in key): [r[c] for c in columns] for r in df.select(*key, *columns).collect()} for df in (a, b))
    assert left.keys() == right.keys()
    for k, row in left.items():
        assert row == pytest.approx(right[k], abs=1e-9, nan_ok=True), (k, [c for c, x, y in zip(columns, row, right[k]) if x != y])


@pytest.mark.parametrize("entity", ["Driver", "Team"])
def test_snapshots_resume_and_advance(spark, entity):
    rows = panel(spark, SF).where("Year >= 1998").cache()
    key = [entity, "Year", "Race_Num"]
    source = snapshots.team_events(rows, lags(entity)) if entity == "Team" else rows
    whole = ft._apply(source, entity, lags(entity), team=entity == "Team", events=None)
    taken = snapshots.take(rows.where("Year < 2001"), entity, lags(entity))
    new = source.where("Year >= 2001")
    outs = [lag.out for lag in lags(entity)]
    same(snapshots.resume(new, taken).select(*key, *outs), whole.where("Year >= 2001").select(*key, *outs), key)
    # In two steps, the first one within a season.
    early = snapshots.take(rows.where("Year < 2000 OR (Year = 2000 AND Race_Num < 6)"), entity, lags(entity))
    middle = source.where("(Year = 2000 AND Race_Num >= 6)")
    later = snapshots.advance(early, middle)
    same(snapshots.resume(middle, early).select(*key, *outs), whole.where("Year = 2000 AND Race_Num >= 6").select(*key, *outs), key)
    same(snapshots.resume(new, later).select(*key, *outs), whole.where("Year >= 2001").select(*key, *outs), key)


def test_upsert_reads_touched_partitions_only(spark):
    path = scratch_path(spark, "moving")
    ingest.prepare_table(spark, path, spark.createDataFrame([], "id long, day int, v double, ver int").schema, "day")
    rows = spark.range(1000).select("id", (F.col("id") % 20).cast("int").alias("day"), F.lit(1.0).alias("v"), F.lit(1).alias("ver"))
    store.upsert_table(path, rows, ["id"], "day", order=["ver"])
    assert set(store.table_schema(spark, path).fieldNames()) == {"id", "day", "v", "ver"}
    before = spark.read.parquet(path).inputFiles()
    move = spark.createDataFrame([(3, 7, 2.0, 2), (5000, 7, 3.0, 1)], "id long, day int, v double, ver int")
    store.upsert_table(path, move, ["id"], "day", order=["ver"])
    after = spark.read.parquet(path).inputFiles()
    changed = {f.split("day=")[1].split("/")[0] for f in set(after) ^ set(before)}
    assert changed == {"3", "7"}
    got = {r["id"]: (r["day"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert got[3] == (7, 2.0) and got[5000] == (7, 3.0) and len(got) == 1001
    store.upsert_table(path, spark.createDataFrame([(3, 9, 0.0, 1)], "id long, day int, v double, ver int"), ["id"], "day", order=["ver"])
    assert {r["day"] for r in spark.read.parquet(path).where("id = 3").collect()} == {7}


def test_new_columns_and_types_of_a_stored_table(spark):
    path = scratch_path(spark, "typed")
    spark.createDataFrame([], "id long, Year int, n long").write.partitionBy("Year").parquet(path)
    store.upsert_table(path, spark.createDataFrame([(1, 2000, 5)], "id long, Year int, n long"), ["id", "Year"])
    store.upsert_table(path, spark.createDataFrame([(2, 2001, 6, "x")], "id long, Year int, n int, s string"), ["id", "Year"])
    stored = store.stored_table(path, spark.createDataFrame([], "id long, Year int"))
    assert dict(stored.dtypes) == {"id": "bigint", "Year": "int", "n": "bigint", "s": "string"}
    assert sorted((r["id"], r["n"], r["s"]) for r in stored.collect()) == [(1, 5, None), (2, 6, "x")]


class Value:
    def __init__(self):
        self.v = None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map:
    def __init__(self):
        self.d, self.reads = {}, 0

    def getValue(self, k):
        self.reads += 1
        return self.d[k]

    def updateValue(self, k, v):
        self.d[k] = ([*v[0]], [*v[1]])


def test_form_state_in_any_order_reads_few_leaves():
    import pandas as pd

    rng = random.Random(1)
    order = list(range(1000))
    rng.shuffle(order)
    truth = {s: (None if s % 17 == 0 else float(s % 11)) for s in order}
    p = FormProcessor(3)
    p.leaves, p.index = Map(), Value()
    latest, reads = {}, []
    for lo in range(0, 1000, 5):
        part = order[lo : lo + 5]
        p.leaves.reads = 0
        for out in p.handleInputRows(("d",), iter([pd.DataFrame({"seq": part, "Position": [truth[s] for s in part]})]), None):
            latest |= {r.seq: r.form for r in out.itertuples()}
        reads.append(p.leaves.reads)
    for s in order:
        values = [truth[x] for x in range(max(0, s - 3), s) if truth[x] is not None]
        want = sum(values) / len(values) if values else None
        assert (latest[s] == pytest.approx(want)) if want is not None else latest[s] != latest[s]
    # Five results touch at most three leaves each, however many came before.
    assert max(reads) <= 15 and all(len(v[0]) <= LEAF for v in p.leaves.d.values())


class CountedMap(Map):
    def __init__(self):
        super().__init__()
        self.writes = 0

    def getValue(self, k):
        self.reads += 1
        return self.d.get(k)

    def updateValue(self, k, v):
        self.writes += 1
        self.d[k] = v


def test_dealt_drivers_share_a_call_and_one_value_each():
    import pandas as pd

    rng = random.Random(2)
    rows = [(d, s, float(rng.randrange(1, 20))) for d in range(40) for s in range(84)]
    rng.shuffle(rows)
    p = DealtFormProcessor(3)
    p.leaves, p.index = CountedMap(), CountedMap()
    latest, frames = {}, 0
    for lo in range(0, len(rows), 1000):
        part = pd.DataFrame(rows[lo : lo + 1000], columns=["Driver", "seq", "Position"])
        p.index.reads = p.index.writes = 0
        for out in p.handleInputRows((7,), iter([part[:400], part[400:]]), None):
            frames += 1
            latest |= {(r.Driver, r.seq): r.form for r in out.itertuples()}
        assert p.index.reads == p.index.writes == part["Driver"].nunique() and p.leaves.reads == p.leaves.writes == 0
    assert frames == math.ceil(len(rows) / 1000)
    truth = {(d, s): x for d, s, x in rows}
    for d, s, _ in rows:
        values = [truth[d, x] for x in range(max(0, s - 3), s)]
        assert latest[d, s] == pytest.approx(sum(values) / len(values)) if values else latest[d, s] != latest[d, s]


def test_dealt_drivers_without_a_number():
    import pandas as pd

    p = DealtFormProcessor(3)
    p.leaves, p.index = CountedMap(), CountedMap()
    part = pd.DataFrame({"Driver": [None, None], "seq": [2, 1], "Position": [4.0, 6.0]})
    (out,) = p.handleInputRows((None,), iter([part]), None)
    assert out["Driver"].tolist() == [None, None] and out["seq"].tolist() == [1, 2] and out["form"].tolist()[1] == 6.0
