from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rankpanel.operators import clean, store
from rankpanel.session import scratch_path
from rankpanel.sources import sinks

KEY = ["Year", "Race_Num", "Driver"]


@pytest.fixture
def stored_path(spark, races):
    path = scratch_path(spark, "races")
    store.full_refresh(path, races)
    return path


def test_upsert_is_idempotent(spark, races, stored_path):
    store.upsert_table(stored_path, races, KEY)
    store.upsert_table(stored_path, races, KEY)
    assert spark.read.parquet(stored_path).count() == races.count()


def test_upsert_overwrites_and_keeps_the_rest(spark, races, stored_path):
    batch = races.where("Year = 2024 AND Race_Num = 3").withColumn("Position", F.lit(99.0))
    store.upsert_table(stored_path, batch, KEY)
    after = spark.read.parquet(stored_path)
    assert after.count() == 40
    assert [r["Race_Num"] for r in after.where("Position = 99").collect()] == [3]


def test_empty_batch_changes_nothing(spark, races, stored_path):
    store.upsert_table(stored_path, races.limit(0), KEY)
    assert spark.read.parquet(stored_path).count() == 40


def test_year_range_is_inclusive_and_open(races):
    assert store.year_range(races, 2024, 2024).count() == 20
    assert store.year_range(races, 0, 2023).count() == 20
    assert store.year_range(races, None, None).count() == 40


def test_log(spark):
    log = spark.createDataFrame([(2023, 1, "R"), (2023, 2, "Q")], "Year int, Race_Num int, session string")
    marked = store.mark_processed(log, spark.createDataFrame([(2023, 3, "R"), (2023, 1, "R")], log.schema))
    assert sorted((r[0], r[1]) for r in store.processed_events(marked).collect()) == [(2023, 1), (2023, 3)]
    assert store.is_processed(marked, 2023, 2, "Q") and not store.is_processed(marked, 2023, 2, "R")


def test_checksum_ignores_order_and_sees_changes(races):
    cols = ["Driver", "Team", "Position", "Grid"]

    def sums(df):
        return {(r[0], r[1]): r["checksum"] for r in store.batch_checksum(df, ["Year", "Race_Num"], cols).collect()}

    assert sums(races) == sums(races.orderBy(F.rand(1)))
    assert sums(races) != sums(races.withColumn("Grid", F.col("Grid") + 1))


def test_cache_expires(spark):
    cache = spark.createDataFrame([], "key string, fetched_at timestamp, payload string, expires_at timestamp")
    entry = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), "{}")], "key string, fetched_at timestamp, payload string")
    cache = store.cache_put(cache, entry, 12)
    assert store.cache_lookup(cache, F.lit("2024-01-01 11:00:00").cast("timestamp")).count() == 1
    assert store.cache_lookup(cache, F.lit("2024-01-01 12:00:00").cast("timestamp")).count() == 0


def test_latest_by_keeps_the_last_row(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)], "k int, seq int, v string")
    assert sorted(map(tuple, store.latest_by(df, ["k"], ["seq"]).select("k", "v").collect())) == [(1, "c"), (2, None)]


def test_contract(spark):
    df = spark.createDataFrame([(1.0, None, "x")], "a double, b double, extra string")
    with pytest.raises(clean.ContractError):
        clean.enforce_contract(df, ["a", "c"], {})
    got = clean.enforce_contract(df, ["c", "b", "a"], {"b": 4.0, "c": float("inf")}, critical=["a"])
    assert got.columns == ["c", "b", "a"] and tuple(got.first()) == (0.0, 4.0, 1.0)


def test_roster_needs_driver_and_team(spark, races):
    path = scratch_path(spark, "csv")
    races.select("Driver").write.csv(path, header=True)
    with pytest.raises(ValueError):
        sinks.read_roster_csv(spark, path, 2024, "X", spark.createDataFrame([], "Year int, RoundNumber int, EventName string"))


def test_feature_cache_reuses_equal_inputs_only(spark, races):
    root, calls = scratch_path(spark, "cache"), []

    def build():
        calls.append(1)
        return races.select(*KEY)

    sinks.cached_features(spark, root, [races], ["a"], "1", build)
    sinks.cached_features(spark, root, [races.orderBy(F.rand(2))], ["a"], "1", build)
    assert len(calls) == 1
    sinks.cached_features(spark, root, [races], ["b"], "1", build)
    assert len(calls) == 2


def test_records_write_nan_as_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.5)], "a int, b double")
    assert [r[0] for r in store.to_records(df).collect()] == ['{"a":1,"b":null}', '{"a":2,"b":null}', '{"a":3,"b":1.5}']


def test_checkpoint_setting_is_read():
    from types import SimpleNamespace

    from rankpanel.session import checkpoint_dir

    def session(value, master):
        conf = SimpleNamespace(get=lambda key, default=None: value if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-x"))

    assert checkpoint_dir(session("s3a://shared/ckpt/", "yarn")) == "s3a://shared/ckpt"
    with pytest.raises(RuntimeError):
        checkpoint_dir(session(None, "yarn"))
    assert checkpoint_dir(session(None, "local[4]"))
