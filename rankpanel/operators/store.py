"""Table scans, keyed upserts, the ingestion log and the TTL cache."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rankpanel.functions.columns import contains_flag, digest_number, row_digest, utc_naive
from rankpanel.session import materialize

LOG_KEY = ["Year", "Race_Num", "session"]


def year_range(df: DataFrame, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Inclusive bounds; 0 or None leaves a side open. Prunes ``Year`` partitions."""
    if start_year:
        df = df.where(F.col("Year") >= start_year)
    if end_year:
        df = df.where(F.col("Year") <= end_year)
    return df


def unique_rows(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch as it is; a key that repeats fails the job, as a primary key would."""
    rest = [c for c in batch.columns if c not in keys]
    one = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(F.lit(1).alias("_one"), *rest)).alias("_row"))
    failed = F.raise_error(F.concat(F.lit("key repeats in the batch: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    row = F.when(F.col("_n") > 1, failed.cast(one.schema["_row"].dataType)).otherwise(F.col("_row")).alias("_row")
    return one.select(*keys, row).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in batch.columns])


def upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``batch`` replace rows with the same key; columns match by name, absent ones are null.

    With ``order`` the row with the largest values stays, whether it was stored
    or is new, so repeated keys and late batches are harmless. Without it a key
    may be in the batch once only.
    """
    if order:
        return latest_by(existing.unionByName(batch, allowMissingColumns=True), keys, order)
    kept = existing.join(batch.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(unique_rows(batch, keys), allowMissingColumns=True)


#: Folder inside a table for what the upsert knows about it; Spark's readers pass it over.
META = "_rankpanel"
#: Folders of the key map; a batch reads and rewrites those its keys fall into.
MAP_BUCKETS = 64


def table_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema kept beside a table, from one small file; None for tables the upsert has not written yet."""
    try:
        row = spark.read.text(f"{path}/{META}/schema", wholetext=True).first()
    except AnalysisException:
        return None
    return StructType.fromJson(json.loads(row[0])) if row and row[0].strip() else None


def save_schema(spark: SparkSession, path: str, schema: StructType) -> None:
    plain = StructType([StructField(f.name, f.dataType) for f in schema.fields])
    spark.createDataFrame([(plain.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{path}/{META}/schema")


def stored_table(path: str, like: DataFrame) -> DataFrame:
    """A stored table with all columns any of its files has, typed as in ``like`` where that has them.

    With a kept schema no file is opened to plan the read; without one the
    schemas of all files are merged.
    """
    spark = like.sparkSession
    known = table_schema(spark, path)
    try:
        stored = spark.read.schema(known).parquet(path) if known else spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException:  # no file yet
        return spark.read.schema(like.schema).parquet(path).select(like.columns)
    types = dict(like.dtypes)
    found = [F.col(c).cast(types.get(c, t)).alias(c) for c, t in stored.dtypes]
    return stored.select(*found, *[F.lit(None).cast(t).alias(c) for c, t in like.dtypes if c not in stored.columns])


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(MAP_BUCKETS)).cast("int").alias("bucket")


def _key_map(path: str, existing: DataFrame, keys: Sequence[str], partition: str, buckets: Sequence[int]) -> DataFrame:
    """(keys, bucket, at): the partition each stored key is in, for the given buckets; made from the table the first time."""
    spark = existing.sparkSession
    where = f"{path}/{META}/keys"
    shape = StructType([*[StructField(k, existing.schema[k].dataType) for k in keys], StructField("at", existing.schema[partition].dataType), StructField("bucket", IntegerType())])
    try:
        found = spark.read.schema(shape).parquet(where)
    except AnalysisException:
        rows = existing.select(*keys, F.col(partition).alias("at"), _bucket(keys))
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(where)
        found = spark.read.schema(shape).parquet(where)
    return found.where(F.col("bucket").isin(list(buckets)))


def upsert_table(
    path: str, batch: DataFrame, keys: Sequence[str], partition: str = "Year", stored: bool = False, order: Sequence[str] = ()
) -> None:
    """Upsert into a partitioned table; only partitions the batch touches are read and rewritten.

    The merged rows are written aside first, so a lost executor never reads a
    partition that is being replaced. ``stored`` says that the batch is a
    written table already. Stored columns that the batch lacks stay, and columns
    keep their stored types. If the partition is no part of the key, a row can
    move: a map from keys to partitions, kept beside the table and cut into
    buckets, tells which partitions may hold a key of the batch, so the others
    are neither listed nor scanned. Schema and map are written after the data; a
    missing one is made anew from the table. The rebalance hint gives files of
    even size and splits a large partition over tasks.
    """
    batch = batch if stored else materialize(batch, "batch")
    if batch.isEmpty():
        return
    spark = batch.sparkSession
    known = table_schema(spark, path)
    existing = stored_table(path, batch)
    # one value per table folder: this list prunes the scan to the touched partitions
    values = [r[0] for r in batch.select(partition).distinct().collect()]
    moving = partition not in keys
    if moving:
        buckets = [r[0] for r in batch.select(_bucket(keys)).distinct().collect()]  # MAP_BUCKETS at most
        key_map = _key_map(path, existing, keys, partition, buckets)
        moved = key_map.join(batch.select(*keys).distinct(), list(keys), "left_semi").select("at").distinct()
        values = sorted({*values, *[r[0] for r in moved.collect()]}, key=str)
    touched = existing.where(F.col(partition).isin(values))
    merged = upsert(touched, batch, keys, order)
    types = {f.name: f.dataType for f in known.fields} if known else {}
    merged = materialize(merged.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in merged.columns]), "merged")
    (
        merged.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    wanted = StructType([*(known.fields if known else []), *[f for f in merged.schema.fields if f.name not in types]])
    if known is None or len(wanted) != len(known):
        save_schema(spark, path, wanted)
    if moving:
        left = {r[0] for r in merged.select(partition).distinct().collect()}
        _drop_partitions(spark, path, partition, [v for v in values if v not in left])
        now = merged.join(batch.select(*keys).distinct(), list(keys), "left_semi").select(*keys, F.col(partition).alias("at"), _bucket(keys))
        rest = key_map.join(batch.select(*keys).distinct(), list(keys), "left_anti")
        fresh = materialize(rest.unionByName(now), "key-map")
        fresh.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{META}/keys")


def _drop_partitions(spark, path: str, partition: str, values: Sequence) -> None:
    """Delete the folders of partitions that lost their last row."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for value in values:
        folder = hadoop(f"{path}/{partition}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def full_refresh(path: str, df: DataFrame, partition: str = "Year") -> None:
    """Replace a whole table."""
    rows = materialize(df, "refresh").hint("rebalance", partition)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(partition).parquet(path)


def log_entries(rows: DataFrame, session: str, cols: Sequence[str], loaded_at: Column) -> DataFrame:
    """A log row per event of a loaded batch: rows, checksum and load time."""
    event = ["Year", "Race_Num"]
    return batch_checksum(rows, event, cols).select(*event, F.lit(session).alias("session"), "rows", "checksum", loaded_at.alias("loaded_at"))


def mark_processed(log: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(log, batch, LOG_KEY)


def processed_events(log: DataFrame) -> DataFrame:
    return log.where(F.col("session") == "R").select("Year", "Race_Num").distinct()


def is_processed(log: DataFrame, year: int, race_num: int, session: str) -> bool:
    hit = (F.col("Year") == year) & (F.col("Race_Num") == race_num) & (F.col("session") == session)
    return not log.where(hit).isEmpty()


def batch_checksum(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Order-free checksum per group: md5 of the row count and the sum of row digests.

    Sums combine on the map side, so a large group is never gathered in one task.
    """
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(digest_number(row_digest(cols))).cast("decimal(38,0)").alias("_sum")
    )
    text = F.concat_ws(":", F.col("rows").cast("string"), F.col("_sum").cast("string"))
    return agg.select(*keys, "rows", F.md5(text).alias("checksum"))


def cache_put(cache: DataFrame, entries: DataFrame, ttl_hours: int) -> DataFrame:
    """Add (key, fetched_at, payload) rows with their expiry; the key's old entry goes."""
    fresh = with_expiry(entries, ttl_hours)
    return upsert(cache, fresh.select(cache.columns), ["key"])


def with_expiry(entries: DataFrame, ttl_hours: int) -> DataFrame:
    return entries.withColumn("expires_at", F.col("fetched_at") + F.make_dt_interval(hours=F.lit(ttl_hours)))


def cache_lookup(cache: DataFrame, as_of: Column) -> DataFrame:
    """Entries that have not expired at ``as_of``."""
    return cache.where(F.col("expires_at") > as_of)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the largest ``order`` values, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def events_to_load(schedule: DataFrame, log: DataFrame, as_of: Column, force: bool = False) -> DataFrame:
    """Rounds to ingest: per season up to the first future event, without round 0 and loaded events.

    The window runs inside one season's schedule.
    """
    upto = Window.partitionBy("Year").orderBy("RoundNumber").rowsBetween(Window.unboundedPreceding, 0)
    future = F.coalesce((F.col("EventDate") > as_of).cast("int"), F.lit(0))
    due = (
        schedule.withColumn("_future", F.max(future).over(upto))
        .where((F.col("_future") == 0) & (F.col("RoundNumber") > 0))
        .drop("_future")
    )
    if force:
        return due
    done = processed_events(log).withColumnRenamed("Race_Num", "RoundNumber")
    return due.join(done, ["Year", "RoundNumber"], "left_anti")


def extract_races(session_rows: DataFrame, weather: DataFrame, events: DataFrame) -> DataFrame:
    """Session rows with event attributes, mean session weather and the sprint flag."""
    means = weather.groupBy("Year", "Race_Num").agg(
        *[F.avg(c).alias(c) for c in ("AirTemp", "Humidity", "Pressure", "WindSpeed", "Rainfall")]
    )
    return _with_event(session_rows, events).join(means, ["Year", "Race_Num"], "left")


def extract_qualifying(session_rows: DataFrame, events: DataFrame) -> DataFrame:
    return _with_event(session_rows, events)


def _with_event(session_rows: DataFrame, events: DataFrame) -> DataFrame:
    named = events.select(
        "Year",
        F.col("RoundNumber").alias("Race_Num"),
        F.col("EventName").alias("Circuit"),
        F.col("EventDate").alias("Date"),
        contains_flag(F.col("EventFormat"), "sprint").alias("Is_Sprint"),
    )
    text = [c for c in ("Team", "Status") if c in session_rows.columns]
    filled = session_rows.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in text})
    return filled.join(named, ["Year", "Race_Num"])


def schedule_listing(schedule: DataFrame, zone: str) -> DataFrame:
    return schedule.select("Year", "RoundNumber", "EventName", utc_naive(F.col("EventDate"), zone).alias("EventDateUtc"))


def to_records(df: DataFrame, out: str = "record") -> DataFrame:
    """Each row as one JSON text; NaN becomes null and nulls are written out."""
    cols = [
        F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes
    ]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(out))
