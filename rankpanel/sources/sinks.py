"""File sources and sinks: rosters, predictions, lineage, cache, evaluation, registry."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpanel.functions.columns import digest_number, row_digest


def read_roster_csv(spark: SparkSession, path: str, year: int, race_name: str, schedule: DataFrame) -> DataFrame:
    """A roster with at least Driver and Team; event columns default from the arguments and the schedule."""
    df = spark.read.csv(path, header=True)
    missing = {"Driver", "Team"} - set(df.columns)
    if missing:
        raise ValueError(f"roster file lacks {sorted(missing)}")
    named = schedule.where((F.col("Year") == year) & (F.col("EventName") == race_name))
    defaults = {
        "Year": F.lit(year),
        "Race_Name": F.lit(race_name),
        "Race_Num": F.coalesce(named.agg(F.min("RoundNumber")).scalar(), F.lit(0)),
        "Date": F.make_date(F.lit(year), F.lit(1), F.lit(1)),
    }
    types = {"Year": "int", "Race_Num": "int", "Date": "date", "Race_Name": "string"}
    cols = [(F.col(c).try_cast(types[c]) if c in df.columns else e).alias(c) for c, e in defaults.items()]
    return df.select("Driver", "Team", *cols)


def write_predictions(path: str, rows: DataFrame, meta: dict[str, str], generated_at: str) -> str:
    """Write rows and one run row; returns the run id, which is the same for the same run.

    A run has folders of its own, which a retry replaces.
    """
    run_id = "r" + hashlib.sha256(json.dumps({**meta, "at": generated_at}, sort_keys=True).encode()).hexdigest()[:16]
    spark = rows.sparkSession
    tagged = rows.withColumnsRenamed({"Year": "event_year"}).withColumns(
        {"run_id": F.lit(run_id), "model_type": F.lit(meta["model_type"]), "year": F.lit(int(meta["year"]))}
    )
    _replace(tagged, f"{path}/rows", ("model_type", "year", "run_id"))
    run = spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(generated_at).cast("timestamp").alias("generated_at"),
        F.array(*[F.lit(c) for c in rows.columns]).alias("columns"),
        *[F.lit(str(v)).alias(k) for k, v in meta.items()],
    )
    _replace(run, f"{path}/runs", ("run_id",))
    return run_id


def _replace(rows: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replace the partitions that ``rows`` has values for, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_lineage(path: str, rows: DataFrame, source: str) -> None:
    if source not in ("actual", "predicted"):
        raise ValueError(source)
    rows.withColumn("Quali_Source", F.lit(source)).write.mode("append").parquet(path)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of row digests): the same for any row order and partitioning."""
    cols = sorted(df.columns)
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(digest_number(row_digest(cols))), F.lit(0)).cast("decimal(38,0)").alias("s")
    ).first()
    return row["n"], int(row["s"])


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def cached_features(
    spark: SparkSession, root: str, inputs: Sequence[DataFrame], steps: Sequence[str], config: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Features stored under a key of their inputs, steps and settings.

    A marker is written after the data, so an interrupted write is not taken
    for a finished one.
    """
    key_text = json.dumps([[str(x) for x in fingerprint(i)] for i in inputs] + [list(steps), config])
    path = f"{root}/{hashlib.sha256(key_text.encode()).hexdigest()}"
    if not _exists(spark, f"{path}/done"):
        build().write.mode("overwrite").parquet(f"{path}/data")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/data")


def write_evaluation(path: str, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def register_model(
    path: str, model: str, features: Sequence[str], medians: DataFrame, weights: DataFrame, settings: dict[str, str]
) -> None:
    """One row per model: features, imputation values, weights and settings."""
    imputation = medians.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "median")))).alias("m"))
    w = [c for c in weights.columns if c.startswith("w_")]
    # one entry per feature: the feature list bounds the collected map
    row = medians.sparkSession.range(1).select(
        F.lit(model).alias("model"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        imputation.scalar().alias("imputation_values"),
        F.array(*[weights.select(c).scalar() for c in w]).alias("weights"),
        F.create_map(*[F.lit(x) for kv in settings.items() for x in kv]).alias("settings"),
    )
    row.write.mode("append").parquet(path)
