"""Hold-outs, folds, scaling, imputation, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import panel, predictions, query, rounded, with_results
from rankpanel.operators import splits
from rankpanel.sources.tables import ROW_KEY


@query("d1_holdout_years", with_results("SELECT Year, Race_Num, Driver, CASE WHEN Year IN (2000, 2001) THEN 'test' ELSE 'train' END AS split FROM panel"))
def d1(spark, sf):
    return splits.holdout_split(panel(spark, sf), [2000, 2001]).select(*ROW_KEY, "split")


@query(
    "d1_holdout_by_time",
    with_results("SELECT Year, Race_Num, Driver, CASE WHEN event_idx > floor((SELECT max(event_idx) FROM eventdim) * 0.85::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM panel JOIN eventdim USING (Year, Race_Num)"),
)
def d1_time(spark, sf):
    return splits.holdout_split(panel(spark, sf), [], 0.15).select(*ROW_KEY, "split")


@query("d2_leak_guard", with_results("SELECT Year, Race_Num, Driver, Grid, Quali_Pos, AirTemp FROM panel"))
def d2(spark, sf):
    """Position is the target: same-event outcomes go, what is known before the start stays."""
    rows = panel(spark, sf).select(*ROW_KEY, "Position", "Points", "Laps", "DNF", "Status", "Grid", "Quali_Pos", "AirTemp")
    return splits.drop_outcomes(rows, "Position", ROW_KEY)


def _folds_sql(purge: int, embargo: int) -> str:
    gap = " OR ".join(
        f"(j{j} <= fold AND i >= e{j} AND i < e{j} + {embargo})" for j in range(1, 6)
    )
    ends = ", ".join(f"floor(m * {j + 1} / 6.0::DOUBLE) AS e{j}, {j} AS j{j}" for j in range(1, 6))
    keep = f"AND NOT ({gap})" if embargo else ""
    return f"""
folds0 AS (SELECT Year, Race_Num, event_idx - 1 AS i, m, fold, floor(m * (fold + 1) / 6.0::DOUBLE) AS te, floor(m * (fold + 2) / 6.0::DOUBLE) AS ve, {ends}
  FROM (SELECT Year, Race_Num, row_number() OVER (ORDER BY Year, Race_Num) AS event_idx, count(*) OVER () AS m FROM eventdim WHERE Year <> 2001), range(5) t(fold)),
folds AS (SELECT Year, Race_Num, CAST(fold AS INTEGER) AS fold, CASE WHEN i < te - {purge} {keep} THEN 'train' WHEN i >= te AND i < ve THEN 'val' END AS role FROM folds0)"""


@query("d3_time_series_folds", with_results("SELECT Driver, Year, Race_Num, fold, role FROM panel JOIN folds USING (Year, Race_Num) WHERE role IS NOT NULL", _folds_sql(0, 0).strip()))
def d3(spark, sf):
    rows = panel(spark, sf).select(*ROW_KEY)
    return splits.fold_rows(rows, splits.fold_events(rows, 5, [2001])).select(*ROW_KEY, "fold", "role")


@query("d4_purged_folds", with_results("SELECT Year, Race_Num, fold, role FROM folds WHERE role IS NOT NULL", _folds_sql(1, 1).strip()))
def d4(spark, sf):
    return splits.fold_events(panel(spark, sf), 5, [2001], purge=1, embargo=1)


@query("d5_group_sizes", with_results("SELECT Year, Race_Num, count(*) AS group_size FROM panel GROUP BY 1, 2"))
def d5(spark, sf):
    return splits.group_counts(panel(spark, sf))


@query(
    "d6_event_zscore",
    with_results(
        """SELECT Year, Race_Num, Driver, round((Quali_Pos - avg(Quali_Pos) OVER e) / nullif(stddev_pop(Quali_Pos) OVER e, 0), 6) AS Quali_Pos,
           round((Revenue - avg(Revenue) OVER e) / nullif(stddev_pop(Revenue) OVER e, 0), 6) AS Revenue, CAST(NULL AS DOUBLE) AS AirTemp
           FROM panel WINDOW e AS (PARTITION BY Year, Race_Num)"""
    ),
)
def d6(spark, sf):
    rows = panel(spark, sf).select(*ROW_KEY, "Quali_Pos", "Revenue", F.col("AirTemp").cast("double").alias("AirTemp"))
    return rounded(splits.event_zscore(rows, ["Quali_Pos", "Revenue", "AirTemp"]))


@query(
    "d7_train_median_imputation",
    with_results(
        """SELECT Year, Race_Num, Driver, coalesce(Quali_Pos, (SELECT quantile_cont(Quali_Pos, 0.5) FROM panel WHERE Year < 2000)) AS Quali_Pos,
           coalesce(Grid, (SELECT quantile_cont(Grid, 0.5) FROM panel WHERE Year < 2000)) AS Grid FROM panel WHERE Year >= 2000"""
    ),
)
def d7(spark, sf):
    rows = panel(spark, sf).select(*ROW_KEY, "Quali_Pos", "Grid")
    medians = splits.train_medians(rows.where("Year < 2000"), ["Quali_Pos", "Grid"])
    return splits.impute_from(rows.where("Year >= 2000"), medians, ["Quali_Pos", "Grid"])


@query("d8_score_ranks", with_results("SELECT Year, Race_Num, Driver, row_number() OVER (PARTITION BY Year, Race_Num ORDER BY pred DESC, Driver) AS rank FROM preds"))
def d8(spark, sf):
    return splits.score_ranks(predictions(spark, sf), "pred", "rank").select(*ROW_KEY, "rank")


@query("d9_relevance", with_results("SELECT Year, Race_Num, Driver, (SELECT max(y) FROM preds) + 1 - y AS relevance FROM preds"))
def d9(spark, sf):
    return splits.to_relevance(predictions(spark, sf), "y", "relevance").select(*ROW_KEY, "relevance")
