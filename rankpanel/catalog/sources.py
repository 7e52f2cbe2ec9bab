"""A: scans, keyed writes, log, cache and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import query, rounded, with_results
from rankpanel.operators import store
from rankpanel.sources import sinks
from rankpanel.sources.tables import ROW_KEY, build_results, ingestion_log, qualifying, races, results, schedule, table
from rankpanel.session import scratch_path

RESULT_COLUMNS = (
    "Year, Race_Num, Driver, Team, Circuit, CAST(Date AS VARCHAR) AS Date, Position, Quali_Pos, Grid, Status, Laps, Points, "
    "AirTemp, Humidity, Pressure, WindSpeed, Rainfall, Is_Sprint, Q1, Q2, Q3, Revenue"
)


@query("results_table", with_results(f"SELECT {RESULT_COLUMNS} FROM results"))
def results_table(spark, sf):
    """The panel itself, built from the base tables."""
    return build_results(spark, sf)


@query("a1_races_year_range", with_results("SELECT Year, Race_Num, Driver, Team, Position, Grid, Points FROM results WHERE Year BETWEEN 1996 AND 1999"))
def a1(spark, sf):
    return store.year_range(races(spark, sf), 1996, 1999).select("Year", "Race_Num", "Driver", "Team", "Position", "Grid", "Points")


@query("a2_qualifying_year_range", with_results("SELECT Year, Race_Num, Driver, Quali_Pos AS Position, Q1, Q2, Q3 FROM results WHERE Year >= 1998 AND Quali_Pos IS NOT NULL"))
def a2(spark, sf):
    return store.year_range(qualifying(spark, sf), 1998, None).select("Year", "Race_Num", "Driver", "Position", "Q1", "Q2", "Q3")


BATCH_SQL = """
lastyear AS (SELECT max(Year) AS ly FROM results),
lastround AS (SELECT max(Race_Num) AS lr FROM results, lastyear WHERE Year = ly),
batch AS (
  SELECT Year, Race_Num, Driver, Team, Position + 1 AS Position, Points FROM results, lastyear, lastround WHERE Year = ly AND Race_Num > lr - 3
  UNION ALL
  SELECT Year, Race_Num + 1, Driver, Team, Position, Points FROM results, lastyear, lastround WHERE Year = ly AND Race_Num = lr),
merged AS (
  SELECT Year, Race_Num, Driver, Team, Position, Points FROM results r
  WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.Year = r.Year AND b.Race_Num = r.Race_Num AND b.Driver = r.Driver)
  UNION ALL SELECT * FROM batch)
"""


def upsert_batch(spark, sf):
    """The last three events with changed positions, and one new event."""
    rows = races(spark, sf).select(*ROW_KEY, "Team", "Position", "Points")
    season = rows.where(F.col("Year") == rows.agg(F.max("Year")).scalar())
    last = season.agg(F.max("Race_Num")).scalar()
    changed = season.where(F.col("Race_Num") > last - 3).withColumn("Position", F.col("Position") + 1)
    new = season.where(F.col("Race_Num") == last).withColumn("Race_Num", F.col("Race_Num") + 1)
    return rows, changed.unionByName(new)


@query("a3_keyed_upsert", with_results("SELECT * FROM merged", BATCH_SQL.strip()))
def a3(spark, sf):
    rows, batch = upsert_batch(spark, sf)
    return store.upsert(rows, batch, ROW_KEY)


@query(
    "a3_table_upsert",
    with_results(
        """SELECT m.*, CASE WHEN b.Year IS NULL THEN 'stored' END AS Note FROM merged m LEFT JOIN batch b USING (Year, Race_Num, Driver)""",
        BATCH_SQL.strip(),
    ),
)
def a3_table(spark, sf):
    """The same upsert against a stored table with a column the batch lacks, rewriting only the touched year."""
    rows, batch = upsert_batch(spark, sf)
    path = scratch_path(spark, "upsert")
    store.full_refresh(path, rows.withColumn("Note", F.lit("stored")))
    store.upsert_table(path, batch, ROW_KEY)
    return spark.read.parquet(path).select(*rows.columns, "Note")


@query(
    "a3_upsert_by_order",
    with_results("SELECT Year, Race_Num, Driver, Position + CASE WHEN Driver % 3 = 0 THEN 5 WHEN Driver % 3 = 1 THEN 2 ELSE 0 END AS Position FROM results"),
)
def a3_order(spark, sf):
    """Keys repeat in the batch, and some batch rows are older than the stored ones: the largest version stays."""
    stored = races(spark, sf).select(*ROW_KEY, "Position", F.lit(3).alias("version"))
    third = F.col("Driver") % 3

    def change(which: int, version: int, add: int):
        return stored.where(third == which).withColumns({"Position": F.col("Position") + add, "version": F.lit(version)})

    batch = change(0, 4, 1).unionByName(change(0, 9, 5)).unionByName(change(1, 4, 2)).unionByName(change(2, 1, 7))
    return store.upsert(stored, batch, ROW_KEY, order=["version"]).drop("version")


@query(
    "a4_processed_events",
    with_results(
        "SELECT DISTINCT Year, RoundNumber AS Race_Num FROM schedule WHERE RoundNumber % 3 <> 0 OR Year = 1996"
    ),
)
def a4(spark, sf):
    log = ingestion_log(spark, sf)
    more = schedule(spark, sf).where("Year = 1996").select("Year", F.col("RoundNumber").alias("Race_Num"), F.lit("R").alias("session"))
    return store.processed_events(store.mark_processed(log, more))


@query(
    "a4_log_content",
    with_results(
        """SELECT Year, Race_Num, 'R' AS session, count(*) AS rows, '2002-01-01 00:00:00' AS loaded_at,
           md5(count(*)::VARCHAR || ':' || sum(('0x' || substr(md5(concat_ws('|', Year, Race_Num, Driver, CAST(Position AS BIGINT))), 1, 15))::BIGINT)::VARCHAR) AS checksum
           FROM results GROUP BY 1, 2"""
    ),
)
def a4_content(spark, sf):
    """A first load of half the events, then a load of all of them: entries are replaced, not repeated."""
    rows = races(spark, sf).withColumn("Position", F.col("Position").cast("long"))
    cols = ["Year", "Race_Num", "Driver", "Position"]
    first = store.log_entries(rows.where("Race_Num % 2 = 0"), "R", cols, F.lit("2001-01-01 00:00:00"))
    return store.mark_processed(first, store.log_entries(rows, "R", cols, F.lit("2002-01-01 00:00:00")))


@query(
    "a5_batch_checksum",
    with_results(
        """SELECT Year, Race_Num, count(*) AS rows,
           md5(count(*)::VARCHAR || ':' || sum(('0x' || substr(md5(concat_ws('|', Year, Race_Num, Driver, Team, CAST(Position AS BIGINT), coalesce(CAST(CAST(Grid AS BIGINT) AS VARCHAR), '~'))), 1, 15))::BIGINT)::VARCHAR) AS checksum
           FROM results GROUP BY 1, 2"""
    ),
)
def a5(spark, sf):
    whole = races(spark, sf).withColumns({"Position": F.col("Position").cast("long"), "Grid": F.col("Grid").cast("long")})
    return store.batch_checksum(whole, ["Year", "Race_Num"], ["Year", "Race_Num", "Driver", "Team", "Position", "Grid"])


@query(
    "a6_ttl_lookup",
    """WITH latest AS (SELECT user_id AS key, max_by(value, event_id) AS value, max_by(ts, event_id) AS fetched FROM events GROUP BY 1)
       SELECT key, round(value, 6) AS value, strftime(fetched + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS expires
       FROM latest WHERE fetched + INTERVAL 12 HOUR > (SELECT max(ts) FROM events)""",
)
def a6(spark, sf):
    """Newest entry per key with a 12-hour life, looked up at the last event's time."""
    ev = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("fetched_at"), F.col("value"))
    newest = store.latest_by(ev, ["key"], ["event_id"]).select("key", "fetched_at", "value")
    cache = store.with_expiry(newest, 12)
    live = store.cache_lookup(cache, ev.agg(F.max("fetched_at")).scalar())
    return rounded(live.select("key", "value", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires")))


@query("a6_ttl_put", """WITH latest AS (SELECT user_id AS key, max_by(value, event_id) AS value, max_by(ts, event_id) AS fetched FROM events GROUP BY 1),
       buys AS (SELECT user_id AS key, max_by(value, event_id) AS value, max_by(ts, event_id) AS fetched FROM events WHERE event_type = 'purchase' GROUP BY 1)
       SELECT l.key, round(coalesce(b.value, l.value), 6) AS value,
              strftime(CASE WHEN b.key IS NOT NULL THEN b.fetched + INTERVAL 2 HOUR ELSE l.fetched + INTERVAL 12 HOUR END, '%Y-%m-%d %H:%M:%S') AS expires
       FROM latest l LEFT JOIN buys b USING (key)""")
def a6_put(spark, sf):
    """Entries of one event type replace the cached ones with a shorter life."""
    ev = table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").alias("key"), F.col("ts").alias("fetched_at"), "value")
    newest = store.latest_by(ev, ["key"], ["event_id"]).select("key", "fetched_at", "value")
    fresh = store.latest_by(ev.where("event_type = 'purchase'"), ["key"], ["event_id"]).select("key", "fetched_at", "value")
    cache = store.cache_put(store.with_expiry(newest, 12), fresh, 2)
    return rounded(cache.select("key", "value", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires")))


@query("a7_full_refresh", with_results("SELECT Year, count(*) AS rows, CAST(sum(Points) AS DOUBLE) AS points FROM results GROUP BY 1"))
def a7(spark, sf):
    path = scratch_path(spark, "refresh")
    store.full_refresh(path, races(spark, sf).where("Year < 1998").select(*ROW_KEY, "Points"))
    store.full_refresh(path, races(spark, sf).select(*ROW_KEY, "Points"))
    return spark.read.parquet(path).groupBy("Year").agg(F.count(F.lit(1)).alias("rows"), F.sum("Points").alias("points"))


A8_WHERE = "RoundNumber > 0 AND EventDate <= DATE '2000-06-15' AND NOT (RoundNumber % 3 <> 0)"


@query("a8_events_to_load", with_results(f"SELECT Year, RoundNumber, EventName FROM schedule WHERE {A8_WHERE}"))
def a8(spark, sf):
    due = store.events_to_load(schedule(spark, sf), ingestion_log(spark, sf), F.lit("2000-06-15").cast("date"))
    return due.select("Year", "RoundNumber", "EventName")


@query(
    "a9_race_extract",
    with_results(
        """SELECT r.Year, r.Race_Num, r.Driver, coalesce(CASE WHEN r.Driver % 10 <> 0 THEN r.Team END, 'Unknown') AS Team,
           r.Position, s.EventName AS Circuit, CAST(s.EventDate AS VARCHAR) AS Date, CASE WHEN s.EventFormat LIKE 'Sprint%' THEN 1 ELSE 0 END AS Is_Sprint,
           round(w.AirTemp, 6) AS AirTemp, round(w.Rainfall, 6) AS Rainfall
           FROM results r JOIN schedule s ON r.Year = s.Year AND r.Race_Num = s.RoundNumber
           JOIN (SELECT Year, Race_Num, avg(AirTemp + Driver % 5) AS AirTemp, avg(Rainfall) AS Rainfall FROM results GROUP BY 1, 2) w
             ON w.Year = r.Year AND w.Race_Num = r.Race_Num"""
    ),
)
def a9(spark, sf):
    """Session rows (some without a team) with event attributes and the session's mean weather."""
    rows = races(spark, sf)
    session = rows.select(*ROW_KEY, F.when(F.col("Driver") % 10 != 0, F.col("Team")).alias("Team"), "Position")
    weather = rows.select("Year", "Race_Num", (F.col("AirTemp") + F.col("Driver") % 5).alias("AirTemp"), "Humidity", "Pressure", "WindSpeed", "Rainfall")
    out = store.extract_races(session, weather, schedule(spark, sf))
    return rounded(out.select(*ROW_KEY, "Team", "Position", "Circuit", "Date", "Is_Sprint", "AirTemp", "Rainfall"))


@query("a10_qualifying_extract", with_results("SELECT Year, Race_Num, Driver, Team, Quali_Pos AS Position, Q1, Q2, Q3, Circuit, CAST(Date AS VARCHAR) AS Date, Is_Sprint FROM results WHERE Quali_Pos IS NOT NULL"))
def a10(spark, sf):
    session = qualifying(spark, sf).drop("Circuit", "Date", "Is_Sprint")
    return store.extract_qualifying(session, schedule(spark, sf)).select(*ROW_KEY, "Team", "Position", "Q1", "Q2", "Q3", "Circuit", "Date", "Is_Sprint")


@query(
    "a11_roster_csv",
    with_results(
        """SELECT DISTINCT CAST(Driver AS VARCHAR) AS Driver, Team, 2002 AS Year, 'C05' AS Race_Name, 5 AS Race_Num, '2002-01-01' AS Date FROM results"""
    ),
)
def a11(spark, sf):
    """A roster file with only Driver and Team; the rest comes from defaults and the schedule."""
    path = scratch_path(spark, "roster")
    results(spark, sf).select("Driver", "Team").distinct().write.csv(path, header=True)
    named = schedule(spark, sf).where("Year = 2001").withColumn("Year", F.lit(2002))
    return sinks.read_roster_csv(spark, path, 2002, "C05", named)


@query("a12_prediction_sink", with_results("SELECT 'race' AS model_type, 'auto' AS scenario, count(*) AS rows, sum(pred) AS positions FROM preds"))
def a12(spark, sf):
    from rankpanel.catalog.base import predictions

    path = scratch_path(spark, "predictions")
    rows = predictions(spark, sf).select(*ROW_KEY, "Team", F.col("pred").alias("Predicted_Race_Pos"))
    meta = {"model_type": "race", "year": "2001", "race": "all", "model_version": "1", "scenario": "auto", "config_hash": "none", "features_used": "Quali_Pos"}
    for _ in range(2):  # a retried run
        sinks.write_predictions(path, rows, meta, generated_at="2002-01-01 00:00:00")
    runs = spark.read.parquet(f"{path}/runs").select("run_id", "scenario")
    return spark.read.parquet(f"{path}/rows").join(runs, "run_id").groupBy("model_type", "scenario").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("Predicted_Race_Pos").alias("positions")
    )


@query("a13_input_lineage", with_results("SELECT Year, Race_Num, Driver, Quali_Pos, 'actual' AS Quali_Source FROM results WHERE Quali_Pos IS NOT NULL"))
def a13(spark, sf):
    path = scratch_path(spark, "lineage")
    sinks.write_lineage(path, qualifying(spark, sf).select(*ROW_KEY, F.col("Position").alias("Quali_Pos")), "actual")
    return spark.read.parquet(path)


@query(
    "a14_feature_cache",
    with_results(
        """SELECT Year, count(*) AS rows, sum(Position) AS positions, round(sum(f), 4) AS form, 1 AS builds FROM (
           SELECT Year, Position, avg(Position) OVER (PARTITION BY Driver ORDER BY Year, Race_Num ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f FROM results) GROUP BY 1"""
    ),
)
def a14(spark, sf):
    """Two calls build the features once; the second one reads what the first one wrote."""
    from rankpanel.plans.features import build_features, prepare

    root = scratch_path(spark, "cache")
    r, q = races(spark, sf), qualifying(spark, sf)
    builds = []

    def build():
        builds.append(1)
        return build_features(prepare(r, q), ["rolling"]).select(*ROW_KEY, "Position", "Driver_Avg_Position_short")

    sinks.cached_features(spark, root, [r, q], ["rolling"], "v1", build)
    again = sinks.cached_features(spark, root, [r, q], ["rolling"], "v1", build)
    return again.groupBy("Year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("Position").alias("positions"), F.round(F.sum("Driver_Avg_Position_short"), 4).alias("form"), F.lit(len(builds)).alias("builds")
    )


@query(
    "a15_evaluation_sink",
    with_results(
        """SELECT 'quali' AS model, metric, value FROM (
             SELECT round(avg(abs(pred - y)), 6) AS mae, round(avg((pred - y) ** 2), 6) AS mse, round(sqrt(avg((pred - y) ** 2)), 6) AS rmse,
                    round(1 - sum((pred - y) ** 2) / sum((y - (SELECT avg(y) FROM preds)) ** 2), 6) AS r2 FROM preds)
           UNPIVOT (value FOR metric IN (mae, mse, rmse, r2))"""
    ),
)
def a15(spark, sf):
    from rankpanel.catalog.base import predictions
    from rankpanel.operators import metrics

    path = scratch_path(spark, "evaluation")
    sinks.write_evaluation(path, {"metrics": metrics.metrics_long(metrics.error_metrics(predictions(spark, sf)), "quali")})
    return rounded(spark.read.parquet(f"{path}/metrics"))


@query("a16_registry_row")
def a16(spark, sf):
    from rankpanel.catalog.base import predictions
    from rankpanel.operators import ensemble, splits

    path = scratch_path(spark, "registry")
    rows = predictions(spark, sf)
    weights = ensemble.mae_weights(rows, "y", ["pred", "p2", "p3"], parts=4)
    medians = splits.train_medians(rows, ["pred", "p2", "p3"])
    sinks.register_model(path, "blend", ["pred", "p2", "p3"], medians, weights, {"holdout_years": "2001"})
    return spark.read.parquet(path)


@query(
    "a16_registry_values",
    with_results(
        """SELECT 'median' AS kind, name, round(value, 6) AS value FROM (SELECT median(pred) AS pred, median(p2) AS p2, median(p3) AS p3 FROM preds) UNPIVOT (value FOR name IN (pred, p2, p3))
           UNION ALL SELECT 'weights', 'sum', 1.0 UNION ALL SELECT 'weights', 'negative', 0.0"""
    ),
)
def a16_values(spark, sf):
    """What the registry row holds: a median per feature, and weights that are not negative and sum to 1."""
    row = a16(spark, sf)
    medians = row.select(F.explode("imputation_values").alias("name", "value")).select(F.lit("median").alias("kind"), "name", "value")
    weights = row.select(F.explode("weights").alias("w"))
    total = weights.agg(F.sum("w").alias("value")).select(F.lit("weights").alias("kind"), F.lit("sum").alias("name"), "value")
    below = weights.agg(F.sum(F.when(F.col("w") < 0, 1.0).otherwise(0.0)).alias("value")).select(F.lit("weights").alias("kind"), F.lit("negative").alias("name"), "value")
    return rounded(medians.unionByName(total).unionByName(below))


@query("a17_schedule_listing", with_results("SELECT Year, RoundNumber, EventName, strftime(EventDate::TIMESTAMP + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS EventDateUtc FROM schedule"))
def a17(spark, sf):
    """Dates are wall-clock in a zone five hours behind UTC."""
    listing = store.schedule_listing(schedule(spark, sf), "-05:00")
    return listing.withColumn("EventDateUtc", F.date_format("EventDateUtc", "yyyy-MM-dd HH:mm")).orderBy("Year", "RoundNumber")


@query(
    "a18_records_export",
    with_results(
        """SELECT '{"Year":' || Year || ',"Race_Num":' || Race_Num || ',"Driver":' || Driver || ',"Quali":' ||
           coalesce(CAST(CAST(Quali_Pos AS BIGINT) AS VARCHAR) || '.0', 'null') || '}' AS record FROM results"""
    ),
)
def a18(spark, sf):
    """Missing qualifying positions arrive as NaN and leave as JSON null."""
    rows = results(spark, sf).select(*ROW_KEY, F.coalesce("Quali_Pos", F.lit(float("nan"))).alias("Quali"))
    return store.to_records(rows)
