"""S: streaming jobs run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import predictions, query, rounded, with_results
from rankpanel.session import scratch_path
from rankpanel.sources.tables import ROW_KEY, qualifying, results, table
from rankpanel.streaming import ingest


@query(
    "s1_refresh_predictions",
    with_results(
        """SELECT Year, Race_Num, Driver, round(CASE WHEN Race_Num % 3 <> 0 THEN r.Quali_Pos ELSE p3 END, 6) AS Quali_Pos,
           CASE WHEN Race_Num % 3 <> 0 THEN 'actual' ELSE 'predicted' END AS Quali_Source FROM results r JOIN preds USING (Year, Race_Num, Driver)"""
    ),
)
def s1(spark, sf):
    """Qualifying of two of three rounds arrives in files that split the events."""
    landing, out, check = (scratch_path(spark, x) for x in ("landing", "refreshed", "stream"))
    actual = qualifying(spark, sf).where("Race_Num % 3 <> 0").select(*ROW_KEY, F.col("Position").alias("Quali_Pos"))
    actual.repartition(6, "Driver").write.parquet(landing)
    roster = results(spark, sf).select(*ROW_KEY, "Team")
    predicted = predictions(spark, sf).select(*ROW_KEY, F.col("p3").alias("Quali_Pos"))
    ingest.refresh_predictions(spark, landing, actual.schema, roster, predicted, out, check, max_files=4)
    return rounded(spark.read.parquet(out).select(*ROW_KEY, "Quali_Pos", "Quali_Source"))


@query("s2_idempotent_ingest", "SELECT event_type, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s2(spark, sf):
    """Every file spans all dates and comes as a batch of its own, every event arrives twice, and the job runs twice."""
    landing, out, log, check = (scratch_path(spark, x) for x in ("landing", "ingested", "log", "stream"))
    source = table(spark, sf, "events")
    for part in range(3):
        source.where(F.col("event_id") % 3 == part).unionByName(source.where(F.col("event_id") % 3 == (part + 1) % 3)).coalesce(1).write.mode("append").parquet(landing)
    stream = ingest.read_event_stream(spark, landing, source.schema, max_files=1)
    ingest.prepare_table(spark, out, stream.withColumn("day", F.to_date("ts")).schema, "day")
    for _ in range(2):
        ingest.ingest(stream, out, log, check, ["event_id"])
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "s2_newest_of_key",
    """SELECT user_id, count(*) AS rows, max(event_id) AS event_id, round(sum(value), 6) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts
       FROM events WHERE event_id IN (SELECT max_by(event_id, struct_pack(ts := ts, event_id := event_id)) FROM events GROUP BY user_id) GROUP BY 1""",
)
def s2_newest(spark, sf):
    """Rows of one user come in three batches, newest rows first; the newest row stays and moves between days."""
    landing, out, log, check = (scratch_path(spark, x) for x in ("landing", "ingested", "log", "stream"))
    source = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    for part in (2, 0, 1):
        source.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(landing)
    stream = ingest.read_event_stream(spark, landing, source.schema, max_files=1)
    ingest.prepare_table(spark, out, stream.withColumn("day", F.to_date("ts")).schema, "day")
    ingest.ingest(stream, out, log, check, ["user_id"], order=["ts", "event_id"])
    kept = spark.read.parquet(out).groupBy("user_id")
    return kept.agg(
        F.count(F.lit(1)).alias("rows"), F.max("event_id").alias("event_id"), F.round(F.sum("value"), 6).alias("value"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("ts"),
    )


FORM = with_results(
    """SELECT Driver, CAST(Year * 100 + Race_Num AS BIGINT) AS seq, round(avg(Position) OVER (PARTITION BY Driver ORDER BY Year, Race_Num ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS form FROM results"""
)


def _form_stream(spark, sf):
    """Results in three files, none of them in order."""
    landing = scratch_path(spark, "landing")
    rows = results(spark, sf).select("Driver", (F.col("Year") * 100 + F.col("Race_Num")).cast("long").alias("seq"), "Position")
    for part in (2, 0, 1):
        rows.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(landing)
    return spark.readStream.schema("Driver long, seq long, Position double").option("maxFilesPerTrigger", 1).parquet(landing)


@query("s3_online_form", FORM)
def s3(spark, sf):
    """Seasons arrive out of order and split over files, so every batch corrects earlier ones."""
    out, history, check = (scratch_path(spark, x) for x in ("form", "history", "stream"))
    ingest.online_form(_form_stream(spark, sf), out, history, check)
    return rounded(ingest.current_form(spark, out))


@query("s3_keyed_state", FORM)
def s3_keyed(spark, sf):
    """The same results and files, with the form held in keyed state."""
    out, check = (scratch_path(spark, x) for x in ("form", "stream"))
    ingest.keyed_form(_form_stream(spark, sf), out, check)
    return rounded(ingest.current_keyed_form(spark, out))
