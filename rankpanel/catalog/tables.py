"""B: cleansing, lookups, rosters, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import query, rounded, with_results
from rankpanel.functions import columns as fc
from rankpanel.operators import clean, store
from rankpanel.sources.tables import ROW_KEY, qualifying, races, results, schedule, table

EVENT = ["Year", "Race_Num"]


@query(
    "b1_lenient_coercion",
    with_results(
        """SELECT Year, Race_Num, Driver, CASE WHEN Driver % 3 = 0 THEN NULL ELSE Position END AS Position,
           CASE WHEN Driver % 4 = 0 THEN NULL ELSE CAST(Date AS VARCHAR) END AS Date FROM results"""
    ),
)
def b1(spark, sf):
    """Every third number and every fourth date is unreadable text."""
    text = results(spark, sf).select(
        *ROW_KEY,
        F.when(F.col("Driver") % 3 == 0, "n/a").otherwise(F.col("Position").cast("string")).alias("Position"),
        F.when(F.col("Driver") % 4 == 0, "soon").otherwise(F.date_format("Date", "yyyy-MM-dd")).alias("Date"),
    )
    return clean.coerce(text, numbers=["Position"], dates=["Date"])


@query("b2_suffix", with_results("SELECT Year, Race_Num, Driver, CASE WHEN Circuit LIKE '% Grand Prix' THEN Circuit ELSE Circuit || ' Grand Prix' END AS Circuit FROM results"))
def b2(spark, sf):
    return results(spark, sf).select(*ROW_KEY, fc.with_suffix(F.col("Circuit")).alias("Circuit"))


@query("b3_canonical_names", "SELECT s_suppkey AS Driver, CASE WHEN n_nationkey % 10 = 0 THEN n_name || ' Racing' ELSE n_name END AS Team FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def b3(spark, sf):
    """Every tenth team has an alias."""
    nations = table(spark, sf, "nation")
    aliases = nations.where("n_nationkey % 10 = 0").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit(" Racing")).alias("alias"))
    teams = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("Driver"), F.col("n_name").alias("Team"))
    return clean.canonical_names(teams, "Team", aliases)


@query("b4_utc_normalisation", "SELECT event_id, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def b4(spark, sf):
    """Event times read as wall-clock of a zone five and a half hours ahead."""
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.date_format(fc.utc_naive(F.col("ts"), "+05:30"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("b5_event_by_name", with_results("SELECT * REPLACE (CAST(EventDate AS VARCHAR) AS EventDate) FROM schedule WHERE EventName = 'C07' ORDER BY Year, RoundNumber LIMIT 1"))
def b5(spark, sf):
    return clean.event_by_name(schedule(spark, sf), "C07")


@query(
    "b6_fallback_lookup",
    with_results(
        """SELECT r.Year, r.Race_Num, r.Driver, coalesce(a.lat, b.lat) AS lat
           FROM results r
           LEFT JOIN dims a ON a.name = r.Circuit
           LEFT JOIN dims b ON b.name = CASE WHEN r.Circuit LIKE '% Grand Prix' THEN replace(r.Circuit, ' Grand Prix', '') ELSE r.Circuit || ' Grand Prix' END""",
        """dims AS (SELECT DISTINCT CASE WHEN Race_Num % 3 = 0 THEN replace(Circuit, ' Grand Prix', '') ELSE Circuit END AS name, CAST(Race_Num * 2 AS DOUBLE) AS lat
           FROM results WHERE Race_Num <> 5)""",
    ),
)
def b6(spark, sf):
    """A third of the dimension lacks the suffix the panel has, one circuit is absent."""
    r = results(spark, sf)
    name = F.when(F.col("Race_Num") % 3 == 0, fc.without_suffix(F.col("Circuit"))).otherwise(F.col("Circuit"))
    dims = r.where("Race_Num <> 5").select(name.alias("Circuit"), (F.col("Race_Num") * 2).cast("double").alias("lat")).distinct()
    return clean.lookup_with_suffix(r.select(*ROW_KEY, "Circuit"), "Circuit", dims, ["lat"]).select(*ROW_KEY, "lat")


@query("b7_sprint_text_flag", with_results("SELECT Year, RoundNumber, CASE WHEN lower(EventFormat) LIKE '%sprint%' THEN 1 ELSE 0 END AS Is_Sprint FROM schedule"))
def b7(spark, sf):
    return schedule(spark, sf).select("Year", "RoundNumber", fc.contains_flag(F.col("EventFormat"), "sprint").alias("Is_Sprint"))


@query("b8_dnf_flag", with_results("SELECT Year, Race_Num, Driver, CASE WHEN Driver % 9 = 0 THEN 1 WHEN Status IN ('Finished', '+1 Lap') THEN 0 ELSE 1 END AS DNF FROM results"))
def b8(spark, sf):
    """Status is missing for every ninth driver; missing counts as not finished."""
    status = F.when(F.col("Driver") % 9 != 0, F.col("Status"))
    return results(spark, sf).select(*ROW_KEY, fc.dnf_flag(status).alias("DNF"))


@query("b9_rename_or_add", with_results("SELECT Year, Race_Num, Driver, Quali_Pos, CAST(NULL AS DOUBLE) AS Sprint_Pos FROM results WHERE Quali_Pos IS NOT NULL"))
def b9(spark, sf):
    q = qualifying(spark, sf).select(*ROW_KEY, "Position")
    return clean.ensure_columns(q, {"Quali_Pos": "double", "Sprint_Pos": "double"}, {"Position": "Quali_Pos"})


@query("b10_keep_last", with_results("SELECT Year, Race_Num, Driver, CASE WHEN Driver % 2 = 0 THEN Position + 100 ELSE Position END AS Position FROM results"))
def b10(spark, sf):
    """Half the rows arrive again, later, with another position."""
    first = results(spark, sf).select(*ROW_KEY, "Position", F.lit(1).alias("seq"))
    again = first.where("Driver % 2 = 0").withColumns({"Position": F.col("Position") + 100, "seq": F.lit(2)})
    return store.latest_by(first.unionByName(again), ROW_KEY, ["seq"]).drop("seq")


@query("b11_join_qualifying", with_results("SELECT Year, Race_Num, Driver, Position, Quali_Pos FROM results"))
def b11(spark, sf):
    q = qualifying(spark, sf).select(*ROW_KEY, F.col("Position").alias("Quali_Pos"))
    return races(spark, sf).select(*ROW_KEY, "Position").join(q, ROW_KEY, "left")


@query(
    "b12_colliding_columns",
    with_results(
        """SELECT Year, Race_Num, Driver, Team, CASE WHEN Driver % 5 = 0 AND Quali_Pos IS NULL THEN NULL ELSE CAST(Is_Sprint AS DOUBLE) END AS Is_Sprint, Q1
           FROM (SELECT * EXCLUDE Q1, CASE WHEN Quali_Pos IS NOT NULL THEN Q1 END AS Q1 FROM results)"""
    ),
)
def b12(spark, sf):
    """The sprint flag is missing on every fifth race row and comes from qualifying there."""
    flag = F.col("Is_Sprint").cast("double")
    left = races(spark, sf).select(*ROW_KEY, "Team", F.when(F.col("Driver") % 5 != 0, flag).alias("Is_Sprint"))
    right = qualifying(spark, sf).select(*ROW_KEY, "Team", flag.alias("Is_Sprint"), "Q1")
    return clean.left_join_coalescing(left, right, ROW_KEY)


@query("b13_fill_from_sibling", with_results("SELECT Year, Race_Num, Driver, coalesce(Grid, Quali_Pos) AS Grid FROM results"))
def b13(spark, sf):
    return results(spark, sf).select(*ROW_KEY, F.coalesce("Grid", "Quali_Pos").alias("Grid"))


def _clock_sql(c):
    return f"""(coalesce(try_cast(nullif(regexp_extract({c}, '^(\\d+) days? ', 1), '') AS DOUBLE), 0.0) * 86400
        + try_cast(nullif(regexp_extract({c}, '(\\d+):(\\d+):([0-9.]+)$', 1), '') AS DOUBLE) * 3600
        + try_cast(nullif(regexp_extract({c}, '(\\d+):(\\d+):([0-9.]+)$', 2), '') AS DOUBLE) * 60
        + try_cast(nullif(regexp_extract({c}, '(\\d+):(\\d+):([0-9.]+)$', 3), '') AS DOUBLE))"""


@query("b14_day_clock_seconds", with_results(f"SELECT Year, Race_Num, Driver, round({_clock_sql('Q1')}, 6) AS Q1_s, round({_clock_sql('Q3')}, 6) AS Q3_s, CAST(NULL AS DOUBLE) AS bad FROM results"))
def b14(spark, sf):
    r = results(spark, sf)
    return rounded(
        r.select(
            *ROW_KEY,
            fc.day_clock_seconds(F.col("Q1")).alias("Q1_s"),
            fc.day_clock_seconds(F.col("Q3")).alias("Q3_s"),
            fc.day_clock_seconds(F.substring("Q1", 10, 7)).alias("bad"),
        )
    )


@query(
    "b15_minute_clock_seconds",
    with_results("SELECT Year, Race_Num, Driver, CASE Driver % 3 WHEN 0 THEN round(60 + Position / 8, 6) WHEN 1 THEN round(Position / 8, 6) END AS seconds FROM results"),
)
def b15(spark, sf):
    """A third ``1:ss.fff``, a third plain seconds, a third unreadable; positions over 479 roll into minutes."""
    s = F.col("Position") / 8
    text = F.when(F.col("Driver") % 3 == 0, F.concat(F.lit("1:"), s.cast("decimal(18,3)").cast("string"))).when(
        F.col("Driver") % 3 == 1, s.cast("decimal(18,3)").cast("string")
    ).otherwise("no time")
    return rounded(results(spark, sf).select(*ROW_KEY, fc.minute_clock_seconds(text).alias("seconds")))


@query("b16_first_available", with_results("SELECT Year, Race_Num, Driver, coalesce(Q3, Q2, Q1) AS best FROM results"))
def b16(spark, sf):
    return results(spark, sf).select(*ROW_KEY, F.coalesce("Q3", "Q2", "Q1").alias("best"))


@query("b17_allow_list", with_results("SELECT Year, Race_Num, Driver, Grid, Quali_Pos FROM results"))
def b17(spark, sf):
    return clean.allow_list(results(spark, sf), ["Grid", "Quali_Pos", "Unknown"], keep=ROW_KEY)


@query("b18_feature_contract", with_results("SELECT Year, Race_Num, Driver, coalesce(Quali_Pos, 15.0) AS Quali_Pos, 7.5::DOUBLE AS Tyre, coalesce(Grid, 0.0) AS Grid, CAST(Laps AS DOUBLE) AS Laps FROM results"))
def b18(spark, sf):
    return clean.enforce_contract(
        results(spark, sf),
        ["Quali_Pos", "Tyre", "Grid", "Laps"],
        {"Quali_Pos": 15.0, "Tyre": 7.5, "Grid": float("nan")},
        critical=["Quali_Pos"],
        keep=ROW_KEY,
    )


@query("b19_roster_expansion", with_results("SELECT Year, Race_Num, Driver, Team, Circuit, CAST(Date AS VARCHAR) AS Date, Is_Sprint FROM results"))
def b19(spark, sf):
    """Every event with its roster; the event attributes come from the schedule."""
    roster = results(spark, sf).select(*ROW_KEY, "Team")
    return clean.expand_roster(schedule(spark, sf), roster).select(*ROW_KEY, "Team", "Circuit", "Date", "Is_Sprint")


@query("b20_next_event", with_results("SELECT * REPLACE (CAST(EventDate AS VARCHAR) AS EventDate) FROM schedule WHERE EventDate > DATE '1999-03-15' ORDER BY EventDate LIMIT 1"))
def b20(spark, sf):
    return clean.next_event(schedule(spark, sf), F.lit("1999-03-15").cast("date"))


@query(
    "b21_as_of_roster",
    with_results(
        """SELECT t.Year, t.Race_Num, r.Driver, max(CASE WHEN r.Driver % 5 = 0 THEN 'A new team' ELSE r.Team END) AS Team FROM targets t
           JOIN results r ON r.Year * 100 + r.Race_Num = (SELECT max(h.Year * 100 + h.Race_Num) FROM have h WHERE h.Year * 100 + h.Race_Num <= t.Year * 100 + t.Race_Num)
             AND r.Race_Num % 3 <> 1
           GROUP BY 1, 2, 3""",
        "targets AS (SELECT Year, RoundNumber AS Race_Num FROM schedule UNION ALL SELECT max(Year) + 2, 4 FROM schedule)",
        "have AS (SELECT DISTINCT Year, Race_Num FROM results WHERE Race_Num % 3 <> 1)",
    ),
)
def b21(spark, sf):
    """Every scheduled event, and one two seasons ahead; a third of the events has no rows, and some drivers change team."""
    s = schedule(spark, sf)
    ahead = s.agg((F.max("Year") + 2).alias("Year"), F.lit(4).alias("Race_Num"))
    targets = s.select("Year", F.col("RoundNumber").alias("Race_Num")).unionByName(ahead)
    first = races(spark, sf).where("Race_Num % 3 <> 1").select(*ROW_KEY, "Team", F.lit(1).alias("load_seq"))
    later = first.where("Driver % 5 = 0").withColumns({"Team": F.lit("A new team"), "load_seq": F.lit(2)})
    return clean.as_of_roster(targets, later.unionByName(first), "load_seq")


@query(
    "b22_latest_completed_roster",
    with_results(
        """SELECT Driver, Team FROM results JOIN (SELECT Year y, RoundNumber rn FROM schedule WHERE EventDate < DATE '1998-09-20' AND RoundNumber <= 7
           ORDER BY EventDate DESC LIMIT 1) ON Year = y AND Race_Num = rn"""
    ),
)
def b22(spark, sf):
    last = clean.latest_completed_event(schedule(spark, sf), F.lit("1998-09-20").cast("date"), 7)
    event = last.select("Year", F.col("RoundNumber").alias("Race_Num"))
    return results(spark, sf).join(event, EVENT, "left_semi").select("Driver", "Team")


@query("b23_latest_qualifying", with_results("SELECT Year, Race_Num, Driver, Quali_Pos AS Position FROM results WHERE Quali_Pos IS NOT NULL AND Year = 2001 AND Race_Num = (SELECT max(Race_Num) FROM results WHERE Year = 2001 AND Quali_Pos IS NOT NULL)"))
def b23(spark, sf):
    return clean.latest_round_of_year(qualifying(spark, sf), 2001).select(*ROW_KEY, "Position")


@query(
    "b24_union_widening",
    with_results(
        """SELECT Year, Race_Num, Driver, Position, FALSE AS is_upcoming FROM results
           UNION ALL SELECT Year + 1, Race_Num, Driver, NULL, TRUE FROM results WHERE Year = 2001"""
    ),
)
def b24(spark, sf):
    history = results(spark, sf).select(*ROW_KEY, "Position")
    upcoming = results(spark, sf).where("Year = 2001").select((F.col("Year") + 1).alias("Year"), "Race_Num", "Driver")
    return clean.union_widening(history, upcoming)


@query(
    "b25_upcoming_slice",
    with_results(
        """SELECT Year, Race_Num, Driver, round(form, 6) AS form FROM (
             SELECT *, avg(Position) OVER (PARTITION BY Driver ORDER BY Year, Race_Num ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS form FROM (
               SELECT Year, Race_Num, Driver, CASE WHEN Year < 2001 THEN Position END AS Position FROM results)) WHERE Year = 2001"""
    ),
)
def b25(spark, sf):
    """The last season is upcoming: its rows get features but no target."""
    from rankpanel.operators.features import Lag, driver_history

    rows = results(spark, sf).select(*ROW_KEY, "Position")
    both = clean.union_widening(rows.where("Year < 2001"), rows.where("Year = 2001").drop("Position"))
    return rounded(clean.upcoming_slice(driver_history(both, [Lag("form", "mean", "Position", 3)])))


FORECAST_SQL = """
hours AS (SELECT user_id, CAST(ts AS DATE) AS day, value, event_id, event_type,
            row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS h FROM events),
first AS (SELECT * FROM hours WHERE h <= 24)
"""


@query(
    "b26_forecast_means",
    f"""WITH {FORECAST_SQL.strip()}
        SELECT user_id, CAST(day AS VARCHAR) AS day, round(avg(value), 6) AS AirTemp,
               round(avg(CASE WHEN event_type <> 'view' THEN value / 2 END), 6) AS Humidity,
               round(100 * avg(CASE WHEN event_type = 'click' THEN 0.5 ELSE 0.0 END), 6) AS Rainfall
        FROM first GROUP BY 1, 2""",
)
def b26(spark, sf):
    """A JSON forecast per user and day; humidity and rain are absent from some entries.

    A payload holds up to 48 hourly entries, more than the 24 that the means
    are taken over; a group's entries are spread over payloads of that length
    and the first one counts.
    """
    from rankpanel.operators.ordering import row_numbers

    ev = table(spark, sf, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", "event_type", "value")
    numbered = row_numbers(ev, ["user_id", "day"], [F.col("event_id")], "h").withColumn("payload_no", F.floor((F.col("h") - 1) / 48))
    hours = numbered
    entry = F.struct(
        "h",
        F.col("value").alias("temp"),
        F.when(F.col("event_type") != "view", F.col("value") / 2).alias("humidity"),
        F.when(F.col("event_type") == "click", 0.5).alias("pop"),
    )
    payload = hours.groupBy("user_id", "day", "payload_no").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("hourly"))).alias("payload"))
    means = clean.forecast_means(F.col("payload"), 24)
    return rounded(payload.where("payload_no = 0").select("user_id", "day", *[means[c].alias(c) for c in ("AirTemp", "Humidity", "Rainfall")]))


@query("b27_attach_scalars", with_results("SELECT Year, Race_Num, Driver, (SELECT max(AirTemp) FROM results) AS AirTemp, (SELECT round(avg(Humidity), 6) FROM results) AS Humidity FROM results"))
def b27(spark, sf):
    r = results(spark, sf)
    one = r.agg(F.max("AirTemp").alias("AirTemp"), F.round(F.avg("Humidity"), 6).alias("Humidity"))
    return clean.attach_scalars(r.select(*ROW_KEY), one, ["AirTemp", "Humidity"])


@query(
    "b28_feature_difference",
    with_results(
        """SELECT name, 'missing' AS kind FROM (SELECT DISTINCT Circuit AS name FROM results WHERE Year < 1998 AND Race_Num <= 8 EXCEPT SELECT Circuit FROM results WHERE Race_Num >= 4)
           UNION ALL SELECT name, 'extra' FROM (SELECT DISTINCT Circuit AS name FROM results WHERE Race_Num >= 4 EXCEPT SELECT Circuit FROM results WHERE Year < 1998 AND Race_Num <= 8)"""
    ),
)
def b28(spark, sf):
    """Names two parts of the panel do not share."""
    s = schedule(spark, sf)
    required = s.where("Year < 1998 AND RoundNumber <= 8").select(F.col("EventName").alias("name")).distinct()
    available = s.where("RoundNumber >= 4").select(F.col("EventName").alias("name")).distinct()
    return clean.contract_difference(required, available)


@query("b29_labelled_numeric", with_results("SELECT Year, Race_Num, Driver, Quali_Pos, Position, Grid, Laps, Points FROM results WHERE Quali_Pos IS NOT NULL"))
def b29(spark, sf):
    rows = results(spark, sf).select(*ROW_KEY, "Team", "Status", "Position", "Quali_Pos", "Grid", "Laps", "Points")
    return clean.labelled_numeric(rows, "Quali_Pos", ROW_KEY)


@query("b30_round_spec", with_results("SELECT * REPLACE (CAST(EventDate AS VARCHAR) AS EventDate) FROM schedule WHERE RoundNumber IN (1, 3, 5, 6, 7, 9, 10)"))
def b30(spark, sf):
    """A spec with a bad part and a reversed range."""
    return clean.events_of_rounds(schedule(spark, sf), "1, 3,x,7-5,9-10,10")


@query("b31_sort_and_head", with_results("SELECT Year, Race_Num, Driver, Revenue FROM results ORDER BY Revenue DESC, Year, Race_Num, Driver LIMIT 20"))
def b31(spark, sf):
    rows = results(spark, sf).select(*ROW_KEY, "Revenue")
    return clean.top(rows, [F.col("Revenue").desc(), *[F.col(c) for c in ROW_KEY]], 20)
