"""Streaming ingest, prediction refresh and online form."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rankpanel.operators import scoring, store
from rankpanel.operators.timeline import Frame, lagged_frames
from rankpanel.session import materialize

EVENT = ["Year", "Race_Num"]
KEY = ["Year", "Race_Num", "Driver"]


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    """A file stream with ``ts`` as a real timestamp; files may come in any order."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def ingest(stream: DataFrame, table: str, log: str, checkpoint: str, keys: Sequence[str], order: Sequence[str] = ("ts",)) -> None:
    """Upsert each batch by key and log it, until the available input is done.

    No row is late: of all rows of a key, in whatever batches, the one with the
    largest ``order`` values stays. A replayed batch upserts the same rows and
    rewrites its own log entry, so restarts leave one copy of everything.
    """
    dated = stream.withColumn("day", F.to_date("ts"))

    def load(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(store.latest_by(batch, keys, order), "microbatch")
        store.upsert_table(table, rows, keys, partition="day", stored=True, order=order)
        entry = rows.groupBy("day").agg(F.count(F.lit(1)).alias("rows")).withColumn("batch_id", F.lit(batch_id))
        entry.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    query = dated.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def prepare_table(spark: SparkSession, path: str, schema: T.StructType, partition: str) -> None:
    """An empty partitioned table to upsert into, with its schema beside it."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(partition).parquet(path)
    if store.table_schema(spark, path) is None:
        store.save_schema(spark, path, schema)


def refresh_predictions(
    spark: SparkSession, landing: str, schema: T.StructType, roster: DataFrame, predicted: DataFrame, out: str, checkpoint: str, max_files: int = 1
) -> None:
    """As qualifying files arrive, rewrite the events they touch with actual positions.

    Before any file the table holds predicted positions for every event. Actual
    positions are kept in one table, upserted by season, so a batch reads the
    seasons it touches and none of the batches before it. An event's rows are
    replaced once per batch that touches it; when all files are in, the stream ends.
    """
    first = scoring.choose_qualifying(roster, "pre_quali", None, predicted)
    store.full_refresh(out, first)

    seen = f"{out}-actual"
    shape = spark.createDataFrame([], schema).select(*KEY, "Quali_Pos", F.lit(0).cast("long").alias("batch")).schema
    prepare_table(spark, seen, shape, "Year")

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch.select(*KEY, "Quali_Pos", F.lit(batch_id).cast("long").alias("batch")), "arrived")
        # an event's rows may come in several batches: the newest one per driver stays
        store.upsert_table(seen, store.latest_by(rows, KEY, ["Quali_Pos"]), KEY, order=["batch"])
        years = [r["Year"] for r in rows.select("Year").distinct().collect()]  # seasons are few
        now = rows.select(*EVENT).distinct()
        actual = store.stored_table(seen, rows).where(F.col("Year").isin(years)).join(now, EVENT, "left_semi").select(*KEY, "Quali_Pos")
        touched = roster.join(now, EVENT, "left_semi")
        store.upsert_table(out, scoring.choose_qualifying(touched, "auto", actual, predicted).select(first.columns), KEY)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(landing)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def online_form(stream: DataFrame, out: str, history: str, checkpoint: str, rows: int = 3, buckets: int = 16) -> None:
    """Mean of a driver's last ``rows`` positions before each result, kept up to date as results arrive in any order.

    ``stream`` has (Driver, seq, Position). Arrived rows are kept by a hash of
    the driver; a batch reads the buckets of its drivers, and of those only its
    drivers' rows. It writes the new rows and the ``rows`` ones after each of
    them, whose form a late result changes; ``current_form`` takes the newest
    version of every row. A replayed batch rewrites its own folders. A batch is
    one lagged frame, so a busy driver is spread over tasks like any large group.
    """
    key = ["Driver", "seq"]
    schema = "Driver long, seq long, Position double, bucket int, batch long"

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("Driver"), F.lit(buckets)).cast("int")
        arrived = materialize(batch.select(*key, "Position").withColumn("bucket", bucket).dropDuplicates(key), "arrived")
        arrived.write.mode("overwrite").partitionBy("bucket").parquet(f"{history}/batch={batch_id}")
        touched = [r["bucket"] for r in arrived.select("bucket").distinct().collect()]
        known = spark.read.schema(schema).parquet(history).where((F.col("batch") <= batch_id) & F.col("bucket").isin(touched))
        known = known.join(arrived.select("Driver").distinct(), "Driver", "left_semi")
        both = store.latest_by(known, key, ["batch"]).withColumn("_new", (F.col("batch") == batch_id).cast("int"))
        frames = [Frame("form", "avg", "Position", rows), Frame("_after", "sum", "_new", rows)]
        formed = lagged_frames(materialize(both, "form"), ["Driver"], frames, ["seq"])
        changed = formed.where((F.col("_new") == 1) | (F.col("_after") > 0))
        changed.select(*key, "form").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_form(spark: SparkSession, out: str) -> DataFrame:
    """(Driver, seq, form): the newest version of every row."""
    return store.latest_by(spark.read.parquet(out), ["Driver", "seq"], ["batch"]).drop("batch")


#: Rows of one leaf of a driver's kept history.
LEAF = 256
#: Keys that drivers are dealt to, so that a call serves several of them, and rows of a frame such a call yields.
KEYS, FRAME = 1 << 12, 1 << 16


class FormProcessor(StatefulProcessor):
    """Keyed state of a driver: results in order, in leaves of at most ``LEAF`` rows.

    A history of one leaf lies in the index itself, so a batch reads and writes one
    value. Of a longer one an arrived result touches its own leaf and as many
    neighbours as the form window reaches into, so what a batch reads follows its
    own rows and not the batches before it. Results may come in any order; the
    newest version of one replaces the older ones.
    """

    def __init__(self, rows: int):
        self.rows = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.leaves = handle.getMapState("leaves", "leaf long", "seqs array<long>, positions array<double>")
        self.index = handle.getValueState("index", "firsts array<long>, ids array<long>, version long, seqs array<long>, positions array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest: dict[int, float | None] = {}
        for part in rows:
            for seq, position in zip(part["seq"].tolist(), part["Position"].tolist()):
                latest[seq] = None if position != position else position  # NaN is a missing value
        changed, version = self.applied(latest, self.index, self.leaves)
        yield _frame([(key[0], seq, form, version) for seq, form in changed])

    def applied(self, latest: dict[int, float | None], index, kept) -> tuple[list[tuple[int, float | None]], int]:
        """Take a driver's arrived results into its state: (seq, form) of all results they change, and the version."""
        arrived = sorted(latest)
        known = index.get()
        firsts, ids, version = (list(known[0]), list(known[1]), known[2]) if known else ([], [], 0)
        held: dict[int, tuple[list[int], list[float | None]]] = {}
        if len(ids) == 1:
            held[ids[0]] = (list(known[3]), list(known[4]))
        stored = len(ids) > 1
        dirty: set[int] = set()

        def leaf(at: int) -> tuple[list[int], list[float | None]]:
            if ids[at] not in held:
                seqs, positions = kept.getValue((ids[at],))
                held[ids[at]] = (list(seqs), list(positions))
            return held[ids[at]]

        for seq in arrived:
            if not ids:
                firsts, ids = [seq], [0]
                held[0] = ([], [])
            at = max(0, bisect.bisect_right(firsts, seq) - 1)
            seqs, positions = leaf(at)
            i = bisect.bisect_left(seqs, seq)
            if i < len(seqs) and seqs[i] == seq:
                positions[i] = latest[seq]
            else:
                seqs.insert(i, seq)
                positions.insert(i, latest[seq])
            dirty.add(ids[at])
            firsts[at] = seqs[0]
            if len(seqs) > LEAF:
                half, fresh = len(seqs) // 2, max(ids) + 1
                held[fresh] = (seqs[half:], positions[half:])
                del seqs[half:], positions[half:]
                firsts.insert(at + 1, held[fresh][0][0])
                ids.insert(at + 1, fresh)
                dirty.add(fresh)
        changed: dict[int, float | None] = {}
        for seq in arrived:
            at = max(0, bisect.bisect_right(firsts, seq) - 1)
            i = bisect.bisect_left(leaf(at)[0], seq)
            # The result itself and the ones whose window it is in; before them, the rows their windows reach.
            before: list[float | None] = []
            back, j = at, i
            while len(before) < self.rows and (j > 0 or back > 0):
                if j == 0:
                    back -= 1
                    j = len(leaf(back)[0])
                    continue
                j -= 1
                before.insert(0, leaf(back)[1][j])
            for _ in range(self.rows + 1):
                while at < len(ids) and i >= len(leaf(at)[0]):
                    at, i = at + 1, 0
                if at >= len(ids):
                    break
                seqs, positions = leaf(at)
                if seqs[i] not in changed:
                    values = [x for x in before if x is not None]
                    changed[seqs[i]] = sum(values) / len(values) if values else None
                before = [*before, positions[i]][-self.rows :]
                i += 1
        version += 1
        if len(ids) == 1:
            index.update((firsts, ids, version, *held[ids[0]]))
        else:
            for x in dirty if stored else ids:
                kept.updateValue((x,), held[x])
            index.update((firsts, ids, version, None, None))
        return sorted(changed.items()), version

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    drivers, seqs, forms, versions = zip(*rows) if rows else ((), (), (), ())
    return pd.DataFrame({"Driver": pd.Series(drivers, dtype="object"), "seq": pd.Series(seqs, dtype="int64"), "form": pd.Series(forms, dtype="float64"), "version": pd.Series(versions, dtype="int64")})


class _Value:
    """A driver's entry in a map state."""

    def __init__(self, state, driver: int):
        self.state, self.driver = state, driver

    def get(self):
        return self.state.getValue((self.driver,))

    def update(self, value: tuple) -> None:
        self.state.updateValue((self.driver,), value)


class _Leaves(_Value):
    def getValue(self, key: tuple) -> tuple:
        return self.state.getValue((self.driver, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.state.updateValue((self.driver, *key), value)


class DealtFormProcessor(FormProcessor):
    """The same state for the drivers dealt to one key (null for those of null driver): a call costs far more than a driver's results."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.leaves = handle.getMapState("leaves", "driver long, leaf long", "seqs array<long>, positions array<double>")
        self.index = handle.getMapState("index", "driver long", "firsts array<long>, ids array<long>, version long, seqs array<long>, positions array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        none = key[0] is None
        arrived: dict[int, dict[int, float | None]] = {}
        for part in rows:
            drivers = [0] * len(part) if none else part["Driver"].tolist()
            for driver, seq, position in zip(drivers, part["seq"].tolist(), part["Position"].tolist()):
                arrived.setdefault(driver, {})[seq] = None if position != position else position
        out: list[tuple] = []
        for driver, latest in arrived.items():
            changed, version = self.applied(latest, _Value(self.index, driver), _Leaves(self.leaves, driver))
            out += [(None if none else driver, seq, form, version) for seq, form in changed]
            if len(out) >= FRAME:
                yield _frame(out)
                out = []
        yield _frame(out)


def keyed_form(stream: DataFrame, out: str, checkpoint: str, rows: int = 3) -> None:
    """Like ``online_form``, as keyed state: every batch reads only the leaves its results fall into.

    ``stream`` has (Driver, seq, Position). ``out`` gets the form of every result
    a batch changes, with a version per driver; ``current_keyed_form`` takes the
    newest. State and output are both committed by the checkpoint, so a replayed
    batch changes nothing. Needs protobuf for Python, as Spark's state API does.
    """
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        dealt = F.when(F.col("Driver").isNotNull(), F.pmod(F.xxhash64("Driver"), F.lit(KEYS))).alias("dealt")
        formed = stream.select(dealt, "Driver", "seq", "Position").groupBy("dealt").transformWithStateInPandas(
            DealtFormProcessor(rows), "Driver long, seq long, form double, version long", outputMode="Append", timeMode="None"
        )
        query = formed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)


def current_keyed_form(spark: SparkSession, out: str) -> DataFrame:
    """(Driver, seq, form): the newest version of every result."""
    return store.latest_by(spark.read.parquet(out), ["Driver", "seq"], ["version"]).drop("version")
