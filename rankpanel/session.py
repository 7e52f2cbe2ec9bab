"""Session settings and materialisation.

Four settings are read from the session, never written:

* ``spark.checkpoint.dir`` - shared folder for tables that cut lineage;
* ``spark.rankpanel.maxGroupRows`` - rows one window group may hold before the
  operators switch to block-wise plans (default 1,000,000);
* ``spark.rankpanel.maxBroadcastCells`` - rows times columns a table may have to
  be broadcast after its rows were counted (default 4,000,000);
* ``spark.sql.shuffle.partitions`` - lower bound for range partitioning.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MAX_GROUP_ROWS = 1_000_000
DEFAULT_MAX_BROADCAST_CELLS = 4_000_000

#: Long texts make few cells large: bytes of all values a broadcast table may have.
MAX_BROADCAST_BYTES = 256 << 20

_local_dirs: dict[str, str] = {}


def build_session(app: str = "rankpanel", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="rankpanel-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below this application's part of the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/rankpanel-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def release_scratch(spark: SparkSession) -> None:
    """Delete what this application materialised; call when its results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/rankpanel-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the checkpoint folder and read it back.

    Unlike ``DataFrame.checkpoint`` the result keeps column pruning, filter
    pushdown and row counts from file footers, and it survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.rankpanel.maxGroupRows", str(DEFAULT_MAX_GROUP_ROWS)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _size(side: DataFrame) -> tuple[int, int]:
    """(rows, bytes of the values) of a table; a fixed-width value counts 8 bytes without being read."""
    texts = [c for c, t in side.dtypes if t in ("string", "binary") or t.startswith(("array", "map", "struct"))]
    size = F.lit(8 * (len(side.columns) - len(texts)))
    for c in texts:
        size = size + F.coalesce(F.length(F.col(c).cast("string")), F.lit(0))
    row = side.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def join_small(df: DataFrame, side: DataFrame, keys: list[str], label: str, how: str = "left") -> DataFrame:
    """Join a per-group table, which is written once and counted first.

    Within the checked size it is broadcast, so the large side keeps its
    partitioning. Beyond it Spark chooses the join, and splits skewed keys.
    """
    side = materialize(side, label)
    limit = int(df.sparkSession.conf.get("spark.rankpanel.maxBroadcastCells", str(DEFAULT_MAX_BROADCAST_CELLS)))
    rows, size = _size(side)
    small = rows * len(side.columns) <= limit and size <= MAX_BROADCAST_BYTES
    return df.join(F.broadcast(side) if small else side, keys, how)
