"""Shared helpers: tables of a folder, scratch copies, range blocks."""

from __future__ import annotations

import math
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpanel.session import materialize, shuffle_partitions

#: A word is a run of characters other than space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(Path(tempfile.mkdtemp()) / "rankpanel.zip", "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(z.filename)
    _shipped.add(context.applicationId)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Small Arrow batches for jobs run inside, whose rows are large."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows):
        yield


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when their job ends; for jobs inside that each run once, their results written."""
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: str | int) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(written: DataFrame, within: str = "") -> None:
    """Delete a written scratch table, or its partition ``within``, that what comes next, itself written, no longer needs."""
    spark = written.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles() if "/rankpanel-" in f and within in f}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_blocks(df: DataFrame, order: list[Column], block: str, label: str, partitions: int | None = None) -> DataFrame:
    """Range-partition on ``order`` and keep the partition number, written once so that numbers stay put.

    A hot key spreads over many blocks, since the order has a tie-breaker below it.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    return materialize(df.repartitionByRange(n, *order).withColumn(block, F.spark_partition_id()), label)


def row_key(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """The documents and a column that tells their rows apart.

    That is ``key`` where it is never null and never repeats; otherwise rows are
    numbered in a written copy, so that the number is the same in every read.
    """
    seen = docs.groupBy(key).count().agg(F.max("count").alias("most"), F.max(F.col(key).isNull()).alias("null")).first()
    if (seen["most"] or 0) <= 1 and not seen["null"]:
        return docs, key
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows"), "_row"


#: Bits of the largest bitmap that is sent to tasks: 512 KB, whatever the data.
BITMAP_BITS = 22


def bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which of 2**bits slots the low bits of a column use, as packed bits; built in Spark, of fixed size."""
    # Spark's bitmap positions count from 1.
    slots = values.select((F.pmod(F.col(column), F.lit(1 << bits)) + 1).alias("slot"))
    rows = slots.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("m")).collect()
    out = np.zeros(max(1 << bits, 1 << 15) // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(r["m"], np.uint8)
        at = (r["b"] - 1) * len(part)
        out[at : at + len(part)] |= part
    return out


def in_bitmap(packed: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    slot = values.view(np.uint64) & np.uint64((1 << bits) - 1)
    return (packed[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def row_filter(rows: DataFrame, column: str, n: int) -> tuple:
    """A broadcast bitmap of the rows of ``column``, and its bits."""
    bits = filter_bits(n)
    return rows.sparkSession.sparkContext.broadcast(bitmap(rows, column, bits)), bits


def filter_bits(n: int) -> int:
    """Bits for a filter of n keys: eight slots a key, up to the fixed bound."""
    return min(BITMAP_BITS, max(15, math.ceil(math.log2(8 * max(n, 1)))))
