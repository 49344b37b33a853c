"""Shared helpers: durable intermediate tables, column guards, global prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset, in local mode, a local one is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kmerspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage, survives lost executors and freezes anything whose recomputation could differ.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sliced(batches, rows: int = 500):
    """Arrow batches in slices of so many rows: Python copies of one slice at a time bound a worker's memory."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


#: Bits of the filter of :func:`maybe_in` at most: 1,048,576 rows are broadcast.
MAX_BITS = 1 << 26


def maybe_in(df: DataFrame, value: Column, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``value`` is in the one column of ``wanted``, and a few others: one bit a hash, and only the bits are broadcast.

    Before a join this spares the shuffle of the rows that find nothing. Beyond 2 million values more and more others pass. A null is a value.
    """
    bits = min(MAX_BITS, max(1 << 10, 1 << (32 * wanted.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = wanted.select(at(F.col(wanted.columns[0])).alias("_h")).select(F.shiftright("_h", 6).alias("_at"), F.expr("shiftleft(1L, cast(_h & 63 AS int))").alias("_bit"))
    words = marks.groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))
    found = df.withColumn("_h", at(value)).join(F.broadcast(words), F.shiftright("_h", 6) == F.col("_at"))
    return found.filter(F.expr("shiftright(_bits, cast(_h & 63 AS int)) & 1 = 1")).select(*df.columns)


def range_partitioned(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` plus ``_pid``: contiguous ranges of ``order``, frozen in a table so that every later reader sees the same cut.

    Rows that are equal in ``order`` are told apart by their place in the input, so that many of them are no single range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_tie").drop("_tie").withColumn("_pid", F.spark_partition_id())
    return materialize(cut, name)


def prefix_sums(cut: DataFrame, sums: dict[str, Column], order: list[Column]) -> DataFrame:
    """Exclusive global prefix sums over a frame from :func:`range_partitioned`.

    Totals of each partition (one row per partition, so bounded by the partition count) are scanned once; rows then
    only need a running sum inside their own partition. ``sums`` maps an output name to what is summed.
    """
    totals = cut.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).cast("long").alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).cast("long").alias(k) for k, c in sums.items()])
    out = out.join(F.broadcast(bases), "_pid")
    for k in sums:
        out = out.withColumn(k, F.col(k) + F.col(f"_b_{k}")).drop(f"_b_{k}")
    return out
