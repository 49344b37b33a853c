"""Histogram and summary statistics of a count table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .count import bounded


def bucket_bounds(low: int = 1, high: int = 10_000, increment: int = 1) -> tuple[int, int, int]:
    """(base, ceiling, number of buckets): one increment below ``low`` (0 at least) to one above ``high``."""
    if increment < 1 or high < low:
        raise ValueError("the increment must be positive and high not below low")
    base = 0 if increment >= low else low - increment
    ceiling = high + increment
    return base, ceiling, (ceiling + increment - base) // increment


def histogram(counts: DataFrame, low: int = 1, high: int = 10_000, increment: int = 1, full: bool = False) -> DataFrame:
    """(bucket, n): how many k-mers have a count in each bucket.

    The first bucket also takes smaller counts and the last one larger ones; empty buckets are left out unless ``full``.
    """
    base, ceiling, n = bucket_bounds(low, high, increment)
    c = F.col("count")
    index = F.when(c < base, 0).when(c > ceiling, n - 1).otherwise(F.floor((c - base) / increment))
    found = counts.select((base + index * increment).cast("long").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    if not full:
        return found
    labels = counts.sparkSession.range(base, base + n * increment, increment).withColumnRenamed("id", "bucket")
    return labels.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stats(counts: DataFrame, lower: int | None = None, upper: int | None = None) -> DataFrame:
    """One row: k-mers seen once, different k-mers, all occurrences, highest count."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return bounded(counts, lower, upper).agg(
        zero(F.sum(F.when(F.col("count") == 1, 1))).alias("unique_mers"),
        F.count(F.lit(1)).alias("distinct_mers"),
        zero(F.sum("count")).alias("total"),
        zero(F.max("count")).alias("max_count"),
    )
