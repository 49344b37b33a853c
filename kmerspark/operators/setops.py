"""Merging count tables: multiset union, weighted intersection and union, similarity, per-table matrix.

Tables have their k-mers in column ``kmer`` or, all of them, packed in column ``packed``, and so has the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .count import bounded


def _key(tables: list[DataFrame]) -> str:
    return "packed" if all("packed" in t.columns for t in tables) else "kmer"


def _together(tables: list[DataFrame]) -> DataFrame:
    if len(tables) < 2:
        raise ValueError("at least two tables are needed")
    return reduce(DataFrame.unionByName, [t.select(_key(tables), F.col("count").cast("long").alias("count"), F.lit(i).alias("_file")) for i, t in enumerate(tables)])


def _least(n: int):
    """0 unless all ``n`` tables have the k-mer."""
    return F.when(F.count(F.lit(1)) < n, 0).otherwise(F.min("count"))


def merge(tables: list[DataFrame], op: str = "sum", lower: int | None = None, upper: int | None = None) -> DataFrame:
    """(kmer, count) over all tables by one shuffle: ``sum``, ``max``, or ``min`` (0 where a table lacks the k-mer).

    ``lower`` is 1 by default for min, which leaves the k-mers that all tables share.
    """
    agg = {"sum": lambda: F.sum("count"), "max": lambda: F.max("count"), "min": lambda: _least(len(tables))}[op]()
    out = _together(tables).groupBy(_key(tables)).agg(agg.cast("long").alias("count"))
    return bounded(out, 1 if lower is None and op == "min" else lower, upper)


def jaccard(tables: list[DataFrame]) -> DataFrame:
    """One row: shared over all k-mers, and the same weighted by counts; null for empty tables."""
    per = _together(tables).groupBy(_key(tables)).agg(_least(len(tables)).alias("lo"), F.max("count").alias("hi"))
    return per.agg(
        (F.sum(F.when(F.col("lo") > 0, 1).otherwise(0)) / F.count(F.lit(1))).alias("jaccard"),
        F.expr("try_divide(sum(lo), sum(hi))").cast("double").alias("wjaccard"),
    )


def count_matrix(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per k-mer and a column per table, 0 where the table lacks it; one shuffle."""
    names, key = list(tables), _key(list(tables.values()))
    both = reduce(DataFrame.unionByName, [t.select(key, *[(F.col("count") if n == m else F.lit(0)).cast("long").alias(m) for m in names]) for n, t in tables.items()])
    return both.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
