"""Counting: group by k-mer, with the restrictions and pre-filters a count can have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerspark.functions.alphabet import pack
from kmerspark.scratch import scratch_path

from .encode import counting_task, long_counting_task
from .extract import WORD, kmers, packed_kmers, spelled


def count_kmers(
    reads: DataFrame,
    k: int,
    seq: str = "seq",
    qual: str | None = None,
    min_qual: int | None = None,
    canonical: bool = False,
    lower: int | None = None,
    upper: int | None = None,
    only: DataFrame | None = None,
    prefilter: str | None = None,
    seen_twice: DataFrame | None = None,
    saturate_bytes: int | None = None,
    engine: str = "auto",
    packed: bool = False,
) -> DataFrame:
    """(kmer, count) of all windows of the reads.

    ``only``: k-mers to count (each has a row, those never seen with 0); no other k-mer is aggregated or, where their files are under
    Spark's broadcast threshold, shuffled. ``prefilter``: "minus1" leaves out each k-mer's
    first occurrence (what an exact Bloom filter of seen k-mers does), "exact2" keeps k-mers that occur twice or more, or
    that ``seen_twice`` (a count table of a first pass) has with 2 or more. ``lower`` and ``upper`` are inclusive and hold
    before ``saturate_bytes`` bounds the counts to what so many bytes store.

    ``engine``: "arrow" encodes batches to packed longs and combines them before the shuffle; "sql" makes the same longs inside the
    JVM. Both pack up to 31 bases. "auto" takes arrow's encoder, which for longer k-mers makes strings, combined by batch as well. Results are equal.

    ``packed`` leaves k-mers of up to 31 bases as longs, in column ``packed``: what merges and lookups join fastest.
    """
    if k > WORD and (engine == "arrow" or packed):
        raise ValueError(f"at most {WORD} bases are packed")
    key = "packed" if k <= WORD else "kmer"
    if engine == "sql":
        rows = (kmers if k > WORD else packed_kmers)(reads, k, seq, qual, min_qual, canonical).select(key, F.lit(1).cast("long").alias("n"))
    else:
        columns = [seq, qual] if qual is not None and min_qual is not None else [seq]
        task = (long_counting_task if k > WORD else counting_task)(k, canonical, min_qual)
        rows = reads.select(*columns).mapInArrow(task, f"{key} {'string' if k > WORD else 'long'}, n long")
    if only is not None:
        path = scratch_path(reads.sparkSession, "only")
        keyed(only, key).select(key).distinct().write.parquet(path)  # of known size, which decides whether it is broadcast
        only = reads.sparkSession.read.parquet(path)
        rows = rows.join(only, key, "left_semi")
    counts = rows.groupBy(key).agg(F.sum("n").alias("count"))
    if prefilter == "minus1":
        counts = counts.filter("count >= 2").withColumn("count", F.col("count") - 1)
    elif prefilter == "exact2":
        counts = counts.filter("count >= 2") if seen_twice is None else counts.join(keyed(seen_twice.filter("count >= 2"), key).select(key), key, "left_semi")
    elif prefilter is not None:
        raise ValueError(f"no prefilter {prefilter!r}")
    if only is not None:
        counts = only.join(counts, key, "left").select(key, F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    counts = bounded(counts, lower, upper)
    counts = counts if saturate_bytes is None else saturate(counts, saturate_bytes)
    return counts if packed or key == "kmer" else spelled(counts, k)


def keyed(mers: DataFrame, key: str) -> DataFrame:
    """``mers`` with its k-mers in column ``key``, be it ``packed`` or ``kmer``."""
    return mers if key in mers.columns else mers.select(*[pack("kmer").alias("packed") if c == "kmer" else c for c in mers.columns])


def restrict(counts: DataFrame, only: DataFrame) -> DataFrame:
    """Counts of the k-mers of ``only``, 0 for those that have none."""
    return only.select("kmer").distinct().join(counts, "kmer", "left").select("kmer", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def bounded(counts: DataFrame, lower: int | None = None, upper: int | None = None) -> DataFrame:
    """Rows with lower <= count <= upper."""
    if lower is not None:
        counts = counts.filter(F.col("count") >= lower)
    return counts if upper is None else counts.filter(F.col("count") <= upper)


def saturate(counts: DataFrame, n_bytes: int) -> DataFrame:
    """Counts as ``n_bytes`` of storage hold them; eight bytes hold any."""
    return counts if n_bytes >= 8 else counts.withColumn("count", F.least("count", F.lit((1 << 8 * n_bytes) - 1)))


def distinct_kmers(reads: DataFrame, k: int, seq: str = "seq", canonical: bool = False) -> DataFrame:
    if k > WORD:
        return reads.select(seq).mapInArrow(long_counting_task(k, canonical, None), "kmer string, n long").select("kmer").distinct()
    found = reads.select(seq).mapInArrow(counting_task(k, canonical, None), "packed long, n long")
    return spelled(found.select("packed").distinct(), k)


def add_weighted(mers: DataFrame, value: str = "value") -> DataFrame:
    """Sum of ``value`` by k-mer."""
    return mers.groupBy("kmer").agg(F.sum(value).cast("long").alias("count"))


def update_add(counts: DataFrame, mers: DataFrame, value: str = "value") -> DataFrame:
    """``counts`` with the values of the k-mers that it has added; others have no effect."""
    sums = mers.join(counts.select("kmer"), "kmer", "left_semi").groupBy("kmer").agg(F.sum(value).alias("_add"))
    return counts.join(sums, "kmer", "left").select("kmer", (F.col("count") + F.coalesce("_add", F.lit(0))).cast("long").alias("count"))


def top_kmers(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent k-mers, ties in order of the k-mer."""
    return counts.orderBy(F.desc("count"), "kmer").limit(n)
