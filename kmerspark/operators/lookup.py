"""Looking k-mers up in a count table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerspark.functions.alphabet import canonical as canonical_of
from kmerspark.functions.alphabet import parse, unpack

from .count import keyed
from .extract import WORD, kmers_at, packed_at


def query(counts: DataFrame, mers: DataFrame, k: int, canonical: bool = False, mer: str = "mer") -> DataFrame:
    """(mer, count) per queried text: its first ``k`` bases, 0 if they aren't in the table.

    Texts that are shorter or hold other characters are left out. The queries' columns otherwise don't matter.
    """
    asked = mers.select(parse(mer, k).alias("mer")).filter("mer IS NOT NULL")
    if canonical:
        asked = asked.select(canonical_of("mer").alias("mer"))
    return asked.join(counts.select(F.col("kmer").alias("mer"), "count"), "mer", "left").select("mer", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def query_sequences(counts: DataFrame, reads: DataFrame, k: int, keys: list[str], seq: str = "seq", canonical: bool = False) -> DataFrame:
    """Keys, pos, mer and count of every window of the reads, repeats kept; order by keys and pos for reading order."""
    found = _found(counts, reads, k, keys, seq, canonical)
    mer = unpack("packed", k) if k <= WORD else F.col("kmer")
    return found.select(*keys, "pos", mer.alias("mer"), "count")


def _found(counts: DataFrame, reads: DataFrame, k: int, keys: list[str], seq: str, canonical: bool) -> DataFrame:
    """Keys, pos, the k-mer (packed, up to 31 bases) and its count."""
    key = "packed" if k <= WORD else "kmer"
    asked = (packed_at if k <= WORD else kmers_at)(reads, k, keys, seq, canonical=canonical)
    return asked.join(keyed(counts, key).select(key, "count"), key, "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def query_per_read(counts: DataFrame, reads: DataFrame, k: int, keys: list[str], seq: str = "seq", canonical: bool = False, piece: int | None = None) -> DataFrame:
    """Keys and ``counts``: the counts of the read's windows in order. Reads without a valid window have no row.

    With ``piece``, a read's vector is cut at every so many positions, in column ``part`` from 0: long contigs need it.
    """
    rows = _found(counts, reads, k, keys, seq, canonical).select(*keys, "pos", "count")
    if piece is not None:
        rows = rows.withColumn("part", F.expr(f"pos div {int(piece)}"))
    pairs = F.array_sort(F.collect_list(F.struct("pos", "count")))
    return rows.groupBy(*keys, *(["part"] if piece is not None else [])).agg(F.transform(pairs, lambda x: x["count"]).alias("counts"))


def query_classes(counts: DataFrame, mers: DataFrame, k: int, canonical: bool = False, mer: str = "mer") -> DataFrame:
    """As :func:`query`, with counts of two and more as 2: what an exact Bloom counter answers."""
    return query(counts, mers, k, canonical, mer).withColumn("count", F.least("count", F.lit(2)))
