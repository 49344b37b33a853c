"""Small objects over count tables: a counter, a set, a readable database, a k-mer value."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerspark.functions.alphabet import canonical as canonical_of
from kmerspark.scratch import scratch_path

_SWAP = str.maketrans("ACGT", "TGCA")


@dataclass(frozen=True, order=True)
class Kmer:
    """One k-mer on the driver; order is that of the strings."""

    bases: str

    def __post_init__(self) -> None:
        object.__setattr__(self, "bases", self.bases.upper())
        if not self.bases or set(self.bases) - set("ACGT"):
            raise ValueError(f"{self.bases!r} is no k-mer")

    @property
    def k(self) -> int:
        return len(self.bases)

    def __str__(self) -> str:
        return self.bases

    def reverse_complement(self) -> Kmer:
        return Kmer(self.bases.translate(_SWAP)[::-1])

    def canonical(self) -> Kmer:
        return min(self, self.reverse_complement())

    def is_homopolymer(self) -> bool:
        return len(set(self.bases)) == 1

    def shift_left(self, base: str) -> tuple[Kmer, str]:
        return Kmer(self.bases[1:] + base), self.bases[0]

    def shift_right(self, base: str) -> tuple[Kmer, str]:
        return Kmer(base + self.bases[:-1]), self.bases[-1]

    def __getitem__(self, i: int) -> str:
        """Base number ``i`` from the right end."""
        return self.bases[self.k - 1 - i]

    def packed(self) -> int:
        return int(self.bases.translate(str.maketrans("ACGT", "0123")), 4)

    def get_bits(self, start: int, length: int) -> int:
        return self.packed() >> start & (1 << length) - 1

    @classmethod
    def unpack(cls, packed: int, k: int) -> Kmer:
        return cls("".join("ACGT"[packed >> 2 * i & 3] for i in reversed(range(k))))


class KmerDatabase:
    """A count table with its k, to look k-mers up in and to walk through."""

    def __init__(self, counts: DataFrame, k: int, canonical: bool = False) -> None:
        self.counts, self.k, self.canonical = counts, k, canonical

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KmerDatabase:
        from kmerspark.sources.database import read_database, read_metadata

        meta = read_metadata(path)
        return cls(read_database(spark, path), meta["k"], meta["canonical"])

    def lookup(self, mers: Iterable[str]) -> dict[str, int]:
        """Counts of the k-mers, 0 for those not in the table; a scan with the keys pushed down."""
        asked = {m: str(Kmer(m).canonical()) if self.canonical else m.upper() for m in mers}
        keys = sorted(set(asked.values()))
        found = {r["kmer"]: r["count"] for r in self.counts.filter(F.col("kmer").isin(keys)).collect()} if keys else {}
        return {m: found.get(x, 0) for m, x in asked.items()}

    def __getitem__(self, mer: str) -> int:
        return self.lookup([mer])[mer]

    def __iter__(self) -> Iterator[tuple[str, int]]:
        return ((r["kmer"], r["count"]) for r in self.counts.select("kmer", "count").toLocalIterator())


class KmerCounter:
    """Accumulates tables of k-mers; a missing k-mer has no count (None), not 0.

    What is added is counted once, into a table of its own in the shared folder; reading sums the tables, and every MERGE of them
    are made one, so neither a plan nor the number of tables grows with the additions.
    """

    MERGE = 16

    def __init__(self, spark: SparkSession, k: int) -> None:
        self.spark, self.k = spark, k
        self._tables: list[DataFrame] = []

    def _keep(self, counts: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "counter")
        counts.write.parquet(path)
        return self.spark.read.schema("kmer string, count long").parquet(path)

    @property
    def counts(self) -> DataFrame:
        """(kmer, count) of all that was added."""
        if not self._tables:
            return self.spark.createDataFrame([], "kmer string, count long")
        if len(self._tables) == 1:
            return self._tables[0]
        return reduce(DataFrame.unionByName, self._tables).groupBy("kmer").agg(F.sum("count").alias("count"))

    def add(self, mers: DataFrame, value: str | None = None) -> KmerCounter:
        """Add 1 a row, or column ``value``."""
        new = mers.groupBy("kmer").agg(F.sum(F.col(value) if value else F.lit(1)).cast("long").alias("count"))
        self._tables.append(self._keep(new))
        if len(self._tables) >= self.MERGE:
            self._tables = [self._keep(self.counts)]
        return self

    def add_new(self, mers: DataFrame, value: str | None = None) -> DataFrame:
        """Add, and tell of each k-mer whether it is new: (kmer, is_new)."""
        before = self.counts.select("kmer", F.lit(False).alias("is_new"))
        told = mers.select("kmer").distinct().join(before, "kmer", "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))
        path = scratch_path(self.spark, "counter-new")
        told.write.parquet(path)
        self.add(mers, value)
        return self.spark.read.schema("kmer string, is_new boolean").parquet(path)

    def new_keys(self, mers: DataFrame) -> DataFrame:
        """The k-mers that adding these would bring in."""
        return mers.select("kmer").distinct().join(self.counts, "kmer", "left_anti")

    def update_add(self, mers: DataFrame, value: str | None = None) -> KmerCounter:
        from .count import update_add

        self._tables = [self._keep(update_add(self.counts, mers.withColumn("_v", F.col(value) if value else F.lit(1)), "_v"))]
        return self

    def get(self, mer: str) -> int | None:
        row = self.counts.filter(F.col("kmer") == mer).first()
        return None if row is None else row["count"]

    def size(self) -> int:
        return self.counts.count()


class KmerSet:
    """A set of k-mers."""

    def __init__(self, mers: DataFrame) -> None:
        self.kmers = mers.select("kmer").distinct()

    def add(self, mers: DataFrame) -> KmerSet:
        return KmerSet(self.kmers.unionByName(mers.select("kmer")))

    def __contains__(self, mer: str) -> bool:
        return bool(self.kmers.filter(F.col("kmer") == mer).limit(1).count())

    def members(self, mers: DataFrame) -> DataFrame:
        return mers.join(self.kmers, "kmer", "left_semi")

    def size(self) -> int:
        return self.kmers.count()


def canonicalize(mers: DataFrame) -> DataFrame:
    return mers.withColumn("kmer", canonical_of("kmer"))
