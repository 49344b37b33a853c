"""k-mers of a string, for Python and for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_RUN = re.compile("[ACGTacgt]+")
_SWAP = str.maketrans("ACGT", "TGCA")


def string_mers(text: str, k: int, canonical: bool = False) -> Iterator[str]:
    """The valid windows of a string in order."""
    for run in _RUN.findall(text or ""):
        run = run.upper()
        n = len(run)
        other = run.translate(_SWAP)[::-1] if canonical and n >= k else ""  # once a run: windows of it are the windows' complements
        for i in range(n - k + 1):
            m = run[i : i + k]
            yield min(m, other[n - k - i : n - i]) if canonical else m


def string_canonicals(text: str, k: int) -> Iterator[str]:
    return string_mers(text, k, True)


@udtf(returnType="kmer string", useArrow=True)  # rows travel in Arrow batches; functions over whole Arrow arrays can't be joined laterally
class KmersUDTF:
    def eval(self, seq: str, k: int, canonical: bool):
        for m in string_mers(seq, k, canonical):
            yield (m,)


def register(spark: SparkSession) -> None:
    """Make ``kmers(seq, k, canonical)`` a table function: SELECT ... FROM reads, LATERAL kmers(seq, 21, true)."""
    spark.udtf.register("kmers", KmersUDTF)
