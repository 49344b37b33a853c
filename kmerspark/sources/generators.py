"""Sequences from other programs' output and from chance."""

from __future__ import annotations

import io
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequences import PARSERS, SCHEMA, _batch, sniff, to_fasta, to_fastq


def read_commands(file_text: str) -> list[str]:
    """Commands of a generator file: one a line, blank lines and lines that begin with # left out."""
    return [x for x in file_text.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def run_generators(spark: SparkSession, commands: list[str], shell: str = "/bin/sh", allow_execution: bool = False) -> DataFrame:
    """Run each command in a task and read its output as FASTA or FASTQ; a command that fails fails the job.

    This runs arbitrary programs on the executors, so it must be asked for with ``allow_execution``.
    """
    if not allow_execution:
        raise PermissionError("running commands must be allowed with allow_execution=True")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for command in b.column(0).to_pylist():
                with subprocess.Popen([shell, "-c", command], stdout=subprocess.PIPE) as p:
                    stream = io.BufferedReader(p.stdout.raw if isinstance(p.stdout, io.BufferedReader) else p.stdout, 1 << 20)
                    kind = sniff(stream)
                    rows = []
                    for i, (h, s, q) in enumerate(PARSERS[kind](stream) if kind else ()):
                        rows.append((command, i, h, s, q))
                        if len(rows) >= 5_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)
                if p.returncode:
                    raise RuntimeError(f"generator command failed with status {p.returncode}: {command}")

    if not commands:
        return spark.createDataFrame([], SCHEMA)
    frame = spark.createDataFrame([(c,) for c in commands], "command string").repartition(len(commands))
    return frame.mapInArrow(run, SCHEMA)


def random_reads(spark: SparkSession, n: int, length: int, seed: int = 0, quality: bool = False) -> DataFrame:
    """``n`` reads of random bases (and qualities from 66 to 104): digits of md5 sums of the read's number, the seed and the place."""
    out = spark.range(n).withColumnRenamed("id", "record_id")
    digest = lambda kind, i: F.md5(F.concat_ws("-", F.lit(kind), F.col("record_id").cast("string"), F.lit(str(seed)), i.cast("string")))
    words = F.transform(F.sequence(F.lit(0), F.lit(max(length - 1, 0) // 32)), lambda i: F.translate(digest("base", i), "0123456789abcdef", "ACGT" * 4))
    seq = F.substring(F.array_join(words, ""), 1, length)
    out = out.select("record_id", F.concat(F.lit("read_"), F.col("record_id").cast("string")).alias("header"), seq.alias("seq"))
    if not quality:
        return out
    chars = "".join(chr(c) for c in range(66, 105))

    def eight(i):  # four hexadecimal digits a character
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.substring(F.lit(chars), (F.conv(F.substring(digest("qual", i), 4 * j + 1, F.lit(4)), 16, 10).cast("int") % len(chars)) + 1, F.lit(1)))

    qual = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max(length - 1, 0) // 8)), eight)), "")
    return out.withColumn("qual", F.substring(qual, 1, length))


def write_random(spark: SparkSession, path: str, bases: int, read_length: int | None = None, seed: int = 0, fastq: bool = False) -> None:
    """A folder of FASTA (wrapped at 70) or four-line FASTQ files of ``bases`` random bases in reads of ``read_length`` (FASTQ: 70), the last one shorter."""
    size = min(read_length or (70 if fastq else 10_000), max(bases, 1))
    n, rest = divmod(bases, size)
    reads = random_reads(spark, n + (rest > 0), size, seed, fastq)
    if rest:
        cut = F.when(F.col("record_id") == n, rest).otherwise(size)
        reads = reads.withColumns({c: F.substring(c, F.lit(1), cut) for c in (("seq", "qual") if fastq else ("seq",))})
    (to_fastq(reads) if fastq else to_fasta(reads)).write.mode("overwrite").text(path)
