"""Counts over streams: running state, or partial tables that are compacted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerspark.operators.extract import kmers


def stream_reads(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """Reads from the files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def running_counts(reads: DataFrame, k: int, seq: str = "seq", canonical: bool = False) -> DataFrame:
    """Streaming (kmer, count), for output mode ``complete`` or ``update``.

    The state is every k-mer seen: k-mers have no event time, so no watermark can end them. Use
    :func:`use_rocksdb` for states larger than memory, or :func:`append_partials` to keep none.
    """
    return kmers(reads, k, seq, canonical=canonical).groupBy("kmer").agg(F.count(F.lit(1)).alias("count"))


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def append_partials(reads: DataFrame, k: int, out: str, checkpoint: str, seq: str = "seq", canonical: bool = False):
    """A stream writer that keeps each micro-batch's counts as its own folder of ``out``; a batch that is run again replaces its folder."""
    from kmerspark.operators.count import count_kmers

    def write(batch: DataFrame, number: int) -> None:
        count_kmers(batch, k, seq, canonical=canonical).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def compact(spark: SparkSession, out: str) -> DataFrame:
    """The sum of all partial tables: merge of the batches so far."""
    return spark.read.parquet(out).groupBy("kmer").agg(F.sum("count").cast("long").alias("count"))
