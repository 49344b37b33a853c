"""Reads derived from the driver tables: md5 digests spelled in bases, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789abcdef"
WITH_N = "ACGTACGTACGTACGN"
NO_N = "ACGTACGTACGTACGT"
QUALITIES = "!+5?@ABCDEFGHIhi"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer than two tasks a core.

    A file is split by its bytes, at its row groups: a million keys of a few bytes are one task, though each becomes a read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def _digest(*parts: Column | str, letters: str = WITH_N) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.translate(F.md5(F.concat(*cols)), HEX, letters)


def reads_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (F.col("l_orderkey"), "-", F.col("l_linenumber"))
    return spread(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")).select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("rid"), _digest(*key).alias("seq"), _digest("q", *key, letters=QUALITIES).alias("qual"))


def reads_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").cast("string").alias("rid"), _digest(F.col("o_orderkey")).alias("seq"))


def reads_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("rid"), _digest("c", F.col("c_custkey")).alias("seq"))


def reads_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 700
    return spread(_table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("rid"), F.concat(*[_digest("L", str(i), key, letters=NO_N) for i in range(5)]).alias("seq"))


def reads_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), F.col("text").alias("seq"))


#: The same reads as common table expressions for DuckDB.
SQL = {
    "reads_a": f"reads_a AS (SELECT l_orderkey || '-' || l_linenumber AS rid, translate(md5(l_orderkey || '-' || l_linenumber), '{HEX}', '{WITH_N}') AS seq, translate(md5('q' || l_orderkey || '-' || l_linenumber), '{HEX}', '{QUALITIES}') AS qual FROM lineitem)",
    "reads_b": f"reads_b AS (SELECT o_orderkey::VARCHAR AS rid, translate(md5(o_orderkey::VARCHAR), '{HEX}', '{WITH_N}') AS seq FROM orders)",
    "reads_c": f"reads_c AS (SELECT c_custkey AS rid, translate(md5('c' || c_custkey), '{HEX}', '{WITH_N}') AS seq FROM customer)",
    "reads_long": "reads_long AS (SELECT c_custkey AS rid, " + " || ".join(f"translate(md5('L{i}' || (c_custkey % 700)), '{HEX}', '{NO_N}')" for i in range(5)) + " AS seq FROM customer)",
    "reads_text": "reads_text AS (SELECT doc_id AS rid, text AS seq FROM documents)",
}
