"""Cleaning a corpus end to end: toxic documents go, near copies go, benchmark passages go, sources are mixed, tokens are written.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the shared folder and read again as the next
one's ``docs``. All stages but the last return the columns of ``documents``, and any others that there are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerspark.llm import decontaminate, mixing, neardup, tokens, toxicity
from kmerspark.llm.common import materialize, new_path, read_table


def _passing(docs: DataFrame, added: tuple[str, ...], judge: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """The rows for which ``keep`` holds once ``judge`` has added its columns; columns of ``docs`` that are named like these keep their values."""
    prefix = "own "
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "own "
    own = {c: prefix + c for c in docs.columns if c in added}
    judged = judge(docs.withColumnsRenamed(own)).filter(keep)
    return judged.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones among them, does not take for toxic.

    Null and empty texts are clean; very long ones are judged whole, by rate; repeated rows go or stay together; without labels nothing goes.
    """
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return _passing(docs, ("severity", "toxic"), lambda d: toxicity.score(d, model), ~F.col("toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one of the least doc_id, nulls last, ties by the text's hash.

    Of repeated rows, of null and empty texts, and of very long near copies one stays, too.
    """
    return neardup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; very long ones are searched whole; repeated rows go or stay together; without a benchmark nothing goes.
    """
    benchmark = read_table(spark, sf_dir, "benchmark")
    return _passing(docs, decontaminate.RESULT, lambda d: decontaminate.find_contamination(d, benchmark), ~F.col("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixed stream: each source spread at its share, within one block of it at any place.

    The order is that of the written files and of the rows in them, which the next stage reads back. A null source is one of its own;
    rows that share doc_id and source (repeated ones, null ids) stay together, at the first of their places; texts only pass through.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = mixing.mix_sources(docs.select("doc_id", "source"), key="doc_id")
    first = placed.groupBy("doc_id", "source").agg(F.min("position").alias("place"))
    wrapped = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from"))
    joined = wrapped.join(first, wrapped["id"].eqNullSafe(first["doc_id"]) & wrapped["from"].eqNullSafe(first["source"]))
    return joined.select("row", "place").repartitionByRange(n, "place").sortWithinPartitions("place").select("row.*")


def in_row_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, at): every row's place in the frame. A frame that is not read from files is written first, which keeps its order."""
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    place = [F.coalesce(file, F.lit(-1)).alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")]
    try:
        return docs.select("doc_id", "text", *place)
    except AnalysisException:
        return materialize(docs.select("doc_id", "text"), "row-order").select("doc_id", "text", *place)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixed stream; place, length and checksum of each document, read back from them.

    Null and empty texts are documents of the end id alone; repeated rows are documents each; very long texts are encoded whole.
    """
    folder = new_path(spark, "tokens")
    manifest = tokens.write_tokens(in_row_order(docs), folder, tokens.tokenizer_path(), [F.col("part"), F.col("file"), F.col("at")])
    return tokens.read_tokens(manifest, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: The stages learn a model, cluster, tile and tokenize: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
    return STAGES[-1][1](spark, docs, sf_dir)
