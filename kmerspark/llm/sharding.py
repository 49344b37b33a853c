"""Contiguous byte-balanced shards from global prefix sums [native]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prefix_sums, range_partitioned, read_table, text_or_empty


def shard_by_bytes(df: DataFrame, n_shards: int, size: str = "size", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``start`` (bytes before the row), ``shard`` and ``slot`` (place in its shard, gapless from 0).

    Rows are laid out by ``order`` (nulls first); the total is cut at ``n_shards`` equal targets and a row goes to the
    shard in which its first byte lies, so a shard's bytes differ from the target by less than its largest row. Byte
    prefix sums come from the totals of range partitions; only ids and sizes are shuffled, never the texts the caller
    leaves out. Repeated rows and repeated ids keep a place each (ties by the remaining ``order`` columns, then size).
    An empty table gives an empty result. Other columns
    pass through, though columns of the three added names are replaced.
    """
    df = df.drop(*({"start", "shard", "slot"} - {size, *order}))
    keys = [F.col(c).asc_nulls_first() for c in (*order, size)]
    cut = range_partitioned(df, keys, "shard-cut")
    placed = prefix_sums(cut, {"start": F.col(size), "_row": F.lit(1)}, keys)
    total = cut.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] or 1
    shard = F.least(F.lit(n_shards - 1), F.floor(F.col("start").cast("decimal(38,0)") * n_shards / F.lit(total).cast("decimal(38,0)")).cast("int"))
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first")).drop("_row", "_first", "_pid")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the ``bytes`` law; a null text has size 1 and the checksum of the empty text."""
    docs = read_table(spark, sf_dir, "documents")
    small = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    sharded = shard_by_bytes(materialize(small, "shard-sizes"), 16, order=("doc_id", "text_crc32"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "start"
    )


OP4_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), s AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT,
        list_transform(range(size - 1), lambda i: ((instr('123456789ABCDEF', h[2 * i + 1]) * 16 + instr('123456789ABCDEF', h[2 * i + 2])))::UBIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM s, crc_table
), p AS (
  SELECT *, (sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start, sum(size) OVER () AS total FROM c
), q AS (
  SELECT *, least(15, (start::HUGEINT * 16) // total::HUGEINT)::INTEGER AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard, start
FROM q
"""
