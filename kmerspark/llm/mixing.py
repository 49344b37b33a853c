"""Mixing sources to target weights by Pfair scheduling [native]."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, prefix_sums, range_partitioned, read_table

#: Weights that repeat exactly after so many slots (or two a source) are planned for one period; all others over the whole stream.
PERIOD = 1000
#: The driver plans with a state a source, so their number has a bound, which is a parameter; more raise an error.
MAX_SOURCES = 1_000_000
#: Least number of parts of each source that are numbered apart and joined by prefix sums, so that a hot source is no single task.
PARTS = 256


def exact_weights(weights: dict) -> dict:
    """Weights as the least integers in exactly the same proportions."""
    weights = {k: Fraction(v) for k, v in weights.items()}
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    scale = math.lcm(*(v.denominator for v in weights.values()))
    whole = {k: int(v * scale) for k, v in weights.items()}
    common = math.gcd(*whole.values())
    return {k: v // common for k, v in whole.items()}


def pfair_stream(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """The schedule of so many blocks of each source: (number of the source, index of its block, slot), by slot.

    Block k (from 0) of a source with weight w = a / sum is released at floor(k / w) and due at ceil((k + 1) / w).
    Each slot takes, among the released blocks, the one due first (ties by source); it stays empty if there is none. The
    weights fill the slots at most, so every block meets its window and, until it ends, no source is ever one block or more
    off its share. Only one block a source is held.
    """
    total = sum(weights)
    waiting, ready, t = [(0, i, 0) for i in range(len(weights)) if blocks[i]], [], 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[i]), i, k))
        d, i, k = heapq.heappop(ready)
        assert d > t, "a deadline was missed"
        yield i, k, t
        t += 1
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, ((k + 1) * total // weights[i], i, k + 1))


def pfair_period(weights: dict) -> list[tuple[object, int]]:
    """One period of the schedule: (source, index of its block) for each slot; all slots are filled."""
    name = sorted(weights, key=lambda k: (k is None, str(k)))
    shares = [weights[k] for k in name]
    return [(name[i], k) for i, k, _ in pfair_stream(shares, shares)]


def _stream_plan(spark: SparkSession, weights: list[int], blocks: list[int]) -> DataFrame:
    """(_i, _k, _slot) of every block of the stream, written by the driver in pieces, of which it holds one at a time."""
    path, stream, schema = new_path(spark, "mix-plan"), pfair_stream(weights, blocks), "_i long, _k long, _slot long"
    while piece := list(islice(stream, 100_000)):
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def mix_sources(docs: DataFrame, weights: dict | None = None, block: int = 4, source: str = "source", key: str = "doc_id", period: int = PERIOD, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Add ``block`` (number within the source), ``slot`` and ``position`` (place in the mixed stream, gapless from 0).

    Each source's rows are dealt in a fixed pseudo-random order (md5 of ``key``, then ``key``) into blocks of ``block``
    rows. ``weights`` maps sources to target weights (sources it lacks get the smallest one given); by default they are
    the sources' shares of the rows, so that all sources end together. A source that ends leaves its slots empty and the
    others go on at their relative rates: every row is kept, once. The weights are taken exactly: at every slot until it ends,
    a source has less than one block more or less than its weight times the slots so far, however long the stream is.

    A null source is a source of its own; rows with equal or null keys are dealt in any order among themselves but each
    has a place; an empty table gives an empty result; other columns pass through, though columns of the three added names
    are replaced. Weights that repeat exactly after max(period, 2 x sources) slots or fewer are planned for one
    period on the driver, which is broadcast; others over the whole stream, block by block on the driver, written in pieces and joined
    (about a million blocks a second: choose larger blocks for larger tables). A source of many rows is numbered in as many parts as
    there are shuffle partitions. More than ``max_sources`` sources raise an error.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "slot", "position")
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tag = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.withColumn("_tag", tag).withColumn("_part", F.shiftright(F.conv(F.substring("_tag", 1, 6), 16, 10).cast("long") * parts, 24))
    counts = materialize(rows.groupBy(F.col(source).alias("_src"), "_part").count(), "mix-counts")
    sizes = {r[0]: r[1] for r in counts.groupBy("_src").agg(F.sum("count")).limit(max_sources + 1).collect()}
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if not sizes:
        return docs.select("*", *[F.lit(0).cast("long").alias(c) for c in ("block", "slot", "position")])
    shares = exact_weights({k: weights.get(k, min(weights.values())) for k in sizes} if weights else sizes)
    total, name = sum(shares.values()), sorted(shares, key=lambda k: (k is None, str(k)))
    number = {k: i for i, k in enumerate(name)}

    before = Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_src", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(source, "_part").orderBy("_tag", key)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(bases, ranked[source].eqNullSafe(bases["_src"]) & (ranked["_part"] == bases["_part"])).drop(bases["_part"]).drop("_src")
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).withColumn("block", F.floor(F.col("_rank") / block))

    periodic = total <= max(period, 2 * len(shares))
    share = spark.createDataFrame([(k, number[k], shares[k] if periodic else None) for k in name], f"_src {docs.schema[source].dataType.simpleString()}, _i long, _a long")
    placed = ranked.join(F.broadcast(share), ranked[source].eqNullSafe(share["_src"])).drop("_src")
    if periodic:
        plan = F.broadcast(spark.createDataFrame([(number[s], k, t) for t, (s, k) in enumerate(pfair_period(shares))], "_i long, _k long, _slot long"))
        placed = placed.withColumn("_k", F.col("block") % F.col("_a")).join(plan, ["_i", "_k"])
        placed = placed.withColumn("slot", F.expr("block div _a") * total + F.col("_slot"))
    else:
        plan = _stream_plan(spark, [shares[k] for k in name], [-(-sizes[k] // block) for k in name])
        placed = placed.withColumn("_k", F.col("block")).join(plan, ["_i", "_k"]).withColumn("slot", F.col("_slot"))
    placed = placed.drop("_i", "_k", "_slot", "_a", "_base", "_part", "_tag")
    order = [F.col("slot"), F.col("_rank")]
    out = prefix_sums(range_partitioned(placed, order, "mix-order"), {"position": F.lit(1)}, order)
    return out.drop("_pid", "_rank")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that each source's target weight is the square root of its rows (temperature 2), in thousandths.

    The weights are kept to exactly: nothing is rounded to a period.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    sizes = docs.groupBy("source").count().limit(MAX_SOURCES + 1).collect()
    return mix_sources(docs, {r[0]: Fraction(round(r[1] ** 0.5 * 1000)) for r in sizes} or None)
