"""Sequences to k-mers: the table-generating function of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from kmerspark.functions.alphabet import bases, canonical as canonical_of, unpack

from .encode import placing_task

#: Lengths to which sequences are cut, in turn, before they become windows: a substring costs time in its place, so
#: neither a long contig nor a long run may be the row that windows are taken from.
STEPS = (1 << 20, 1 << 13, 256)
#: Bases that a long holds.
WORD = 31


def mask_quality(seq: Column, qual: Column, min_qual: int) -> Column:
    """``seq`` with N in place of bases whose quality character is below ``min_qual``; no quality, no mask."""
    masked = F.array_join(F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda b, q: F.when(F.ascii(q) < min_qual, "N").otherwise(b)), "", "N")
    return F.when(qual.isNull(), seq).otherwise(masked)


def _pieces(run: Column, k: int, step: int) -> Column:
    many = F.transform(F.sequence(F.lit(0), F.length(run) - k, F.lit(step)), lambda s: F.substring(run, s + 1, F.lit(step + k - 1)))
    return F.when(F.length(run) >= F.lit(step + k), many).otherwise(F.array(run))


def _runs(df: DataFrame, k: int, seq: str, qual: str | None, min_qual: int | None, last: int | None = None) -> DataFrame:
    """Runs of bases of bounded length, in column ``_run``, that overlap so that each window is in one of them."""
    if k < 1:
        raise ValueError("k must be at least 1")
    s = bases(F.col(seq))
    if qual is not None and min_qual is not None:
        s = mask_quality(s, F.col(qual), min_qual)
    out = df.select(F.explode(F.split(s, "[^ACGT]+")).alias("_run")).filter(F.length("_run") >= k)
    for step in STEPS if last is None else (*STEPS, last):
        out = out.select(F.explode(_pieces(F.col("_run"), k, step)).alias("_run"))
    return out


def packed_kmers(df: DataFrame, k: int, seq: str = "seq", qual: str | None = None, min_qual: int | None = None, canonical: bool = False) -> DataFrame:
    """As :func:`kmers`, but packed (k up to 31), in column ``packed``.

    Runs are cut to pieces of up to 31 bases, each of which is read once as a number, whose bits give its reverse complement; windows
    are shifts of these, so no string is made for a window.
    """
    if k > WORD:
        raise ValueError(f"at most {WORD} bases are packed")
    out = _runs(df, k, seq, qual, min_qual, WORD - k + 1)
    forward = F.conv(F.translate("_run", "ACGT", "0123"), 4, 10).cast("long")
    out = out.select(forward.alias("_f"), F.length("_run").alias("_l"))
    if canonical:  # the complement's pairs of bits in reverse order; a select each, as each step takes the last one twice
        out = out.select("_f", "_l", F.bitwise_not("_f").alias("_r"))
        for bits, pattern in ((2, "33"), (4, "0F"), (8, "00FF"), (16, "0000FFFF")):
            keep = int(pattern * (16 // len(pattern)), 16)
            out = out.select("_f", "_l", F.expr(f"shiftrightunsigned(_r, {bits}) & {keep}L | shiftleft(_r & {keep}L, {bits})").alias("_r"))
        out = out.select("_f", "_l", F.expr("shiftrightunsigned(shiftrightunsigned(_r, 32) | shiftleft(_r, 32), 64 - 2 * _l)").alias("_r"))
    # in a select of its own: numbers beside the explode would be made anew for each window
    out = out.select(*out.columns, (F.col("_l") - k).alias("_n"), F.explode(F.sequence(F.lit(0), F.col("_l") - k)).alias("_i"))
    mask = (1 << 2 * k) - 1
    ahead = F.expr(f"shiftright(_f, 2 * (_n - _i)) & {mask}L")
    return out.select((F.least(ahead, F.expr(f"shiftright(_r, 2 * _i) & {mask}L")) if canonical else ahead).alias("packed"))


def kmers(df: DataFrame, k: int, seq: str = "seq", qual: str | None = None, min_qual: int | None = None, canonical: bool = False) -> DataFrame:
    """One row per valid window, with only column ``kmer``.

    A window holds bases of one sequence only (either case); any other character, or a base below ``min_qual``, ends a
    run. Sequences are split into runs of bases and runs are cut, with overlaps, so no window is lost or checked twice.
    """
    out = _runs(df, k, seq, qual, min_qual)
    windows = F.transform(F.sequence(F.lit(1), F.length("_run") - k + 1), lambda i: F.substring(F.col("_run"), i, F.lit(k)))
    out = out.select(F.explode(windows).alias("kmer"))
    return out.select(canonical_of("kmer").alias("kmer")) if canonical else out


def spelled(df: DataFrame, k: int) -> DataFrame:
    """Column ``packed`` as ``kmer``, in its place."""
    return df.select(*[unpack("packed", k).alias("kmer") if c == "packed" else c for c in df.columns])


def packed_at(df: DataFrame, k: int, keys: list[str], seq: str = "seq", qual: str | None = None, min_qual: int | None = None, canonical: bool = False) -> DataFrame:
    """As :func:`kmers_at`, with column ``packed`` in place of ``kmer`` (k up to 31)."""
    if not 1 <= k <= WORD:
        raise ValueError(f"1 to {WORD} bases are packed")
    columns = [*keys, seq, qual] if qual is not None and min_qual is not None else [*keys, seq]
    schema = StructType([*df.select(*keys).schema.fields, StructField("pos", LongType()), StructField("packed", LongType())])
    return df.select(*columns).mapInArrow(placing_task(k, canonical, len(keys), min_qual), schema)


def kmers_at(df: DataFrame, k: int, keys: list[str], seq: str = "seq", qual: str | None = None, min_qual: int | None = None, canonical: bool = False) -> DataFrame:
    """One row per valid window with ``keys``, its place ``pos`` (from 0) in the sequence, and ``kmer``."""
    if k <= WORD:
        return spelled(packed_at(df, k, keys, seq, qual, min_qual, canonical), k)
    s = bases(F.col(seq))
    if qual is not None and min_qual is not None:
        s = mask_quality(s, F.col(qual), min_qual)
    out = df.select(*keys, s.alias("_run"), F.lit(0).cast("long").alias("_at")).filter(F.length("_run") >= k)
    for step in STEPS:
        out = out.select(*keys, F.posexplode(_pieces(F.col("_run"), k, step)).alias("_i", "_piece"), "_at").select(*keys, F.col("_piece").alias("_run"), (F.col("_at") + F.col("_i") * step).alias("_at"))
    # invalid windows become nulls, so that a join on the k-mer infers no pattern match for its other side
    window = lambda i: F.substring(F.col("_run"), i, F.lit(k))
    windows = F.transform(F.sequence(F.lit(1), F.length("_run") - k + 1), lambda i: F.when(~window(i).rlike("[^ACGT]"), window(i)))
    out = out.select(*keys, F.posexplode(windows).alias("_i", "kmer"), "_at").filter(F.col("kmer").isNotNull())
    return out.select(*keys, (F.col("_at") + F.col("_i")).alias("pos"), (canonical_of("kmer") if canonical else F.col("kmer")).alias("kmer"))
