"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, sliced, text_or_empty

SYMBOLS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW = 7  # bytes of the rolling register
LENGTH = 64  # most characters of a signature
MIN_BLOCK = 4
COMMON = 5  # characters in a row that two signatures must share to be compared at all
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64((1 << 8 * WINDOW) - 1)


def _rolled(data: bytes) -> np.ndarray:
    """Hash of the last WINDOW bytes at every byte (zeros before the start)."""
    padded = np.frombuffer(bytes(WINDOW - 1) + data + b"\0", np.uint8)
    register = np.ndarray(len(data), "<u8", padded, strides=(1,)) & _MASK
    h = register * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _signature(h: np.ndarray, cuts: np.ndarray) -> bytes:
    """One symbol a chunk, from the sum of its rolled hashes; cuts are the chunks' last bytes."""
    starts = np.concatenate(([0], cuts + 1))
    starts = starts[starts < len(h)]
    if len(starts) > LENGTH:  # the rest is the last chunk
        starts = starts[:LENGTH]
    sums = np.add.reduceat(h, starts) * _MIX
    return SYMBOLS[(sums >> np.uint64(58)).astype(np.intp)].tobytes()


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block`` of whole ``data``; the empty text has ``4::``.

    A chunk ends where the rolling hash of the last 7 bytes is 0 modulo the block size. The block size starts at
    the power of two that would give at most 64 chunks and is halved while there are fewer than 32.
    """
    if not data:
        return f"{MIN_BLOCK}::"
    h = _rolled(data)
    block = MIN_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    low = h & np.uint64(block - 1)
    cuts = np.flatnonzero(low == 0)
    while len(cuts) < LENGTH // 2 - 1 and block > MIN_BLOCK:
        block //= 2
        cuts = np.flatnonzero((h & np.uint64(block - 1)) == 0)
    coarse = cuts[(h[cuts] & np.uint64(2 * block - 1)) == 0]
    return f"{block}:{_signature(h, cuts).decode()}:{_signature(h, coarse).decode()}"


def _packed(sigs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(sigs), LENGTH), np.uint8)
    for i, s in enumerate(sigs):
        out[i, : len(s)] = np.frombuffer(s.encode(), np.uint8)
    return out, np.array([len(s) for s in sigs], np.int64)


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    """1 - (insertions + deletions) / (both lengths) of each pair: a bit-parallel longest common subsequence over all pairs at once."""
    (x, nx), (y, ny) = _packed(a), _packed(b)
    same = x[:, :, None] == y[:, None, :]
    same &= (x != 0)[:, :, None] & (y != 0)[:, None, :]
    bits = np.packbits(same, axis=1, bitorder="little")  # (pairs, 8, 64): the places of x that match each place of y
    masks = np.ascontiguousarray(bits.transpose(0, 2, 1)).view("<u8")[:, :, 0]
    v = np.full(len(a), ~np.uint64(0))
    for j in range(LENGTH):
        u = v & masks[:, j]
        v = (v + u) | (v - u)
    lcs = np.bitwise_count(~v).astype(np.int64)
    run = same[:, : LENGTH - COMMON + 1, : LENGTH - COMMON + 1].copy()
    for k in range(1, COMMON):
        run &= same[:, k : LENGTH - COMMON + 1 + k, k : LENGTH - COMMON + 1 + k]
    linked = run.any(axis=(1, 2)) | (np.minimum(nx, ny) < COMMON)
    return np.where(linked, 2 * lcs / np.maximum(nx + ny, 1), 0.0)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness from 0 to 1 of fingerprint pairs.

    Signatures are compared where block sizes are equal (the better of both signatures) or differ by a factor of two
    (at the size they share), by edit distance with insertions and deletions; a run of 5 equal symbols must be
    shared, for chance likeness. Other pairs are 0, equal fingerprints 1; an empty text is like an empty one only.
    """
    out, jobs = np.zeros(len(pairs)), []
    for i, (p, q) in enumerate(pairs):
        if p == q:
            out[i] = 1.0
            continue
        (bp, p1, p2), (bq, q1, q2) = p.split(":"), q.split(":")
        bp, bq = int(bp), int(bq)
        if not p1 or not q1:
            continue
        if bp == bq:
            jobs += [(i, p1, q1), (i, p2, q2)]
        elif bp == 2 * bq:
            jobs.append((i, p1, q2))
        elif bq == 2 * bp:
            jobs.append((i, p2, q1))
    for k in range(0, len(jobs), 512):
        some = jobs[k : k + 512]
        np.maximum.at(out, [j[0] for j in some], _ratios([j[1] for j in some], [j[2] for j in some]))
    return out


def _cuts_up_to(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``key``: a binary search, whose expression is as small for ten thousand cuts as for ten."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # folded to a constant
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        up = (s["lo"] < s["hi"]) & (F.get(table, mid) <= key)
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, halve)["lo"]


def next_in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", pieces: int | None = None) -> DataFrame:
    """Rows (piece, key, text, h, ghost) so that in each piece, by descending key, every row is followed by its successor.

    The keys' range is cut at quantiles into pieces; the first row of each piece is also given, as a ghost, to the piece
    before it (and the very first row to the last piece), so neighbours meet with one shuffle of the texts. Null
    keys come last; rows of equal keys are ordered by their text's hash ``h``, by which null keys are cut into pieces, too.
    """
    spark = docs.sparkSession
    pieces = pieces or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")).withColumn("h", F.xxhash64("text"))
    cuts = slim.agg(F.percentile_approx("key", [i / pieces for i in range(1, pieces)], 20 * pieces).alias("q")).first()["q"] if pieces > 1 else []
    cuts = sorted(set(cuts or []))
    nulls = F.expr(f"((shiftright(h, 32) + {1 << 31}L) * {pieces}) div {1 << 32}L").cast("int")  # by equal ranges of the hash
    slim = slim.withColumn("piece", F.when(F.col("key").isNull(), len(cuts) + 1 + nulls).otherwise(len(cuts) - _cuts_up_to(F.col("key"), cuts)))
    heads = slim.groupBy("piece").agg(F.max(F.struct("key", F.bitwise_not("h").alias("nh"))).alias("head")).collect()  # a row per piece
    present = sorted(heads, key=lambda r: r["piece"])
    if not present:
        return slim.select("piece", "key", "text", "h", F.lit(False).alias("ghost"))
    before = {r["piece"]: present[i - 1]["piece"] for i, r in enumerate(present)}
    # equal rows may share a head's place: the reader takes the first ghost it meets
    lookup = spark.createDataFrame([(r["piece"], r["head"]["key"], ~r["head"]["nh"], before[r["piece"]]) for r in present], "hp int, hk long, hh long, to int")
    joined = slim.join(F.broadcast(lookup), (slim["piece"] == lookup["hp"]) & slim["key"].eqNullSafe(lookup["hk"]) & (slim["h"] == lookup["hh"]), "left")
    places = F.when(F.col("to").isNull(), F.array(F.struct(F.col("piece").alias("piece"), F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("piece").alias("piece"), F.lit(False).alias("ghost")), F.struct(F.col("to").alias("piece"), F.lit(True).alias("ghost")))
    )
    return joined.select(F.explode(places).alias("at"), "key", "text", "h").select("at.piece", "key", "text", "h", "at.ghost")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness.

    The edited text is the text with its last floor(n / 2) code points replaced by as many first ones (or all) of the
    next document by descending key; after the last comes the first, so a lone document is its own next. Null texts
    count as empty; null keys come last; repeated rows keep a row each; an empty table gives an empty result. A very long text is
    read whole, with its neighbour. Other columns are ignored, whatever their names.
    """
    placed = next_in_order(docs, key, text)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = placed.repartition(n, "piece").sortWithinPartitions("piece", "ghost", F.col("key").desc_nulls_last(), "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose successor comes next
        pairs: list[tuple] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            rows, likes = [], []
            for (k, t, fp), (nt, nfp) in pairs:
                half = len(t) // 2
                edited = (t[: len(t) - half] + nt[:half]).encode("utf-8", "surrogatepass")
                efp = fingerprint(edited)
                rows.append((k, len(t), hashlib.sha256(edited).hexdigest(), fp, efp))
                likes += [(fp, efp), (fp, nfp)]
            scores = likeness(likes)
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:]), pa.array(scores[::2]), pa.array(scores[1::2])],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for b in sliced(batches):
            for p, k, t, ghost in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                fp = fingerprint(t.encode("utf-8", "surrogatepass"))
                if held is not None and held[0] == p:
                    pairs.append((held[1:], (t, fp)))
                    chars += len(t)
                held = None if ghost else (p, k, t, fp)
                if chars > 4_000_000:
                    yield flush()
                    pairs, chars = [], 0
        if pairs:
            yield flush()

    return sorted_rows.mapInArrow(run, SCHEMA)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likeness to the edited text and to the next document."""
    return fingerprint_neighbours(read_table(spark, sf_dir, "documents"))
