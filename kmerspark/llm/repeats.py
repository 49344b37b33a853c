"""Exact removal of repeated passages by merging the Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, read_table, sliced, text_or_empty
from .suffixes import Transform, merged_transforms
from .tokens import _filesystem

LENGTH = 100  # bytes of a repeated string
GRAM = 40  # bytes of an anchor
#: Documents of a unit, the piece of the input whose findings lie together, in the order of its rows; small, so that folders get equal shares.
UNIT = 2_048
#: Bytes worked on at once, so that the arrays stay in a core's cache; bytes of snippets merged at once, and of a shard of them.
PIECE, BUCKET, SHARD = 1 << 18, 1 << 20, 1 << 18
#: Variants of an anchor that are merged in one piece of memory; beyond, each window is a string of its own, named by its hash.
MAX_VARIANTS = 10_000
#: In place of the anchor's offset: a run whose snippet comes earlier in the same text.
LATER = 255
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(4)
def _power_table(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _powers(base: int, n: int) -> np.ndarray:
    return _power_table(base, 1 << n.bit_length())[:n]


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of every ``k`` bytes, from windows of doubled size."""
    cur, size, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    out, have, rest = None, 0, k
    while True:
        if rest & 1:
            if out is None:
                out, have = cur, size
            else:
                n = len(data) - have - size + 1
                out = out[:n] * np.uint64(power) + cur[have : have + n]
                have += size
        rest >>= 1
        if not rest:
            break
        n = len(cur) - size
        cur, size, power = cur[:n] * np.uint64(power) + cur[size : size + n], 2 * size, power * power % (1 << 64)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least hash (its upper half) in every ``w`` in a row, the leftmost of equal ones."""
    cur, size = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    out, have, rest = None, 0, w
    while True:
        if rest & 1:
            if out is None:
                out, have = cur, size
            else:
                n = len(h) - have - size + 1
                out = np.minimum(out[:n], cur[have : have + n])
                have += size
        rest >>= 1
        if not rest:
            return (out & np.uint64(0xFFFFFFFF)).astype(np.int64)
        n = len(cur) - size
        cur, size = np.minimum(cur[:n], cur[size : size + n]), 2 * size


def runs_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows by their anchor: (text, start, windows, place of the anchor after the start, anchor hash, snippet hash).

    A window of ``length`` bytes has as its anchor the least-hashed gram in it, so equal windows have equal anchors at equal
    places. The windows of one anchor are consecutive; the snippet of a run is the bytes that its windows cover.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = _grams(data, gram)
    anchor = _least(h, length - gram + 1)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= ends[owner]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
    cut = np.flatnonzero(new & inside)
    breaks = np.flatnonzero(np.concatenate((new[1:] | ~inside[1:], [True])) & inside)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * _powers(_BASE, len(data)), dtype=np.uint64)))
    stop = breaks + length
    snippet = (sums[stop] - sums[cut]) * _powers(_INVERSE, len(data) + 1)[cut]
    offset, windows = anchor[cut] - cut, breaks - cut + 1
    snippet ^= (offset.astype(np.uint64) << np.uint64(32)) | windows.astype(np.uint64)
    snippet *= np.uint64(0x94D049BB133111EB)
    begin = np.concatenate(([0], ends))[owner[cut]]
    return owner[cut], cut - begin, windows, offset, h[anchor[cut]].view(np.int64), snippet.view(np.int64)


def first_in_text(t: np.ndarray, g: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which runs are the first of their text with their anchor and snippet."""
    keys = (g.view(np.uint64) * np.uint64(_BASE) ^ v.view(np.uint64)) * np.uint64(_INVERSE) + t.astype(np.uint64)
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def _pieces(batch: pa.RecordBatch, column: int, most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of about ``most`` bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(batch.column(column).to_pylist()):
        held.append(t)
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _shards(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[list[Transform], np.ndarray]:
    """Transforms of shards of about SHARD bytes of whole strings, and the number of each shard's first string."""
    firsts, at = [0], 0
    for i in np.flatnonzero(np.diff(ends // SHARD)).tolist():
        firsts.append(i + 1)
    out = []
    for i, j in zip(firsts, [*firsts[1:], len(ends)], strict=True):
        out.append(Transform(data[at : ends[j - 1]], ends[i:j] - at, length))
        at = int(ends[j - 1])
    return out, np.array(firsts)


def owned_ranges(doc: np.ndarray, start: np.ndarray, data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Ranges of windows whose string starts earlier in another snippet: (snippet, first window, last window).

    Snippets are given by the rank of their document, their start in it, and their bytes (``data`` cut at ``ends``).
    """
    shards, firsts = _shards(data, ends, length)
    shard, string, into, new = merged_transforms(shards, length)
    which = firsts[shard] + string
    keys = doc[which] << 32 | start[which] + into
    blocks = np.flatnonzero(new)
    least = np.minimum.reduceat(keys, blocks) if len(keys) else keys
    later = keys != np.repeat(least, np.diff(np.append(blocks, len(keys))))
    begins = ends - np.diff(ends, prepend=0)
    flags = np.zeros(len(data) + 1, np.int8)  # a snippet's last bytes begin no window, so runs don't cross snippets
    flags[(begins[which] + into)[later]] = 1
    change = np.diff(flags, prepend=0)
    a, b = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    owner = np.searchsorted(ends, a, side="right")
    return owner, a - begins[owner], b - 1 - begins[owner]


class _Side:
    """Findings beside the input: rows (unit, row, ...) in files sorted by both, read forward, a stretch at a time."""

    def __init__(self, folder: str, parts: int) -> None:
        self.folder, self.parts, self.unit, self.at, self.files = folder, parts, None, 0, []

    def _open(self, unit: int, row: int) -> None:
        import pyarrow.dataset as ds

        fs, path = _filesystem(f"{self.folder}/slot={unit % self.parts}")
        self.files = []
        if fs.get_file_info(path).type.name == "Directory":
            for f in ds.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=False).get_fragments():
                wanted = (ds.field("unit") == unit) & (ds.field("row") >= row)
                batches = f.to_batches(filter=wanted, batch_size=8192, use_threads=False, batch_readahead=0, fragment_readahead=0)
                self.files.append([batches, None, 0])
        self.unit = unit

    def rows(self, unit: int, row: int) -> list[tuple]:
        """The findings (...) of one row; rows of a unit are asked for in ascending order, or it is opened again."""
        if unit != self.unit or row <= self.at:
            self._open(unit, row)
        self.at, out = row, []
        for f in self.files:
            while True:
                if f[1] is None:
                    b = next(f[0], None)
                    if b is None:
                        break
                    f[1], f[2] = (b.column("row").to_numpy(), b.drop_columns(["unit", "row"])), 0
                places, rest = f[1]
                i, j = np.searchsorted(places, (row, row + 1))
                if j > i:
                    out += zip(*(c.to_pylist() for c in rest.slice(i, j - i).columns), strict=True)
                if j < len(places):
                    break
                f[1] = None
        return out


def _by_unit(df: DataFrame, name: str) -> tuple[str, int]:
    """Write rows (unit, row, ...) sorted by both, the rows of a unit in one folder of several; returns the folders' parent and their number."""
    spark = df.sparkSession
    path, n = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("slot", F.pmod("unit", F.lit(n))).repartition(n, "slot").sortWithinPartitions("slot", "unit", "row")
    rows.write.option("parquet.block.size", 1 << 22).partitionBy("slot").parquet(path)
    return path, n


def placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, raw, unit, row): rows named by their place in the files they are read from; frames that have none are written first."""
    slim = (F.col(key).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("raw"))
    place = (F.xxhash64(F.col("_metadata.file_path"), F.expr(f"_metadata.row_index div {UNIT}")).alias("unit"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select(*slim, *place)
    except AnalysisException:
        return materialize(docs.select(*slim), "repeats-docs").select("doc_id", "raw", *place)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, texts: bool = True) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, and (``texts``) what is kept and the removed spans.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a document of smaller doc_id (nulls first,
    ties in a fixed order of their places in the input), or earlier in the same one. Strings are judged on the input and don't cross documents.

    1. Each window is named by its anchor; windows whose anchor is nowhere else can't repeat. Anchors are counted in a pass
       of their own, combined before the shuffle, so that a common one is a sum and not a pile of rows.
    2. Equal snippets of an anchor are one variant, with its first place. A document's later runs of a variant are lost
       at once.
    3. The variants of anchors with more than one are merged: Burrows-Wheeler transforms by shard, interleaved by refinement
       (see :mod:`suffixes`). Repeated intervals of ``length`` bytes give each window its first place. An anchor of
       over MAX_VARIANTS variants has its windows named by a 128-bit hash instead: the first place of each is a minimum,
       taken in part before the shuffle, and joined to the others, so no task holds a group.
    4. All of a variant's places but the first lose all windows; the first loses those that start earlier elsewhere.

    Texts are never shuffled: findings are written by input unit, in the order of its rows, and read back beside the texts,
    a stretch at a time, so very long texts with many findings need no more memory than one text and its own. Null and empty texts,
    and those under ``length`` bytes, lose nothing (kept text: with undecodable cut characters replaced). Repeated rows
    lose all but the first. An empty table gives an empty result. Other columns are ignored, whatever their names.
    ``length`` is over GRAM and at most GRAM + 194 (a run's windows and its anchor's place are kept in 8 bits).

    Equal snippets are told by 64-bit hashes, and only compared where their anchors have equal hashes, so a chance
    collision needs two different variants of one anchor: v variants of an anchor bring it with a chance of v * v / 2 ** 65.
    """
    if not GRAM < length <= GRAM + 194:
        raise ValueError(f"length must be over {GRAM} and at most {GRAM + 194}")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = placed(docs, key, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for _, some in _pieces(b, 0):
                t, _, _, _, anchor, snippet = runs_of(some, length)
                g, many = np.unique(anchor[first_in_text(t, anchor, snippet)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(many)], names=["g", "many"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids, units, places = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            for first, some in _pieces(b, 1):
                t, start, windows, offset, anchor, snippet = runs_of(some, length)
                later = ~first_in_text(t, anchor, snippet)
                anchor[later] ^= start[later] * np.int64(0x9E3779B97F4A7C1)  # they wait for no other row: spread them
                offset[later] = LATER
                t = t + first
                pack = (start << 16 | windows << 8 | offset).astype(np.int64)
                doc = np.where(null[t], -(1 << 63), ids[t]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, snippet, doc, units[t].astype(np.int64), places[t].astype(np.int64), pack)], names=["g", "v", "doc", "unit", "row", "pack"])

    shared = rows.select("raw").mapInArrow(count, "g long, many long").groupBy("g").agg(F.sum("many").alias("many")).filter("many > 1").select(F.col("g").alias("again"))
    shared = materialize(shared, "repeats-anchors")
    found = rows.mapInArrow(find, "g long, v long, doc long, unit long, row long, pack long")
    is_later = F.col("pack").bitwiseAND(F.lit(255)) == LATER
    found = found.join(shared, found["g"] == shared["again"], "left").filter(F.col("again").isNotNull() | is_later).drop("again")
    found = materialize(found, "repeats-places")
    places = found.filter(~is_later)
    variants = places.groupBy("g", "v").agg(F.min(F.struct("doc", "unit", "row", "pack")).alias("first"))
    variants = materialize(variants.select("g", "v", "first.*"), "repeats-variants")
    several = materialize(variants.groupBy("g").count().filter("count > 1").select("g", (F.col("count") > MAX_VARIANTS).alias("hot")), "repeats-several")
    side = _by_unit(variants.join(several, "g").select("unit", "row", "g", "v", "pack", "hot"), "repeats-wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Side(*side)
        for b in sliced(batches):
            out = []
            for doc, raw, unit, row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for g, v, pack, hot in wanted.rows(unit, row):
                    if not hot:
                        s, windows = pack >> 16, pack >> 8 & 255
                        out.append((g, v, -(1 << 63) if doc is None else doc, unit, row, s, raw[s : s + windows + length - 1]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names=["g", "v", "doc", "unit", "row", "start", "bytes"])

    def cut_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Side(*side)
        for b in sliced(batches):
            out = []
            for doc, raw, unit, row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for g, v, pack, hot in wanted.rows(unit, row):
                    s = pack >> 16
                    for i in range(pack >> 8 & 255) if hot else ():
                        name = hashlib.blake2b(raw[s + i : s + i + length], digest_size=16).digest()
                        out.append((name, g, v, -(1 << 63) if doc is None else doc, unit, row, s + i))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["name", "g", "v", "doc", "unit", "row", "start"])

    snippets = rows.mapInArrow(cut, "g long, v long, doc long, unit long, row long, start long, bytes binary")
    snippets = snippets.repartition(n, "g").sortWithinPartitions("g")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "v", "ranges"]

        def result(t: pa.Table) -> pa.RecordBatch:
            g, v, doc, unit, row, start = (t.column(i).to_numpy() for i in range(6))
            new = np.lexsort((row, unit, doc))
            rank = np.empty(len(new), np.int64)
            rank[new] = np.cumsum(np.concatenate(([False], (np.diff(doc[new]) != 0) | (np.diff(unit[new]) != 0) | (np.diff(row[new]) != 0))))
            raw = t.column(6).combine_chunks()
            raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
            sizes = pc.binary_length(raw).to_numpy().astype(np.int64)
            data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
            owner, a, b = owned_ranges(rank, start, data, np.cumsum(sizes), length)
            heads, counts = np.unique(owner, return_counts=True)
            ranges = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(2 * counts))), pa.int32()), pa.array(np.stack((a, b), axis=1).ravel(), pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(g[heads]), pa.array(v[heads]), ranges], names=names)

        held, size = [], 0
        for batch in batches:
            for b in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                held.append(b)
                size += b.column(6).nbytes
                if size >= BUCKET:
                    t = pa.Table.from_batches(held)
                    last = int(np.searchsorted(t.column(0).to_numpy(), b.column(0)[-1].as_py()))  # the last anchor may go on
                    if last:
                        yield result(t.slice(0, last))
                        t = t.slice(last)
                    held, size = t.to_batches(), t.column(6).nbytes
        if held:
            yield result(pa.Table.from_batches(held))

    losses = materialize(snippets.mapInArrow(merge, "g long, v long, ranges array<int>"), "repeats-losses")

    # the first place of a variant loses its ranges, all others lose every window
    start, windows = F.shiftright("pack", 16), F.shiftright("pack", 8).bitwiseAND(F.lit(255))
    firsts = variants.join(losses, ["g", "v"]).select("unit", "row", start.alias("s"), F.col("ranges"))
    spread = F.transform(F.sequence(F.lit(0), F.expr("size(ranges) div 2 - 1").cast("int")), lambda i: F.struct((F.col("s") + F.element_at("ranges", (2 * i + 1).cast("int"))).alias("a"), (F.col("s") + F.element_at("ranges", (2 * i + 2).cast("int")) + length).alias("b")))
    lost = firsts.select("unit", "row", F.explode(spread).alias("x")).select("unit", "row", "x.a", "x.b")
    heads = variants.select("g", "v", F.col("unit").alias("fu"), F.col("row").alias("fr"), F.col("pack").alias("fp"))
    rest = places.join(heads, ["g", "v"]).filter("NOT (unit = fu AND row = fr AND pack = fp)").select("unit", "row", start.alias("a"), (start + windows + (length - 1)).alias("b"))
    again = found.filter(is_later).select("unit", "row", start.alias("a"), (start + windows + (length - 1)).alias("b"))
    spans = lost.unionByName(rest).unionByName(again)
    if several.filter("hot").limit(1).count():
        hot = materialize(rows.mapInArrow(cut_hot, "name binary, g long, v long, doc long, unit long, row long, start long"), "repeats-windows")
        heads = hot.groupBy("name").agg(F.min(F.struct("doc", "unit", "row", "start")).alias("head"), F.count(F.lit(1)).alias("many"))
        heads = materialize(heads.filter("many > 1").select("name", "head"), "repeats-heads")
        later = hot.join(heads, "name").filter(F.struct("doc", "unit", "row", "start") != F.col("head"))
        each = Window.partitionBy("g", "v").orderBy("start")  # the windows of one run, under 256
        later = later.withColumn("island", F.col("start") - F.row_number().over(each)).groupBy("g", "v", "unit", "row", "island")
        later = later.agg(F.min("start").alias("a"), (F.max("start") + length).alias("b"))
        spans = spans.unionByName(later.select("unit", "row", "a", "b"))
    spans = _by_unit(spans, "repeats-spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findings = _Side(*spans)
        for b in sliced(batches):
            out = []
            for doc, raw, unit, row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                gone: list[list[int]] = []
                for a, e in sorted(findings.rows(unit, row)):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], e)
                    else:
                        gone.append([a, e])
                kept, at = [], 0
                for a, e in gone:
                    kept.append(raw[at:a])
                    at = e
                kept.append(raw[at:])
                kept = b"".join(kept)
                out.append((doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None, [{"start": a, "end": e} for a, e in gone] if texts else None))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    result = rows.mapInArrow(clean, SCHEMA)
    return result if texts else result.drop("kept", "spans")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what they lose to repeated strings of 100 bytes."""
    return remove_repeats(read_table(spark, sf_dir, "documents"), texts=False)
