"""Bloom counters and Bloom filters over k-mers, in blocks of cells that are built, stored and asked one by one.

A counter holds classes 0, 1 and 2 or more: never one too low, and one too high at the false-positive rate. A k-mer has
``hashes`` cells by double hashing. No task and no driver holds more than a block of cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerspark.functions.gf2 import BinaryMatrix
from kmerspark.functions.helpers import bloom_size
from kmerspark.sources.database import BLOOM, encode_keys, header_bytes, pack_cells, provenance, read_header, unpack_cells
from kmerspark.sources.files import filesystem

#: Cells of a block; five of them share a byte in a file, so blocks end at bytes.
BLOCK = 5 * 1_311
#: Two matrices hash a key to so many bits.
HASH_BITS = 64


class Counter:
    """Shape of a counter: k, cells, hashes, and the two matrices that hash a k-mer."""

    def __init__(self, k: int, cells: int, hashes: int, matrices: tuple[BinaryMatrix, BinaryMatrix], canonical: bool = False) -> None:
        self.k, self.cells, self.hashes, self.matrices, self.canonical = k, max(cells, 1), max(hashes, 1), matrices, canonical

    @classmethod
    def sized(cls, k: int, n: int, fpr: float = 0.001, canonical: bool = False, seed: int = 1) -> Counter:
        """For ``n`` expected k-mers at a false-positive rate."""
        cells, hashes = bloom_size(n, fpr)
        return cls(k, cells, hashes, (BinaryMatrix.chance(HASH_BITS, 2 * k, seed), BinaryMatrix.chance(HASH_BITS, 2 * k, seed + 1)), canonical)

    @classmethod
    def of_header(cls, header: dict) -> Counter:
        return cls(header["key_len"] // 2, header["size"], header["nb_hashes"], (BinaryMatrix.of_header(header, 1), BinaryMatrix.of_header(header, 2)), bool(header.get("canonical", False)))

    def header(self) -> dict:
        return {"format": BLOOM, "key_len": 2 * self.k, "canonical": self.canonical, "size": self.cells, "nb_hashes": self.hashes, "matrix1": self.matrices[0].header(), "matrix2": self.matrices[1].header(), **provenance()}

    def places(self, kmers: list[str]) -> np.ndarray:
        """Cells of each k-mer: (h0 + i * h1) modulo their number."""
        keys = encode_keys(kmers, self.k)
        a, b = (m.products(keys) % np.uint64(self.cells) for m in self.matrices)
        return ((a[:, None] + np.arange(self.hashes, dtype=np.uint64) * b[:, None]) % np.uint64(self.cells)).astype(np.int64)


def _blocks(n: int) -> int:
    return -(-n // BLOCK)


def bloom_counter(counts: DataFrame, shape: Counter) -> DataFrame:
    """(block, cells) of the counter after all k-mers of ``counts`` were inserted as often as they occur; empty blocks have no row.

    Hits of a cell are added up by batch, saturating at 2, before they are shuffled to their block.
    """

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = shape.places(b.column(0).to_pylist())
            n = np.minimum(b.column(1).to_numpy(), 2)
            # a k-mer whose cells coincide hits them once for each
            cells, where = np.unique(at, return_inverse=True)
            hits = np.minimum(np.bincount(where.ravel(), np.repeat(n, shape.hashes), len(cells)), 2).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(cells // BLOCK), pa.array((cells % BLOCK).astype(np.int32)), pa.array(hits)], names=["block", "at", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = None, np.zeros(BLOCK, np.uint8)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([cells.tobytes()], pa.binary())], names=["block", "cells"])
        for b in batches:
            blocks, at, n = (c.to_numpy() for c in b.columns)
            for i, j in _stretches(blocks):
                if blocks[i] != held:
                    if held is not None:
                        yield done()
                    held, cells = int(blocks[i]), np.zeros(BLOCK, np.uint8)
                cells = np.minimum(cells + np.minimum(np.bincount(at[i:j], n[i:j], BLOCK), 2), 2).astype(np.uint8)
        if held is not None:
            yield done()

    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = counts.select("kmer", F.col("count").cast("long")).mapInArrow(hit, "block long, at int, n byte")
    return hits.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(build, "block long, cells binary")


def _stretches(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """[start, end) of each run of equal keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True) if len(keys) else ()


def classes(mers: DataFrame, sketch: DataFrame, shape: Counter) -> DataFrame:
    """(kmer, seen) of the distinct k-mers of ``mers``: the least of their cells, which are looked up block by block."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = shape.places(b.column(0).to_pylist())
                rows = pa.array(np.repeat(np.arange(b.num_rows), shape.hashes))
                flat = at.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(flat // BLOCK), pa.array((flat % BLOCK).astype(np.int32)), b.column(0).take(rows), pa.nulls(len(flat), pa.binary())], names=["block", "at", "kmer", "cells"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = None, None
        for b in batches:
            blocks, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            keep, seen = at >= 0, np.zeros(len(at), np.int32)
            for i, j in _stretches(blocks):
                if blocks[i] != held:
                    held, cells = int(blocks[i]), None
                if at[i] < 0:
                    cells = np.frombuffer(b.column(3)[i].as_py(), np.uint8)
                if cells is not None:
                    seen[i:j] = cells[np.maximum(at[i:j], 0)]
            yield pa.RecordBatch.from_arrays([b.column(2).filter(pa.array(keep)), pa.array(seen[keep])], names=["kmer", "seen"])

    parts = int(mers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = mers.select("kmer").distinct().mapInArrow(ask, "block long, at int, kmer string, cells binary")
    stored = sketch.select("block", F.lit(-1).alias("at"), F.lit(None).cast("string").alias("kmer"), "cells")
    both = asked.unionByName(stored).repartition(parts, "block").sortWithinPartitions("block", "at")  # a block, then who asks it
    return both.mapInArrow(answer, "kmer string, seen int").groupBy("kmer").agg(F.min("seen").alias("seen"))


def check(mers: DataFrame, sketch: DataFrame, shape: Counter) -> DataFrame:
    """``mers`` with ``seen``: the class that the counter has for the k-mer."""
    return mers.join(classes(mers, sketch, shape), "kmer", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))


def sketch_filter(counts: DataFrame, sketch: DataFrame, shape: Counter) -> DataFrame:
    """Counts of k-mers that a first pass's counter has as 2 or more; singletons may stay at the false-positive rate."""
    kept = classes(counts, sketch, shape).filter("seen >= 2").select("kmer")
    return counts.join(kept, "kmer", "left_semi")


# --- counter files


def write_counter(sketch: DataFrame, path: str, shape: Counter) -> None:
    """One file of all cells, which other tools read; blocks pass through the driver one after another."""
    held = sketch if sketch.is_cached else sketch.select("*").persist()  # a sort takes its input twice, and building it is the work
    try:
        _write_blocks(held, path, shape)
    finally:
        if held is not sketch:
            held.unpersist()


def _write_blocks(sketch: DataFrame, path: str, shape: Counter) -> None:
    empty, n = pack_cells(np.zeros(BLOCK, np.uint8)).tobytes(), _blocks(shape.cells)
    fs, place = filesystem(path)
    with fs.open_output_stream(place) as f:
        f.write(header_bytes(shape.header()))
        at, left = 0, -(-shape.cells // 5)

        def put(data: bytes) -> None:
            nonlocal left
            f.write(data[:left])
            left -= len(data[:left])

        for row in sketch.orderBy("block").toLocalIterator():
            for _ in range(at, row["block"]):
                put(empty)
            put(pack_cells(np.frombuffer(row["cells"], np.uint8)).tobytes())
            at = row["block"] + 1
        for _ in range(at, n):
            put(empty)


def read_counter(spark: SparkSession, path: str) -> tuple[DataFrame, Counter]:
    """(block, cells) and shape of a counter file; each task reads its own ranges of the file."""
    header, offset = read_header(path)
    if header.get("format") != BLOOM:
        raise ValueError(f"{path}: format {header.get('format')!r} is not {BLOOM}")
    if "matrix1" not in header:
        raise ValueError(f"{path}: no matrices")
    shape = Counter.of_header(header)
    fs, place = filesystem(path)
    if fs.get_file_info(place).size < offset + -(-shape.cells // 5):
        raise ValueError(f"{path}: cut off")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(path)
        with store.open_input_file(at) as f:
            for b in batches:
                for i in b.column(0).to_pylist():
                    f.seek(offset + i * (BLOCK // 5))
                    n = min(BLOCK, shape.cells - i * BLOCK)
                    cells = np.zeros(BLOCK, np.uint8)
                    cells[:n] = unpack_cells(np.frombuffer(f.read(-(-n // 5)), np.uint8), n)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([cells.tobytes()], pa.binary())], names=["block", "cells"])

    return spark.range(_blocks(shape.cells)).mapInArrow(read, "block long, cells binary"), shape
