"""Count tables on disk: Parquet with a metadata sidecar, and the fixed-record binary and text files other tools exchange."""

from __future__ import annotations

import getpass
import json
import os
import platform
import sys
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kmerspark.scratch import scratch_path

from .files import filesystem, list_files

# Fixed values of the exchange format.
BINARY, TEXT, BLOOM = "binary/sorted", "text/sorted", "bloomcounter"
HEADER_DIGITS, ALIGNMENT = 9, 8
RECORDS_PER_SPLIT = 2_000_000


def provenance() -> dict:
    """Where, when and by what a table was written; SOURCE_DATE_EPOCH fixes the time."""
    epoch = int(os.environ.get("SOURCE_DATE_EPOCH", time.time()))
    return {"hostname": platform.node(), "pwd": os.getcwd(), "user": getpass.getuser(), "time": time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(epoch)), "exe_path": sys.executable, "cmdline": sys.argv}


# --- Parquet


def write_database(counts: DataFrame, path: str, k: int, canonical: bool, mode: str = "errorifexists", **extra) -> None:
    """Parquet sorted by k-mer within files (compact, and prunable by range), and ``_kmers.json`` with k, canonical and provenance."""
    counts.select("kmer", "count").sortWithinPartitions("kmer").write.mode(mode).parquet(path)
    fs, place = filesystem(path)
    with fs.open_output_stream(f"{place}/_kmers.json") as f:
        f.write(json.dumps({"format": "parquet", "k": k, "key_len": 2 * k, "canonical": canonical, **extra, **provenance()}).encode())


def read_metadata(path: str) -> dict:
    fs, place = filesystem(path)
    with fs.open_input_file(f"{place}/_kmers.json") as f:
        return json.loads(f.read())


def read_database(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def database_size(path: str) -> int:
    """Bytes of the table itself."""
    return sum(size for _, size in list_files([path]))


def check_compatible(metas: list[dict]) -> tuple[int, bool]:
    """(k, canonical) that all tables to be merged share; else an error."""
    shared = {(m["k"] if "k" in m else m["key_len"] // 2, bool(m.get("canonical", False))) for m in metas}
    if len(shared) != 1:
        raise ValueError("the tables differ in k or in being canonical")
    return shared.pop()


# --- exchange files


def read_header(path: str) -> tuple[dict, int]:
    """(header, offset of the first record) of an exchange file: nine digits, JSON of that length, padded with zeros."""
    fs, place = filesystem(path)
    with fs.open_input_file(place) as f:
        digits = f.read(HEADER_DIGITS)
        if not digits.isdigit():
            raise ValueError(f"{path}: no header")
        body = f.read(int(digits)).rstrip(b"\0")
    return json.loads(body), HEADER_DIGITS + int(digits)


def header_bytes(header: dict) -> bytes:
    body = json.dumps(header, separators=(",", ":"), sort_keys=True).encode()
    body += b"\0" * (-(HEADER_DIGITS + len(body)) % ALIGNMENT)
    return f"{len(body):0{HEADER_DIGITS}d}".encode() + body


def decode_keys(raw: np.ndarray, k: int) -> np.ndarray:
    """Strings of keys given as rows of little-endian bytes, last base in the low bits."""
    out = np.empty((len(raw), k), np.uint8)
    for i in range(k):  # i-th base from the right
        out[:, k - 1 - i] = (raw[:, i // 4] >> (2 * (i % 4))) & 3
    return np.frombuffer(b"ACGT", np.uint8)[out].view(f"S{k}")[:, 0]


def encode_keys(kmers: list[str], k: int) -> np.ndarray:
    codes = np.zeros(256, np.uint8)
    codes[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    text = codes[np.frombuffer("".join(kmers).encode(), np.uint8)].reshape(len(kmers), k)
    out = np.zeros((len(kmers), -(-k // 4)), np.uint8)
    for i in range(k):
        out[:, i // 4] |= text[:, k - 1 - i] << np.uint8(2 * (i % 4))
    return out


class _Span(InputPartition):
    def __init__(self, path: str, offset: int, n: int, k: int, value: int) -> None:
        self.path, self.offset, self.n, self.k, self.value = path, offset, n, k, value


class _BinaryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.per_split = int(options.get("recordspersplit", RECORDS_PER_SPLIT))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in list_files(self.paths):
            header, offset = read_header(path)
            if header.get("format") != BINARY:
                raise ValueError(f"{path}: format {header.get('format')!r} is not {BINARY}")
            k, value = header["key_len"] // 2, header["counter_len"]
            record = -(-header["key_len"] // 8) + value
            n = (size - offset) // record
            out += [_Span(path, offset + i * record, min(self.per_split, n - i), k, value) for i in range(0, n, self.per_split)]
        return out

    def read(self, span: _Span) -> Iterator[pa.RecordBatch]:
        key = -(-span.k // 4)
        record = key + span.value
        fs, place = filesystem(span.path)
        with fs.open_input_file(place) as f:
            f.seek(span.offset)
            left = span.n
            while left:
                n = min(left, 100_000)
                raw = np.frombuffer(f.read(n * record), np.uint8).reshape(n, record)
                counts = np.zeros((n, 8), np.uint8)
                counts[:, : span.value] = raw[:, key:]
                yield pa.RecordBatch.from_arrays([pa.array(decode_keys(raw[:, :key], span.k).astype(str)), pa.array(counts.view("<i8")[:, 0])], names=["kmer", "count"])
                left -= n


class BinaryCounts(DataSource):
    """``spark.read.format("kmer_binary")``: records have one length, so files split anywhere."""

    @classmethod
    def name(cls) -> str:
        return "kmer_binary"

    def schema(self) -> str:
        return "kmer string, count long"

    def reader(self, schema) -> DataSourceReader:
        return _BinaryReader(dict(self.options))


def read_binary(spark: SparkSession, paths: str | list[str], records_per_split: int = RECORDS_PER_SPLIT) -> DataFrame:
    spark.dataSource.register(BinaryCounts)
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("kmer_binary").option("paths", ",".join(paths)).option("recordsPerSplit", str(records_per_split)).load()


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text exchange file: a header, then ``kmer count`` lines; the header's line ends in the first record."""
    header, _ = read_header(list_files([path])[0][0])
    if header.get("format") != TEXT:
        raise ValueError(f"{path}: format {header.get('format')!r} is not {TEXT}")
    k = header["key_len"] // 2
    lines = spark.read.text(path).select(F.regexp_extract("value", f"([ACGT]{{{k}}}) ([0-9]+)$", 1).alias("kmer"), F.regexp_extract("value", f"([ACGT]{{{k}}}) ([0-9]+)$", 2).alias("c"))
    return lines.filter("kmer != ''").select("kmer", F.col("c").cast("long").alias("count"))


def _in_exchange_order(counts: DataFrame, k: int, canonical: bool, text: bool, counter_len: int) -> tuple[DataFrame, dict]:
    """(rows of encoded bytes in the order of an identity matrix: low bits of the key, then the key; the header)."""
    from kmerspark.operators.count import saturate

    parts = scratch_path(counts.sparkSession, "exchange")
    counts.select("kmer", "count").write.parquet(parts)  # computed once: for the size, the sort's sample and the sort
    counts = counts.sparkSession.read.parquet(parts)
    n = counts.count()
    lsize = max(int(n * 5 / 4).bit_length(), 4)
    bits = min(lsize, 2 * k)
    low = F.expr(f"right(kmer, {-(-bits // 2)})")
    if bits % 2:  # an odd number of bits: the leading base counts by its low bit only
        low = F.concat(F.translate(F.substring(low, 1, 1), "GT", "AC"), F.expr(f"substring(right(kmer, {-(-bits // 2)}), 2)"))
    ordered = (counts if text else saturate(counts, counter_len)).select("kmer", "count", low.alias("_pos")).orderBy("_pos", "kmer").select("kmer", "count", F.spark_partition_id().alias("pid"))
    header = {"format": TEXT if text else BINARY, "key_len": 2 * k, "canonical": canonical, "size": 1 << bits, "val_len": 7, "max_reprobe": 0, "reprobes": [0], "matrix1": {"r": bits, "c": 2 * k, "identity": True}, **provenance()}
    if not text:
        header["counter_len"] = counter_len

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            mers, values = b.column(0).to_pylist(), b.column(1).to_numpy()
            if text:
                data = "".join(f"{m} {c}\n" for m, c in zip(mers, values, strict=True)).encode()
            else:
                data = np.hstack([encode_keys(mers, k), values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :counter_len]]).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(2).slice(0, 1), pa.array([data], pa.binary())], names=["pid", "data"])

    return ordered.mapInArrow(encode, "pid int, data binary"), header


def write_exchange(counts: DataFrame, path: str, k: int, canonical: bool = False, text: bool = False, counter_len: int = 4) -> None:
    """One exchange file. The sort and the encoding are distributed; the parts' bytes pass through the driver one after another."""
    rows, header = _in_exchange_order(counts, k, canonical, text, counter_len)
    fs, place = filesystem(path)
    with fs.open_output_stream(place) as f:
        f.write(header_bytes(header))
        for row in rows.toLocalIterator():
            f.write(row["data"])


def write_exchange_parts(counts: DataFrame, folder: str, k: int, canonical: bool = False, text: bool = False, counter_len: int = 4) -> int:
    """A folder of exchange files, each a range of the order with a header of its own, written by the tasks; returns their number.

    A task that runs again writes a file of another name; the driver gives the files that count their names, and removes others.
    """
    rows, header = _in_exchange_order(counts, k, canonical, text, counter_len)
    fs, place = filesystem(folder)
    fs.create_dir(place, recursive=True)
    head = header_bytes(header)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where, f, pid, name = *filesystem(folder), None, 0, f"_part-{uuid.uuid4().hex}"
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if f is None:
                    f, pid = store.open_output_stream(f"{where}/{name}"), p
                    f.write(head)
                f.write(data)
        if f is not None:
            f.close()
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([name])], names=["pid", "name"])

    files = sorted(tuple(r) for r in rows.mapInArrow(put, "pid int, name string").collect())  # a row a file
    for i, (_, name) in enumerate(files):
        fs.move(f"{place}/{name}", f"{place}/part-{i:05d}")
    for info in fs.get_file_info(pafs.FileSelector(place)):
        if info.base_name.startswith("_part-"):
            fs.delete_file(info.path)
    return len(files)


def pack_cells(cells: np.ndarray) -> np.ndarray:
    """Five cells (0 to 2) a byte, in base 3, lowest first."""
    padded = np.zeros(-(-len(cells) // 5) * 5, np.uint8)
    padded[: len(cells)] = cells
    return (padded.reshape(-1, 5) @ np.array([1, 3, 9, 27, 81])).astype(np.uint8)


def unpack_cells(raw: np.ndarray, n: int) -> np.ndarray:
    return ((raw[:, None] // np.array([1, 3, 9, 27, 81])) % 3).astype(np.uint8).ravel()[:n]


# --- text outputs


def dump_fasta(counts: DataFrame, lower: int | None = None, upper: int | None = None) -> DataFrame:
    """Column ``value``: the count as a header line, the k-mer below; write it with ``.write.text``."""
    from kmerspark.operators.count import bounded

    return bounded(counts, lower, upper).select(F.concat(F.lit(">"), F.col("count").cast("string"), F.lit("\n"), "kmer").alias("value"))


def dump_columns(counts: DataFrame, tab: bool = False, lower: int | None = None, upper: int | None = None) -> DataFrame:
    from kmerspark.operators.count import bounded

    return bounded(counts, lower, upper).select(F.concat("kmer", F.lit("\t" if tab else " "), F.col("count").cast("string")).alias("value"))
