"""FASTA, FASTQ, SAM and BAM as DataFrames of (path, record_id, header, seq, qual)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import filesystem, list_files, open_stream

SCHEMA = "path string, record_id long, header string, seq string, qual string"
_ARROW = pa.schema([("path", pa.string()), ("record_id", pa.int64()), ("header", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
BATCH_CHARS = 8_000_000
#: Bytes of a plain four-line FASTQ file that are one task.
SPLIT_BYTES = 64 << 20


class SequenceFormatError(ValueError):
    pass


def _lines(stream) -> Iterator[str]:
    rest = ""
    while block := stream.read(1 << 20):
        lines = (rest + block.decode("latin-1")).split("\n")
        rest = lines.pop()
        yield from (x.rstrip("\r") for x in lines) if b"\r" in block else lines
    if rest:
        yield rest.rstrip("\r")


def parse_fasta(stream) -> Iterator[tuple[str, str, None]]:
    """(header, sequence, None): sequence lines joined, blank lines ignored, > a header only at the start of a line."""
    header, parts = None, []
    for line in _lines(stream):
        if line.startswith(">"):
            if header is not None:
                yield header, "".join(parts), None
            header, parts = line[1:], []
        elif header is None:
            if line:
                raise SequenceFormatError("a FASTA file must start with >")
        else:
            parts.append(line)
    if header is not None:
        yield header, "".join(parts), None


def parse_fastq(stream) -> Iterator[tuple[str, str, str]]:
    """(header, sequence, qualities), both of which may be wrapped; as many qualities as bases are read."""
    lines = _lines(stream)
    line = next(lines, None)
    while line is not None:
        if not line:
            line = next(lines, None)
            continue
        if not line.startswith("@"):
            raise SequenceFormatError("a FASTQ record must start with @")
        header, parts = line[1:], []
        for line in lines:
            if line.startswith("+"):
                break
            parts.append(line)
        else:
            raise SequenceFormatError("a FASTQ record is cut off")
        seq, quals, have = "".join(parts), [], 0
        while have < len(seq):
            line = next(lines, None)
            if line is None:
                raise SequenceFormatError("a FASTQ record is cut off")
            quals.append(line)
            have += len(line)
        if have != len(seq):
            raise SequenceFormatError("a FASTQ record has another number of qualities than bases")
        yield header, seq, "".join(quals)
        line = next(lines, None)
        if line is not None and not seq and not line:
            line = next(lines, None)


def parse_sam(stream) -> Iterator[tuple[str, str, str]]:
    """(name, sequence, qualities) of every alignment line; * is an empty sequence, or no qualities (null)."""
    for line in _lines(stream):
        if line and not line.startswith("@"):
            f = line.split("\t")
            if len(f) < 11:
                raise SequenceFormatError("a SAM line has fewer than 11 fields")
            seq = "" if f[9] == "*" else f[9]
            yield f[0], seq, _absent(len(seq)) if f[10] == "*" and len(seq) != 1 else f[10]


def _absent(n: int) -> str:
    """Absent qualities are below every threshold: stored as 255, they wrap around to the blank."""
    return " " * n


_BAM_BASES = [a + b for a in "=ACMGRSVTWYHKDBN" for b in "=ACMGRSVTWYHKDBN"]


def parse_bam(stream) -> Iterator[tuple[str, str, str]]:
    """Every record of an unpacked BAM stream; codes of no single base become N."""
    read = stream.read
    if read(4) != b"BAM\1":
        raise SequenceFormatError("not a BAM file")
    read(struct.unpack("<i", read(4))[0])
    for _ in range(struct.unpack("<i", read(4))[0]):
        read(struct.unpack("<i", read(4))[0] + 4)
    to_n = str.maketrans("=MRSVWYHKDB", "N" * 11)
    while True:
        size = read(4)
        if not size:
            return
        if len(size) < 4:
            raise SequenceFormatError("a BAM record is cut off")
        body = read(struct.unpack("<i", size)[0])
        if len(body) < max(32, struct.unpack("<i", size)[0]):
            raise SequenceFormatError("a BAM record is cut off")
        l_name, n_cigar, l_seq = body[8], struct.unpack_from("<H", body, 12)[0], struct.unpack_from("<i", body, 16)[0]
        at = 32 + l_name + 4 * n_cigar
        seq = "".join(map(_BAM_BASES.__getitem__, body[at : at + (l_seq + 1) // 2]))[:l_seq].translate(to_n)
        q = body[at + (l_seq + 1) // 2 : at + (l_seq + 1) // 2 + l_seq]
        yield body[32 : 32 + l_name - 1].decode("latin-1"), seq, bytes((x + 33) & 255 for x in q).decode("latin-1")


PARSERS = {"fasta": parse_fasta, "fastq": parse_fastq, "sam": parse_sam, "bam": parse_bam}


def sniff(stream) -> str | None:
    """Format by the first byte: > FASTA, @ FASTQ; None for an empty file."""
    first = stream.peek(1)[:1]
    if not first:
        return None
    kind = {b">": "fasta", b"@": "fastq"}.get(first)
    if kind is None:
        raise SequenceFormatError(f"unknown sequence format, first byte {first!r}")
    return kind


# --- four-line FASTQ, which can be read from any place on

_LETTERS = re.compile(r"[A-Za-z.*-]+")


def four_line_records(lines: list[str]) -> tuple[list[str], list[str], list[str]] | None:
    """(headers, sequences, qualities) of whole four-line records, or None if the lines are anything else."""
    heads, seqs, marks, quals = lines[::4], lines[1::4], lines[2::4], lines[3::4]
    if len(lines) % 4 or not all(h[:1] == "@" for h in heads) or not all(m[:1] == "+" for m in marks) or list(map(len, seqs)) != list(map(len, quals)) or not all(seqs):
        return None
    return [h[1:] for h in heads], seqs, quals


def _is_four_line(head: str) -> bool:
    """Whether a file that begins so has four lines a record, as far as can be seen."""
    lines = head.replace("\r\n", "\n").split("\n")[:-1]
    whole = lines[: len(lines) // 4 * 4]
    found = four_line_records(whole) if whole else None
    return found is not None and all(map(_LETTERS.fullmatch, found[1]))


def _next_record(f, at: int, size: int) -> int:
    """Place of the first record that begins at ``at`` or later in a four-line file: a line with @ before one of letters.

    (A line of qualities that begins with @ is before a header, which begins with @ as well.)
    """
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    f.seek(at - 1)
    window, base = b"", at - 1
    while True:
        more = f.read(1 << 16)
        window += more
        start = window.find(b"\n") + 1
        while start > 0:
            lines = window[start:].split(b"\n", 2)
            if len(lines) == 3 or (not more and len(lines) == 2):
                if lines[0][:1] == b"@" and _LETTERS.fullmatch(lines[1].rstrip(b"\r").decode("latin-1")):
                    return base + start
                start += len(lines[0]) + 1
            else:
                break
        if not more:
            return size


class _File(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int = -1) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.kind = options.get("inputformat", "auto")
        self.mode = options.get("mode", "FAILFAST").upper()
        self.paths = [p for p in options.get("path", options.get("paths", "")).split(",") if p]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p, size in list_files(self.paths):
            if size > self.split and self.kind in ("auto", "fastq") and self._four_lines(p):
                out += [_File(p, i, min(i + self.split, size)) for i in range(0, size, self.split)]
            else:
                out.append(_File(p))
        return out

    def _four_lines(self, path: str) -> bool:
        fs, place = filesystem(path)
        with fs.open_input_file(place) as f:
            return _is_four_line(f.read(1 << 18).decode("latin-1"))

    def _range(self, partition: _File) -> Iterator[pa.RecordBatch]:
        """Records that begin in a range of a four-line file. Their numbers go on from the place of the range's first one."""
        fs, place = filesystem(partition.path)
        with fs.open_input_file(place) as f:
            size = f.size()
            begin, stop = (_next_record(f, at, size) for at in (partition.start, partition.end))
            f.seek(begin)
            left, rest, i = stop - begin, "", begin
            while left:
                block = f.read(min(left, 4_000_000))
                left -= len(block)
                lines = (rest + block.decode("latin-1")).split("\n")
                rest = lines.pop() if left else ""
                if not left and lines and lines[-1] == "":
                    lines.pop()
                keep = len(lines) // 4 * 4 if left else len(lines)
                rest = "\n".join([*lines[keep:], rest]) if left else ""
                lines = [x.rstrip("\r") for x in lines[:keep]]
                while not left and lines and not lines[-1]:
                    lines.pop()
                found = four_line_records(lines)
                if found is None:
                    if self.mode == "PERMISSIVE":
                        return
                    raise SequenceFormatError(f"{partition.path}: a record between bytes {begin} and {stop} has not four lines, as those at the file's start have; read it with splitBytes over its size")
                n = len(found[0])
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(range(i, i + n), pa.int64()), *(pa.array(c, pa.string()) for c in found)], schema=_ARROW)
                i += n

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.end >= 0:
            yield from self._range(partition)
            return
        rows, size = [], 0
        with open_stream(partition.path) as stream:
            kind = sniff(stream) if self.kind == "auto" else self.kind if stream.peek(1)[:1] else None
            records = PARSERS[kind](stream) if kind else iter(())
            i = 0
            while True:
                try:
                    header, seq, qual = next(records)
                except StopIteration:
                    break
                except SequenceFormatError as e:
                    if self.mode == "PERMISSIVE":
                        break
                    raise SequenceFormatError(f"{partition.path}, record {i}: {e}") from None
                rows.append((partition.path, i, header, seq, qual))
                size += len(seq)
                i += 1
                if size > BATCH_CHARS or len(rows) >= 20_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class SequenceDataSource(DataSource):
    """``spark.read.format("sequence")``: files streamed in constant memory, plain or gzipped, a task each.

    A plain FASTQ file that begins with four-line records is split at every ``splitBytes``; should it hold a wrapped record later on, the job fails. Options:
    ``inputFormat`` auto (by first byte; empty files skipped), fasta, fastq, sam or bam; ``mode`` FAILFAST
    (a malformed record fails the job) or PERMISSIVE (a file ends at its first malformed record).
    """

    @classmethod
    def name(cls) -> str:
        return "sequence"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_sequences(spark: SparkSession, paths: str | list[str], input_format: str = "auto", mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the files; formats may be mixed with ``auto``."""
    spark.dataSource.register(SequenceDataSource)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("sequence").option("paths", ",".join(paths)).option("inputFormat", input_format).option("mode", mode).option("splitBytes", str(split_bytes)).load()


def by_format(paths: list[str]) -> tuple[list[str], list[str]]:
    """(plain FASTA files, which Spark's text reader splits; all others: FASTQ, gzipped files, pipes)."""
    fasta, others = [], []
    for path, size in list_files(paths):
        fs, place = filesystem(path)
        plain = size > 0 and fs.get_file_info(place).is_file
        if plain:
            with fs.open_input_file(place) as f:
                plain = f.read(1) == b">"
        (fasta if plain else others).append(path)
    return fasta, others


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """FASTA by Spark's own text reader, which splits large files at records: (path, header, seq)."""
    lines = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^[\r\n]*>?", "").alias("value")).filter("value != ''")
    parts = F.split("value", "\n", 2)
    return lines.select("path", F.regexp_replace(parts[0], "\r$", "").alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "[\r\n]", "").alias("seq"))


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SAM by Spark's text reader, split anywhere: (path, header, seq, qual); absent qualities are blanks, below every threshold."""
    f = F.split("value", "\t")
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value").filter("value != '' AND NOT startswith(value, '@')")
    seq = F.when(f[9] == "*", "").otherwise(f[9])
    qual = F.when((f[10] == "*") & (F.length(seq) != 1), F.expr("repeat(' ', length(split(value, '\t')[9]))")).otherwise(F.regexp_replace(f[10], "\r$", ""))
    return lines.select("path", f[0].alias("header"), seq.alias("seq"), qual.alias("qual"))


def fastq_to_sam(records: DataFrame) -> DataFrame:
    """Unmapped SAM lines of (header, seq, qual), in column ``value``."""
    name = F.split("header", r"\s")[0]
    return records.select(F.concat_ws("\t", name, F.lit("4"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual").alias("value"))


def to_fasta(reads: DataFrame, width: int = 70) -> DataFrame:
    """FASTA records of (header, seq), in column ``value``, wrapped at ``width`` bases; write it with ``.write.text``."""
    return reads.select(F.concat(F.lit(">"), "header", F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))


def to_fastq(reads: DataFrame) -> DataFrame:
    """Four-line FASTQ records of (header, seq, qual), in column ``value``."""
    return reads.select(F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))
