"""Command line: ``python -m kmerspark.cli count -m 21 -o counts reads.fa`` and the commands on count tables."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerspark.functions.helpers import format_size, parse_size, quality_threshold
from kmerspark.memory import largest_size, table_bytes
from kmerspark.operators import count as C
from kmerspark.operators import extract, lookup, setops, sketch, summarize
from kmerspark.operators.collections import Kmer
from kmerspark.scratch import scratch_path
from kmerspark.sources import database, generators, sequences


VERSION = "0.2"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kmerspark", description=__doc__)
    p.add_argument("-V", "--version", action="version", version=f"kmerspark {VERSION}")
    sub = p.add_subparsers(dest="command", required=True)

    def inputs(c: argparse.ArgumentParser) -> None:
        c.add_argument("files", nargs="*")
        c.add_argument("-m", "--mer-len", type=int, required=True)
        c.add_argument("-C", "--canonical", action="store_true")
        c.add_argument("-g", "--generator", help="file of commands whose outputs are read")
        c.add_argument("-S", "--shell", default="/bin/sh")
        c.add_argument("--timing")
        # of no effect on results: Spark sizes, schedules and spills by itself
        for names in (("-s", "--size"), ("-t", "--threads"), ("-F", "--Files"), ("-G", "--Generators")):
            c.add_argument(*names)

    c = sub.add_parser("count", help="count k-mers")
    inputs(c)
    c.add_argument("-o", "--output", default="mer_counts")
    c.add_argument("--sam", action="append", default=[], help="SAM or BAM file")
    c.add_argument("--out-counter-len", type=int)
    c.add_argument("--bc", help="counts of a first pass; only k-mers seen twice there are counted")
    c.add_argument("--bf-size", help="leave each k-mer's first occurrence out")
    c.add_argument("--bf-fp", type=float)
    c.add_argument("--if", dest="only", action="append", default=[], help="file of sequences whose k-mers alone are counted")
    c.add_argument("-Q", "--min-qual-char")
    c.add_argument("--quality-start", type=int, default=64)
    c.add_argument("--min-quality", type=int)
    c.add_argument("--text", action="store_true", help="write a text exchange file")
    c.add_argument("--binary", action="store_true", help="write a binary exchange file")
    c.add_argument("-L", "--lower-count", type=int)
    c.add_argument("-U", "--upper-count", type=int)
    for names in (("-c", "--counter-len"), ("-p", "--reprobes")):
        c.add_argument(*names)
    for name in ("--disk", "--no-merge", "--no-unlink", "--no-write"):
        c.add_argument(name, action="store_true")

    c = sub.add_parser("bc", help="classes (0, 1, 2 or more) of a first pass: a Bloom counter of the size given with -s, else an exact table")
    inputs(c)
    c.add_argument("-f", "--fpr", type=float, default=0.001)
    c.add_argument("-o", "--output", default="mer_bloom_counter")

    c = sub.add_parser("histo", help="histogram of the counts", add_help=False)  # -h is the high end here
    c.add_argument("--help", action="help")
    c.add_argument("db")
    c.add_argument("-t", "--threads")
    c.add_argument("-s", "--size")
    c.add_argument("-v", "--verbose", action="store_true")
    c.add_argument("-l", "--low", type=int, default=1)
    c.add_argument("-h", "--high", type=int, default=10_000)
    c.add_argument("-i", "--increment", type=int, default=1)
    c.add_argument("-f", "--full", action="store_true")
    c.add_argument("-o", "--output")

    c = sub.add_parser("stats", help="unique, distinct, total and highest count")
    c.add_argument("db")
    c.add_argument("-r", "--recompute", action="store_true")
    c.add_argument("-v", "--verbose", action="store_true")
    c.add_argument("-L", "--lower-count", type=int, default=0)
    c.add_argument("-U", "--upper-count", type=int)
    c.add_argument("-o", "--output")

    c = sub.add_parser("dump", help="k-mers and counts as text")
    c.add_argument("db")
    c.add_argument("-c", "--column", action="store_true")
    c.add_argument("-t", "--tab", action="store_true")
    c.add_argument("-L", "--lower-count", type=int)
    c.add_argument("-U", "--upper-count", type=int)
    c.add_argument("-o", "--output")

    c = sub.add_parser("merge", help="merge tables")
    c.add_argument("db", nargs="+")
    c.add_argument("-o", "--output", default="mer_counts_merged")
    how = c.add_mutually_exclusive_group()
    how.add_argument("-m", "--min", action="store_true")
    how.add_argument("-M", "--max", action="store_true")
    how.add_argument("-j", "--jaccard", action="store_true")
    c.add_argument("-L", "--lower-count", type=int)
    c.add_argument("-U", "--upper-count", type=int)

    c = sub.add_parser("query", help="look k-mers up")
    c.add_argument("db")
    c.add_argument("mers", nargs="*")
    c.add_argument("-s", "--sequence", action="append", default=[])
    c.add_argument("-i", "--interactive", action="store_true")
    c.add_argument("-l", "--load", action="store_true")
    c.add_argument("-L", "--no-load", action="store_true")
    c.add_argument("-o", "--output")

    c = sub.add_parser("generate", help="write files of random sequence")
    c.add_argument("bases", nargs="+", help="bases of each file")
    c.add_argument("-o", "--output", default="random")
    c.add_argument("-r", "--read-length", type=int)
    c.add_argument("-s", "--seed", type=int, default=0)
    c.add_argument("-q", "--fastq", action="store_true")

    c = sub.add_parser("info", help="how a table was made")
    c.add_argument("db")
    c.add_argument("-j", "--json", action="store_true")
    c.add_argument("-c", "--cmd", action="store_true")
    c.add_argument("-s", "--skip", action="store_true", help="bytes of the table itself")

    c = sub.add_parser("mem", help="memory of an in-memory table, or the size that fits")
    c.add_argument("-m", "--mer-len", type=int, required=True)
    size = c.add_mutually_exclusive_group(required=True)
    size.add_argument("-s", "--size")
    size.add_argument("--mem")
    c.add_argument("-c", "--counter-len", type=int, default=7)
    c.add_argument("-p", "--reprobes", type=int, default=126)
    return p


def _reads(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    fasta, others = sequences.by_format(a.files)
    parts = [sequences.read_fasta(spark, fasta).select("path", F.lit(None).cast("long").alias("record_id"), "header", "seq", F.lit(None).cast("string").alias("qual"))] if fasta else []
    parts += [sequences.read_sequences(spark, others)] if others else []
    parts += [sequences.read_sequences(spark, f, "bam" if f.endswith(".bam") else "sam") for f in getattr(a, "sam", [])]
    if a.generator:
        with open(a.generator) as f:
            parts.append(generators.run_generators(spark, generators.read_commands(f.read()), a.shell, allow_execution=True))
    if not parts:
        raise ValueError("no input files")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _put(lines, output: str | None) -> None:
    with open(output, "w") if output else _stdout() as f:
        for line in lines:
            f.write(f"{line}\n")


class _stdout:
    def __enter__(self):
        return sys.stdout

    def __exit__(self, *_):
        sys.stdout.flush()


def open_db(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Counts and metadata of a Parquet table or an exchange file."""
    import os

    if os.path.isdir(path):
        return database.read_database(spark, path), database.read_metadata(path)
    header, _ = database.read_header(path)
    meta = header | {"k": header["key_len"] // 2}
    return (database.read_text if header["format"] == database.TEXT else database.read_binary)(spark, path), meta


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "mem":
        if a.size:
            n = table_bytes(a.mer_len, parse_size(a.size), a.counter_len, a.reprobes)
            print(f"{n} ({format_size(n, 1024)})")
        else:
            n = largest_size(a.mer_len, parse_size(a.mem), a.counter_len, a.reprobes)
            print(f"{n} ({format_size(n)})")
        return 0
    spark = spark or SparkSession.builder.appName("kmerspark").getOrCreate()
    try:
        return _run(spark, a)
    except (ValueError, OSError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def is_counter(path: str) -> bool:
    """Whether a path is a Bloom counter file."""
    import os

    return not os.path.isdir(path) and database.read_header(path)[0].get("format") == database.BLOOM


def _valid(m: str, k: int, canonical: bool) -> str | None:
    """The k-mer that a text begins with; a text that begins with none is reported."""
    try:
        x = Kmer(m[:k])
        if x.k < k:
            raise ValueError("too short")
    except ValueError:
        print(f"Invalid mer '{m}'", file=sys.stderr)
        return None
    return str(x.canonical() if canonical else x)


def _interactive(count_of, k: int, canonical: bool) -> None:
    """The count of each line's k-mer as soon as the line is read; an invalid line is reported, and the next one read."""
    for line in sys.stdin:
        x = _valid(line.strip(), k, canonical)
        if x:
            print(count_of(x), flush=True)


def _query_counter(spark: SparkSession, a: argparse.Namespace) -> int:
    """Classes that a Bloom counter file has for k-mers."""
    cells, shape = sketch.read_counter(spark, a.db)
    lines = []
    if a.sequence:
        path = scratch_path(spark, "asked")
        extract.kmers_at(sequences.read_sequences(spark, a.sequence), shape.k, ["path", "record_id"], canonical=shape.canonical).write.parquet(path)
        asked = spark.read.parquet(path)
        found = sketch.check(asked, cells, shape).orderBy("path", "record_id", "pos")
        lines += [f"{r['kmer']} {r['seen']}" for r in found.select("kmer", "seen").toLocalIterator()]
    seen_of = lambda mers: {r["kmer"]: r["seen"] for r in sketch.classes(spark.createDataFrame([(m,) for m in mers], "kmer string"), cells, shape).collect()} if mers else {}
    valid = [x for x in (_valid(m, shape.k, shape.canonical) for m in a.mers) if x]
    seen = seen_of(sorted(set(valid)))
    _put(lines + [f"{x} {seen[x]}" for x in valid], a.output)
    if a.interactive:
        _interactive(lambda x: seen_of([x])[x], shape.k, shape.canonical)
    return 0


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    began = time.time()
    if a.command in ("count", "bc"):
        k = a.mer_len
        reads = _reads(spark, a)
        if a.command == "bc":
            ready = time.time()
            counts = C.count_kmers(reads, k, canonical=a.canonical).withColumn("count", F.least("count", F.lit(2)))
            if a.size:
                shape = sketch.Counter.sized(k, parse_size(a.size), a.fpr, a.canonical)
                path = scratch_path(spark, "counter")
                sketch.bloom_counter(counts, shape).write.parquet(path)
                counted = time.time()
                sketch.write_counter(spark.read.parquet(path), a.output, shape)
            else:
                counted = time.time()
                database.write_database(counts, a.output, k, a.canonical, "overwrite", classes=True)
        else:
            extra: dict = {}
            counter = None
            if a.bc and is_counter(a.bc):
                counter = sketch.read_counter(spark, a.bc)
                if (counter[1].k, counter[1].canonical) != (k, a.canonical):
                    raise ValueError("the first pass differs in k or in being canonical")
            elif a.bc:
                first, meta = open_db(spark, a.bc)
                if (meta["k"], bool(meta["canonical"])) != (k, a.canonical):
                    raise ValueError("the first pass differs in k or in being canonical")
                extra = {"prefilter": "exact2", "seen_twice": first}
            elif a.bf_size:
                extra = {"prefilter": "minus1"}
            if a.only:
                extra["only"] = C.distinct_kmers(sequences.read_sequences(spark, a.only), k, canonical=a.canonical)
            threshold = quality_threshold(a.min_qual_char, a.min_quality, a.quality_start)
            ready = time.time()
            counts = C.count_kmers(reads, k, qual="qual", min_qual=threshold, canonical=a.canonical, lower=a.lower_count, upper=a.upper_count, saturate_bytes=None if a.text else a.out_counter_len, **extra)
            if counter is not None:
                counts = sketch.sketch_filter(counts, *counter)
            if a.timing or counter is not None or not (a.text or a.binary or a.no_write):  # counted once, before it is written
                path = scratch_path(spark, "counts")
                counts.write.parquet(path)
                counts = spark.read.parquet(path)
            counted = time.time()
            if a.no_write:
                counts.write.format("noop").mode("overwrite").save()
            elif a.text or a.binary:
                database.write_exchange(counts, a.output, k, a.canonical, a.text, a.out_counter_len or 4)
            else:
                database.write_database(counts, a.output, k, a.canonical, "overwrite")
        if a.timing:
            _put([f"Init     {ready - began:.6g}", f"Counting {counted - ready:.6g}", f"Writing  {time.time() - counted:.6g}"], a.timing)
        return 0
    if a.command == "merge":
        opened = [open_db(spark, p) for p in a.db]
        k, canonical = database.check_compatible([m for _, m in opened])
        tables = [t for t, _ in opened]
        if a.jaccard:
            row = setops.jaccard(tables).first()
            _put([f"Jaccard  {row['jaccard']:.6g}", f"wJaccard {row['wjaccard']:.6g}"] if row["jaccard"] is not None else ["Jaccard  nan", "wJaccard nan"], a.output if a.output != "mer_counts_merged" else None)
        else:
            merged = setops.merge(tables, "min" if a.min else "max" if a.max else "sum", a.lower_count, a.upper_count)
            database.write_database(merged, a.output, k, canonical, "overwrite")
        return 0
    if a.command == "generate":
        for i, n in enumerate(a.bases):
            path = f"{a.output}{f'_{i}' if len(a.bases) > 1 else ''}.{'fq' if a.fastq else 'fa'}"
            generators.write_random(spark, path, parse_size(n), a.read_length, a.seed + i, a.fastq)
        return 0
    if a.command == "query" and is_counter(a.db):
        return _query_counter(spark, a)
    counts, meta = open_db(spark, a.db)
    if a.command == "histo":
        rows = summarize.histogram(counts, a.low, a.high, a.increment, a.full).orderBy("bucket").collect()  # at most one row a bucket
        _put((f"{r['bucket']} {r['n']}" for r in rows), a.output)
    elif a.command == "stats":
        r = summarize.stats(counts, a.lower_count, a.upper_count).first()
        _put([f"Unique:    {r['unique_mers']}", f"Distinct:  {r['distinct_mers']}", f"Total:     {r['total']}", f"Max_count: {r['max_count']}"], a.output)
    elif a.command == "dump":
        out = database.dump_columns(counts, a.tab, a.lower_count, a.upper_count) if a.column else database.dump_fasta(counts, a.lower_count, a.upper_count)
        _put((r["value"] for r in out.toLocalIterator()), a.output)
    elif a.command == "query":
        k, canonical = meta["k"], bool(meta["canonical"])
        lines = []
        if a.sequence:
            found = lookup.query_sequences(counts, sequences.read_sequences(spark, a.sequence), k, ["path", "record_id"], canonical=canonical).orderBy("path", "record_id", "pos")
            lines += [f"{r['mer']} {r['count']}" for r in found.toLocalIterator()]
        if a.mers:
            asked = spark.createDataFrame([(m,) for m in a.mers], "mer string")
            found = {r["mer"]: r["count"] for r in lookup.query(counts, asked, k, canonical).collect()}
            lines += [f"{x} {found[x]}" for x in map(lambda m: _valid(m, k, canonical), a.mers) if x]
        _put(lines, a.output)
        if a.interactive:
            counts = counts.cache()
            _interactive(lambda x: next(iter(counts.filter(F.col("kmer") == x).limit(1).collect()), {"count": 0})["count"], k, canonical)
    elif a.command == "info":
        if a.json:
            _put([json.dumps(meta)], None)
        elif a.cmd:
            _put([" ".join(meta.get("cmdline", []))], None)
        elif a.skip:
            _put([str(database.database_size(a.db))], None)
        else:
            _put([f"command: {' '.join(meta.get('cmdline', []))}", f"where: {meta.get('hostname')}:{meta.get('pwd')}", f"when: {meta.get('time')}", f"canonical: {'yes' if meta.get('canonical') else 'no'}"], None)
    return 0


if __name__ == "__main__":
    sys.exit(main())
