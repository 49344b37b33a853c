"""Readers, writers, sketches, streams and the command line."""

import gzip
import io
import json
import struct

import numpy as np
import pytest
from kmerspark import cli
from kmerspark.functions.helpers import bloom_size
from kmerspark.functions.udtf import string_mers
from kmerspark.operators import count as C
from kmerspark.operators import sketch
from kmerspark.sources import database, generators
from kmerspark.sources import sequences as S
from kmerspark.streaming import running

FASTA = ">read1 some > text\nACGT\n\nACNNA\n>read2\n>read3\nGG\nTTA"
FASTQ = "@r1 x\nACG\nTA\n+r1\n@II\n>I\n@r2\n\n+\n\n@r3\nA\n+\nI\n"


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("path", "record_id").select(*cols).collect()]


def write(path, text, newline="\n"):
    path.write_bytes(text.replace("\n", newline).encode())
    return str(path)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_fasta(spark, tmp_path, newline):
    p = write(tmp_path / "a.fa", FASTA, newline)
    expected = [("read1 some > text", "ACGTACNNA"), ("read2", ""), ("read3", "GGTTA")]
    assert rows(S.read_sequences(spark, p), "header", "seq") == expected
    assert sorted(map(tuple, S.read_fasta(spark, p).select("header", "seq").collect())) == expected


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_fastq_wrapped(spark, tmp_path, newline):
    p = write(tmp_path / "a.fq", FASTQ, newline)
    assert rows(S.read_sequences(spark, p), "header", "seq", "qual") == [("r1 x", "ACGTA", "@II>I"), ("r2", "", ""), ("r3", "A", "I")]


@pytest.mark.parametrize("bad", ["@r\nACG\n", "@r\nACG\n+\nII", "@r\nACG\n+\nIIII\n", "@r\nAC\n+\nII\nACG\n", "ACGT\n", "@r1\nA\n+\nI\nx\n"])
def test_malformed_files_fail_or_end(spark, tmp_path, bad):
    p = write(tmp_path / "bad", bad)
    with pytest.raises(Exception):
        S.read_sequences(spark, p).collect()
    if bad[0] == "@":
        S.read_sequences(spark, p, mode="PERMISSIVE").collect()


def test_mixed_gzipped_and_empty_files(spark, tmp_path):
    write(tmp_path / "a.fa", ">a\nAC\n")
    write(tmp_path / "b.fq", "@b\nGT\n+\nII\n")
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(b">c\nTT\n"))
    write(tmp_path / "empty", "")
    assert rows(S.read_sequences(spark, str(tmp_path)), "header", "seq", "qual") == [("a", "AC", None), ("b", "GT", "II"), ("c", "TT", None)]
    assert S.read_sequences(spark, str(tmp_path / "*.f?")).count() == 2
    with pytest.raises(Exception):
        S.read_sequences(spark, str(tmp_path / "missing")).collect()


def bam_record(name, seq, qual):
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 1, 4, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", 16) + packed + bytes(qual)
    return struct.pack("<i", len(body)) + body


def test_sam_equals_bam(spark, tmp_path):
    records = [("r1", "ACGTN", [0, 10, 40, 41, 2]), ("r2", "ACG", [255, 255, 255]), ("r3", "MTT", [30, 30, 30])]
    bam = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 9)
    bam += b"".join(bam_record(*r) for r in records)
    (tmp_path / "a.bam").write_bytes(gzip.compress(bam[:50]) + gzip.compress(bam[50:]))
    sam = ["@HD\tVN:1.6"] + ["\t".join([n, "4", "*", "0", "0", "1M", "*", "0", "0", s, "*" if q[0] == 255 else "".join(chr(x + 33) for x in q)]) for n, s, q in records]
    p = write(tmp_path / "a.sam", "\n".join(sam) + "\n")
    expected = [("r1", "ACGTN", "!+IJ#"), ("r2", "ACG", "   "), ("r3", "NTT", "???")]
    assert rows(S.read_sequences(spark, str(tmp_path / "a.bam"), "bam"), "header", "seq", "qual") == expected
    from_sam = rows(S.read_sequences(spark, p, "sam"), "header", "seq", "qual")
    assert [x[1].replace("M", "N") for x in from_sam] == [x[1] for x in expected] and [x[2] for x in from_sam] == [x[2] for x in expected]
    assert sorted(map(tuple, S.read_sam(spark, p).select("header", "seq", "qual").collect())) == sorted(from_sam)
    assert len(list(S.parse_bam(io.BytesIO(bam)))) == 3
    with pytest.raises(S.SequenceFormatError):
        list(S.parse_bam(io.BytesIO(bam[:-3])))


def test_generators(spark):
    assert generators.read_commands("# x\n\n a \n") == [" a "]
    with pytest.raises(PermissionError):
        generators.run_generators(spark, ["true"])
    assert generators.run_generators(spark, ["true", "printf '>a\\nAC\\n'"], allow_execution=True).count() == 1
    with pytest.raises(Exception):
        generators.run_generators(spark, ["printf '>a\\nAC\\n'; exit 3"], allow_execution=True).collect()
    r = generators.random_reads(spark, 20, 70, 3, quality=True).collect()
    assert all(len(x["seq"]) == len(x["qual"]) == 70 and set(x["seq"]) <= set("ACGT") and set(x["qual"]) <= set(map(chr, range(66, 105))) for x in r)
    assert r == generators.random_reads(spark, 20, 70, 3, quality=True).collect() and len({x["seq"] for x in r}) == 20


@pytest.mark.parametrize("k", [1, 4, 5, 13, 35])
def test_exchange_files(spark, tmp_path, k):
    reads = generators.random_reads(spark, 40, 90, k)
    counts = C.count_kmers(reads, k)
    expected = {r["kmer"]: r["count"] for r in counts.collect()}
    database.write_exchange(counts, str(tmp_path / "b"), k, counter_len=1)
    assert {r["kmer"]: r["count"] for r in database.read_binary(spark, str(tmp_path / "b"), 7).collect()} == {m: min(c, 255) for m, c in expected.items()}
    database.write_exchange(counts, str(tmp_path / "t"), k, True, text=True)
    assert {r["kmer"]: r["count"] for r in database.read_text(spark, str(tmp_path / "t")).collect()} == expected
    header, offset = database.read_header(str(tmp_path / "b"))
    assert offset % 8 == 0 and header["key_len"] == 2 * k
    raw = np.frombuffer((tmp_path / "b").read_bytes()[offset:], np.uint8).reshape(len(expected), -1)
    keys = [int.from_bytes(r[: -(-k // 4)].tobytes(), "little") for r in raw]
    assert keys == sorted(keys, key=lambda v: (v % header["size"], v))  # the order of an identity matrix
    n = database.write_exchange_parts(counts, str(tmp_path / "bs"), k, counter_len=1)
    assert {r["kmer"]: r["count"] for r in database.read_binary(spark, str(tmp_path / "bs"), 7).collect()} == {m: min(c, 255) for m, c in expected.items()}
    database.write_exchange_parts(counts, str(tmp_path / "ts"), k, True, text=True)
    assert {r["kmer"]: r["count"] for r in database.read_text(spark, str(tmp_path / "ts")).collect()} == expected
    parts = sorted((tmp_path / "bs").iterdir())
    assert [p.name for p in parts if not p.name.startswith(".")] == [f"part-{i:05d}" for i in range(n)]
    assert b"".join(p.read_bytes()[offset:] for p in parts if not p.name.startswith(".")) == (tmp_path / "b").read_bytes()[offset:]
    with pytest.raises(ValueError):
        database.read_text(spark, str(tmp_path / "b"))
    with pytest.raises(Exception, match="is not binary"):
        database.read_binary(spark, str(tmp_path / "t")).collect()


def test_streams(spark, tmp_path):
    reads = generators.random_reads(spark, 50, 40, 2).select("seq")
    reads.repartition(4).write.parquet(str(tmp_path / "in"))
    expected = {r["kmer"]: r["count"] for r in C.count_kmers(reads, 6).collect()}
    stream = running.stream_reads(spark, str(tmp_path / "in"), "seq string", files_per_trigger=1)
    q = running.running_counts(stream, 6).writeStream.outputMode("complete").format("memory").queryName("kt").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["kmer"]: r["count"] for r in spark.table("kt").collect()} == expected
    running.append_partials(stream, 6, str(tmp_path / "out"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert {r["kmer"]: r["count"] for r in running.compact(spark, str(tmp_path / "out")).collect()} == expected


def run(spark, capsys, *argv):
    code = cli.main([str(a) for a in argv], spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_command_line(spark, tmp_path, capsys):
    fa = write(tmp_path / "a.fa", ">a\nACGTACGTNACG\n>b\nTTTTT\n")
    db, db2, text = tmp_path / "db", tmp_path / "db2", tmp_path / "t"
    assert run(spark, capsys, "count", "-m", 3, "-C", "-s", "10M", "-o", db, "--timing", tmp_path / "time", fa)[0] == 0
    assert "Counting" in (tmp_path / "time").read_text()
    expected = {}
    for s in ("ACGTACGTNACG", "TTTTT"):
        for m in string_mers(s, 3, True):
            expected[m] = expected.get(m, 0) + 1
    code, out, _ = run(spark, capsys, "dump", "-c", db)
    assert dict(x.split() for x in out.splitlines()) == {m: str(c) for m, c in expected.items()}
    assert run(spark, capsys, "dump", "-L", 2, db)[1].count(">") == sum(c >= 2 for c in expected.values())
    assert run(spark, capsys, "count", "-m", 3, "-C", "--text", "-o", text, fa)[0] == 0
    for command in (["stats"], ["histo"], ["histo", "-l", 1, "-h", 2, "-f"], ["dump", "-c", "-t"]):
        a, b = (sorted(run(spark, capsys, *command, x)[1].splitlines()) for x in (db, text))
        assert a == b and a
    assert f"Distinct:  {len(expected)}" in run(spark, capsys, "stats", db)[1]
    code, out, err = run(spark, capsys, "query", db, "CGTA", "TTT", "GG", "CCC")
    assert out.splitlines() == [f"ACG {expected['ACG']}", f"AAA {expected['AAA']}", "CCC 0"] and "Invalid mer 'GG'" in err
    assert len(run(spark, capsys, "query", "-s", fa, db)[1].splitlines()) == sum(expected.values())
    assert run(spark, capsys, "count", "-m", 3, "-C", "-o", db2, fa)[0] == 0
    assert run(spark, capsys, "merge", "-o", tmp_path / "m", db, db2)[0] == 0
    assert dict(x.split() for x in run(spark, capsys, "dump", "-c", tmp_path / "m")[1].splitlines()) == {m: str(2 * c) for m, c in expected.items()}
    assert "canonical: yes" in run(spark, capsys, "info", tmp_path / "m")[1]
    assert json.loads(run(spark, capsys, "info", "-j", db)[1])["k"] == 3
    assert int(run(spark, capsys, "info", "-s", db)[1]) > 0 and run(spark, capsys, "info", "-c", db)[1]
    assert run(spark, capsys, "merge", "-j", db, db2)[1].split() == ["Jaccard", "1", "wJaccard", "1"]
    assert run(spark, capsys, "count", "-m", 4, "-o", tmp_path / "k4", fa)[0] == 0
    code, _, err = run(spark, capsys, "merge", "-o", tmp_path / "x", db, tmp_path / "k4")
    assert code == 1 and "differ" in err
    assert run(spark, capsys, "bc", "-m", 3, "-C", "-o", tmp_path / "bc", fa)[0] == 0
    assert run(spark, capsys, "count", "-m", 3, "-C", "--bc", tmp_path / "bc", "-o", tmp_path / "d", fa)[0] == 0
    assert dict(x.split() for x in run(spark, capsys, "dump", "-c", tmp_path / "d")[1].splitlines()) == {m: str(c) for m, c in expected.items() if c > 1}
    assert run(spark, capsys, "count", "-m", 3, "--bc", tmp_path / "bc", "-o", tmp_path / "e", fa)[0] == 1
    assert run(spark, capsys, "count", "-m", 3, "-C", "--if", fa, "--binary", "-o", tmp_path / "bin", fa)[0] == 0
    assert dict(x.split() for x in run(spark, capsys, "dump", "-c", tmp_path / "bin")[1].splitlines()) == {m: str(c) for m, c in expected.items()}
    (tmp_path / "gen").write_text(f"# comment\ncat {fa}\n")
    assert run(spark, capsys, "count", "-m", 3, "-C", "-g", tmp_path / "gen", "-o", tmp_path / "g", "--bf-size", "1M")[0] == 0
    assert dict(x.split() for x in run(spark, capsys, "dump", "-c", tmp_path / "g")[1].splitlines()) == {m: str(c - 1) for m, c in expected.items() if c > 1}
    assert run(spark, capsys, "mem", "-m", 24, "-s", "1G")[1] == "4521043056 (4G)\n"
    assert run(spark, capsys, "mem", "-m", 31, "--mem", "8g")[1] == "1073741824 (1G)\n"
    assert run(spark, capsys, "count", "-m", 3, "-o", tmp_path / "z", tmp_path / "nowhere.fa")[0] != 0


def test_named_pipe(spark, tmp_path):
    import os
    import threading

    pipe = str(tmp_path / "pipe")
    os.mkfifo(pipe)
    writer = threading.Thread(target=lambda: open(pipe, "w").write(FASTA), daemon=True)
    writer.start()
    got = S.read_sequences(spark, pipe).select("header", "seq").collect()  # one pass: a sort would read it twice
    assert [tuple(r) for r in got] == [("read1 some > text", "ACGTACNNA"), ("read2", ""), ("read3", "GGTTA")]


def test_metadata_and_size(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("SOURCE_DATE_EPOCH", "0")
    database.write_database(spark.createDataFrame([("AC", 1)], "kmer string, count long"), str(tmp_path / "d"), 2, False)
    assert database.read_metadata(str(tmp_path / "d"))["time"] == "1970-01-01 00:00:00"
    assert database.read_database(spark, str(tmp_path / "d")).collect() == [("AC", 1)]
    assert database.dump_columns(database.read_database(spark, str(tmp_path / "d"))).first()[0] == "AC 1"
    assert database.check_compatible([{"k": 2, "canonical": False}, {"key_len": 4}]) == (2, False)
