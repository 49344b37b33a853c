import io
import random

import numpy as np
import pytest

from kmerspark import cli
from kmerspark.functions.gf2 import BinaryMatrix
from kmerspark.functions.helpers import random_bits
from kmerspark.operators import count as C
from kmerspark.operators import extract, lookup, sketch
from kmerspark.operators.collections import Kmer, KmerCounter
from kmerspark.sources import database, generators, sequences


def brute_times(m, v):
    """Row by row: parity of the row's bits at the vector's ones."""
    out = 0
    for bit in range(m.r):
        row = [c >> bit & 1 for c in m.columns]
        out |= (sum(row[m.c - 1 - i] & v >> i & 1 for i in range(m.c)) % 2) << bit
    return out


def test_matrices_over_gf2(spark):
    r = random.Random(1)
    for rows, columns in ((1, 1), (7, 12), (64, 62), (20, 100)):
        m = BinaryMatrix.chance(rows, columns, columns)
        keys = [r.getrandbits(columns) for _ in range(40)] + [0, (1 << columns) - 1]
        assert [m.times(v) for v in keys] == [brute_times(m, v) for v in keys]
        raw = np.array([list(v.to_bytes(-(-columns // 8), "little")) for v in keys], np.uint8)
        assert m.products(raw).tolist() == [m.times(v) for v in keys]
        assert BinaryMatrix.of_header({"matrix1": m.header()}) == m
    a, b = BinaryMatrix.chance(9, 14, 2), BinaryMatrix.chance(14, 20, 3)
    assert all((a @ b).times(v) == a.times(b.times(v)) for v in range(0, 1 << 20, 99_991))
    for n in (1, 8, 33, 64):
        m = BinaryMatrix.invertible(n, n)
        assert m @ m.inverse() == m.inverse() @ m == BinaryMatrix.identity(n) and m.rank() == n
    low = BinaryMatrix.identity(5, 12)
    assert low.header() == {"r": 5, "c": 12, "identity": True} and all(low.times(v) == v & 31 for v in range(4096)) and low.rank() == 5
    with pytest.raises(ValueError):
        BinaryMatrix(3, (1, 2, 3)).inverse()
    for bad in (lambda: BinaryMatrix(2, (4,)), lambda: BinaryMatrix(65, (1,)), lambda: a @ a, lambda: low.inverse()):
        with pytest.raises(ValueError):
            bad()
    m = BinaryMatrix.chance(64, 20, 9)
    got = spark.range(0, 1 << 20, 40_009).select("id", m.column(sketch.F.col("id")).alias("h")).collect()
    assert all(x["h"] % (1 << 64) == m.times(x["id"]) for x in got)
    assert 0 <= random_bits(7) < 128 and random_bits(0) == 0 and random_bits(64, random.Random(1)) == random.Random(1).getrandbits(64)


@pytest.mark.parametrize("block", [5, 65_535])
def test_bloom_counters(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(sketch, "BLOCK", block if block > 5 else 500)
    once = generators.random_reads(spark, 200, 60, 1)
    counts = C.count_kmers(once.union(once.limit(70)), 15).cache()
    n = counts.count()
    for size, fpr in ((n, 0.01), (3, 0.2), (n // 50, 0.1)):  # the last two far too small: never one too low all the same
        shape = sketch.Counter.sized(15, size, fpr)
        cells = sketch.bloom_counter(counts.repartition(3), shape).cache()
        seen = sketch.check(counts, cells, shape).collect()
        assert len(seen) == n and all(x["seen"] >= min(x["count"], 2) for x in seen)
        if size == n:
            assert sum(x["seen"] > min(x["count"], 2) for x in seen) < n / 20
            kept = sketch.sketch_filter(counts, cells, shape)
            assert kept.filter("count >= 2").count() == counts.filter("count >= 2").count() <= kept.count() < n
        plain = np.zeros(shape.cells, np.int64)
        for x in seen:
            for at in shape.places([x["kmer"]])[0]:
                plain[at] += min(x["count"], 2)
        path = str(tmp_path / f"{size}.bc")
        sketch.write_counter(cells, path, shape)
        back, again = sketch.read_counter(spark, path)
        whole = np.concatenate([np.frombuffer(x["cells"], np.uint8) for x in back.orderBy("block").collect()])
        assert whole[: shape.cells].tolist() == np.minimum(plain, 2).tolist() and not whole[shape.cells :].any()
        assert again.matrices == shape.matrices and {x["kmer"]: x["seen"] for x in sketch.check(counts, back, again).collect()} == {x["kmer"]: x["seen"] for x in seen}
        with open(path, "rb") as f:
            data = f.read()
        (tmp_path / "cut").write_bytes(data[:-1])
        with pytest.raises(ValueError):
            sketch.read_counter(spark, str(tmp_path / "cut"))
    empty = sketch.bloom_counter(counts.limit(0), shape)
    assert {x["seen"] for x in sketch.check(counts, empty, shape).collect()} == {0}


def test_cells_of_a_counter_file():
    cells = np.array([0, 1, 2, 2, 1, 0, 2], np.uint8)
    assert database.unpack_cells(database.pack_cells(cells), 7).tolist() == cells.tolist()
    assert database.pack_cells(cells).tolist() == [0 + 3 + 18 + 54 + 81, 0 + 6]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_is_split_at_records(spark, tmp_path, end):
    r = random.Random(3)
    records = []
    for i in range(700):
        n = r.randrange(1, 90)
        quality = "".join(r.choice("@+AI5!") for _ in range(n))
        records.append((f"@r{i} @x" if i % 9 == 0 else f"r{i}", "".join(r.choice("ACGTNacgt") for _ in range(n)), "@" * n if i % 5 == 0 else quality))
    for last in ("", end):
        text = end.join(f"@{h}{end}{s}{end}+{h if i % 3 else ''}{end}{q}" for i, (h, s, q) in enumerate(records)) + last
        path = tmp_path / f"x{len(last)}.fq"
        path.write_bytes(text.encode())
        whole = [tuple(x) for x in sequences.read_sequences(spark, str(path)).select("header", "seq", "qual").collect()]
        assert whole == records
        for size in (97, 1000, 20_000):
            df = sequences.read_sequences(spark, str(path), split_bytes=size)
            got = df.orderBy("record_id").collect()
            assert [(x["header"], x["seq"], x["qual"]) for x in got] == records and len({x["record_id"] for x in got}) == len(records)
            assert df.rdd.getNumPartitions() == -(-len(text) // size)
    wrapped = "@a\nACGT\nACGT\n+\n@III\nIIII\n" * 50
    (tmp_path / "wrapped.fq").write_text(wrapped)
    df = sequences.read_sequences(spark, str(tmp_path / "wrapped.fq"), split_bytes=64)
    assert df.rdd.getNumPartitions() == 1 and {tuple(x) for x in df.select("seq", "qual").collect()} == {("ACGTACGT", "@IIIIIII")} and df.count() == 50
    (tmp_path / "late.fq").write_text("@a\nACGT\n+\nIIII\n" * 30_000 + wrapped)
    with pytest.raises(Exception, match="has not four lines"):
        sequences.read_sequences(spark, str(tmp_path / "late.fq"), split_bytes=1 << 16).count()


def test_random_files(spark, tmp_path):
    generators.write_random(spark, str(tmp_path / "a.fa"), 1000, 300, 5)
    reads = sequences.read_sequences(spark, str(tmp_path / "a.fa")).collect()
    assert sorted(len(x["seq"]) for x in reads) == [100, 300, 300, 300]
    generators.write_random(spark, str(tmp_path / "a.fq"), 150, seed=5, fastq=True)
    reads = sequences.read_sequences(spark, str(tmp_path / "a.fq")).collect()
    assert sorted(len(x["seq"]) for x in reads) == [10, 70, 70] and all(len(x["qual"]) == len(x["seq"]) and set(x["qual"]) <= {chr(c) for c in range(66, 105)} for x in reads)
    one, other = (generators.random_reads(spark, 50, 200, s).collect() for s in (1, 2))
    assert one == generators.random_reads(spark, 50, 200, 1).collect() != other and len({x["seq"] for x in one}) == 50
    text = "".join(x["seq"] for x in one)
    assert all(0.2 < text.count(c) / len(text) < 0.3 for c in "ACGT")


@pytest.mark.parametrize("k,canonical", [(1, True), (9, True), (9, False), (30, True), (31, False), (31, True)])
def test_packed_windows_inside_the_jvm(spark, k, canonical):
    r = random.Random(k)
    texts = ["".join(r.choice("ACGTacgtN") for _ in range(n)) for n in (0, 1, k, 40, 3000)] + ["ACGT" * 3000, None, "é" + "ACGTTTGA" * 9]
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    expected = {x["kmer"]: x["n"] for x in extract.kmers(df, k, canonical=canonical).groupBy("kmer").agg(sketch.F.count("*").alias("n")).collect()}
    for engine in ("sql", "arrow"):
        assert {x["kmer"]: x["count"] for x in C.count_kmers(df, k, canonical=canonical, engine=engine).collect()} == expected
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    places = [(i, p, str(Kmer(t[p : p + k]).canonical() if canonical else Kmer(t[p : p + k]))) for i, t in enumerate(texts) if t for p in range(len(t) - k + 1) if not set(t[p : p + k]) - set("ACGTacgt")]
    assert sorted(map(tuple, extract.kmers_at(keyed, k, ["id"], canonical=canonical).collect())) == places
    with pytest.raises(ValueError):
        extract.packed_kmers(df, 32)
    with pytest.raises(ValueError):
        C.count_kmers(df, 32, packed=True)


def test_vectors_in_parts(spark):
    reads = spark.createDataFrame([(1, "ACGT" * 50), (2, "A" * 30)], "id long, seq string")
    counts = C.count_kmers(reads, 5)
    whole = {x["id"]: x["counts"] for x in lookup.query_per_read(counts, reads, 5, ["id"]).collect()}
    parts = lookup.query_per_read(counts, reads, 5, ["id"], piece=40).orderBy("id", "part").collect()
    assert all(len(x["counts"]) <= 40 for x in parts) and max(x["part"] for x in parts) == 4
    assert {i: [c for x in parts if x["id"] == i for c in x["counts"]] for i in (1, 2)} == whole


def test_counter_grows_without_its_plan(spark):
    counter, expected = KmerCounter(spark, 3), {}
    for i in range(20):
        mers = ["AAA"] * i + [f"AC{'ACGT'[i % 4]}"]
        told = counter.add_new(spark.createDataFrame([(m,) for m in mers], "kmer string"))
        if i in (0, 1, 19):
            assert {x["kmer"]: x["is_new"] for x in told.collect()} == {m: m not in expected for m in mers}
        for m in mers:
            expected[m] = expected.get(m, 0) + 1
    assert {x["kmer"]: x["count"] for x in counter.counts.collect()} == expected and counter.size() == len(expected)
    assert counter.get("AAA") == expected["AAA"] and counter.get("TTT") is None and len(counter._tables) <= 16


def run(spark, monkeypatch, capsys, argv, stdin=""):
    monkeypatch.setattr("sys.stdin", io.StringIO(stdin))
    status = cli.main([str(x) for x in argv], spark)
    out = capsys.readouterr()
    return status, out.out.splitlines(), out.err


def test_command_line_counters(spark, tmp_path, monkeypatch, capsys):
    go = lambda *argv, stdin="": run(spark, monkeypatch, capsys, argv, stdin)
    assert go("generate", "3k", "2000", "-o", tmp_path / "g", "-s", 3)[0] == 0
    a, b = tmp_path / "g_0.fa", tmp_path / "g_1.fa"
    (tmp_path / "x.fa").write_text(">r\nACGTACGTACGTTTTT\n>s\nACGTACG\n")
    x = tmp_path / "x.fa"
    assert go("count", "-m", 7, "-o", tmp_path / "t", "--timing", tmp_path / "time", x)[0] == 0
    assert [line.split()[0] for line in (tmp_path / "time").read_text().splitlines()] == ["Init", "Counting", "Writing"]
    status, out, err = go("query", "-i", tmp_path / "t", stdin="ACGTACG\nACG\nno\nACGTACGxx\nTTTTTTT\n")
    assert (status, out) == (0, ["3", "3", "0"]) and err.count("Invalid mer") == 2
    assert go("bc", "-m", 7, "-C", "-s", "10k", "-o", tmp_path / "bc", "--timing", tmp_path / "time", x, a, b)[0] == 0
    assert go("bc", "-m", 7, "-C", "-o", tmp_path / "exact", x, a, b)[0] == 0
    exact = {r["kmer"]: r["count"] for r in database.read_database(spark, str(tmp_path / "exact")).collect()}
    status, out, err = go("query", tmp_path / "bc", *exact, "XYZ")
    told = {line.split()[0]: int(line.split()[1]) for line in out}
    assert status == 0 and "Invalid mer 'XYZ'" in err and told.keys() == exact.keys() and all(told[m] >= c for m, c in exact.items())
    assert sum(told[m] != c for m, c in exact.items()) < len(exact) / 50
    assert go("query", tmp_path / "bc", "-i", stdin="CGTACGT\n?\n")[1] == [str(told["ACGTACG"])]
    status, out, _ = go("query", tmp_path / "bc", "-s", x)
    assert len(out) == 11 and all(int(line.split()[1]) >= exact[line.split()[0]] for line in out)
    assert go("count", "-m", 7, "-C", "--bc", tmp_path / "bc", "-o", tmp_path / "two", x, a, b)[0] == 0
    assert go("count", "-m", 7, "-C", "--bc", tmp_path / "exact", "-o", tmp_path / "sure", x, a, b)[0] == 0
    two, sure = ({r["kmer"]: r["count"] for r in database.read_database(spark, str(tmp_path / p)).collect()} for p in ("two", "sure"))
    assert sure.items() <= two.items() and len(two) < len(exact)
    assert go("count", "-m", 6, "--bc", tmp_path / "bc", "-o", tmp_path / "no", x)[0] == 1
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert "kmerspark" in capsys.readouterr().out
