"""Work is spread over the cores and combined before the shuffle, with the results of plain Python."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerspark.functions.udtf import string_mers
from kmerspark.operators import count as C
from kmerspark.operators import encode
from kmerspark.plans import fixtures as X


def plain(seqs, k, canonical):
    out = Counter()
    for s in seqs:
        out.update(string_mers(s or "", k, canonical))
    return dict(out)


@pytest.mark.parametrize("name", ["reads_a", "reads_b", "reads_c", "reads_long"])
def test_reads_of_one_small_file_are_made_by_all_cores(spark, name):
    df = getattr(X, name)(spark, "/root/testdata/sf0.001")
    rows = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("k,canonical", [(32, True), (33, False), (62, True), (63, True), (100, False), (100, True)])
def test_long_kmers_are_combined_by_batch(spark, monkeypatch, k, canonical):
    r = random.Random(k)
    unit = "".join(r.choice("ACGT") for _ in range(150))
    seqs = [unit, unit.lower(), unit[:70] + "N" + unit[70:], "é" + unit + "ACGU", "A" * 120, "ACGT" * 40, unit[::-1], "", None, unit[: k - 1], unit[:k]] * 3
    expected = plain(seqs, k, canonical)
    for piece in (encode.PIECE, 301):
        monkeypatch.setattr(encode, "PIECE", piece)
        got = Counter()
        for b in encode.long_counting_task(k, canonical, None)(iter([pa.RecordBatch.from_arrays([pa.array(seqs)], names=["seq"])])):
            got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
            if piece > 301:  # one row a k-mer of the batch
                assert b.num_rows == len(expected)
        assert dict(got) == expected
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    for engine in ("auto", "sql"):
        assert {x["kmer"]: x["count"] for x in C.count_kmers(df, k, canonical=canonical, engine=engine).collect()} == expected
    assert {x["kmer"] for x in C.distinct_kmers(df, k, canonical=canonical).collect()} == expected.keys()
    quals = spark.createDataFrame([(s, "I" * 50 + "!" + "I" * 120 if s else s) for s in seqs], "seq string, qual string")
    tables = [{x["kmer"]: x["count"] for x in C.count_kmers(quals, k, qual="qual", min_qual=40, canonical=canonical, engine=e).collect()} for e in ("auto", "sql")]
    assert tables[0] == tables[1] != expected


@pytest.mark.parametrize("canonical", [True, False])
def test_pieces_are_packed_before_their_windows(spark, canonical):
    from kmerspark.operators import extract

    df = spark.createDataFrame([("ACGTTGCANNACGGGTTTACAGTACCAGTTTGACCAAACGT",), ("T" * 31,), ("A" * 31,)], "seq string")
    for k in (1, 9, 30, 31):
        assert Counter(x["kmer"] for x in extract.spelled(extract.packed_kmers(df, k, canonical=canonical), k).collect()) == plain([x["seq"] for x in df.collect()], k, canonical)
    plan = extract.packed_kmers(df, 9, canonical=canonical)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = next(i for i, line in enumerate(plan) if "explode(sequence(" in line)
    assert any("conv(" in line for line in plan[windows + 1 :]) and not any("conv(" in line for line in plan[:windows])


def test_a_counter_is_built_once_for_its_file(spark, tmp_path):
    from kmerspark.operators import sketch

    made = spark.sparkContext.accumulator(0)
    counts = spark.createDataFrame([("ACGTACGTA", 1), ("CCCCCCCCC", 2), ("TTTTTTTTT", 1)], "kmer string, count long")
    shape = sketch.Counter.sized(9, 3, 0.01)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    cells = sketch.bloom_counter(counts, shape).mapInArrow(seen, "block long, cells binary")
    sketch.write_counter(cells, str(tmp_path / "x.bc"), shape)
    assert made.value == 1  # the one block
    back, again = sketch.read_counter(spark, str(tmp_path / "x.bc"))
    assert {x["kmer"]: x["seen"] for x in sketch.check(counts, back, again).collect()} == {"ACGTACGTA": 1, "CCCCCCCCC": 2, "TTTTTTTTT": 1}


@pytest.mark.parametrize("k,canonical", [(1, True), (5, True), (5, False), (8, True), (9, True)])
def test_windows_of_a_text(k, canonical):
    for text in ("ACGGTTAC", "acgNNacgttgca", "", None, "ACGTACGT", "ACG"):
        runs = "".join(c if c in "ACGT" else " " for c in (text or "").upper()).split()
        mers = [run[i : i + k] for run in runs for i in range(len(run) - k + 1)]
        assert list(string_mers(text, k, canonical)) == [min(m, m[::-1].translate(str.maketrans("ACGT", "TGCA"))) if canonical else m for m in mers]
