"""Extraction, counting and what is made of counts, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerspark.functions import alphabet as A
from kmerspark.functions import helpers as H
from kmerspark.functions.udtf import register, string_canonicals, string_mers
from kmerspark.memory import largest_size, slot_layout, table_bytes
from kmerspark.operators import count as C
from kmerspark.operators import encode, extract, lookup, setops, summarize
from kmerspark.operators.collections import Kmer, KmerCounter, KmerDatabase, KmerSet

EDGE = ["", "ACG", "NNNNNNNNNN", "acgtacgtacgt", "ACGUACGUACGTRYK-ACGTT", "ACGT", "AAAAAAAAAA", None, "ACGT ACGTAẗCGTT"]


def reads(seed=0, n=60):
    r = random.Random(seed)
    return EDGE + ["".join(r.choice("ACGTacgtN") if r.random() < 0.2 else r.choice("ACGT") for _ in range(r.randrange(0, 120))) for _ in range(n)]


def plain(seqs, k, canonical=False):
    out = Counter()
    for s in seqs:
        out.update(string_mers(s, k, canonical))
    return dict(out)


def table(df):
    return {r["kmer"]: r["count"] for r in df.collect()}


def frame(spark, seqs, quals=None):
    return spark.createDataFrame([(i, s, (quals or {}).get(i)) for i, s in enumerate(seqs)], "rid long, seq string, qual string")


@pytest.mark.parametrize("k,canonical", [(1, True), (4, False), (4, True), (9, True), (31, True)])
@pytest.mark.parametrize("engine", ["sql", "arrow"])
def test_count_equals_plain(spark, k, canonical, engine):
    seqs = reads(k)
    assert table(C.count_kmers(frame(spark, seqs), k, canonical=canonical, engine=engine)) == plain(seqs, k, canonical)


@pytest.mark.parametrize("k", [32, 100])
def test_long_keys(spark, k):
    seqs = reads(k)
    assert table(C.count_kmers(frame(spark, seqs), k, canonical=True)) == plain(seqs, k, True)
    with pytest.raises(ValueError):
        C.count_kmers(frame(spark, seqs), k, engine="arrow")


def test_partition_count_does_not_matter(spark):
    df = frame(spark, reads(5))
    assert table(C.count_kmers(df.repartition(1), 6)) == table(C.count_kmers(df.repartition(7), 6))


def test_long_sequences_are_cut_without_loss(spark, monkeypatch):
    r = random.Random(2)
    seq = "".join(r.choice("ACGT") for _ in range(3000)) + "N" + "".join(r.choice("ACGT") for _ in range(700))
    monkeypatch.setattr(extract, "STEPS", (500, 60, 7))
    monkeypatch.setattr(encode, "PIECE", 333)
    expected = plain([seq], 11)
    for engine in ("sql", "arrow"):
        assert table(C.count_kmers(frame(spark, [seq]), 11, engine=engine)) == expected
    rows = extract.kmers_at(frame(spark, [seq]), 11, ["rid"]).collect()
    assert sorted((x["pos"], x["kmer"]) for x in rows) == [(i, seq[i : i + 11]) for i in range(len(seq) - 10) if "N" not in seq[i : i + 11]]


def test_quality_masks(spark):
    r = random.Random(4)
    seqs = [s for s in reads(4) if s]
    quals = {i: "".join(chr(r.randrange(33, 105)) for _ in s) for i, s in enumerate(seqs) if i % 5}
    masked = ["".join("N" if i in quals and ord(quals[i][j]) < 64 else c for j, c in enumerate(s)) for i, s in enumerate(seqs)]
    for engine in ("sql", "arrow"):
        got = table(C.count_kmers(frame(spark, seqs, quals), 5, qual="qual", min_qual=64, engine=engine))
        assert got == plain(masked, 5)
        assert table(C.count_kmers(frame(spark, seqs, quals), 5, qual="qual", min_qual=33, engine=engine)) == plain(seqs, 5)


def test_quality_thresholds():
    assert H.quality_threshold("@") == H.quality_threshold(min_quality=0) == 64
    assert H.quality_threshold("C") == H.quality_threshold(min_quality=34, quality_start=33)
    assert H.quality_threshold() is None
    for bad in ({"min_qual_char": "@", "min_quality": 1}, {"min_qual_char": "é"}, {"min_quality": 99}):
        with pytest.raises(ValueError):
            H.quality_threshold(**bad)


def test_prefilters_restriction_and_bounds(spark):
    seqs = reads(1)
    all_ = plain(seqs, 5)
    df = frame(spark, seqs)
    assert table(C.count_kmers(df, 5, prefilter="minus1")) == {m: n - 1 for m, n in all_.items() if n > 1}
    assert table(C.count_kmers(df, 5, prefilter="exact2")) == {m: n for m, n in all_.items() if n > 1}
    first = C.count_kmers(frame(spark, reads(9)), 5)
    twice = {m for m, n in plain(reads(9), 5).items() if n > 1}
    assert table(C.count_kmers(df, 5, prefilter="exact2", seen_twice=first)) == {m: n for m, n in all_.items() if m in twice}
    only = spark.createDataFrame([("ACGTA",), ("ACGTA",), ("GGGGC",)], "kmer string")
    got = table(C.count_kmers(df, 5, only=only))
    assert got == {m: all_.get(m, 0) for m in ("ACGTA", "GGGGC")}
    assert 0 not in table(C.count_kmers(df, 5, only=only, lower=1)).values()
    assert table(C.count_kmers(df, 2, lower=3, saturate_bytes=1)) == {m: min(n, 255) for m, n in plain(seqs, 2).items() if n >= 3}
    assert table(C.saturate(C.count_kmers(df, 2), 8)) == plain(seqs, 2)
    with pytest.raises(ValueError):
        C.count_kmers(df, 5, prefilter="other")


def test_doubled_input_makes_the_prefilter_a_no_op(spark):
    seqs = reads(3) * 2
    assert table(C.count_kmers(frame(spark, seqs), 7, prefilter="exact2")) == plain(seqs, 7)


def test_palindromes_count_once_an_occurrence(spark):
    assert table(C.count_kmers(frame(spark, ["ACGT", "acgt"]), 4, canonical=True)) == {"ACGT": 2}


@pytest.mark.parametrize("low,high,inc", [(1, 10_000, 1), (3, 20, 4), (5, 9, 2), (1, 3, 7)])
def test_histogram(spark, low, high, inc):
    values = [0, 1, 1, 2, 3, 4, 5, 8, 9, 10, 11, 19, 20, 24, 25, 10_001, 30_000]
    counts = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "kmer string, count long")
    base, ceil, n = summarize.bucket_bounds(low, high, inc)
    expected = Counter(base + (0 if v < base else n - 1 if v > ceil else (v - base) // inc) * inc for v in values)
    assert {r["bucket"]: r["n"] for r in summarize.histogram(counts, low, high, inc).collect()} == dict(expected)
    full = {r["bucket"]: r["n"] for r in summarize.histogram(counts, low, high, inc, True).collect()}
    assert len(full) == n and {b: c for b, c in full.items() if c} == dict(expected)


def test_histogram_rejects_bad_bounds():
    for bad in ((5, 4, 1), (1, 4, 0)):
        with pytest.raises(ValueError):
            summarize.bucket_bounds(*bad)


def test_stats_count_zero_keys_as_distinct(spark):
    counts = spark.createDataFrame([("A", 0), ("C", 1), ("G", 7)], "kmer string, count long")
    assert tuple(summarize.stats(counts).first()) == (1, 3, 8, 7)
    assert tuple(summarize.stats(counts, 2, 9).first()) == (0, 1, 7, 7)
    assert tuple(summarize.stats(counts.limit(0)).first()) == (0, 0, 0, 0)


def test_merging(spark):
    sets = [reads(i) for i in (1, 2, 3)]
    tables = [C.count_kmers(frame(spark, s), 4) for s in sets]
    counts = [plain(s, 4) for s in sets]
    keys = set().union(*counts)
    each = {m: [c.get(m, 0) for c in counts] for m in keys}
    assert table(setops.merge(tables)) == {m: sum(v) for m, v in each.items()} == plain(sum(sets, []), 4)
    assert table(setops.merge(tables, "max")) == {m: max(v) for m, v in each.items()}
    assert table(setops.merge(tables, "min")) == {m: min(v) for m, v in each.items() if min(v)}
    assert table(setops.merge(tables, "min", lower=0)) == {m: min(v) for m, v in each.items()}
    assert table(setops.merge(tables, lower=10, upper=20)) == {m: sum(v) for m, v in each.items() if 10 <= sum(v) <= 20}
    j = setops.jaccard(tables).first()
    assert j["jaccard"] == pytest.approx(sum(min(v) > 0 for v in each.values()) / len(keys))
    assert j["wjaccard"] == pytest.approx(sum(map(min, each.values())) / sum(map(max, each.values())))
    matrix = {r["kmer"]: [r["a"], r["b"], r["c"]] for r in setops.count_matrix(dict(zip("abc", tables))).collect()}
    assert matrix == each
    empty = [t.limit(0) for t in tables]
    assert tuple(setops.jaccard(empty).first()) == (None, None)
    with pytest.raises(ValueError):
        setops.merge(tables[:1])


def test_lookups(spark):
    seqs = reads(6)
    counts = C.count_kmers(frame(spark, seqs), 5, canonical=True)
    expected = plain(seqs, 5, True)
    asked = ["acgta", "ACGTACC", "ACG", "ACGNA", "TTTTT"]
    got = lookup.query(counts, spark.createDataFrame([(a,) for a in asked], "mer string"), 5, True).collect()
    keys = [str(Kmer(a[:5]).canonical()) for a in asked if len(a) >= 5 and set(a[:5].upper()) <= set("ACGT")]
    assert sorted((r["mer"], r["count"]) for r in got) == sorted((m, expected.get(m, 0)) for m in keys)
    per = {r["rid"]: r["counts"] for r in lookup.query_per_read(counts, frame(spark, seqs), 5, ["rid"], canonical=True).collect()}
    assert per == {i: [expected[m] for m in string_canonicals(s, 5)] for i, s in enumerate(seqs) if list(string_mers(s, 5))}
    classes = lookup.query_classes(counts, spark.createDataFrame([(a,) for a in asked], "mer string"), 5, True).collect()
    assert max(r["count"] for r in classes) <= 2


def test_weighted_and_conditional_addition(spark):
    mers = spark.createDataFrame([("AC", 3), ("AC", 4), ("GT", 1)], "kmer string, value long")
    assert table(C.add_weighted(mers)) == {"AC": 7, "GT": 1}
    counts = spark.createDataFrame([("AC", 1), ("TT", 2)], "kmer string, count long")
    assert table(C.update_add(counts, mers)) == {"AC": 8, "TT": 2}
    c = KmerCounter(spark, 2).add(mers.select("kmer")).add(mers, "value")
    assert (c.get("AC"), c.get("GT"), c.get("CC"), c.size()) == (9, 2, None, 2)
    assert c.new_keys(spark.createDataFrame([("AC",), ("CC",)], "kmer string")).collect()[0][0] == "CC"
    assert c.update_add(spark.createDataFrame([("AC",), ("CC",)], "kmer string")).get("CC") is None
    s = KmerSet(mers).add(spark.createDataFrame([("TT",)], "kmer string"))
    assert "TT" in s and "CC" not in s and s.size() == 3
    db = KmerDatabase(counts, 2)
    assert db["ac"] == 1 and db["GG"] == 0 and dict(db) == {"AC": 1, "TT": 2}


def test_algebra(spark):
    r = random.Random(8)
    mers = ["".join(r.choice("ACGT") for _ in range(r.randrange(1, 32))) for _ in range(100)] + ["AAAA", "ACGT", "T" * 31]
    df = spark.createDataFrame([(m,) for m in mers], "m string")
    left, popped_l = A.shift_left("m", F.lit("g"))
    right, popped_r = A.shift_right("m", F.lit("T"))
    bad, _ = A.shift_left("m", F.lit("Z"))
    rows = df.select("m", A.reverse_complement("m").alias("rc"), A.canonical("m").alias("c"), left.alias("l"), popped_l.alias("pl"), right.alias("r"), popped_r.alias("pr"), bad.alias("bad"), A.is_homopolymer("m").alias("h"), A.pack("m").alias("p"), A.base_at("m", 0).alias("b0"), A.get_bits("m", 1, 3).alias("bits"), A.reverse_complement(A.reverse_complement("m")).alias("twice")).collect()
    for x in rows:
        k = Kmer(x["m"])
        assert x["rc"] == str(k.reverse_complement()) and x["c"] == str(k.canonical()) and x["twice"] == x["m"] and x["c"] <= x["m"]
        assert (Kmer(x["l"]), x["pl"]) == k.shift_left("G") and (Kmer(x["r"]), x["pr"]) == k.shift_right("T")
        assert x["bad"] is None and x["h"] == k.is_homopolymer() and x["p"] == k.packed() and x["b0"] == k[0] and x["bits"] == k.get_bits(1, 3)
        assert Kmer.unpack(k.packed(), k.k) == k
    for k in {len(m) for m in mers}:
        same = df.filter(F.length("m") == k)
        assert all(x["m"] == x["u"] for x in same.select("m", A.unpack(A.pack("m"), k).alias("u")).collect())
        assert same.orderBy("m").collect() == same.orderBy(A.pack("m")).collect()
    one = spark.range(1)
    v = one.select(A.parse(F.lit("acgtt"), 3).alias("a"), A.parse(F.lit("ac"), 3).alias("b"), A.parse(F.lit("acn"), 3).alias("c"), A.complement_base(F.lit("n")).alias("d"), A.complement_base(F.lit("a")).alias("e"), A.code(F.lit("t")).alias("f"), A.code(F.lit("x")).alias("g"), A.base_of_code(F.lit(2)).alias("h"), A.complement_code(F.lit(1)).alias("i"), A.set_base(F.lit("ACGT"), 0, "A").alias("j"), A.poly("C", 3).alias("k"), A.set_bits(F.lit("AAAA"), 2, 2, 3, 4).alias("l"), A.not_dna(F.lit("-")).alias("m"), A.is_valid(F.lit("ACGN")).alias("n"), F.length(A.random_mer(9, 1)).alias("o")).first()
    assert tuple(v) == ("ACG", None, None, "N", "T", 3, -1, "G", 2, "ACGA", "CCC", "AATA", True, False, 9)
    with pytest.raises(ValueError):
        Kmer("ACX")


def test_udtf(spark):
    register(spark)
    rows = spark.sql("SELECT kmer FROM kmers('acgtNacg', 3, true)").collect()
    assert [r[0] for r in rows] == list(string_canonicals("acgtNacg", 3))


def test_helpers():
    assert H.parse_size("10M") == 10_000_000 and H.parse_size("7") == 7 and H.parse_size("4k") == 4000
    assert H.format_size(4_521_043_056, 1024) == "4G" and H.format_size(999) == "999" and H.format_size(1_073_741_824) == "1G"
    assert [H.ceil_log2(x) for x in (1, 2, 3, 8, 9)] == [0, 1, 2, 3, 4] and H.floor_log2(9) == 3 and H.bit_size(0) == 1
    assert H.reverse_bits(0b1101, 4) == 0b1011 and H.first_false(0, 10, lambda x: x < 7) == 7 and H.div_ceil(7, 2) == 4
    assert [H.slice_of(i, 3, 10) for i in range(3)] == [(0, 4), (4, 8), (8, 10)]
    assert H.bloom_size(100, 0.01) == (1000, 7) and H.bloom_size(100, 0.001) == (1400, 10)
    assert H.quote_arg("a b'c") == "'a b'\"'\"'c'"


def test_memory_formula():
    assert slot_layout(25, 7) == (19, 10)
    assert table_bytes(24, 10**9) == 4_521_043_056
    assert largest_size(31, 8 * 10**9) == 1_073_741_824
