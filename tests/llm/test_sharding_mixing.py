import random
import zlib
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from kmerspark.llm.mixing import exact_weights, mix_sources, op9_query, pfair_period, pfair_stream
from kmerspark.llm.oracles import OP9_SQL
from kmerspark.llm.sharding import OP4_SQL, op4_query, shard_by_bytes


def sized(spark, sizes):
    return spark.createDataFrame([(i if isinstance(s, int) else s[0], s if isinstance(s, int) else s[1], "x") for i, s in enumerate(sizes)], "doc_id long, size long, shard string")


def brute(rows, n):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    total, at, out, slots = sum(r[1] for r in rows) or 1, 0, [], {}
    for d, s in rows:
        k = min(n - 1, at * n // total)
        out.append((d, s, at, k, slots.setdefault(k, 0)))
        slots[k] += 1
        at += s
    return out


@pytest.mark.parametrize("sizes", [[], [5], [1] * 40, [3, 1000, 2, 2, 2], [(None, 4), (None, 9), (3, 3), (3, 3), (3, 8), (-2, 1)], [random.Random(1).randrange(1, 500) for _ in range(300)]])
def test_shards_equal_brute_force(spark, sizes):
    df = sized(spark, sizes)
    got = [tuple(r) for r in shard_by_bytes(df, 16).select("doc_id", "size", "start", "shard", "slot").collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute([(r["doc_id"], r["size"]) for r in df.collect()], 16), key=key)


def test_shards_differ_by_less_than_a_row(spark):
    r = random.Random(3)
    sizes = [r.randrange(1, 900) for _ in range(2000)]
    per = [x[1] for x in shard_by_bytes(sized(spark, sizes), 16).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(per) == 16 and max(abs(p - sum(sizes) / 16) for p in per) < max(sizes)


def test_op4_nulls_and_unicode(spark, tmp_path):
    texts = [None, "", "aé😀", "x" * 5000, "dup", "dup"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in op4_query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"], rows[i]["law"], rows[i]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    assert "RECURSIVE" in OP4_SQL


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 500, "b": 499, "c": 1}, {str(i): i + 1 for i in range(30)}])
def test_schedule_keeps_every_prefix_within_a_block(weights):
    w = exact_weights(weights)
    total, got = sum(w.values()), dict.fromkeys(w, 0)
    for t, (s, k) in enumerate(pfair_period(w), 1):
        assert k == got[s]
        got[s] += 1
        assert all(abs(got[x] * total - w[x] * t) < total for x in w)
    assert got == w


def test_exact_weights():
    for bad in ({"a": 0}, {"a": -1, "b": 2}, {}):
        with pytest.raises(ValueError):
            exact_weights(bad)
    assert exact_weights({"a": Fraction(1, 3), "b": Fraction(1, 6), "c": 0.25}) == {"a": 4, "b": 2, "c": 3}
    assert exact_weights({i: 7 for i in range(3000)}) == dict.fromkeys(range(3000), 1)


def test_mix_keeps_every_row_and_the_shares(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["hot"] * 6 + ["a", "b", None]), "t") for i in range(900)] + [(None, "a", "t"), (1, "hot", "t"), (1, "hot", "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    for weights in (None, {"hot": 1, "a": 2, "b": 1, None: 1}, {"a": 3, "hot": 1}):
        got = mix_sources(df, weights, block=3).orderBy("position").collect()
        assert [x["position"] for x in got] == list(range(len(rows)))
        assert sorted((x["doc_id"] is None, x["doc_id"] or 0, str(x["source"])) for x in got) == sorted((x[0] is None, x[0] or 0, str(x[1])) for x in rows)
        sizes = {s: sum(x[1] == s for x in rows) for s in {x[1] for x in rows}}
        w = exact_weights({s: weights.get(s, min(weights.values())) for s in sizes} if weights else sizes)
        blocks = sorted({(x["slot"], x["source"], x["block"]) for x in got}, key=lambda b: b[0])
        alive = min(max(b[0] for b in blocks if b[1] == s) for s in sizes)  # until the first source ends
        have = dict.fromkeys(sizes, 0)
        for slot, s, b in blocks:
            if slot > alive:
                break
            assert b == have[s]
            have[s] += 1
            assert all(abs(have[x] * sum(w.values()) - w[x] * (slot + 1)) < sum(w.values()) for x in sizes)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string")
    assert mix_sources(df).collect() == [] and {"block", "slot", "position"} <= set(mix_sources(df).columns)


@pytest.mark.parametrize("weights", [{"a": 335, "b": 9665}, {"a": 2, "b": 9998}, {"a": 14, "b": 33, "c": 9953}, {i: 2 * i + 1 for i in range(60)}])
def test_stream_keeps_to_the_given_weights(weights):
    w, total = list(weights.values()), sum(weights.values())
    have, n = [0] * len(w), 0
    for i, k, t in pfair_stream(w, [3 * x for x in w]):
        assert (k, t) == (have[i], n)
        have[i], n = have[i] + 1, n + 1
        assert all(abs(h * total - x * n) < total for h, x in zip(have, w, strict=True))
    assert n == 3 * total
    got = [t for i, k, t in pfair_stream([1, 9], [4, 1])]  # the slots of a source that ended stay empty
    assert got[0] == 0 and len(got) == 5 and all(10 * k <= t < 10 * (k + 1) for i, k, t in pfair_stream([1, 9], [4, 1]) if i == 0)


def test_mix_keeps_to_shares_that_a_period_does_not_divide(spark):
    sizes = {"rare": 5, "odd": 34, "third": 804, "rest": 23158}  # 0.0002, 0.0014, 0.0335 of the rows
    total = sum(sizes.values())
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    for weights in (None, {s: Fraction(n, total) for s, n in sizes.items()}):
        rows = mix_sources(docs, weights, block=1).select("slot", "source", "position").orderBy("position").collect()
        assert [x["position"] for x in rows] == list(range(total))
        have = dict.fromkeys(sizes, 0)
        for x in rows:
            have[x["source"]] += 1
            assert all(abs(have[s] * total - sizes[s] * (x["slot"] + 1)) < total for s in sizes)


@pytest.mark.parametrize("sizes", [{"a": 50, "b": 50, "c": 9}, {"a": 401, "b": 37, "c": 9, None: 3, "d": 1}])
def test_op9_on_unequal_sources_equals_sql(spark, tmp_path, sizes):
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "source", "block", "slot", "position"]
    got = op9_query(spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({OP9_SQL})").fetchall(), key=str) and len(got) == len(rows)
    # every prefix of the stream is within a block of the unrounded target, until the first source ends
    target = {s: n**0.5 for s, n in sizes.items()}
    at = {(x["source"], x["block"]): x["slot"] for x in got}
    alive = min(max(t for (s, _), t in at.items() if s == x) for x in sizes)
    have = dict.fromkeys(sizes, 0)
    for (s, _), t in sorted(at.items(), key=lambda x: x[1]):
        if t <= alive:
            have[s] += 1
            assert all(abs(have[x] - target[x] / sum(target.values()) * (t + 1)) < 1.01 for x in sizes)


def test_parts_do_not_change_the_order(spark, monkeypatch):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "a") for i in range(400)], "doc_id long, source string")
    one = sorted(map(tuple, mix_sources(df).collect()))
    monkeypatch.setattr("kmerspark.llm.mixing.PARTS", 3)
    assert sorted(map(tuple, mix_sources(df).collect())) == one
    with pytest.raises(ValueError):
        mix_sources(df, max_sources=1)
