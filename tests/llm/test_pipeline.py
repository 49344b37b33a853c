import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kmerspark.llm import decontaminate, neardup, toxicity
from kmerspark.llm.common import materialize, read_table
from kmerspark.llm.tokens import END_ID, WordEncoder, tokenizer_path

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_and_run_equal_a_plain_version(spark):
    docs = read_table(spark, SF, "documents")
    columns, kept = docs.columns, docs
    texts = {r["doc_id"]: r for r in docs.collect()}
    results = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in kept.collect()}
        kept = materialize(stage(spark, kept, SF), "stage")
        results.append((name, before, kept))
        assert kept.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    left = [sorted(r["doc_id"] for r in k.collect()) for _, _, k in results]
    model = toxicity.train(docs, read_table(spark, SF, "labels"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).filter("toxic").collect()}
    assert toxic and left[0] == sorted(set(texts) - toxic)
    shingles, reps = neardup.Shingler(), []
    cls = {i: set(shingles(texts[i]["text"]).tolist()) for i in left[0]}
    parent = {i: i for i in cls}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in cls:
        for j in cls:
            if i < j and len(cls[i] & cls[j]) >= 0.8 * len(cls[i] | cls[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    reps = sorted({find(i) for i in cls})
    assert left[1] == reps and len(reps) < len(cls)
    words = decontaminate.Words()
    items = [words(r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    clean = [i for i in reps if not any(sum(t[2] for t in decontaminate.tiles(w, words(texts[i]["text"]))) >= 0.5 * len(w) for w in items)]
    assert left[2] == clean and left[3] == clean and len(clean) < len(reps)
    encoder = WordEncoder(tokenizer_path())
    final = results[-1][2].orderBy("start").collect()
    ids = {i: encoder.tokenizer.encode(texts[i]["text"] or "", add_special_tokens=False).ids + [END_ID] for i in clean}
    at = 0
    for r in final:
        x = ids.pop(r["doc_id"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert not ids
    # the token files follow the mixed stream: every prefix has the sources at their shares
    share = {r["source"]: r["count"] / len(clean) for r in results[3][2].groupBy("source").count().collect()}
    have = dict.fromkeys(share, 0)
    for n, r in enumerate(final, 1):
        have[texts[r["doc_id"]]["source"]] += 1
        assert all(abs(have[s] - share[s] * n) < 3 * 4 for s in share)
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, results[-1][2].select(run.columns).collect()))
    assert run.filter(F.col("n_tokens") < 1).count() == 0


NAMES = "_id long, _source string, _place long, _file string, _row long, _gone long, toxic string, severity string, n_items string, best_item string, coverage string, contaminated string, slot string, block string, position string, place long, comp long, h1 long, `a.b` string"


def odd_docs(spark, n=4):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns named as the operators name theirs."""
    words = "the river stone cloud lamp table green walk paper house road light water wind fire glass".split()
    text = lambda i, k: " ".join(words[(i * j + j // 7 + i) % len(words)] + str(i) for j in range(k))
    rows = [(None, None, None), (1, None, "a"), (1, None, "a"), (2, "", "b"), (3, "one", None), (None, text(5, 60), "a"), (None, text(5, 60), "a"), (None, text(6, 60), None), (7, text(7, 80), "b"), (7, text(8, 80), "b"), (9, text(9, 60_000), "a"), (10, text(10, 70), "a"), (11, text(10, 70), "c")]
    extra = [None if "long" in c else "kept" for c in NAMES.split(", ")]
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, source string, {NAMES}").repartition(n), rows


def test_stages_on_odd_rows(spark, tmp_path):
    docs, rows = odd_docs(spark)
    sf = str(tmp_path)
    spark.createDataFrame([(1, 0), (7, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, rows[11][1]), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    texts = lambda df: sorted(((x["doc_id"], x["text"], x["source"], x["contaminated"], x["a.b"]) for x in df.collect()), key=str)
    expected = [(*r, "kept", "kept") for r in rows]
    kept, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, sf), "stage")
        assert kept.columns == docs.columns, name
        left.append(texts(kept))
    assert left[0] == sorted(expected, key=str)
    ids = [(x[0], x[1]) for x in left[1]]
    assert len(ids) == len(set(ids)) == 8 and {t for _, t in ids} >= {rows[i][1] for i in (4, 5, 7, 8, 9, 10, 11)} - {None}
    assert {x[1] for x in left[1]} - {x[1] for x in left[2]} == {rows[11][1]} and left[3] == left[2]
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert sorted((x["doc_id"] for x in out), key=str) == sorted((x[0] for x in left[3]), key=str) and sum(x["start"] == 0 for x in out) == 1
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert materialize(stage(spark, empty, sf), "stage").collect() == [], name


def test_files_are_read_in_the_order_of_their_numbers(spark, tmp_path):
    for i, name in enumerate(["part-99999-x.parquet", "part-100000-x.parquet"]):
        pq.write_table(pa.table({"doc_id": pa.array([2 * i, 2 * i + 1]), "text": ["a b", "c"]}), f"{tmp_path}/{name}")
    files = spark.read.parquet(str(tmp_path))
    for docs in (files, spark.createDataFrame([(i, "a") for i in range(4)], "doc_id long, text string").coalesce(1)):
        rows = corpus_pipeline.write_tokens(spark, docs, "").orderBy("start").collect()
        assert [x["doc_id"] for x in rows] == [0, 1, 2, 3]
