import random
import re

import numpy as np
import pytest

from kmerspark.llm import decontaminate as D
from kmerspark.llm import toxicity as X

CALM, BAD = ["river", "stone", "cloud", "lamp", "table", "green", "walk", "paper"], ["vilest", "vilely", "grubby"]


def labelled(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [r.choice(CALM) + r.choice(["", "s", "y"]) for _ in range(r.randrange(20, 200))]
        y = r.random() < 0.2
        if y:
            for _ in range(max(2, len(w) // r.choice([15, 40]))):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        out.append((i, " ".join(w), int(y)))
    return out


def test_held_out_accuracy(spark):
    rows = labelled(700, 1)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, lang string, severity double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, toxic int")
    model = X.train(docs, labels)
    got = {r["doc_id"]: r for r in X.score(docs, model).collect()}
    held = [(got[i]["toxic"], bool(y)) for i, _, y in rows if not i % 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert not any(a and not b for a, b in held)
    assert all(0 <= r["severity"] <= 2 for r in got.values()) and list(model.cuts) == sorted(model.cuts)
    dense = [got[i]["severity"] for i, t, y in rows if y and sum(w in BAD for w in t.split()) / len(t.split()) > 0.05]
    thin = [got[i]["severity"] for i, t, y in rows if y and sum(w in BAD for w in t.split()) / len(t.split()) < 0.03]
    assert np.mean(dense) > np.mean(thin)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "vilest vilely"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r["toxic"] for r in X.score(docs, X.train(docs, none)).collect())
    clean = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert not any(r["toxic"] for r in X.score(docs, X.train(docs, clean)).collect())
    rows = labelled(200, 3)
    model = X.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    out = X.score(docs, model).collect()
    assert len(out) == 4 and [r["toxic"] for r in out].count(True) == 1
    assert X.score(docs.limit(0), model).collect() == []


def test_bounded_sample(spark):
    rows = labelled(300, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert len(X.train(docs, labels, max_train=150).features) < len(X.train(docs, labels).features) + 50


def test_gradient_fit_orders_grades():
    r = np.random.default_rng(1)
    x = r.random(400)
    grades = np.digitize(x + r.normal(0, 0.05, 400), [0.4, 0.7])
    model = X.fit_ordinal([([0], [float(v)]) for v in x], grades, ["f"], steps=1500, ridge=0.0)
    expected = model.above([([0], [0.1]), ([0], [0.55]), ([0], [0.95])]).sum(axis=1)
    assert expected[0] < 0.3 and 0.6 < expected[1] < 1.4 and expected[2] > 1.6


def test_likelihood_and_gradient_equal_a_plain_version():
    r = np.random.default_rng(2)
    width, top, n = 6, 3, 40
    dense = r.random((n, width)) * (r.random((n, width)) < 0.5)
    grades = r.integers(0, top + 1, n)
    row, col = np.nonzero(dense)
    p = r.normal(0, 0.5, width + top)

    def plain(p):
        cuts, total = [p[width]], 0.0
        for g in p[width + 1 :]:
            cuts.append(cuts[-1] + np.exp(g))
        for x, y in zip(dense, grades):
            up = [1.0] + [1 / (1 + np.exp(-(sum(a * b for a, b in zip(p, x)) - c))) for c in cuts] + [0.0]
            total -= np.log(up[y] - up[y + 1])
        return total / n + 0.01 / 2 * sum(w * w for w in p[:width])

    loss, gradient = X.log_loss(p, (row, col, dense[row, col]), grades, width, 0.01)
    assert loss == pytest.approx(plain(p))
    for i in range(len(p)):
        step = np.zeros(len(p))
        step[i] = 1e-5
        assert gradient[i] == pytest.approx((plain(p + step) - plain(p - step)) / 2e-5, rel=1e-4, abs=1e-7)


def test_scores_equal_a_plain_version(spark):
    rows = labelled(300, 7) + [(900, "vilest " * 60_000 + "river", 1), (901, None, 0)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows], "doc_id long, text string, y int, f string")
    model = X.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    for x in X.score(docs, model).collect():
        found = re.findall(r"[^\W\d_]+", (x["text"] or "").lower())
        counts = {}
        for w in found:
            for f in [w + "$"] + [w[:n] for n in range(3, 9) if n <= len(w)]:
                if f in model.features:
                    counts[f] = counts.get(f, 0) + 1
        z = sum(model.weights[model.features.index(f)] * c / (c + len(found) / 100) ** 0.5 for f, c in counts.items())
        above = [1 / (1 + np.exp(-(z - c))) for c in model.cuts]
        assert x["severity"] == pytest.approx(sum(above), abs=1e-9) and x["toxic"] == (above[0] >= model.threshold)


def test_labels_that_are_grades(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(CALM) for _ in range(60)) + " grubby" * (3 * g), g) for i in range(400) for g in [r.randrange(4)]]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(0, 99), (1, -5), (2, None), (None, 3), (10**6, 3)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    assert len(model.cuts) == 3 and list(model.cuts) == sorted(model.cuts)
    got = {x["doc_id"]: x["severity"] for x in X.score(docs, model).collect()}
    mean = [np.mean([got[i] for i, _, g in rows if g == k]) for k in range(4)]
    assert mean[0] < 0.3 and all(b > a + 0.3 for a, b in zip(mean, mean[1:]))


def brute_tiles(a, b, least):
    fa, fb, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        fa[i : i + n], fb[j : j + n] = [False] * n, [False] * n
        total += n


def test_tiles_equal_brute_force():
    r = random.Random(3)
    for _ in range(300):
        a, b = [r.randrange(1, 6) for _ in range(r.randrange(3, 40))], []
        for _ in range(r.randrange(1, 6)):
            i = r.randrange(len(a))
            b += a[i : i + r.randrange(1, 14)] + [r.randrange(7)] * r.randrange(2)
        found = D.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert all(a[p : p + n] == b[d : d + n] and n >= 3 for p, d, n in found)
        assert sum(n for *_, n in found) == brute_tiles(a, b, 3)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog near the old river bank today"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, "too short"), (4, None), (2, "one two three four five six seven eight nine ten")]


def plain(texts, items, threshold=0.5):
    """Every text with every item: (n_items, best_item, coverage, n_tiles)."""
    words, out = D.Words(), []
    for t in texts:
        held = []
        for k, it in items:
            ids = words(it)
            found = D.tiles(ids, words(t)) if len(ids) else []
            covered = sum(x[2] for x in found) / max(len(ids), 1)
            if found and covered >= threshold:
                held.append((-covered, k is None, k or 0, len(found)))
        c, no, k, n = min(held) if held else (-0.0, True, 0, 0)
        out.append((len(held), None if no else k, -c, n))
    return out


def test_contamination(spark):
    r = random.Random(5)
    noise = lambda n: " ".join(r.choice(["lorem", "ipsum", "the", "of", "and"]) for _ in range(n))
    w = ITEMS[0][1].split()
    texts = {0: ITEMS[0][1], 1: f"{noise(90)} {' '.join(w[8:])}. {noise(70)} {' '.join(w[:8])}, {noise(9)}", 2: noise(300), 3: " ".join(w[:6]) + " " + noise(30), 4: ITEMS[1][1].upper() + " " + ITEMS[4][1], 5: None, 6: "", 7: "Too short!", 8: "far too short", 9: "", 10: noise(60_000) + " " + ITEMS[0][1] + " " + noise(60_000)}
    docs = spark.createDataFrame([(i, t, 0.5, "x", 2) for i, t in [*texts.items(), *texts.items()]], "doc_id long, text string, coverage double, h1 string, n long")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = D.find_contamination(docs, bench).collect()
    got = {x["doc_id"]: x for x in rows}
    assert len(rows) == 2 * len(texts) and rows[0].asDict().keys() == {"doc_id", "text", "h1", "n", *D.RESULT}
    assert sorted(i for i in got if got[i]["contaminated"]) == [0, 1, 4, 7, 10]
    assert (got[0]["best_item"], got[0]["coverage"]) == (1, 1.0) and got[1]["n_tiles"] == 2 and got[1]["coverage"] == 1.0
    assert (got[3]["best_item"], got[3]["coverage"]) == (None, 0.0) and got[4]["n_items"] == 2
    assert not any(x["contaminated"] for x in D.find_contamination(docs, bench.limit(0)).collect())
    assert D.find_contamination(docs.limit(0), bench).collect() == []
    third = {x["doc_id"]: x for x in D.find_contamination(docs, bench, threshold=0.35).collect()}
    assert third[3]["coverage"] == pytest.approx(6 / len(w)) and third[3]["n_tiles"] == 1


@pytest.mark.parametrize("threshold", [0.2, 0.5, 1.0])
def test_contamination_equals_every_pair_tiled(spark, threshold):
    r = random.Random(9)
    text = lambda n, v: " ".join(r.choice("abcdefghijklmnopqrst"[:v]) for _ in range(n))
    line = text(12, 20)
    items = [(i if i % 7 else None, f"{line} {text(r.randrange(1, 40), 20)}") for i in range(40)] + [(3, text(30, 4)), (3, text(30, 4)), (50, line), (50, line), (51, "a b c"), (52, "")]
    texts = [text(r.randrange(0, 200), 4) for _ in range(10)] + [f"{text(30, 20)} {line} {text(9, 20)}" for _ in range(10)]
    for _ in range(60):
        parts = [" ".join(x[a : a + r.randrange(3, 25)]) for x in (r.choice(items)[1].split() for _ in range(4)) for a in [r.randrange(0, len(x) + 1)]]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_items"], x["best_item"], x["coverage"], x["n_tiles"]) for x in D.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), threshold=threshold).collect()}
    expected = plain(texts, items, threshold)
    assert [got[i][:3] for i in range(len(texts))] == [e[:3] for e in expected] and any(e[0] for e in expected)


def test_a_line_that_all_items_share_pairs_nothing(spark, monkeypatch):
    r = random.Random(10)
    line = "choose the best one of the answers that follow and say why"
    own = lambda i: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    items = [(i, f"{line} {own(i)}") for i in range(300)]
    docs = spark.createDataFrame([(i, f"{own(i)} {line} {own(i)}") for i in range(300)] + [(1000 + i, f"{own(i)} {t}") for i, t in items[:20]], "doc_id long, text string")
    frames, write = {}, D.materialize

    def kept(df, name):
        frames[name] = write(df, name)
        return frames[name]

    monkeypatch.setattr(D, "materialize", kept)
    got = {x["doc_id"]: x for x in D.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert frames["contamination-pairs"].count() == 20
    assert sorted(i for i in got if got[i]["contaminated"]) == list(range(1000, 1020)) and all(got[1000 + i]["best_item"] == i for i in range(20))


def test_query_equals_every_pair_tiled(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [tuple(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {x["doc_id"]: (x["n_items"], x["best_item"], x["coverage"], x["n_tiles"], x["contaminated"]) for x in D.op10_query(spark, sf).collect()}
    expected = plain([x["text"] for x in docs], items)
    assert got == {x["doc_id"]: (*e, e[0] > 0) for x, e in zip(docs, expected, strict=True)} and any(e[0] for e in expected)
