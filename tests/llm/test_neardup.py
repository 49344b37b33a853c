import random

import numpy as np
import pyarrow as pa
import pytest

from kmerspark.llm import neardup
from kmerspark.llm.common import maybe_in
from kmerspark.llm.components import connected_components
from kmerspark.llm.neardup import BANDS, Shingler, choose_bands, drop_near_copies, jaccard_join, may_link, overlap, parities, prefix, share


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n)]


def corpus():
    r = random.Random(1)
    out = [None, "", "...", "one two", "One, two!", "one two three four five", "x" * 40_000]
    for size in (1, 2, 7, 40):
        base = words(r, 120)
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = r.choice(words(r, 3))
            out += [" ".join(w)] * r.choice([1, 1, 3])
    w = words(r, 20_000)
    out += [" ".join(w), " ".join([*w[:-900], *words(r, 900)])]
    chain = words(r, 300)  # each near the next one, the ends far from one another
    for i in range(12):
        out.append(" ".join(chain))
        chain[20 * i : 20 * i + 20] = words(r, 20)
    return out


def brute(texts):
    s = Shingler()
    sets = [frozenset(s(t).tolist()) for t in texts]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9
    links = [[j for j in range(len(sets)) if j != i and near(sets[i], sets[j])] for i in range(len(sets))]
    cls = list(range(len(sets)))
    for _ in sets:
        cls = [min([c, *(cls[j] for j in links[i])]) for i, c in enumerate(cls)]
    return {i: (cls[i], len(links[i]), len({texts[j] or "" for j in links[i]} - {texts[i] or ""})) for i in range(len(sets))}


@pytest.mark.parametrize("most,shingles", [(384, 10**6), (7, 10**6), (384, 3000)])
def test_join_equals_brute_force(spark, docs_of, monkeypatch, most, shingles):
    monkeypatch.setattr(neardup, "MAX_TEXTS", most)
    monkeypatch.setattr(neardup, "MAX_SHINGLES", shingles)
    texts = corpus()
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_text_links"]) for r in jaccard_join(docs_of(texts)).collect()}
    assert got == brute(texts)


def test_deduplication(spark, docs_of):
    texts = corpus()
    kept = sorted(r["doc_id"] for r in drop_near_copies(docs_of(texts)).collect())
    assert kept == sorted({c for c, _, _ in brute(texts).values()})
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (None, "other words"), (None, "other words")]
    assert sorted(str(r["doc_id"]) for r in drop_near_copies(docs_of(rows)).collect()) == ["4", "None"]
    assert drop_near_copies(docs_of([])).collect() == []


def test_one_row_of_each_class_stays_whatever_its_id(spark, docs_of):
    r = random.Random(6)
    a, b, c = (words(r, 100) for _ in range(3))
    near = lambda w, i: " ".join([*w[:i], "zzz", *w[i + 1 :]])
    rows = [(None, " ".join(a)), (None, near(a, 3)), (7, near(a, 50)), (None, " ".join(b)), (None, near(b, 9)), (7, " ".join(c)), (7, near(c, 4)), (7, near(c, 4)), (None, None), (None, ""), (7, "...")]
    texts = [t for _, t in rows]
    kept = [(x["doc_id"], x["text"]) for x in drop_near_copies(docs_of(rows)).collect()]
    classes = brute(texts)
    assert len(kept) == len({k[0] for k in classes.values()}) == 4
    assert sorted(classes[texts.index(t)][0] for _, t in kept) == sorted({k[0] for k in classes.values()})
    assert (7, near(a, 50)) in kept and (7, "...") in kept


def test_banding_reaches_its_recall():
    bands, rows = choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    with pytest.raises(ValueError):
        choose_bands(0.1, 0.9999999, 2)


def test_links_right_at_the_threshold(spark, docs_of):
    """Pairs of a similarity of 0.8 that 24 bands of 5 rows missed."""
    texts = []
    for seed in (17563, 45981):
        same = [f"{seed:x}w{i}" for i in range(49)]
        texts += [" ".join(same), " ".join([*same[:44], *(f"{seed:x}v{i}" for i in range(5))])]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_text_links"]) for r in jaccard_join(docs_of(texts)).collect()}
    assert got == {i: (i - i % 2, 1, 1) for i in range(4)} == brute(texts)
    bands, rows = choose_bands()
    assert (1 - 0.8**rows) ** bands <= 1e-7


def test_only_texts_of_clusters_are_shuffled(spark, docs_of):
    ids = [3, None, 900, -7]
    rows = docs_of([(i, "a") for i in [*range(1000), None, -7, -7]], clash=False)
    got = [r["doc_id"] for r in maybe_in(rows, rows["doc_id"], spark.createDataFrame([(i,) for i in ids], "rep long")).collect()]
    assert got.count(-7) == 2 and set(ids) <= set(got) and len(got) < 100
    assert maybe_in(rows, rows["doc_id"], rows.select("doc_id").limit(0)).collect() == []


def test_links_that_no_band_finds(spark, docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "signature", lambda shingles: np.random.default_rng().integers(0, 1 << 62, BANDS))
    texts = corpus()
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_text_links"]) for r in jaccard_join(docs_of(texts)).collect()}
    assert got == brute(texts)


def test_parities_tell_of_sets_that_are_not_linked():
    r = random.Random(10)
    for n, m, same in ((120, 140, 80), (64, 66, 30), (1000, 1100, 600), (4000, 4200, 2500)):
        base = r.sample(range(1 << 60), n + m - same)
        x, y = (np.array(sorted(s), np.uint64) for s in (base[:n], base[n - same :]))
        assert not may_link(n, parities(x), m, parities(y)) and not may_link(m, parities(y), n, parities(x))
        assert may_link(n, parities(x), n, parities(x))


def test_linked_sets_share_their_prefix():
    r = random.Random(8)
    for _ in range(10_000):
        a = r.randrange(1, r.choice((10, 90, 90)))
        base = r.sample(range(1 << 30), 2 * a)
        cut, more = r.randrange(a // 5 + 1), r.randrange(a // 4 + 1)
        x, y = set(base[:a]), set(base[cut : a + more])
        if len(x & y) >= 0.8 * len(x | y) - 1e-9:
            p, q = (set(prefix(np.array(sorted(s), np.uint64)).tolist()) for s in (x, y))
            assert may_link(len(x), parities(np.array(sorted(x), np.uint64)), len(y), parities(np.array(sorted(y), np.uint64)))
            assert len(p & q) >= share(min(len(x), len(y))) >= max(share(overlap(len(x))), share(overlap(len(y))))


@pytest.mark.parametrize("rows", [1, 2, 3, 50])
def test_shingles_of_several_nodes(rows):
    r = random.Random(9)
    table = sorted((r.randrange(12), r.randrange(4)) for _ in range(40)) + [(99, 1), (99, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t[i] for t in table[j : j + rows]], pa.int64()) for i in range(2)], names=["g", "node"]) for j in range(0, len(table), rows)]
    got = [tuple(t.values()) for b in neardup._shared(iter(batches)) for t in b.to_pylist()]
    assert got == [t for t in sorted(set(table)) if len({x for g, x in table if g == t[0]}) > 1]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    df = spark.createDataFrame(edges, "u long, v long")
    comp = {}
    for u, v in edges:
        comp.setdefault(u, u), comp.setdefault(v, v)
    for _ in range(len(comp)):
        for u, v in edges:
            comp[u] = comp[v] = min(comp[u], comp[v])
    touched = {x for u, v in edges if u != v for x in (u, v)}
    assert {r["node"]: r["comp"] for r in connected_components(df, "t").collect()} == {x: comp[x] for x in touched}
    assert connected_components(df.limit(0), "t").collect() == []
