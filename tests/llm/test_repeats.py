import hashlib
import random

import numpy as np
import pytest

from kmerspark.llm import repeats
from kmerspark.llm.repeats import remove_repeats, runs_of
from kmerspark.llm.suffixes import Transform, merged_transforms


def brute(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def text(r, n, letters="abcdefghij "):
    return "".join(r.choice(letters) for _ in range(n))


def corpora():
    r = random.Random(1)
    a, b, passage = text(r, 900), text(r, 500), text(r, 260)
    near = [a[:i] + "X" + a[i + 1 :] for i in (0, 50, 99, 100, 450, 899)]
    yield []
    yield [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "x" * 400]
    yield [a, b, a, None, b[:99], b[:100], b[1:], *near, passage.join([text(r, 40), text(r, 90), text(r, 200)]), passage]
    yield ["ab" * 300, "ba" * 200, ("word " * 100) + a[:150], "é" * 120, "aé😀" * 60, a[200:450] + "aé😀" * 60]
    yield [text(r, r.randrange(0, 400), "ab") for _ in range(60)]
    yield [a] * 40 + [a[: 100 + i] + text(r, 30) + a[300 + i :] for i in range(40)]


@pytest.mark.parametrize("texts", list(corpora()))
@pytest.mark.parametrize("shard,variants", [(1 << 18, 50_000), (700, 1)])
def test_removal_equals_brute_force(spark, docs_of, monkeypatch, texts, shard, variants):
    monkeypatch.setattr(repeats, "MAX_VARIANTS", variants)
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "BUCKET", 4 * shard)
    monkeypatch.setattr(repeats, "PIECE", 1500)
    monkeypatch.setattr(repeats, "UNIT", 7)
    got = {r["doc_id"]: r for r in remove_repeats(docs_of(texts)).collect()}
    for i, e in enumerate(brute(texts)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == e, i
        assert sum(s["end"] - s["start"] for s in r["spans"]) == e[1] and len(r["spans"]) == e[2]
    assert len(got) == len(texts)


def test_order_is_by_id_not_by_row(spark, docs_of):
    r = random.Random(2)
    a = text(r, 300)
    got = {x["doc_id"]: x["n_removed"] for x in remove_repeats(docs_of([(9, a), (3, a), (5, a[100:])])).collect()}
    assert got == {3: 0, 5: 200, 9: 300}
    rows = remove_repeats(docs_of([(1, a), (1, a), (None, a)])).collect()
    assert sorted((x["doc_id"] or 0, x["n_removed"]) for x in rows) == [(0, 0), (1, 300), (1, 300)]


def test_equal_windows_have_equal_anchors():
    r = random.Random(3)
    p = text(r, 180, "ab").encode()
    texts = [text(r, 77).encode() + p + text(r, 50).encode(), p, text(r, 200).encode() + p]
    found, where = {}, [(0, 77), (1, 0), (2, 200)]
    for t, s, n, off, g, v in zip(*(x.tolist() for x in runs_of(texts))):
        for j in range(n):
            found[t, s + j] = (g, off - j)
    for j in range(81):
        assert len({found[t, at + j] for t, at in where}) == 1
    assert len(found) == sum(len(t) - 99 for t in texts)


def joined(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings], dtype=np.int64)


def test_transform_is_the_sorted_suffixes_and_walks_back_through_each_string():
    r = random.Random(4)
    strings = [text(r, r.randrange(0, 200), "ab\0").encode() for _ in range(30)] + [b"a" * 150, b"a" * 151, b""]
    for length in (1, 7, 8, 50, 100):
        t = Transform(*joined(strings), length)
        suffixes = [strings[k][i : i + length] for k, i in zip(t.string.tolist(), t.into.tolist())]
        assert suffixes == sorted(s[i : i + length] for s in strings for i in range(len(s) + 1))
        for k, s in enumerate(strings):
            at = next(x for x in range(len(t.into)) if (t.string[x], t.into[x]) == (k, len(s)))
            back = bytearray()
            for _ in s:
                back.append(t.before[at])
                at = t.link[at]
            assert bytes(back[::-1]) == s and t.into[at] == 0


@pytest.mark.parametrize("length", [99, 100, 3])
@pytest.mark.parametrize("n", [1, 11, 1000])
def test_merged_transforms_are_the_sorted_windows(n, length):
    r = random.Random(6)
    strings = [text(r, r.randrange(0, 160), "ab").encode() for _ in range(40)] + [b"a" * 150, b"a" * 151, b"ab" * 70, bytes(range(256))]
    shards = [Transform(*joined(strings[i : i + n]), length) for i in range(0, len(strings), n)]
    shard, string, into, new = merged_transforms(shards, length)
    windows = [strings[n * a + k][i : i + length] for a, k, i in zip(shard.tolist(), string.tolist(), into.tolist())]
    assert windows == sorted(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    assert new.tolist() == [i == 0 or windows[i] != windows[i - 1] for i in range(len(windows))]
    assert len(set(zip(shard.tolist(), string.tolist(), into.tolist()))) == len(windows)


def test_nothing_merges_to_nothing():
    assert [len(x) for x in merged_transforms([], 100)] == [0] * 4
    assert [len(x) for x in merged_transforms([Transform(*joined([b"", b"short"]), 100)], 100)] == [0] * 4


def test_lengths_that_fit(spark, docs_of):
    r = random.Random(11)
    a = text(r, 700)
    for length in (41, 60, 234):
        for i, e in enumerate(brute([a, a[100:400], a + a], length)):
            got = {x["doc_id"]: x for x in remove_repeats(docs_of([a, a[100:400], a + a]), length=length).collect()}
            assert (got[i]["n_removed"], got[i]["n_spans"]) == e[1:3]
    for length in (40, 235):
        with pytest.raises(ValueError):
            remove_repeats(docs_of([a]), length=length)


def test_very_long_text(spark, docs_of):
    r = random.Random(12)
    long = text(r, 1_500_000)
    texts = [long[:1_000_000], long, long[700_000:700_300]]
    got = {x["doc_id"]: x for x in remove_repeats(docs_of(texts), texts=False).collect()}
    assert [got[i]["n_removed"] for i in range(3)] == [e[1] for e in brute(texts)] == [0, 1_000_000, 300]


def test_windows_of_a_hot_anchor_are_minima_before_they_are_joined(spark, docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "MAX_VARIANTS", 20)
    frames, write = {}, repeats.materialize

    def kept(df, name):
        frames[name] = write(df, name)
        return frames[name]

    monkeypatch.setattr(repeats, "materialize", kept)
    r = random.Random(9)
    passage = text(r, 160)
    texts = [text(r, 150) + passage + text(r, 150) for _ in range(200)]
    got = {x["doc_id"]: x for x in remove_repeats(docs_of(texts)).collect()}
    for i, e in enumerate(brute(texts)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == e
    windows, heads = frames["repeats-windows"], frames["repeats-heads"]
    assert 61 <= heads.count() == heads.select("name").distinct().count() < windows.count() / 20
