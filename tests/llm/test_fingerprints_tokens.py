import bisect
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerspark.llm import tokens
from kmerspark.llm.common import new_path
from kmerspark.llm.fingerprints import _cuts_up_to, fingerprint, fingerprint_neighbours, likeness, next_in_order, op7_query
from kmerspark.llm.tokens import END_ID, WordEncoder, _Remote, op8_query, open_tokens, read_tokens, tokenizer_path, write_tokens

SF = "/root/testdata/sf0.001"

TEXTS = ["", "a", "ab", "héllo 😀 wörld", "x" * 3000, "The quick brown fox. " * 40, "the same", "the same", None]


def some_text(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(n))


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else min(row[j], new[-1]) + 1)
        row = new
    return row[-1]


def test_likeness_is_an_edit_distance():
    r = random.Random(1)
    for _ in range(60):
        t = some_text(r, r.randrange(1, 900))
        cut = r.randrange(len(t))
        p, q = fingerprint(t.encode()), fingerprint((t[:cut] + some_text(r, 40) + t[cut + r.randrange(200) :]).encode())
        (bp, p1, p2), (bq, q1, q2) = p.split(":"), q.split(":")
        pairs = [(p1, q1), (p2, q2)] if bp == bq else [(p1, q2)] if int(bp) == 2 * int(bq) else [(p2, q1)] if int(bq) == 2 * int(bp) else []
        best = 1.0 if p == q else 0.0
        for a, b in pairs:
            if min(len(a), len(b)) < 5 or any(a[i : i + 5] in b for i in range(len(a) - 4)):
                best = max(best, 1 - indel(a, b) / max(len(a) + len(b), 1)) if a or b else best
        assert likeness([(p, q)])[0] == pytest.approx(best)
        assert max(len(p1), len(q1)) <= 64
    assert likeness([("4::", "4::"), ("4::", fingerprint(b"abcdef"))]).tolist() == [1.0, 0.0]


def test_changes_stay_local_and_strangers_differ():
    r = random.Random(2)
    a = [some_text(r, 400) for _ in range(60)]
    fp = [fingerprint(t.encode()) for t in a]
    near = likeness([(f, fingerprint((t[:1000] + "X" + t[1001:]).encode())) for f, t in zip(fp, a)])
    assert near.mean() > 0.9 and likeness(list(zip(fp, fp[1:]))).mean() < 0.05


def plain_fingerprint(data):
    """The fingerprint once more, a byte at a time."""
    if not data:
        return "4::"
    mask, hashes = (1 << 64) - 1, []
    for i in range(len(data)):
        last = (bytes(7) + data[: i + 1])[-7:]
        h = int.from_bytes(last, "little") * 0x9E3779B97F4A7C15 & mask
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask
        hashes.append(h ^ h >> 32)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def signature(block):
        chunks, total, count = [], 0, 0
        for i, h in enumerate(hashes):
            total, count = (total + h) & mask, count + 1
            if h % block == 0 and len(chunks) < 63:
                chunks.append(total)
                total, count = 0, 0
        if count:
            chunks.append(total)
        return "".join(symbols[(c * 0x9E3779B97F4A7C15 & mask) >> 58] for c in chunks)

    block = 4
    while block * 64 < len(data):
        block *= 2
    while block > 4 and sum(h % block == 0 for h in hashes) < 31:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def test_fingerprint_equals_a_plain_version():
    r = random.Random(4)
    some = [t.encode() for t in TEXTS if t] + [some_text(r, r.randrange(1, 700)).encode() for _ in range(60)] + [bytes(r.randrange(256) for _ in range(5000)), b"ab" * 4000, some_text(r, 6000).encode()]
    for data in some:
        assert fingerprint(data) == plain_fingerprint(data), data[:40]


def test_query_fingerprints_equal_a_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {x["doc_id"]: x for x in op7_query(spark, SF).collect()}
    order = sorted(rows, key=lambda x: -x["doc_id"])
    assert len(got) == len(rows)
    for a, b in zip(order, order[1:] + order[:1]):
        t, nxt = a["text"] or "", b["text"] or ""
        edited = (t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()
        x = got[a["doc_id"]]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(edited).hexdigest())
        if len(t) < 3000:
            assert (x["fingerprint"], x["edited_fingerprint"]) == (plain_fingerprint(t.encode()), plain_fingerprint(edited))


def test_very_long_text(spark, docs_of):
    r = random.Random(5)
    long = some_text(r, 400_000)
    rows = {x["doc_id"]: x for x in fingerprint_neighbours(docs_of([long, long + " end", "short"])).collect()}
    assert rows[0]["n_chars"] == len(long) and rows[1]["near_next"] > 0.9 and len(rows[0]["fingerprint"].split(":")[1]) <= 64


@pytest.mark.parametrize("pieces", [1, 2, 5, 50])
def test_neighbours_meet(spark, docs_of, pieces):
    ids = [5, 3, 900, -4, 17, 2, 1000000, 44]
    df = docs_of([(i, f"t{i}") for i in ids] + [(None, "null")])
    rows = next_in_order(df, pieces=pieces).collect()
    at = {}
    for r in rows:
        at.setdefault(r["piece"], []).append(r)
    pairs = set()
    for some in at.values():
        own = sorted((r for r in some if not r["ghost"]), key=lambda r: (r["key"] is None, -(r["key"] or 0)))
        own += [r for r in some if r["ghost"]][:1]
        pairs |= {(a["text"], b["text"]) for a, b in zip(own, own[1:])}
    order = [f"t{i}" for i in sorted(ids, reverse=True)] + ["null"]
    assert pairs == set(zip(order, order[1:] + order[:1]))


def test_many_rows_without_id_are_no_single_piece(spark, docs_of):
    texts = [f"text {i}" for i in range(300)]
    df = docs_of([(None, t) for t in texts] + [(None, "same")] * 3 + [(5, "five"), (5, "cinq"), (9, "nine")])
    rows = next_in_order(df, pieces=8).collect()
    sizes = {}
    for r in rows:
        sizes[r["piece"]] = sizes.get(r["piece"], 0) + 1
    assert max(sizes.values()) < 80 and sum(not r["ghost"] for r in rows) == 306 and sum(r["ghost"] for r in rows) <= len(sizes) + 2
    hashed = dict(df.select("text", F.xxhash64("text")).collect())
    order = ["nine", *sorted(["five", "cinq"], key=hashed.get), *sorted([*texts, "same", "same", "same"], key=hashed.get)]
    follows = {}
    for a, b in zip(order, order[1:] + order[:1]):
        follows.setdefault(a, set()).add(b)
    got = fingerprint_neighbours(df).collect()
    edits = sorted(r["edited_sha256"] for r in got)
    assert edits == sorted(hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1]))


@pytest.mark.parametrize("cuts", [[], [5], [1, 2, 3], list(range(-500, 40_000, 7))])
def test_binary_search(spark, cuts):
    keys = [-(1 << 63), -501, -500, -499, 0, 1, 2, 3, 4, 5, 6, 39_000, 40_000, (1 << 63) - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert [x[0] for x in df.select(_cuts_up_to(F.col("k"), cuts)).collect()] == [bisect.bisect_right(cuts, k) for k in keys]


@pytest.mark.parametrize("texts", [[], ["only one"], TEXTS, [some_text(random.Random(9), 50 * i) for i in range(30)]])
def test_fingerprint_rows_equal_brute_force(spark, docs_of, texts):
    got = {r["doc_id"]: r for r in fingerprint_neighbours(docs_of(texts)).collect()}
    plain = [t or "" for t in texts]
    assert len(got) == len(texts)
    for i, t in enumerate(plain):
        nxt = plain[i - 1]
        half = len(t) // 2
        edited = (t[: len(t) - half] + nxt[:half]).encode()
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint(t.encode()), fingerprint(edited))
        assert (r["near_edited"], r["near_next"]) == tuple(likeness([(r["fingerprint"], r["edited_fingerprint"]), (r["fingerprint"], fingerprint(nxt.encode()))]))


def test_repeated_ids_keep_their_rows(spark, docs_of):
    rows = fingerprint_neighbours(docs_of([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "d")])).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "1", "None", "None"]


ODD = ["áb ́c", "<|endoftext|>x <|start", "it's I'LL\tyou\x1cre\x85z\xa0q", "\r\n  　İſK ﬁ", "😀 a", "a.b, c... 'd' e!? don't", "ΣΑΣ Σ. ẞ ß", "x" * 900, "한국어 日本語 ไทย 123 4.5", "word.word word's. ''' '. .'s", "ＡＢＣ ①② ½ é i̇"]


def test_word_table_equals_the_tokenizer():
    e = WordEncoder(tokenizer_path())
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("aZé.,' \n!ß́😀9İ") for _ in range(60)) for _ in range(400)]
    for t, raw in zip(texts, e.encode(texts)):
        assert np.frombuffer(raw, "<u2").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_letters_that_come_apart_before_a_mark():
    """Some letters are a letter and a sign to the tokenizer, and the sign joins the mark behind it."""
    e = WordEncoder(tokenizer_path())
    texts = ["\u0958! a\u0958, \u0958", "\u09dc.", "\u0a33?!\n\u0f43,", "é! İ! ΣΑΣ."]
    for t, raw in zip(texts, e.encode(texts)):
        assert np.frombuffer(raw, "<u2").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("most", [3, 10_000])
def test_columns_of_texts(monkeypatch, most):
    """Slices, empty texts and a word table that is full."""
    monkeypatch.setattr(tokens, "MAX_WORDS", most)
    e = WordEncoder(tokenizer_path())
    texts = ["", "left out", "", "a  b,\nc ", "\n", " ", *ODD, "word, word word.", ""]
    for some in (pa.array(texts), pa.array(texts, pa.large_string())[2:-1], pa.array([""]), pa.array([], pa.string())):
        ids, ends = e.encode_column(some)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in some.to_pylist()]


def test_pieces_of_bounded_bytes():
    texts = ["x" * n for n in (3, 0, 9, 25, 1, 1, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(texts[a:b], pa.string())], names=["key", "text"]) for a, b in ((0, 4), (4, 4), (4, 7))]
    pieces = [(k.to_pylist(), t.to_pylist()) for k, t in tokens._in_pieces(iter(batches), 10)]
    assert [k for k, _ in pieces] == [[0, 1, 2], [3], [4, 5, 6]] and sum((t for _, t in pieces), []) == texts


@pytest.mark.parametrize("levels", [True, False])
def test_other_tokenizers_encode_whole_texts(spark, docs_of, tmp_path, levels):
    """A tokenizer whose tokens take in the blank before a word, and one that does not."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    vocabulary = {c: i + 3 for i, c in enumerate(alphabet if levels else sorted({c for t in ODD for c in t if not c.isspace()}))}
    merges = [(" ".replace(" ", "\u0120"), "a")] if levels else []
    vocabulary |= {"".join(m): 900 + i for i, m in enumerate(merges)}
    t = Tokenizer(models.BPE(vocabulary, merges))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False) if levels else pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "t.json")
    t.save(path)
    encoder = WordEncoder(path)
    assert encoder.by_words is not levels
    texts = [x for x in ODD if levels or not any(c.isspace() and c not in " \n" for c in x)] + ["a a  a", ""]
    for x, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, "<u2" if encoder.width == 2 else "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_query_equals_the_tokenizer(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {x["doc_id"]: (x["start"], x["n_tokens"], x["ids_crc32"]) for x in op8_query(spark, SF).collect()}
    tokenizer, at = WordEncoder(tokenizer_path()).tokenizer, 0
    assert len(got) == len(rows)
    for x in rows:
        ids = tokenizer.encode(x["text"] or "", add_special_tokens=False).ids + [END_ID]
        assert got[x["doc_id"]] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_slices_of_a_file_that_is_not_mapped(tmp_path):
    import pyarrow.fs as pafs

    np.arange(1000, dtype="<u4").tofile(tmp_path / "x")
    some = _Remote(pafs.LocalFileSystem().open_input_file(str(tmp_path / "x")), np.dtype("<u4"))
    assert len(some) == 1000 and some[5:8].tolist() == [5, 6, 7] and some[998:2000].tolist() == [998, 999] and some[7:7].tolist() == []


@pytest.mark.parametrize("texts", [[], TEXTS, [(None, "a b"), (7, "c"), (7, "c"), (-3, ODD[3])], ODD * 20])
def test_files_round_trip(spark, docs_of, texts):
    df, folder = docs_of(texts), new_path(spark, "tokens")
    manifest = write_tokens(df, folder, tokenizer_path(), [F.col("doc_id")]).cache()
    got = read_tokens(manifest, folder).orderBy("start").collect()
    tokenizer = WordEncoder(tokenizer_path()).tokenizer
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID] for _, t in rows]
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]
    assert [r["start"] for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    flat = np.concatenate([open_tokens(folder, m["name"], m["width"])[0] for m in manifest.orderBy("base").collect()] or [np.zeros(0)])
    assert flat.tolist() == sum(ids, [])
