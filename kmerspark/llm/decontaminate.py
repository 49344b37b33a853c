"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, sliced, text_or_empty

#: Shortest run of words that counts as a shared passage.
MIN_MATCH = 5
#: Share of an item's words that tiles must cover for a document to count as holding the item.
COVERAGE = 0.5
#: Bits of the seed filter that is sent to the executors: 16 a seed, and 2 ** 27 (16 MB) at most. A fuller filter lets more documents into the join.
BITS_A_SEED, MAX_BITS, PROBES = 16, 1 << 27, 4
_WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Words:
    """64-bit hashes of a text's words (letters lowered), remembered up to a bound."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found, memo = _WORD.findall((text or "").lower()), self.memo
        new = set(found).difference(memo)
        if new:
            if len(memo) > 100_000:
                memo.clear()
                new = set(found)
            memo.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        return np.array([memo[w] for w in found], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(ids: np.ndarray, length: int = MIN_MATCH) -> np.ndarray:
    """Hash of every run of ``length`` words; of fewer words, one hash of them all (which only the same few words have)."""
    n = min(length, len(ids))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(len(ids) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + ids[j : j + len(out)]
    return _mixed(out)


@lru_cache(8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Running:
    """Karp-Rabin hashes (modulo 2 ** 64) of the unmarked runs of a sequence, of any length, from one running sum."""

    def __init__(self, ids: np.ndarray) -> None:
        size = 1 << len(ids).bit_length()
        self.ids, self.free = ids.tolist(), np.ones(len(ids), bool)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * _powers(_BASE, size)[: len(ids)], dtype=np.uint64)))
        self.back = _powers(_INVERSE, size)

    def runs(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the unmarked runs of ``length`` that begin at one of ``at``."""
        marked = np.concatenate(([0], np.cumsum(~self.free)))
        at = at[at + length <= len(self.ids)]
        at = at[marked[at + length] == marked[at]]
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item place, document place, length) of longest non-overlapping common runs.

    Each round looks up the hashes of the document's unmarked runs of the current search length among those of the item's,
    extends the hits to maximal matches (compared word by word), marks them longest first (ties by place) and halves the
    length, down to ``min_match``; a match of twice the length or more raises it instead. Sequences shorter than
    ``min_match`` match as a whole or not at all.
    """
    if min(len(item), len(doc)) < min_match:
        return [(0, 0, len(item))] if len(item) and np.array_equal(item, doc) else []
    spots = np.flatnonzero(np.isin(seeds(doc, min_match), seeds(item, min_match)))
    if not len(spots):
        return []
    a, b = Running(item), Running(doc)
    x, y, everywhere = a.ids, b.ids, np.arange(len(item))
    out: list[tuple[int, int, int]] = []
    length = max(min_match, min(len(item), 32))
    while True:
        at, names = a.runs(length, everywhere)
        by = np.argsort(names, kind="stable")
        at, names = at[by], names[by]
        spot, wanted = b.runs(length, spots)
        lo, hi = np.searchsorted(names, wanted), np.searchsorted(names, wanted, side="right")
        many = hi - lo
        ds = np.repeat(spot, many)
        ps = at[np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())] if len(ds) else ds
        inner = (ps > 0) & (ds > 0)  # part of the match that begins before
        inner[inner] = (item[ps[inner] - 1] == doc[ds[inner] - 1]) & a.free[ps[inner] - 1] & b.free[ds[inner] - 1]
        found, longest = [], 0
        free_a, free_b = a.free.tolist(), b.free
        for p, d in zip(ps[~inner].tolist(), ds[~inner].tolist(), strict=True):
            n = 0
            while p + n < len(x) and d + n < len(y) and x[p + n] == y[d + n] and free_a[p + n] and free_b[d + n]:
                n += 1
            if n >= length:
                found.append((-n, p, d))
                longest = max(longest, n)
        if longest >= 2 * length:
            length = longest
            continue
        again = False
        for n, p, d in sorted(found):
            if a.free[p : p - n].all() and b.free[d : d - n].all():
                a.free[p : p - n] = False
                b.free[d : d - n] = False
                out.append((p, d, -n))
            else:
                again = True  # what is left of it may still be long enough
        if again:
            continue
        if length == min_match:
            return out
        length = max(min_match, length // 2)


def telling_seeds(names: np.ndarray, common: np.ndarray, n_words: int, threshold: float) -> np.ndarray:
    """Seeds of an item of which a document must share one to cover ``threshold`` of its words.

    The others, most common first (``common``: the number of items that have the seed), are left out as long as all the words they
    cover together are too few.
    """
    covered = np.zeros(n_words, bool)
    keep = np.ones(len(names), bool)
    total = 0
    for p in np.lexsort((np.arange(len(names)), -common)).tolist():
        more = int((~covered[p : p + MIN_MATCH]).sum())
        if (total + more) / n_words < threshold:
            covered[p : p + MIN_MATCH] = True
            total += more
            keep[p] = False
    return np.unique(names[keep])


#: What is added to a seed for each probe.
_TURNS = [np.uint64((j + 1) * _BASE % (1 << 64)) for j in range(PROBES)]


def _probe(names: np.ndarray, turn: np.uint64, bits: int) -> np.ndarray:
    return _mixed(names + turn) & np.uint64(bits - 1)


def _filter_of(wanted: DataFrame) -> np.ndarray:
    """Bloom filter of the seeds as 64-bit words, combined on the executors; at most MAX_BITS / 64 rows come to the driver."""
    n = wanted.count()
    bits = min(MAX_BITS, max(1 << 10, 1 << (BITS_A_SEED * n).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate([_probe(b.column(0).to_numpy().view(np.uint64), turn, bits) for turn in _TURNS])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    rows = wanted.select("seed").mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def _in_filter(names: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The distinct seeds that the filter may hold."""
    for turn in _TURNS:
        if not len(names):
            break
        at = _probe(names, turn, 64 * len(words))
        names = names[(words[(at >> np.uint64(6)).astype(np.intp)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return np.unique(names)


RESULT = ("n_items", "best_item", "coverage", "n_tiles", "contaminated")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = COVERAGE) -> DataFrame:
    """Add ``n_items`` (items covered to ``threshold`` or more), the ``best_item`` of these, its ``coverage`` and ``n_tiles``, and ``contaminated``.

    1. Items are cut into seeds, runs of 5 words. Those that many items share (a common line) are left out as long as they
       could not reach the threshold by themselves; the others tell the item.
    2. A pass over the whole texts finds those that hold a telling seed, by a filter of bounded size, whatever the benchmark's.
    3. These texts' seeds are joined to the items' on the seed's hash. Each pair is tiled over the whole text and item,
       so passages count in any order. Equal texts are tiled once.
    4. The results are joined to all documents by a 128-bit hash of the text.

    Null and empty texts and items share nothing. A text or item of fewer than 5 words is compared as a whole: such an item is
    held by the document that consists of it. Of equal coverages the lowest item is the best one (null ids last); items with equal ids
    are each considered, and repeated rows of the benchmark each count. Below the threshold ``best_item`` is null, the rest 0.
    Very long texts are read whole, one at a time. Repeated rows get equal results; an empty table of either kind gives no
    contamination; other columns pass through, though columns of these five names are replaced.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bench = benchmark.select(F.col(item).cast("long").alias("k"), text_or_empty(item_text).alias("t")).groupBy("k", "t").agg(F.count(F.lit(1)).alias("copies"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in sliced(batches):
            ids = [words(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([w.view(np.int64) for w in ids], pa.list_(pa.int64())), pa.array([seeds(w).view(np.int64) for w in ids], pa.list_(pa.int64()))], names=["k", "copies", "words", "seeds"]
            )

    cut_items = bench.mapInArrow(cut, "k long, copies long, words array<long>, seeds array<long>").withColumn("item", F.monotonically_increasing_id())
    items = materialize(cut_items.filter(F.size("words") > 0), "contamination-items")
    each = items.select("item", F.size("words").alias("n"), F.posexplode("seeds").alias("at", "seed"))
    often = each.groupBy("seed").agg(F.countDistinct("item").alias("common"))
    each = each.join(often, "seed").select("item", "n", "at", "seed", "common").repartition(n, "item").sortWithinPartitions("item", "at")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def result() -> pa.RecordBatch:
            cols = [np.array(c) for c in zip(*held, strict=True)]
            kept = telling_seeds(cols[3].view(np.uint64), cols[4], int(cols[1][0]), threshold)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), cols[0][0])), pa.array(kept.view(np.int64))], names=["item", "seed"])

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and x[0] != held[0][0]:
                    yield result()
                    held = []
                held.append(x)
        if held:
            yield result()

    telling = materialize(each.mapInArrow(choose, "item long, seed long"), "contamination-seeds")
    sent = spark.sparkContext.broadcast(_filter_of(telling.select("seed").distinct()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), sent.value
        for b in sliced(batches):
            hits = [_in_filter(seeds(words(t.as_py())), known) for t in b.column(2)]
            some = np.flatnonzero([len(h) for h in hits])
            if len(some):
                b = b.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([hits[i].view(np.int64) for i in some], pa.list_(pa.int64()))], names=["h1", "h2", "t", "hits"])

    whole = F.coalesce(docs[text], F.lit(""))
    named = [F.xxhash64(whole), F.xxhash64(F.lit("text"), whole)]
    texts = docs.select(named[0].alias("h1"), named[1].alias("h2"), whole.alias("t")).mapInArrow(near, "h1 long, h2 long, t string, hits array<long>")
    texts = materialize(texts.groupBy("h1", "h2").agg(F.first("t").alias("t"), F.first("hits").alias("hits")), "contamination-texts")
    pairs = texts.select("h1", "h2", F.explode("hits").alias("seed")).join(telling, "seed").select("h1", "h2", "item").distinct()
    pairs = materialize(pairs, "contamination-pairs")
    some = texts.join(pairs, ["h1", "h2"], "left_semi").select("h1", "h2", F.lit(-1).cast("long").alias("item"), "t", F.lit(None).cast("array<long>").alias("words"))
    both = some.unionByName(pairs.join(items, "item").select("h1", "h2", "item", F.lit(None).cast("string").alias("t"), "words"))
    both = both.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2", "item")  # a text, then the items to tile it with

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, doc = Words(), np.zeros(0, np.uint64)
        for b in sliced(batches, 200):
            out = []
            for h1, h2, i, t, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i < 0:
                    doc = words(t)
                    continue
                ids = np.array(w, np.int64).view(np.uint64)
                found = tiles(ids, doc)
                covered = sum(x[2] for x in found) / len(ids)
                if covered >= threshold and found:
                    out.append((h1, h2, i, covered, len(found)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h1", "h2", "item", "covered", "n_tiles"])

    held = both.mapInArrow(tile, "h1 long, h2 long, item long, covered double, n_tiles long").join(items.select("item", "k", "copies"), "item")
    best = F.min(F.struct((-F.col("covered")).alias("c"), F.col("k").isNull().alias("no"), "k", "n_tiles")).alias("best")
    found = materialize(held.groupBy("h1", "h2").agg(F.sum("copies").alias("n"), best).select("h1", "h2", "n", "best.*"), "contamination-found")
    kept = docs.drop(*RESULT)
    out = kept.join(found, (named[0] == found["h1"]) & (named[1] == found["h2"]), "left")  # found is broadcast only if its files are under Spark's threshold
    return out.select(
        *(kept[f"`{c}`"] for c in kept.columns), F.coalesce(found["n"], F.lit(0)).cast("long").alias("n_items"), found["k"].alias("best_item"), F.coalesce(-found["c"], F.lit(0.0)).alias("coverage"),
        F.coalesce(found["n_tiles"], F.lit(0)).cast("long").alias("n_tiles"), found["n"].isNotNull().alias("contaminated"),
    )


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, read_table(spark, sf_dir, "benchmark")).drop("text")
