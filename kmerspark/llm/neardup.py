"""N-gram Jaccard join: MinHash bands find clusters, a prefix join the pairs between them, full n-gram sets verify both."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_in, read_table, text_or_empty
from .components import connected_components

#: The bands miss a link right at the threshold with a chance of at most 1 - RECALL, a closer one with less; the prefix join finds it. (Of 60,000 such pairs 3 were missed
#: with 0.9999 and one of these with 0.9999999, which missed none of 600,000 others.)
NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999999
#: Texts of a candidate cluster that are verified in one piece of memory, and shingles of them; larger clusters are cut
#: into blocks and every pair of blocks is verified apart.
MAX_TEXTS, MAX_SHINGLES = 384, 1_000_000
_WORD = re.compile(r"\w+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes that finds a pair at the threshold with the target recall."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding reaches this recall")


BANDS, ROWS = choose_bands()
MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's runs of five words (of all its words, where it has fewer)."""

    def __init__(self, n: int = NGRAM) -> None:
        self.n, self.memo = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = _WORD.findall((text or "").lower())
        memo = self.memo
        new = set(found).difference(memo)
        if new:
            if len(memo) > 100_000:
                memo.clear()
                new = set(found)
            memo.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        h = np.array([memo[w] for w in found], np.uint64)
        if not len(h):
            return h
        n = min(self.n, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = out * _MIX[0] + h[j : j + len(out)]
        return np.unique(_mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit hash a band, over the least hashes of its rows."""
    low = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 4096):
        np.minimum(low, (MULTIPLIERS[:, None] * shingles[None, i : i + 4096]).min(axis=1), out=low)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = _mixed(out * _MIX[0] + low[r::ROWS][:BANDS])
    return out.view(np.int64)


def _node(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes()))))


def overlap(n: int) -> int:
    """Shingles that a set of ``n`` has in common with any set that it is linked to, at least."""
    return math.ceil(THRESHOLD * n - 1e-9)


def share(n: int) -> int:
    return 1 + n // 10


def prefix(shingles: np.ndarray) -> np.ndarray:
    """The lowest shingles: linked sets of ``a`` and ``b`` have ``share(min(a, b))`` of them in common, at least.

    Of two linked sets ``c`` shingles are common, c >= overlap(a) and overlap(b). Beyond the l-th lowest of these both sets have c - l more,
    so it is among the lowest a - c + l of the one and b - c + l of the other.
    """
    n = len(shingles)
    return shingles[: n - overlap(n) + share(n)].view(np.int64)


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the shingles, set if an odd number have it; 128 bits or the power of two that is twice the shingles or more."""
    bits = max(128, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.intp), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: int, x: bytes, b: int, y: bytes) -> bool:
    """False only if sets of ``a`` and ``b`` shingles with these parities are not linked: the sets differ in as many shingles as parities, at least."""
    p, q, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), min(len(x), len(y))
    for half in (4 * max(len(x), len(y)) >> i for i in range((max(len(x), len(y)) // size).bit_length() - 1)):
        low = (1 << half) - 1
        p, q = (p >> half ^ p & low, q) if len(x) > size else (p, q >> half ^ q & low)
    return (p ^ q).bit_count() <= (a + b) * (1 - THRESHOLD) / (1 + THRESHOLD) + 1e-6


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, node, text_hash, n_shingles, bands, prefix, parities) of every row; ``node`` names the set of shingles, ``text_hash`` is Spark's of the text.

    Of the rows of a node the first of each task has its prefix and parities, the others (but for some, beyond 500,000 nodes) empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(), set()
        for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            rows = []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                node = _node(s)
                rows.append((node, len(s), signature(s), *((s[:0].view(np.int64), b"") if node in seen else (prefix(s), parities(s)))))
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(node)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(np.concatenate([r[2] for r in rows])))
            lowest = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[3]) for r in rows)]), pa.int32()), pa.array(np.concatenate([r[3] for r in rows])))
            node, size = (pa.array([r[i] for r in rows], pa.int64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), node, b.column(2), size, bands, lowest, pa.array([r[4] for r in rows], pa.binary())], names=["doc_id", "node", "text_hash", "n_shingles", "bands", "prefix", "parities"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text_or_empty(text)).alias("text_hash"))
    return slim.mapInArrow(run, "doc_id long, node long, text_hash long, n_shingles long, bands array<long>, prefix array<long>, parities binary")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (shingle, node) in this order, the distinct rows whose shingle has two nodes or more."""
    g, x, hit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)  # the last row, and whether the one before it has its shingle
    for b in batches:
        held = hit[-1:]
        g, x = np.concatenate((g[-1:], b.column(0).to_numpy())), np.concatenate((x[-1:], b.column(1).to_numpy()))
        if not len(g):
            continue
        fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])))
        g, x = g[fresh], x[fresh]
        same = g[1:] == g[:-1]
        hit = np.concatenate((held if len(held) else [False], same)) | np.concatenate((same, [False]))
        yield pa.RecordBatch.from_arrays([pa.array(g[:-1][hit[:-1]]), pa.array(x[:-1][hit[:-1]])], names=["g", "node"])
    if hit[-1:].any():
        yield pa.RecordBatch.from_arrays([pa.array(g[-1:]), pa.array(x[-1:])], names=["g", "node"])


def _least_common() -> Column:
    """:func:`share` of :func:`overlap` of ``n_shingles``: no set that this one is linked to is smaller than the overlap."""
    return F.lit(1) + F.floor(F.ceil(F.lit(THRESHOLD) * F.col("n_shingles") - F.lit(1e-9)) / 10)


def shared_prefixes(signed: DataFrame) -> DataFrame:
    """(g, node, n_shingles): shingles of prefixes that several nodes have, of those nodes that have enough of them to be linked to any."""
    n = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = signed.select(F.explode("prefix").alias("g"), "node").repartition(n, "g").sortWithinPartitions("g", "node")
    rows = materialize(rows.mapInArrow(_shared, "g long, node long"), "neardup-shared")
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    sizes = maybe_in(signed.select("node", "n_shingles"), F.col("node"), counts.select("node")).distinct()
    near = counts.join(sizes, "node").filter(F.col("n") >= _least_common()).select("node", "n_shingles")
    return materialize(rows.join(near, "node").select("g", "node", "n_shingles"), "neardup-near")


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [may_link(*r) for r in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
        yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def pairs_between(signed: DataFrame, near: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes of different clusters, all linked ones among them.

    A shingle counts if nodes of several clusters have it. Linked nodes have so many of these in common that one is among the
    rarest of both, all but as many less one. So a frequent shingle pairs only nodes that have hardly any others. Pairs whose parities
    rule out a link are dropped before any text is read.
    """
    homes = near.join(clusters, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    homes = materialize(homes, "neardup-homes")
    common = homes.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("g", "n")
    left = homes.join(common, "g")
    each = Window.partitionBy("node")
    left = left.withColumn("all", F.count(F.lit(1)).over(each)).withColumn("rank", F.row_number().over(each.orderBy("n", "g")))
    left = materialize(left.filter(F.col("rank") <= F.col("all") - _least_common() + 1).select("g", "node", "comp", "n_shingles"), "neardup-rare")
    a, b = left.withColumnsRenamed({"node": "u", "comp": "cu", "n_shingles": "nu"}), left.withColumnsRenamed({"node": "v", "comp": "cv", "n_shingles": "nv"})
    sizes = F.least("nu", "nv") >= F.lit(THRESHOLD) * F.greatest("nu", "nv") - F.lit(1e-9)
    pairs = materialize(a.join(b, "g").filter("u < v and cu != cv").filter(sizes).select("u", "v").distinct(), "neardup-met")
    rare = left.select("node").distinct()
    marks = maybe_in(signed.filter(F.length("parities") > 0).select("node", "n_shingles", "parities"), F.col("node"), rare)
    marks = materialize(marks.groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("parities").alias("p")), "neardup-marks")
    x, y = (marks.withColumnsRenamed({"node": c, "n": f"n{c}", "p": f"p{c}"}) for c in "uv")
    passing = pairs.join(x, "u").join(y, "v").select("u", "v", "nu", "pu", "nv", "pv").mapInArrow(_passing, "u long, v long")
    return materialize(passing, "neardup-pairs")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The linked ones of (u, v, text of u, text of v), in the order of u."""
    shingles, last, s = Shingler(), None, None
    for b in (whole.slice(i, 100) for whole in batches for i in range(0, whole.num_rows, 100)):
        out = []
        for u, v, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x != last:
                last, s = x, shingles(x)
            t = shingles(y)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both >= THRESHOLD * (len(s) + len(t) - both) - 1e-9 and _node(s) == u and _node(t) == v:  # not other documents of the same ids
                out.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["u", "v"])


def intersections(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of the sets in ``a`` with those in ``b`` (default: with one another)."""
    sets = a if b is None else a + b
    values = np.concatenate(sets)
    order = np.argsort(values)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
    values = values[order]
    del order
    col = np.cumsum(np.concatenate(([True], values[1:] != values[:-1]))[: len(values)], dtype=np.int32) - 1
    del values
    shared = (np.bincount(col) > 1)[col]
    row, col = row[shared], col[shared]
    del shared
    col = np.cumsum(np.concatenate(([True], col[1:] != col[:-1])), dtype=np.int32) - 1 if len(col) else col
    out = np.zeros((len(a), len(a if b is None else b)), np.float32)
    width = 2048
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (first, first + width))
        x = np.zeros((len(sets), width), np.float32)
        x[row[i:j], col[i:j] - first] = 1
        out += x[: len(a)] @ (x if b is None else x[len(a) :]).T
    return out


def verify(rows: list[tuple], same: bool) -> tuple[dict, list[tuple[int, int]]]:
    """Links of one block (``same``) or between two: {node: [documents, texts] linked}, and a spanning forest of the links.

    ``rows``: (node, side, copies, texts, shingles).
    """
    if same:
        left = right = rows
        inter = intersections([r[4] for r in rows])
    else:
        left, right = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
        if not left or not right:
            return {}, []
        inter = intersections([r[4] for r in left], [r[4] for r in right])
    a, b = np.array([len(r[4]) for r in left]), np.array([len(r[4]) for r in right])
    linked = inter >= THRESHOLD * (a[:, None] + b[None, :] - inter.astype(np.float64)) - 1e-9
    if same:
        np.fill_diagonal(linked, False)
    counts: dict[int, list[int]] = {}
    for part, other, hits in ((left, right, linked),) if same else ((left, right, linked), (right, left, linked.T)):
        weights = np.array([[r[2], r[3]] for r in other])
        for r, n in zip(part, hits.astype(np.int64) @ weights, strict=True):
            if n[0]:
                counts[r[0]] = n.tolist()
    ids = {r[0]: r[0] for r in rows}

    def find(x: int) -> int:
        while ids[x] != x:
            ids[x] = ids[ids[x]]
            x = ids[x]
        return x

    forest = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(left[i][0]), find(right[j][0])
        if x != y:
            ids[max(x, y)] = min(x, y)
            forest.append((x, y))
    return counts, forest


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Row per document: ``class_id`` (least doc_id of its class), ``n_links`` and ``n_text_links``.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles (letters lowered, words as
    \\w+; a text of fewer words is one shingle) is 0.8 or more; a class is a connected component of links. ``n_links``
    counts a document's linked documents, copies included, ``n_text_links`` the different texts among them.

    Documents of equal shingle sets are one node. Nodes that share a band hash are joined to the least node of the
    bucket, and the components of these edges are the candidate clusters: no pair that shares a bucket is lost, and no
    bucket is expanded into pairs. Within a cluster all pairs are verified on whole shingle sets, recomputed from the
    texts, by block: a cluster of any size is cut into blocks of bounded size and each pair of blocks is a group of its
    own, which gives counts and a spanning forest of its links, not the links. Linked pairs of different clusters, which the
    bands miss, are found by an exact prefix join (:func:`prefix`, :func:`pairs_between`) and verified pair by pair, so no link is lost. A set
    whose prefix has too few shingles of others is linked to none and is left out of all that.

    Null and empty texts, and texts without words, have the empty set, and equal sets are linked. Repeated rows count as
    documents; a null doc_id is kept, and is a class id only if no document of the class has one. Very long texts are
    read whole, and one with more shingles than a block holds is a block of its own. An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    return _joined(docs, key, text).select("doc_id", "class_id", "n_links", "n_text_links")


def _joined(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of :func:`jaccard_join` with the text's hash (``text_hash``) and the name of the class (``comp``)."""
    signed = materialize(sign(docs, key, text), "neardup-signed")
    texts = signed.groupBy("node", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"))
    nodes = materialize(texts.groupBy("node").agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")), "neardup-nodes")

    near = shared_prefixes(signed)
    # a node's bands come once for each task and node, not for each copy
    banded = maybe_in(signed.filter("n_shingles > 0"), F.col("node"), near.select("node").distinct()).select("node", F.explode("bands").alias("bucket")).distinct()
    leaders = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    leaders = materialize(leaders, "neardup-leaders")  # a table, so that a hot bucket's rows can be split in the join
    edges = banded.join(leaders, "bucket").filter("node != leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    clusters = materialize(connected_components(edges, "neardup-clusters"), "neardup-clusters")
    members = nodes.join(clusters, "node")
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MAX_TEXTS), F.ceil(F.sum("n_shingles") / MAX_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = materialize(members, "neardup-members")

    def texts_of(reps: DataFrame) -> DataFrame:
        """(node, text) of the nodes' first documents."""
        read = maybe_in(docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")), F.col("doc_id"), reps.select("rep"))
        return read.join(reps, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")

    wanted = texts_of(members.select("rep", "node").distinct())
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = wanted.join(members.select("node", "comp", "block", "other", "copies", "texts"), "node").select(
        "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "copies", "texts", "text"
    )
    grouped = grouped.repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, rows = Shingler(), None, {}

        def result() -> pa.RecordBatch:
            counts, forest = verify(list(rows.values()), held[1] == held[2])
            out = [(k, None, *c) for k, c in counts.items()] + [(u, v, None, None) for u, v in forest]
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v", "documents", "texts"])

        for b in (whole.slice(i, 200) for whole in batches for i in range(0, whole.num_rows, 200)):
            for c, i, j, node, side, copies, n_texts, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (c, i, j) != held:
                    if rows:
                        yield result()
                    held, rows = (c, i, j), {}
                if node not in rows:
                    s = shingles(t)
                    if _node(s) == node:  # not another document of the same id
                        rows[node] = (node, side, copies, n_texts, s)
        if rows:
            yield result()

    found = materialize(grouped.mapInArrow(check, "u long, v long, documents long, texts long"), "neardup-links")
    pairs = pairs_between(signed, near, clusters)
    if pairs.limit(1).count():
        both = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        texts = materialize(texts_of(nodes.join(both, "node").select("rep", "node")).distinct(), "neardup-texts")
        x, y = (texts.withColumnsRenamed({"node": c, "text": f"text_{c}"}) for c in "uv")
        sent = pairs.join(x, "u").join(y, "v").select("u", "v", "text_u", "text_v").repartition(n, "u", "v").sortWithinPartitions("u", "v")
        linked = materialize(sent.mapInArrow(_linked, "u long, v long").distinct(), "neardup-linked")
        ways = linked.union(linked.select("v", "u")).select("u", F.col("v").alias("node")).join(nodes, "node")
        found = found.union(ways.select("u", F.lit(None).cast("long"), "copies", "texts")).union(linked.select("u", "v", F.lit(None).cast("long"), F.lit(None).cast("long")))
    links = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("documents").alias("documents"), F.sum("texts").alias("link_texts"))
    classes = connected_components(found.filter("v is not null"), "neardup-classes")
    named = nodes.join(classes, "node", "left").join(links, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = named.groupBy("comp").agg(F.min("rep").alias("class_id"))
    named = named.join(ids, "comp").select(
        "node", "comp", "class_id", (F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"), (F.col("texts") - 1 + F.coalesce("link_texts", F.lit(0))).alias("n_text_links")
    )
    named = materialize(named, "neardup-named")  # a table, so that the rows of a node of many copies can be split in the join
    return signed.select("doc_id", "node", "text_hash").join(named, "node")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: the one with the least doc_id (nulls last), of equal ids the one whose text hashes lowest.

    Rows are told by id and text, so near copies that share an id, or have none, go too; of repeated rows one stays. Null and
    empty texts are one class. An empty table gives an empty result; other columns pass through, whatever their names.
    """
    joined = materialize(_joined(docs, key, text).select("doc_id", "text_hash", "comp"), "neardup-joined")
    rows = joined.groupBy("comp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    leads = rows.groupBy("comp").agg(F.min(order).alias("lead"), F.min_by("rows", order).alias("rows"))
    leads = materialize(leads, "neardup-leads")  # a table, so that the rows of a large class can be split in the join
    gone = joined.join(leads.select("comp", "lead"), "comp").filter(~(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))))
    gone = gone.select("doc_id", "text_hash").distinct()
    mine = docs[key].cast("long").eqNullSafe(gone["doc_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone["text_hash"])
    kept = docs.join(gone, mine, "left_anti")
    return kept.dropDuplicates([key, text]) if leads.filter("rows > 1").limit(1).count() else kept


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-copy class and number of links."""
    return jaccard_join(read_table(spark, sf_dir, "documents"))
