"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, text_or_empty

#: Labelled rows that the model is fitted on, at most (those whose key hashes lowest).
MAX_TRAIN = 20_000
#: A feature is known if at least so many toxic documents of the sample have it, and so many standard deviations more than clean ones would lead to expect.
MIN_DOCS, MIN_Z = 4, 4.2
#: Labels are grades from 0 to this.
MAX_GRADE = 9
#: Word-start lengths that count as features beside whole words.
STARTS = range(3, 9)
_WORD = re.compile(r"[^\W\d_]+")


def features_of_word(word: str) -> list[str]:
    """The whole word and its first 3 to 8 letters (inflected forms share their starts)."""
    return [f"{word}$", *(word[:n] for n in STARTS if n <= len(word))]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def count_features(text: str | None, known: dict[str, int], memo: dict[str, tuple[int, ...]]) -> tuple[dict[int, int], int]:
    """Counts of the known features in the whole text, and its number of words."""
    out: Counter = Counter()
    found = words(text)
    for w in found:
        hit = memo.get(w)
        if hit is None:
            if len(memo) > 100_000:
                memo.clear()
            hit = memo[w] = tuple(known[f] for f in features_of_word(w) if f in known)
        for f in hit:
            out[f] += 1
    return out, len(found)


def _values(counts: dict[int, int], n_words: int) -> tuple[list[int], list[float]]:
    """Sparse row: each count in units of its spread if one word in a hundred were a chance hit, so that long texts are judged by rate."""
    return list(counts), [c / float(np.sqrt(c + n_words / 100)) for c in counts.values()]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """P(grade > j) = sigmoid(w . x - cut_j): one weight vector for all cuts, which are in order."""

    features: list[str]
    weights: np.ndarray
    cuts: np.ndarray
    threshold: float = 0.5

    def above(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        score = np.array([float(np.dot(self.weights[i], v)) for i, v in rows])
        return _sigmoid(score[:, None] - self.cuts[None, :])


def _cuts(p: np.ndarray, width: int) -> np.ndarray:
    """The first cut plus positive gaps, so that cuts stay in order."""
    return p[width] + np.concatenate(([0.0], np.cumsum(np.exp(np.clip(p[width + 1 :], -9, 9)))))


def log_loss(p: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], grades: np.ndarray, width: int, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the grades plus the ridge, and its gradient; ``rows`` are (row, feature, value)."""
    (r, c, v), n, top = rows, len(grades), len(p) - width
    w, cuts = p[:width], _cuts(p, width)
    score = np.bincount(r, v * w[c], n)
    above = _sigmoid(score[:, None] - cuts[None, :])
    edges = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
    hi, lo = edges[np.arange(n), grades], edges[np.arange(n), grades + 1]
    prob = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
    g_cut = np.bincount(grades[grades > 0] - 1, d_hi[grades > 0], top) / n - np.bincount(grades[grades < top], d_lo[grades < top], top) / n
    gaps = np.exp(np.clip(p[width + 1 :], -9, 9))
    tails = np.cumsum(g_cut[::-1])[::-1]
    gradient = np.concatenate([np.bincount(c, v * ((d_lo - d_hi) / n)[r], width) + ridge * w, [tails[0]], tails[1:] * gaps])
    return float(-np.log(prob).mean() + ridge / 2 * (w @ w)), gradient


def fit_ordinal(rows: list[tuple[list[int], list[float]]], grades: np.ndarray, features: list[str], steps: int = 800, ridge: float = 2e-3) -> OrdinalModel:
    """Maximum likelihood with a ridge, by full-batch Adam."""
    width, top = len(features), int(grades.max()) if len(grades) else 0
    if top == 0:  # nothing to learn from: no document is over grade 0
        return OrdinalModel(features, np.zeros(width), np.array([40.0]))
    flat = (
        np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows]),
        np.concatenate([np.asarray(i, np.int64) for i, _ in rows]),
        np.concatenate([np.asarray(x, np.float64) for _, x in rows]),
    )
    p = np.zeros(width + top)
    p[width] = 2.0
    m, s = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        _, g = log_loss(p, flat, grades, width, ridge)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return OrdinalModel(features, p[:width], _cuts(p, width))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> OrdinalModel:
    """Fit the model on at most ``max_train`` labelled documents.

    Labels are grades of severity, 0 for a clean document up to MAX_GRADE. Where they only say 0 or 1, grades 1 and 2 are made of
    the toxic documents with fewer and with more toxic features a word than their median. Features are screened by their document
    counts in both classes, on the executors; all that pass (``min_docs``, ``min_z``) are known, and the sample bounds their number.
    Unlabelled documents, null labels, labels that are no grades, and labels without a document are ignored; of several labels of a
    document the highest counts. Whole texts are read; null and empty ones have no features; an empty table of either kind gives a
    model that takes nothing for toxic. Other columns are ignored, whatever their names.
    """
    graded = F.col(label).between(0, MAX_GRADE) & F.col(key).isNotNull()
    picked = labels.filter(graded).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64(key), key).limit(max_train)
    sample = docs.select(key, text_or_empty(text).alias("text")).join(F.broadcast(picked), key).select("y", "text", F.xxhash64(F.col(key)).alias("h"))
    sample = materialize(sample, "toxicity-sample")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 100):
                part = b.slice(i, 100)
                counts: dict[str, list[int]] = {}
                for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for f in {f for w in set(words(t)) for f in features_of_word(w)}:
                        counts.setdefault(f, [0, 0])[y > 0] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["f", "clean", "toxic"])

    totals = sample.groupBy("y").count().collect()
    n1, n0 = (sum(r["count"] for r in totals if (r["y"] > 0) == toxic) for toxic in (True, False))
    if not n1 or not n0:
        return OrdinalModel([], np.zeros(0), np.array([40.0 if n0 or not n1 else -40.0]))
    per = sample.select("y", "text").mapInArrow(present, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    expected = (F.col("clean") + 0.5) * (n1 / n0)
    screened = per.filter(F.col("toxic") >= min_docs).withColumn("z", (F.col("toxic") - expected) / F.sqrt(expected + 1)).filter(F.col("z") >= min_z)
    best = screened.select("f").orderBy(F.desc("z"), "f").collect()  # of at most max_train documents
    features = [r["f"] for r in best]
    known = {f: i for i, f in enumerate(features)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            rows = [(y, *count_features(t, known, memo), h) for y, t, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([list(r[1]) for r in rows], pa.list_(pa.int32())), pa.array([list(r[1].values()) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                names=["y", "f", "c", "n", "h"],
            )

    got = sample.mapInArrow(counted, "y int, f array<int>, c array<int>, n long, h long").orderBy("h", "n").collect()  # at most max_train rows of known features
    rows = [_values(dict(zip(r["f"], r["c"], strict=True)), r["n"]) for r in got]
    dense = np.array([sum(r["c"]) / max(r["n"], 1) for r in got])
    grades = np.array([r["y"] for r in got])
    if grades.max() == 1:
        grades = np.where(grades == 1, 1 + (dense > np.median(dense[grades == 1])), 0)
    model = fit_ordinal(rows, grades, features)
    model.threshold = best_threshold(model.above(rows)[:, 0], grades > 0)
    return model


def best_threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of P(grade > 0) with the best F1 on the fitted rows, halfway to the next value below, at most one half."""
    order = np.argsort(-p, kind="stable")
    ranked, hits = p[order], np.cumsum(toxic[order])
    last = np.append(ranked[1:] < ranked[:-1], True)  # equal values fall together
    f1 = np.where(last, 2 * hits / (np.arange(1, len(p) + 1) + toxic.sum()), -1)
    k = int(np.argmax(f1))
    below = ranked[k + 1] if k + 1 < len(p) else 0.0
    return float(min(0.5, (ranked[k] + below) / 2))


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", threshold: float | None = None) -> DataFrame:
    """Add ``severity`` (expected grade) and ``toxic`` (P(grade > 0) >= threshold, by default the model's).

    Whole texts are read; null and empty ones have no features. Repeated rows get equal scores; an empty table gives an
    empty result; other columns pass through, though columns of these two names are replaced.
    """
    threshold = model.threshold if threshold is None else threshold
    known = {f: i for i, f in enumerate(model.features)}
    kept = docs.drop("severity", "toxic")
    names, at = kept.columns, kept.columns.index(text)
    numbered = kept.toDF(*(f"c{i}" for i in range(len(names))))  # any name may pass, also one with a dot
    schema = numbered.select("*", F.lit(0.0).alias("severity"), F.lit(False).alias("toxic")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            rows = [_values(*count_features(t, known, memo)) for t in b.column(at).to_pylist()]
            above = model.above(rows) if rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(above.sum(axis=1)), pa.array(above[:, 0] >= threshold)], names=schema.names)

    return numbered.mapInArrow(run, schema).toDF(*names, "severity", "toxic")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, by a model fitted on the labels table."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels"))).drop("text")
