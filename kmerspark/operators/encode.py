"""Vectorised k-mer encoder for Arrow batches: two bits a base, log2(k) passes over a batch's bases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODES[ord(_c)] = _CODES[ord(_c.lower())] = _i
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
#: Bases encoded at once, so that memory doesn't follow the length of a sequence.
PIECE = 1 << 22
#: Up to this many possible k-mers a batch is counted in a dense array instead of by sorting.
DENSE = 1 << 22


def _numbers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed k-mer, its packed reverse complement) of each place, whether it is a valid window or not; k up to 31."""
    c = (codes & 3).astype(np.int64)
    forward, reverse, have = None, None, 0  # windows of `have` bases
    size, f, r = 1, c, 3 - c  # windows of `size` bases, a power of two
    rest = k
    while rest:
        if rest & 1:
            if have == 0:
                forward, reverse, have = f, r, size
            else:  # the window of `have` bases, then the one of `size` bases
                n = len(codes) - have - size + 1
                forward = forward[:n] << (2 * size) | f[have : have + n]
                reverse = reverse[:n] | r[have : have + n] << (2 * have)
                have += size
        rest >>= 1
        if rest:
            n = len(f) - size
            f, r = f[:n] << (2 * size) | f[size : size + n], r[:n] | r[size : size + n] << (2 * size)
            size *= 2
    return forward, reverse


def _valid(codes: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    """Which places begin a window without an invalid base that lies in one sequence; ``begins`` marks sequences' first bases."""
    total = np.concatenate(([0], np.cumsum(codes > 3, dtype=np.int32)))
    first = np.cumsum(begins, dtype=np.int32)
    return (total[k:] == total[:-k]) & (first[k - 1 :] == first[: len(first) - k + 1])


def _windows(codes: np.ndarray, begins: np.ndarray, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """(packed k-mers, which windows they are) of all valid windows."""
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    valid = _valid(codes, begins, k)
    forward, reverse = _numbers(codes, k)
    out = np.minimum(forward, reverse) if canonical else forward
    return out[valid], valid


def _long_counted(codes: np.ndarray, begins: np.ndarray, k: int, canonical: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(k-mers as strings, how many) of all valid windows, for any k: a window is a few overlapping words of up to 31 bases.

    Windows are sorted by a hash of their words and equal neighbours are combined. Where other windows share a hash, a k-mer may
    come more than once, never with another's windows.
    """
    if len(codes) < k:
        return
    at = np.flatnonzero(_valid(codes, begins, k))
    if not len(at):
        return
    n = -(-k // 31)
    size = -(-k // n)
    places = [min(i * size, k - size) for i in range(n)]
    forward, reverse = _numbers(codes, size)
    words = [forward[at + p] for p in places]
    turned = np.zeros(len(at), bool)
    if canonical:
        others = [reverse[at + (k - size - p)] for p in places]
        open_ = np.ones(len(at), bool)
        for a, b in zip(words, others, strict=True):
            turned |= open_ & (b < a)
            open_ &= a == b
        words = [np.where(turned, b, a) for a, b in zip(words, others, strict=True)]
    mixed = np.zeros(len(at), np.uint64)
    for w in words:
        mixed = (mixed ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    new = np.ones(len(at), bool)
    new[1:] = np.any([w[order[1:]] != w[order[:-1]] for w in words], axis=0)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(at)))
    at, turned = at[order[first]], turned[order[first]]
    step = max(1, (1 << 24) // k)
    for i in range(0, len(at), step):
        some, back = at[i : i + step], turned[i : i + step]
        text = codes[some[:, None] + np.arange(k)]
        text[back] = 3 - text[back, ::-1]
        offsets = np.arange(len(some) + 1, dtype=np.int32) * np.int32(k)
        yield pa.StringArray.from_buffers(len(some), pa.py_buffer(offsets), pa.py_buffer(_LETTERS[text])), counts[i : i + step]


def _counted(packed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if 4**k <= min(DENSE, 4 * max(len(packed), 1)):
        n = np.bincount(packed, minlength=0)
        at = np.flatnonzero(n)
        return at.astype(np.int64), n[at]
    return np.unique(packed, return_counts=True)


def _buffer(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings, where each begins and the last ends), without copying them."""
    wide = pa.types.is_large_string(strings.type)
    offsets = np.frombuffer(strings.buffers()[1], np.int64 if wide else np.int32)[strings.offset : strings.offset + len(strings) + 1]
    raw = strings.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _codes(seqs: pa.Array, quals: pa.Array | None, min_qual: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all bases, where each sequence begins and the last ends); nulls are empty.

    A base whose quality is below ``min_qual`` breaks windows as an invalid one does; a sequence without qualities passes.
    """
    data, offsets = _buffer(seqs.fill_null(""))
    codes = _CODES[data]
    if quals is not None and min_qual is not None:
        marks, places = _buffer(quals.fill_null(""))
        low = marks < min_qual
        wide = bool((data > 127).any() or (marks > 127).any())
        if quals.null_count == 0 and not wide and np.array_equal(places, offsets):
            codes[low] = 4
        else:
            for i in np.flatnonzero(np.diff(places)).tolist():
                base, mark = slice(offsets[i], offsets[i + 1]), slice(places[i], places[i + 1])
                if wide:  # a quality belongs to a character, not to a byte
                    chars, below = np.flatnonzero((data[base] & 0xC0) != 0x80), low[mark][(marks[mark] & 0xC0) != 0x80]
                else:
                    chars, below = np.arange(offsets[i + 1] - offsets[i]), low[mark]
                n = min(len(chars), len(below))
                codes[offsets[i] + chars[:n][below[:n]]] = 4
    return codes, offsets


def _pieces(codes: np.ndarray, offsets: np.ndarray, k: int, canonical: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first base, packed k-mers, which windows they are) of overlapping pieces."""
    begins = np.zeros(len(codes) + 1, bool)
    begins[offsets[:-1]] = True
    for start in range(0, len(codes), PIECE):
        end = min(start + PIECE + k - 1, len(codes))
        yield start, *_windows(codes[start:end], begins[start:end], k, canonical)


def counting_task(k: int, canonical: bool, min_qual: int | None):
    """Function for ``mapInArrow`` over (seq[, qual]): (packed, n), combined by piece before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, offsets = _codes(b.column(0), b.column(1) if b.num_columns > 1 else None, min_qual)
            for _, found, _ in _pieces(codes, offsets, k, canonical):
                packed, n = _counted(found, k)
                for i in range(0, len(packed), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(packed[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)], pa.int64())], names=["packed", "n"])

    return run


def long_counting_task(k: int, canonical: bool, min_qual: int | None):
    """As :func:`counting_task` for any k: (kmer, n), with k-mers as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = max(PIECE // -(-k // 31), 1)
        for b in batches:
            if not b.num_rows:
                continue
            codes, offsets = _codes(b.column(0), b.column(1) if b.num_columns > 1 else None, min_qual)
            begins = np.zeros(len(codes) + 1, bool)
            begins[offsets[:-1]] = True
            for start in range(0, len(codes), piece):
                end = min(start + piece + k - 1, len(codes))
                for mers, n in _long_counted(codes[start:end], begins[start:end], k, canonical):
                    yield pa.RecordBatch.from_arrays([mers, pa.array(n, pa.int64())], names=["kmer", "n"])

    return run


def placing_task(k: int, canonical: bool, n_keys: int, min_qual: int | None):
    """Function for ``mapInArrow`` over (keys..., seq[, qual]): (keys..., pos, packed), a row a valid window, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, offsets = _codes(b.column(n_keys), b.column(n_keys + 1) if b.num_columns > n_keys + 1 else None, min_qual)
            more = (_buffer(b.column(n_keys).fill_null(""))[0] & 0xC0) == 0x80  # bytes that begin no character
            wide = np.cumsum(more) if more.any() else None
            for start, packed, valid in _pieces(codes, offsets, k, canonical):
                at = start + np.flatnonzero(valid)
                row = np.searchsorted(offsets, at, side="right") - 1
                pos = at - offsets[row]
                if wide is not None:
                    pos -= wide[at] - wide[offsets[row]]
                for i in range(0, len(packed), 1 << 17):
                    some = slice(i, i + (1 << 17))
                    keys = b.select(list(range(n_keys))).take(pa.array(row[some]))
                    yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(pos[some].astype(np.int64)), pa.array(packed[some])], names=[*keys.schema.names, "pos", "packed"])

    return run
