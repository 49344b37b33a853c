"""Burrows-Wheeler transforms of shards of strings, and their merge by interleave refinement."""

from __future__ import annotations

import numpy as np

#: Bytes of the first key that suffixes are sorted by; the rest of the word says how many of them there are.
FIRST = 7


class Transform:
    """Burrows-Wheeler transform of a shard of strings, to a depth of ``length`` bytes.

    The suffixes of all strings, the empty one of each included, in the order of their first ``length`` bytes (a suffix that
    ends is before those that go on). For each: ``before``, the byte before it; ``link``, where in this order the suffix
    is that begins with that byte; ``string`` and ``into``, the string it is of and its place there. The byte before a whole
    string is taken as 0 and linked to the string's empty suffix.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int) -> None:
        sizes = np.diff(ends, prepend=0)
        stops = (ends + np.arange(len(ends))).astype(np.int64)  # every string is followed by a slot for its empty suffix
        total = len(data) + len(ends)
        full = np.zeros(total + 8, np.uint8)
        slot = np.ones(total, bool)
        slot[stops] = False
        full[:total][slot] = data
        at = np.arange(total)
        stop = np.repeat(stops, sizes + 1)
        begin = np.repeat(stops - sizes, sizes + 1)
        left = stop - at
        have = np.minimum(left, FIRST).astype(np.uint64)
        word = np.ndarray(total, ">u8", full, strides=(1,)).astype(np.uint64) >> np.uint64(8)
        word &= ~((np.uint64(1) << (np.uint64(8) * (np.uint64(FIRST) - have))) - np.uint64(1))
        key, depth, rank = word << np.uint64(3) | have, FIRST, np.zeros(total + 1, np.int64)
        while True:
            pick = np.argsort(key)
            key = key[pick]
            rank[pick] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
            if depth >= length:
                break
            step = min(depth, length - depth)
            key = rank[:total] << 32 | np.where(step <= left, rank[np.minimum(at + step, total)], 0)
            depth += step
        where = np.empty(total, np.int32)
        where[pick] = np.arange(total, dtype=np.int32)
        prev = np.where(at > begin, at - 1, stop)[pick]
        self.before, self.link = full[prev], where[prev]
        self.before[at[pick] == begin[pick]] = 0
        self.string = np.repeat(np.arange(len(ends), dtype=np.int32), sizes + 1)[pick]
        self.into = (at - begin)[pick].astype(np.int32)


def merged_transforms(shards: list[Transform], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of all shards' windows of ``length`` bytes: (shard, string, place in it, whether a block begins) in order.

    The interleave starts as one shard after the other. Each round takes the bytes before the suffixes, in the order so far,
    and deals the suffixes that these bytes begin into one stretch a byte: what was in order to depth h then is to depth
    h + 1, and a block splits where the common prefix with the suffix before ends. Two bytes are dealt a round. Only transforms are
    read: nothing is compared, and no suffix is sorted again. A block at depth ``length`` is a repeated interval: all places
    of one string.

    A suffix takes part while a window needs it: at depth h those that begin ``length`` - h bytes into a window.
    """
    bases = np.cumsum([0, *(len(s.before) for s in shards)])
    if not bases[-1]:
        return tuple(np.zeros(0, np.int32) for _ in range(3)) + (np.zeros(0, bool),)
    before = np.concatenate([s.before for s in shards])
    link = np.concatenate([s.link + b for s, b in zip(shards, bases.tolist(), strict=False)]).astype(np.int32)
    into = np.concatenate([s.into for s in shards])
    order = np.flatnonzero(into >= length).astype(np.int32)
    block = np.zeros(len(order), np.int32)
    new = np.zeros(len(order), bool)
    two, second = before[link].astype(np.uint16) << np.uint16(8) | before, link[link]
    for h in range(length % 2, length + 1, 2):
        if h == 0:
            continue
        byte, back = (before, link) if h == 1 else (two, second)
        key = byte[order]
        deal = np.argsort(key, kind="stable")  # keys of at most 16 bits: a counting sort
        key, block, order = key[deal], block[deal], back[order[deal]]
        np.not_equal(key[1:], key[:-1], out=new[1:])
        new[1:] |= block[1:] != block[:-1]
        new[:1] = True
        block = np.cumsum(new, dtype=np.int32)
    shard = np.searchsorted(bases, order, side="right").astype(np.int32) - 1
    return shard, np.concatenate([s.string for s in shards])[order], into[order], new
