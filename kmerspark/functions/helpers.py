"""Integer, size and shell helpers of the command line and the file formats."""

from __future__ import annotations

import math
import random
import shlex

SUFFIXES = "kMGTPE"


def parse_size(text: str | int) -> int:
    """Whole number with an optional decimal suffix: 10M is ten million."""
    if isinstance(text, int):
        return text
    text = text.strip()
    at = SUFFIXES.lower().find(text[-1:].lower()) if text else -1
    return int(text[:-1]) * 1000 ** (at + 1) if at >= 0 else int(text)


def format_size(n: int, unit: int = 1000) -> str:
    """Number divided down (whole division by the unit) to the largest suffix that keeps it at 1 or more."""
    i = 0
    while n >= unit and i < len(SUFFIXES):
        n //= unit
        i += 1
    return f"{n}{SUFFIXES[i - 1] if i else ''}"


def floor_log2(n: int) -> int:
    return n.bit_length() - 1


def ceil_log2(n: int) -> int:
    return max(n - 1, 0).bit_length()


def bit_size(n: int) -> int:
    return max(n.bit_length(), 1)


def div_ceil(a: int, b: int) -> int:
    return -(-a // b)


def reverse_bits(v: int, length: int = 64) -> int:
    return int(f"{v:0{length}b}"[::-1], 2)


def slice_of(i: int, n: int, total: int) -> tuple[int, int]:
    """[start, end) of part ``i`` of ``n`` equal parts of ``total``."""
    size = div_ceil(total, n)
    return min(i * size, total), min((i + 1) * size, total)


def first_false(lo: int, hi: int, holds) -> int:
    """Least number in [lo, hi) for which ``holds`` is false, ``hi`` if there is none; ``holds`` is true up to it."""
    while lo < hi:
        mid = (lo + hi) // 2
        if holds(mid):
            lo = mid + 1
        else:
            hi = mid
    return lo


def random_bits(length: int = 64, rng: random.Random | None = None) -> int:
    """A number of ``length`` random bits."""
    return (rng or random).getrandbits(length) if length else 0


def quote_arg(arg: str) -> str:
    return shlex.quote(arg)


def bloom_size(n: int, fpr: float) -> tuple[int, int]:
    """(cells, hashes) for ``n`` keys: the number of cells a key is rounded before it is multiplied."""
    return n * round(-math.log(fpr) / math.log(2) ** 2), round(-math.log(fpr) / math.log(2))


def quality_threshold(min_qual_char: str | None = None, min_quality: int | None = None, quality_start: int = 64) -> int | None:
    """Least quality character, as a number, from either way to give it; both at once is an error."""
    if min_qual_char is not None and min_quality is not None:
        raise ValueError("give a quality character or a quality number, not both")
    if min_qual_char is not None:
        if len(min_qual_char) != 1 or not "!" <= min_qual_char <= "~":
            raise ValueError("the quality character must be one from ! to ~")
        return ord(min_qual_char)
    if min_quality is None:
        return None
    if not ord("!") <= quality_start + min_quality <= ord("~"):
        raise ValueError("the quality threshold is outside of ! to ~")
    return quality_start + min_quality
