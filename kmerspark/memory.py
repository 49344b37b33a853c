"""Sizes of an in-memory open-addressing k-mer table, to plan for tools that use one."""

from __future__ import annotations

from kmerspark.functions.helpers import bit_size, ceil_log2, div_ceil

# Fixed value: bytes of the table's own objects beside its slots.
OBJECT_BYTES = 24_816


def reprobe_offset(i: int) -> int:
    """Distance of the i-th probe: triangular numbers, the first two being 0 and 1."""
    return i * (i + 1) // 2


def slot_layout(key_bits: int, value_bits: int) -> tuple[int, int]:
    """(slots, 64-bit words) of a block.

    A slot is a flag bit, a key and a value, one after another. A key that runs over a word's end gives up one bit of
    each word it touches. A block ends with the first slot that ends at a word's end or at most two bits before it.
    """
    at, slots = 0, 0
    while True:
        need, room = key_bits + 1, 64 - at % 64
        if need <= room:
            at += need
        else:
            whole, last = divmod(need - (room - 1), 63)
            at = (at // 64 + 1 + whole) * 64 + (last + 1 if last else 0)
        at += value_bits
        slots += 1
        if at % 64 in (0, 62, 63):
            return slots, div_ceil(at, 64)


def table_bytes(k: int, size: int, value_bits: int = 7, reprobes: int = 126) -> int:
    """Bytes of a table of at least ``size`` slots."""
    log = ceil_log2(size)
    limit = reprobes
    while limit > 0 and reprobe_offset(limit) >= 1 << log:
        limit -= 1
    slots, words = slot_layout(max(2 * k - log, 0) + bit_size(limit + 1), value_bits)
    return div_ceil(1 << log, slots) * words * 8 + OBJECT_BYTES


def largest_size(k: int, memory: int, value_bits: int = 7, reprobes: int = 126) -> int:
    """Largest power of two of slots whose table is smaller than ``memory``."""
    log = 1
    while table_bytes(k, 1 << (log + 1), value_bits, reprobes) < memory:
        log += 1
    return 1 << log
