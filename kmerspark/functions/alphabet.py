"""The k-mer algebra as column expressions. K is always an argument, never a setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
COMPLEMENT = "TGCA"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bases(seq: Column | str) -> Column:
    """Fold the four lower-case bases; everything else stays and is no base (also letters whose upper case would be one)."""
    return F.translate(_col(seq), "acgt", BASES)


def is_valid(mer: Column | str, k: int | None = None) -> Column:
    """Only bases; of length ``k`` where it is given."""
    return bases(mer).rlike(f"^[ACGT]{{{k}}}$" if k is not None else "^[ACGT]+$")


def parse(s: Column | str, k: int) -> Column:
    """First ``k`` characters as a k-mer; null if the text is shorter or they aren't bases."""
    mer = bases(F.substring(_col(s), 1, k))
    return F.when(is_valid(mer, k), mer)


def reverse_complement(mer: Column | str) -> Column:
    return F.reverse(F.translate(_col(mer), BASES, COMPLEMENT))


def canonical(mer: Column | str) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(_col(mer), reverse_complement(mer))


def complement_base(c: Column | str) -> Column:
    """Complement of a base, ``N`` for any other character."""
    c = bases(c)
    return F.when(c.isin(*BASES), F.translate(c, BASES, COMPLEMENT)).otherwise("N")


def complement_code(code: Column | str) -> Column:
    return F.lit(3) - _col(code)


def code(c: Column | str) -> Column:
    """0 to 3 for A, C, G, T in either case, else -1."""
    c = bases(c)
    return F.when(F.length(c) == 1, F.position(c, F.lit(BASES)) - 1).otherwise(F.lit(-1))


def base_of_code(n: Column | str) -> Column:
    """Base of a code from 0 to 3, null outside."""
    n = _col(n)
    return F.when(n.between(0, 3), F.substring(F.lit(BASES), n.cast("int") + 1, F.lit(1)))


def not_dna(c: Column | str) -> Column:
    return code(c) < 0


def shift_left(mer: Column | str, base: Column | str) -> tuple[Column, Column]:
    """(k-mer with ``base`` pushed at the right end, popped first base); null for an invalid base."""
    mer, base = _col(mer), bases(base)
    return F.when(base.isin(*BASES), F.concat(F.substring(mer, F.lit(2), F.length(mer)), base)), F.substring(mer, 1, 1)


def shift_right(mer: Column | str, base: Column | str) -> tuple[Column, Column]:
    """(k-mer with ``base`` pushed at the left end, popped last base); null for an invalid base."""
    mer, base = _col(mer), bases(base)
    return F.when(base.isin(*BASES), F.concat(base, F.substring(mer, F.lit(1), F.length(mer) - 1))), F.substring(mer, -1, 1)


def base_at(mer: Column | str, i: int) -> Column:
    """Base number ``i`` counted from the right end."""
    mer = _col(mer)
    return F.when(F.length(mer) > i, F.substring(mer, F.length(mer) - i, F.lit(1)))


def set_base(mer: Column | str, i: int, base: str) -> Column:
    mer = _col(mer)
    return F.when(F.length(mer) > i, F.overlay(mer, F.lit(base), F.length(mer) - i, F.lit(1)))


def is_homopolymer(mer: Column | str) -> Column:
    mer = _col(mer)
    return F.length(F.replace(mer, F.substring(mer, 1, 1), F.lit(""))) == 0


def poly(base: str, k: int) -> Column:
    return F.lit(base * k)


def random_mer(k: int, seed: int) -> Column:
    """A k-mer of independent random bases."""
    return F.concat(*[F.substring(F.lit(BASES), (F.rand(seed * 1009 + i) * 4).cast("int") + 1, F.lit(1)) for i in range(k)])


# --- packed form: two bits a base, last base in the low bits; order equals that of the strings


def pack(mer: Column | str) -> Column:
    """Long of a k-mer of at most 31 bases."""
    return F.conv(F.translate(_col(mer), BASES, "0123"), 4, 10).cast("long")


def unpack(packed: Column | str, k: int) -> Column:
    """k-mer of a packed long. Never null, so that a join infers no null check to repeat the decoding for."""
    return F.coalesce(F.translate(F.lpad(F.conv(_col(packed).cast("string"), 10, 4), k, "0"), "0123", BASES), F.lit(""))


def get_bits(mer: Column | str, start: int, length: int) -> Column:
    """``length`` bits of the packed form from bit ``start`` up."""
    return F.shiftright(pack(mer), start).bitwiseAND(F.lit((1 << length) - 1))


def set_bits(mer: Column | str, start: int, length: int, value: int, k: int) -> Column:
    mask = ((1 << length) - 1) << start
    return unpack(pack(mer).bitwiseAND(F.lit(((1 << 2 * k) - 1) & ~mask)).bitwiseOR(F.lit((value << start) & mask)), k)
