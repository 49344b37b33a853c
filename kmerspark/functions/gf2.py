"""Matrices over GF(2), by columns, as hash functions of packed keys."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BinaryMatrix:
    """``r`` rows (at most 64); each column is a number whose low ``r`` bits are the column's entries.

    The last column belongs to the lowest bit of a vector, so a key's first base meets the first columns.
    """

    r: int
    columns: tuple[int, ...]

    def __post_init__(self) -> None:
        if not 0 < self.r <= 64 or not self.columns or any(c >> self.r for c in self.columns):
            raise ValueError("a matrix has 1 to 64 rows, a column or more, and columns of at most its rows' bits")

    @property
    def c(self) -> int:
        return len(self.columns)

    @classmethod
    def identity(cls, r: int, c: int | None = None) -> BinaryMatrix:
        """Takes a vector to its low ``r`` bits."""
        c = r if c is None else c
        return cls(r, tuple(1 << c - 1 - i if c - 1 - i < r else 0 for i in range(c)))

    @classmethod
    def chance(cls, r: int, c: int, seed: int) -> BinaryMatrix:
        rng = random.Random(seed)
        return cls(r, tuple(rng.getrandbits(r) for _ in range(c)))

    @classmethod
    def invertible(cls, r: int, seed: int) -> BinaryMatrix:
        """A random square matrix of full rank."""
        while True:
            m = cls.chance(r, r, seed)
            if m.rank() == r:
                return m
            seed += 1

    @classmethod
    def of_header(cls, header: dict, i: int = 1) -> BinaryMatrix:
        m = header[f"matrix{i}"]
        return cls.identity(m["r"], m["c"]) if m.get("identity") else cls(m["r"], tuple(m["columns"]))

    def header(self) -> dict:
        if self == self.identity(self.r, self.c):
            return {"r": self.r, "c": self.c, "identity": True}
        return {"r": self.r, "c": self.c, "identity": False, "columns": list(self.columns)}

    def times(self, v: int) -> int:
        out = 0
        for i, column in enumerate(reversed(self.columns)):
            if v >> i & 1:
                out ^= column
        return out

    def __matmul__(self, other: BinaryMatrix) -> BinaryMatrix:
        if self.c != other.r:
            raise ValueError("the first matrix must have as many columns as the second has rows")
        return BinaryMatrix(self.r, tuple(self.times(c) for c in other.columns))

    def rank(self) -> int:
        basis: list[int] = []
        for c in self.columns:
            for b in basis:
                c = min(c, c ^ b)
            if c:
                basis.append(c)
        return len(basis)

    def inverse(self) -> BinaryMatrix:
        """Inverse of a square matrix; a singular one is an error."""
        n = self.c
        if self.r != n:
            raise ValueError("only square matrices have an inverse")
        # column i of the identity is the image of bit n - 1 - i; combine columns until they are these
        work = [(c, 1 << n - 1 - i) for i, c in enumerate(self.columns)]
        done: list[tuple[int, int]] = []
        for bit in reversed(range(n)):
            at = next((k for k, (c, _) in enumerate(work) if c >> bit & 1), None)
            if at is None:
                raise ValueError("the matrix is singular")
            c, how = work.pop(at)
            work = [(x ^ c, y ^ how) if x >> bit & 1 else (x, y) for x, y in work]
            done = [(x ^ c, y ^ how) if x >> bit & 1 else (x, y) for x, y in done]
            done.append((c, how))
        return BinaryMatrix(n, tuple(how for _, how in done))

    def column(self, packed: Column) -> Column:
        """Image of a packed key (a long) as an expression; images of 64 bits come as signed longs."""
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        terms = [F.when(F.shiftrightunsigned(packed, i).bitwiseAND(F.lit(1)) == 1, F.lit(signed(c)).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(reversed(self.columns)) if i < 64]
        return reduce(lambda a, b: a.bitwiseXOR(b), terms)

    def products(self, keys: np.ndarray) -> np.ndarray:
        """Images of keys given as rows of little-endian bytes: a table of 256 images a byte, and one exclusive or for each."""
        out = np.zeros(len(keys), np.uint64)
        bits = np.arange(256)
        for j in range(-(-self.c // 8)):
            table = np.zeros(256, np.uint64)
            for b in range(min(8, self.c - 8 * j)):
                table[bits >> b & 1 == 1] ^= np.uint64(self.columns[self.c - 1 - 8 * j - b])
            out ^= table[keys[:, j]]
        return out
