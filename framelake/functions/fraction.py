"""Rational rates and their scaling of positions: exact on the driver, DECIMAL expressions on columns."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fraction:
    hi: int
    lo: int = 1

    def __post_init__(self):
        d = gcd(self.hi, self.lo) or 1
        object.__setattr__(self, "hi", self.hi // d)
        object.__setattr__(self, "lo", self.lo // d)

    def __mul__(self, other: Fraction | int) -> Fraction:
        other = other if isinstance(other, Fraction) else Fraction(other)
        return Fraction(self.hi * other.hi, self.lo * other.lo)

    def __truediv__(self, other: Fraction | int) -> Fraction:
        other = other if isinstance(other, Fraction) else Fraction(other)
        return Fraction(self.hi * other.lo, self.lo * other.hi)

    def __lt__(self, other: Fraction) -> bool:
        return self.hi * other.lo < other.hi * self.lo

    def inverse(self) -> Fraction:
        return Fraction(self.lo, self.hi)

    def as_float(self) -> float:
        return self.hi / self.lo

    def scale(self, v: int, mode: str = "round") -> int:
        """v * hi / lo: trunc to zero, up (positive ones away from zero), or round half away from zero."""
        whole, rest = divmod(abs(v) * self.hi, self.lo)
        if mode == "round" and 2 * rest >= self.lo:
            whole += 1
        if mode == "up" and v > 0 and rest:
            whole += 1
        return -whole if v < 0 else whole

    def scale_column(self, v: Column, mode: str = "round") -> Column:
        wide = F.abs(v).cast("decimal(28,0)") * F.lit(self.hi).cast("decimal(10,0)")
        rest = wide % F.lit(self.lo).cast("decimal(10,0)")
        whole = ((wide - rest) / F.lit(self.lo).cast("decimal(10,0)")).cast("decimal(28,0)").cast("long")
        if mode == "round":
            whole = whole + (2 * rest >= self.lo).cast("long")
        if mode == "up":
            whole = whole + ((v > 0) & (rest > 0)).cast("long")
        return F.when(v < 0, -whole).otherwise(whole)
