"""Tolerances: absolute (Da) or relative (ppm), as bounds and comparisons of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masses import PPM


@dataclass(frozen=True)
class Tolerance:
    value: float
    unit: str = "ppm"

    def __post_init__(self) -> None:
        if self.unit.lower() not in ("ppm", "da", "m/z", "mz"):
            raise ValueError(f"unknown tolerance unit {self.unit}")

    @classmethod
    def parse(cls, text: str) -> Tolerance:
        """From "6ppm", "20 ppm", "0.5 Da"."""
        number = "".join(c for c in text if c in "0123456789.eE-+").rstrip("eE")
        return cls(float(number), text.strip().removeprefix(number).strip().lower())

    @property
    def relative(self) -> bool:
        return self.unit.lower() == "ppm"

    def width(self, reference: Column) -> Column:
        return reference * F.lit(PPM) * F.lit(self.value) if self.relative else F.lit(self.value)

    def lower(self, value: Column, reference: Column | None = None) -> Column:
        return value - self.width(value if reference is None else reference)

    def upper(self, value: Column, reference: Column | None = None) -> Column:
        return value + self.width(value if reference is None else reference)

    def compare(self, a: Column, b: Column) -> Column:
        """-1, 0 or 1; a relative tolerance is taken of the larger value, and bounds count as equal."""
        if self.relative:
            t = F.greatest(a, b) * F.lit(PPM) * F.lit(self.value)
            return F.when((a > b) & (a - t > b), 1).when((a <= b) & (b - t > a), -1).otherwise(0)
        return F.when(a + F.lit(self.value) < b, -1).when(a - F.lit(self.value) > b, 1).otherwise(0)

    def compare_both(self, a: Column, b: Column) -> Column:
        """As compare, but the windows around both values may overlap."""
        return F.when(self.upper(a) < self.lower(b), -1).when(self.lower(a) > self.upper(b), 1).otherwise(0)

    def least_difference(self, a: Column, b: Column) -> Column:
        """Gap between the windows of both values, 0 where they overlap."""
        return F.greatest(self.lower(b) - self.upper(a), self.lower(a) - self.upper(b), F.lit(0.0))

    def error(self, measured: Column, expected: Column) -> Column:
        """Signed error in the tolerance's own unit."""
        return (measured - expected) / expected / F.lit(PPM) if self.relative else measured - expected

    def low_resolution(self) -> bool:
        """An absolute tolerance above 0.06 Da marks low-resolution data."""
        return not self.relative and self.value > 0.06
