"""Isotope distributions of formulas, by convolution of the elements' distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound

# Natural shares of the isotopes of each element, by nominal mass above the lightest.
SHARES: dict[str, tuple[float, ...]] = {
    "H": (0.999885, 0.000115), "C": (0.9893, 0.0107), "N": (0.99636, 0.00364), "O": (0.99757, 0.00038, 0.00205), "S": (0.9499, 0.0075, 0.0425, 0.0, 0.0001),
    "P": (1.0,), "Na": (1.0,), "Cl": (0.7576, 0.0, 0.2424),
}

# Atoms of each residue: C, H, N, O, S.
ATOMS: dict[str, tuple[int, int, int, int, int]] = {
    "A": (3, 5, 1, 1, 0), "C": (3, 5, 1, 1, 1), "D": (4, 5, 1, 3, 0), "E": (5, 7, 1, 3, 0), "F": (9, 9, 1, 1, 0), "G": (2, 3, 1, 1, 0), "H": (6, 7, 3, 1, 0),
    "I": (6, 11, 1, 1, 0), "K": (6, 12, 2, 1, 0), "L": (6, 11, 1, 1, 0), "M": (5, 9, 1, 1, 1), "N": (4, 6, 2, 2, 0), "P": (5, 7, 1, 1, 0), "Q": (5, 8, 2, 2, 0),
    "R": (6, 12, 4, 1, 0), "S": (3, 5, 1, 2, 0), "T": (4, 7, 1, 2, 0), "V": (5, 9, 1, 1, 0), "W": (11, 10, 2, 1, 0), "Y": (9, 9, 1, 2, 0),
}


def convolved(a: Column, b: Column, peaks: int) -> Column:
    """The first `peaks` terms of the product of two polynomials (arrays of that length)."""
    return F.transform(F.sequence(F.lit(0), F.lit(peaks - 1)), lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda acc, i: acc + F.get(a, i) * F.get(b, k - i)))


def powered(base: list[float], count: Column, peaks: int, bits: int = 16) -> Column:
    """base convolved with itself count times (below 2^bits), by repeated squaring."""
    first = (list(base) + [0.0] * peaks)[:peaks]
    one = F.array(*[F.lit(float(k == 0)) for k in range(peaks)])
    zero = F.struct(one.alias("out"), F.array(*[F.lit(x) for x in first]).alias("square"))
    steps = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.pow(F.lit(2.0), i) <= count)

    def step(acc: Column, i: Column) -> Column:
        odd = F.floor(count / F.pow(F.lit(2.0), i)) % 2 == 1
        return F.struct(F.when(odd, convolved(acc["out"], acc["square"], peaks)).otherwise(acc["out"]).alias("out"), convolved(acc["square"], acc["square"], peaks).alias("square"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def distribution(counts: dict[str, Column], peaks: int = 8) -> Column:
    """Shares of the first `peaks` isotope peaks (of all molecules) for numbers of atoms; null and negative numbers count as 0."""
    parts = [powered(list(SHARES[e]), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), peaks) for e, n in counts.items()]
    return reduce(lambda a, b: bound(F.struct(a.alias("a"), b.alias("b")), lambda v: convolved(v["a"], v["b"], peaks)), parts)


def of_formula(formula: Column, peaks: int = 8) -> Column:
    """Isotope distribution of a formula such as C6H12O6; an element may stand more than once."""
    def atoms(element: str) -> Column:
        found = F.regexp_extract_all(formula, F.lit(rf"{element}(?![a-z])(-?\d*)"), F.lit(1))
        return F.aggregate(found, F.lit(0).cast("long"), lambda acc, n: acc + F.when(n == "", 1).otherwise(n.cast("long")))

    return distribution({e: atoms(e) for e in SHARES}, peaks)


def of_peptide(residues: Column, peaks: int = 8) -> Column:
    """Isotope distribution of an unmodified peptide; residues without a formula add no atoms."""
    def atoms(k: int, more: int) -> Column:
        table = F.create_map(*[F.lit(x) for r, n in ATOMS.items() for x in (r, n[k])])
        return F.aggregate(residues, F.lit(more).cast("long"), lambda acc, r: acc + F.coalesce(F.element_at(table, r), F.lit(0)))

    return distribution({e: atoms(k, more) for k, (e, more) in enumerate((("C", 0), ("H", 2), ("N", 0), ("O", 1), ("S", 0)))}, peaks)
