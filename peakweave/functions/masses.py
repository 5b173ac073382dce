"""Physical constants, residue masses and mass arithmetic as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic masses in Da.
PROTON = 1.00727646677
C13_DIFF = 1.0033548
WATER = 18.01056027
AMMONIA = 17.02654493
OXYGEN = 15.99491
CARBON = 12.0
NITROGEN = 14.003074
HYDROGEN = 1.007825035
PPM = 1e-6

# Residue masses in Da. B counts as N; Z counts as Q (see README, deviations); X has no mass.
RESIDUES: dict[str, float] = {
    "A": 71.037114, "C": 103.009184, "D": 115.026943, "E": 129.042593, "F": 147.068414, "G": 57.021464, "H": 137.058912,
    "I": 113.084064, "K": 128.094963, "L": 113.084064, "M": 131.040485, "N": 114.042927, "P": 97.052764, "Q": 128.058578,
    "R": 156.101111, "S": 87.032028, "T": 101.047678, "V": 99.068414, "W": 186.079313, "Y": 163.063329,
    "U": 150.953633405, "O": 237.147726925, "B": 114.042927, "Z": 128.058578, "X": float("inf"),
}

# Monoisotopic element masses in Da.
ELEMENTS: dict[str, float] = {"H": HYDROGEN, "C": CARBON, "N": NITROGEN, "O": OXYGEN, "S": 31.97207, "P": 30.973762, "Na": 22.98977, "Cl": 34.968853}


def neutral_mass(mz: Column, charge: Column) -> Column:
    """(m/z - proton) * z."""
    return (mz - F.lit(PROTON)) * charge


def mz_of(mass: Column, charge: Column) -> Column:
    """mass / z + proton."""
    return mass / charge + F.lit(PROTON)


def residue_map(extra: dict[str, float] | None = None) -> Column:
    table = RESIDUES | (extra or {})
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def tokens(sequence: Column) -> Column:
    """Residues of a sequence: an upper-case letter with the lower-case or bracketed modification, or the (a|b) alternatives, after it."""
    return F.regexp_extract_all(sequence, F.lit(r"([A-Z](?:[a-z0-9_]+|\[[^\]]*\]|\([^A-Z()]*\))*)"), F.lit(1))


def residue_mass(residue: Column, extra: dict[str, float] | None = None) -> Column:
    """Mass of one residue token; X[12.3] weighs 12.3 more than X, and unknown residues are infinite."""
    custom = F.element_at(residue_map(extra), F.substring(residue, 1, 1)) + F.regexp_extract(residue, r"\[([^\]]+)\]$", 1).try_cast("double")
    return F.coalesce(F.element_at(residue_map(extra), residue), custom, F.lit(float("inf")))


def weighable(residue: Column, extra: dict[str, float] | None = None) -> Column:
    """Whether residue_mass() is finite, by a set lookup."""
    table = RESIDUES | (extra or {})
    custom = residue.rlike(r"^[A-WYZ].*\[[-+]?[0-9.]+\]$")
    return residue.isin(*[r for r, m in table.items() if m < float("inf")]) | custom


def peptide_mass(residues: Column, extra: dict[str, float] | None = None) -> Column:
    """Sum over the residue array, from the left, starting at water."""
    return F.aggregate(residues, F.lit(WATER), lambda acc, r: acc + residue_mass(r, extra))


def base_sequence(sequence: Column) -> Column:
    """The sequence without modifications."""
    return F.regexp_replace(sequence, r"[^A-Z]", "")


def formula_mass(formula: Column) -> Column:
    """Mass of a chemical formula such as C6H12O6 or H-2O-1."""
    parts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?-?\d*)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in ELEMENTS.items() for x in kv])

    def add(acc: Column, part: Column) -> Column:
        count = F.regexp_extract(part, r"(-?\d+)", 1)
        return acc + F.element_at(table, F.regexp_extract(part, r"([A-Z][a-z]?)", 1)) * F.when(count == "", F.lit(1.0)).otherwise(count.cast("double"))

    return F.aggregate(parts, F.lit(0.0), add)


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of doubles, added from the left; a fold that copies, for arrays as short as peptides."""
    zero = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, zero, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.array_append(acc["out"], acc["s"] + v).alias("out")), lambda acc: acc["out"])


def isotope_shares(mass: Column, peaks: int = 6) -> Column:
    """Approximate relative intensities of isotope peaks: Poisson with the mean that averagine carbons give (0.0111 of mass / 111.1 * 4.94)."""
    mean = mass / F.lit(111.1254) * F.lit(4.9384) * F.lit(0.0107) / F.lit(1 - 0.0107) * F.lit(1.1)
    return F.transform(F.sequence(F.lit(0), F.lit(peaks - 1)), lambda k: F.exp(-mean) * F.pow(mean, k) / F.factorial(k.cast("int")).cast("double"))


def concat_all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), columns)
