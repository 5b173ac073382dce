"""What the filter:, fragment: and loss: lines of a configuration name: stages on spectra, ion types and losses.

A name that is in no registry is an error. Users add their own by the decorators and the dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masses import C13_DIFF
from ..functions.tolerance import Tolerance
from ..operators import filters as L
from ..operators import fragments as I
from ..operators import spectra as S

_TRUE = {"true", "yes", "t", "y", "1"}
CHARGES = 7  #: highest charge that isotope series in spectra are tried with


def _truth(text: str | None, default: bool) -> bool:
    return default if text is None else text.strip().lower() in _TRUE


@dataclass(frozen=True)
class Spectra:
    """A run's spectra between stages: columns of each spectrum, its peaks as rows, and the peaks that results refer to."""

    table: DataFrame
    peaks: DataFrame  #: spectrum_id, mz, intensity
    tolerance: Tolerance
    origin: DataFrame | None = None

    def only(self, ids: DataFrame) -> Spectra:
        """The spectra that ids (spectrum_id) lists."""
        table = self.table.join(ids, "spectrum_id", "left_semi")
        return replace(self, table=table, peaks=self.peaks.join(ids, "spectrum_id", "left_semi"))

    def series(self) -> DataFrame:
        return S.isotope_clusters(self.peaks, ["spectrum_id"], CHARGES, self.tolerance, every=True)


Stage = Callable[[Spectra], Spectra]
FILTERS: dict[str, Callable[[str], Stage]] = {}


def spectrum_filter(name: str):
    """Register a stage under a (lower-case) name; it is made from the text after the name."""

    def add(make: Callable[[str], Stage]) -> Callable[[str], Stage]:
        FILTERS[name] = make
        return make

    return add


def _options(text: str) -> dict[str, str]:
    """A:x;B:y with lower-case keys; a key alone is true."""
    parts = (p.partition(":") for p in text.split(";") if p.strip())
    return {k.strip().lower(): v.strip() if colon else "true" for k, colon, v in parts}


@dataclass
class Denoise:
    """Rolling top peaks; what later stages look for is kept, see connect()."""

    peaks: int = 20
    window: float = 100.0
    least_mz: float = 0.0
    most_mz: float = float("inf")
    keep_precursor: bool = True
    keep: list[float] = field(default_factory=list)

    def __call__(self, s: Spectra) -> Spectra:
        wanted = [F.array(*[F.lit(float(x)) for x in self.keep])] if self.keep else []
        if self.keep_precursor:  # isotopes below and above the precursor, at any charge
            steps = F.array(*[F.lit(C13_DIFF * p / c) for c in range(1, CHARGES + 1) for p in (-3, -2, -1, 1, 2, 3)])
            wanted.append(F.transform(steps, lambda d: F.col("precursor_mz") + d))
        near: Column = F.lit(False)
        for targets in wanted:
            # Few peaks are between the ends, and only they are held against each target.
            between = F.lit(True) if targets is wanted[0] and self.keep else (F.col("mz") >= s.tolerance.lower(F.col("precursor_mz") - 3 * C13_DIFF)) & (F.col("mz") < s.tolerance.upper(F.col("precursor_mz") + 3 * C13_DIFF))
            near = near | between & F.coalesce(F.exists(targets, lambda t: (F.col("mz") >= s.tolerance.lower(t)) & (F.col("mz") < s.tolerance.upper(t))), F.lit(False))
        held = s.peaks.join(s.table.select("spectrum_id", "precursor_mz"), "spectrum_id").withColumn("__keep", near).drop("precursor_mz")
        left = S.denoised(held, ["spectrum_id"], self.peaks, self.window, CHARGES, s.tolerance, keep="__keep", least_mz=self.least_mz, most_mz=self.most_mz)
        return replace(s, peaks=left.drop("__keep"))


@spectrum_filter("denoise")
def _denoise(text: str) -> Stage:
    o = _options(text)
    keep = [float(x) for x in o.get("keeppeaks", "").split(",") if x.strip()]
    return Denoise(int(float(o.get("peaks", 20))), float(o.get("window", 100)), float(o.get("minmz", 0)), float(o.get("maxmz", "inf")), _truth(o.get("keepprecursor"), True), keep)


@spectrum_filter("removesinglepeaks")
def _remove_single_peaks(text: str) -> Stage:
    return lambda s: replace(s, peaks=S.without_single_peaks(s.peaks, s.series(), ["spectrum_id"]))


@spectrum_filter("rebase")
def _rebase(text: str) -> Stage:
    return lambda s: replace(s, origin=s.peaks)


@spectrum_filter("deisotope")
def _deisotope(text: str) -> Stage:
    return lambda s: replace(s, peaks=S.deisotoped(s.peaks, s.series(), ["spectrum_id"]).drop("charge"))


@spectrum_filter("scanfilteredspectrumaccess")
def _scans(text: str) -> Stage:
    """run:1,2 or run:* or run names scans; whitelist (the default) keeps them, blacklist drops them."""
    keep, listed = True, []
    for item in filter(None, (x.strip() for x in text.split(";"))):
        name, _, value = (x.strip() for x in item.partition(":"))
        if name.lower() in ("whitelist", "blacklist"):
            keep = _truth(value or None, True) == (name.lower() == "whitelist")
        else:
            listed += [(name, None)] if value in ("", "*") else [(name, int(x)) for x in value.split(",")]

    def stage(s: Spectra) -> Spectra:
        spark = s.table.sparkSession
        scans = spark.createDataFrame([(r, n) for r, n in listed if n is not None], "run string, scan int")
        runs = spark.createDataFrame([(r,) for r, n in listed if n is None], "run string")
        same = lambda how: s.table.join(scans, (s.table["run"] == scans["run"]) & (s.table["scan"] == scans["scan"]), how)
        if keep:
            one, whole = same("left_semi").select("spectrum_id"), s.table.join(runs, "run", "left_semi").select("spectrum_id")
            return s.only(one.union(whole).distinct())
        return s.only(same("left_anti").join(runs, "run", "left_anti").select("spectrum_id"))

    return stage


@dataclass
class ContainsPeaks:
    wanted: list[float]
    tolerance: Tolerance | None
    least: int | str

    def __call__(self, s: Spectra) -> Spectra:
        return s.only(L.contains_peaks(s.peaks, "spectrum_id", self.wanted, self.tolerance or s.tolerance, self.least))


@spectrum_filter("containspeaks")
def _contains_peaks(text: str) -> Stage:
    o = _options(text)
    least: int | str = "any" if _truth(o.get("matchany"), False) else "all"
    match = o.get("match", "").lower()
    if match:
        if match not in ("all", "any") and not match.isdigit():
            raise ValueError(f"containspeaks: unknown match {match}")
        least = int(match) if match.isdigit() else match
    return ContainsPeaks([float(x) for x in o.get("peaks", "").split(",") if x.strip()], Tolerance.parse(o["tolerance"]) if "tolerance" in o else None, least)


@dataclass
class PrecursorDetection:
    window: float = 3.0
    longest: bool = True
    charge: bool = False
    artefacts: int = 1
    ratio: float = 3.0

    def __call__(self, s: Spectra) -> Spectra:
        near = s.peaks.join(s.table.select("spectrum_id", "precursor_mz"), "spectrum_id").where(F.abs(F.col("mz") - F.col("precursor_mz")) <= self.window).drop("precursor_mz")
        clusters = S.isotope_clusters(near, ["spectrum_id"], CHARGES, s.tolerance, every=True)
        spectra = s.table.select("spectrum_id", "precursor_mz", "precursor_charge")
        if self.longest:
            found = S.longest_precursor(clusters, near, spectra, "spectrum_id", "precursor_mz", "precursor_charge", s.tolerance, self.charge, self.artefacts, self.ratio)
        else:
            found = S.detect_precursors(clusters, spectra, "spectrum_id", "precursor_mz", self.window)
        table = s.table.join(found, "spectrum_id", "left")
        union = lambda old, new: F.array_distinct(F.concat(F.coalesce(old, F.array().cast(table.schema[old].dataType)), F.coalesce(new, F.array().cast(table.schema[old].dataType))))
        table = table.withColumns({"additional_mz": union("additional_mz", "mz_candidates"), "charge_alternatives": union("charge_alternatives", "charge_candidates")})
        return replace(s, table=table.drop("mz_candidates", "charge_candidates"))


@spectrum_filter("ms2precursordetection")
def _precursors(text: str) -> Stage:
    o = _options(text)
    return PrecursorDetection(float(o.get("window", 3)), _truth(o.get("longest"), True), _truth(o.get("charge"), False), int(o.get("artifactpeaks", 1)), float(o.get("artifactdifference", 3)))


def stages(lines: list[tuple[str, str]]) -> list[Stage]:
    """Stages of the filter lines (name, text) in their order; a denoising keeps what stages behind it look for."""
    out: list[Stage] = []
    for name, text in lines:
        if name.lower() not in FILTERS:
            raise ValueError(f"unknown spectrum filter {name}")
        stage = FILTERS[name.lower()](text)
        for earlier in (x for x in out if isinstance(x, Denoise)):
            if isinstance(stage, PrecursorDetection):
                earlier.keep_precursor = True
            if isinstance(stage, ContainsPeaks):
                earlier.keep = [*earlier.keep, *stage.wanted]
        out.append(stage)
    return out


def filtered(spectra: DataFrame, lines: list[tuple[str, str]], tolerance: Tolerance) -> DataFrame:
    """spectra (as read_spectra gives them, with spectrum_id) after the stages; after a rebase also origin_peaks.

    Peaks are rows between the stages and become arrays once, at the end; a spectrum that lost all its peaks has none.
    """
    made = stages(lines)
    if not made:
        return spectra
    s = Spectra(spectra.drop("peaks"), S.exploded(spectra, ["spectrum_id"]), tolerance)
    for stage in made:
        s = stage(s)
    none = F.array().cast("array<struct<mz:double,intensity:double>>")
    arrays = lambda peaks, name: S.peak_arrays(peaks, ["spectrum_id"]).withColumnRenamed("peaks", name)
    out = s.table.join(arrays(s.peaks, "peaks"), "spectrum_id", "left")
    if s.origin is not None:
        out = out.join(arrays(s.origin, "origin_peaks"), "spectrum_id", "left").withColumn("origin_peaks", F.coalesce("origin_peaks", none))
    return out.withColumn("peaks", F.coalesce("peaks", none)).select(*spectra.columns, *(["origin_peaks"] if s.origin is not None else []))


#: Ion classes: the letter of a terminal ion, or what else they make.
IONS = {"aion": "a", "bion": "b", "cion": "c", "xion": "x", "yion": "y", "zion": "z", "peptideion": "whole", "blikedoublefragmentation": "internal"}


def ion_types(lines: list[str], default: str = "by") -> tuple[str, bool, bool]:
    """Terminal ion types, and whether whole peptides and internal fragments are made; without lines the default."""
    kinds = []
    for line in lines:
        name = line.partition(":")[0].strip()
        kind = name.lower() if len(name) == 1 else IONS.get(name.lower())
        if kind is None or len(kind) == 1 and kind not in "abcxyz":
            raise ValueError(f"unknown ion type {name}")
        kinds.append(kind)
    terminal = "".join(dict.fromkeys(k for k in kinds if len(k) == 1))
    return terminal or ("" if kinds else default), "whole" in kinds, "internal" in kinds


def _restricted(text: str, **more) -> I.Loss:
    o = _options(text)
    if "name" not in o or "mass" not in o:
        raise ValueError(f"a loss needs NAME and MASS: {text}")
    return I.Loss(o["name"], float(o["mass"]), tuple(x.strip() for x in o.get("aminoacids", "").split(",") if x.strip()), n_term="nterm" in o, c_term="cterm" in o, **more)


#: Losses by class name, each made from the text after it.
LOSSES: dict[str, Callable[[str], I.Loss]] = {
    "aminoacidrestrictedloss": _restricted,
    "correctableaminoacidrestrictedloss": lambda text: _restricted(text, correctable=True),
    "crosslinkerrestrictedloss": lambda text: replace(_restricted(text, crosslinked=True), residues=(), n_term=False, c_term=False, once=True),
    "aionloss": lambda text: I.A_ION_LOSS,
    "bionwatergain": lambda text: I.B_WATER_GAIN,
}
LINKER_MODIFIED = "crosslinkermodified"  #: as a loss: linear fragments that carry a linker bound at one end


def losses(lines: list[tuple[str, str]]) -> list[I.Loss]:
    """Losses of the loss lines (name, text) in their order; without lines water and ammonia."""
    out = []
    for name, text in lines:
        if name.lower() == LINKER_MODIFIED:
            continue
        if name.lower() not in LOSSES:
            raise ValueError(f"unknown loss {name}")
        out.append(LOSSES[name.lower()](text))
    return out if lines else [I.WATER_LOSS, I.AMMONIA_LOSS]
