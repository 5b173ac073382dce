"""Transforms of spectra. A peak table is long: one row per peak with the spectrum's key columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masses import C13_DIFF, PROTON, RESIDUES, WATER
from ..functions.tolerance import Tolerance


def precursor_variants(spectra: DataFrame, mz: str, charge: str, charges: Column, offsets: Column | None = None, absolute_from: float = 100.0) -> DataFrame:
    """One row per precursor hypothesis: each alternative charge (for unknown charge) times each alternative m/z.

    offsets holds alternatives: values below absolute_from are mass offsets in Da, others absolute m/z.
    """
    z = F.when(F.col(charge) > 0, F.array(F.col(charge))).otherwise(charges)
    out = spectra.withColumn("hyp_charge", F.explode(z))
    alternatives = F.array(F.lit(0.0)) if offsets is None else F.concat(F.array(F.lit(0.0)), offsets)
    out = out.withColumn("__alt", F.explode(alternatives))
    value = F.when(F.col("__alt") < absolute_from, F.col(mz) + F.col("__alt") / F.col("hyp_charge")).otherwise(F.col("__alt"))
    out = out.withColumn("hyp_mz", value).drop("__alt")
    return out.withColumn("hyp_mass", (F.col("hyp_mz") - F.lit(PROTON)) * F.col("hyp_charge"))


def missing_isotope_offsets(k: int) -> Column:
    """Offsets for precursors that were picked up to k isotopes too high."""
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: -i * F.lit(C13_DIFF)) if k else F.array().cast("array<double>")


def relaxed_offsets(mass: Column, charge: Column) -> Column:
    """A one-isotope-lower variant for heavy precursors: above 7500 Da, above 4500 for charge > 4, above 2000 for charge > 3."""
    heavy = (mass > 7500) | (mass > 4500) & (charge > 4) | (mass > 2000) & (charge > 3)
    return F.when(heavy, F.array(F.lit(-C13_DIFF))).otherwise(F.array().cast("array<double>"))


def shifted(peaks: DataFrame, mz: str, by: float) -> DataFrame:
    return peaks.withColumn(mz, F.col(mz) + F.lit(by))


def with_shifted_copy(peaks: DataFrame, mz: str, by: float, copy: str = "is_copy") -> DataFrame:
    """The peaks and a copy of them moved by a mass."""
    return peaks.withColumn(copy, F.lit(False)).unionByName(shifted(peaks, mz, by).withColumn(copy, F.lit(True)))


def rebase(spectra: DataFrame, peaks: str = "peaks", origin: str = "origin_peaks") -> DataFrame:
    """The current peaks become the origin that results refer to."""
    return spectra.withColumn(origin, F.col(peaks))


def isotope_clusters(peaks: DataFrame, spectrum: list[str], most_charge: Column | int, tolerance: Tolerance, mz: str = "mz", intensity: str = "intensity", most_ratio: float = 8.0, split_factor: float | None = None, every: bool = False) -> DataFrame:
    """Isotope series of each spectrum: key, cluster_id, charge, peak (index by m/z), place (0 is monoisotopic), mz, intensity.

    Peaks are visited upwards; for each charge a series goes on while a peak stands k steps of the C13
    difference over charge above the first one. A first step that is most_ratio times as intense starts none.
    every: each charge with a second peak gives a cluster, and where older series had masked peaks below, the
    series extended downwards is another one; deisotoped() then chooses. Otherwise only the longest series of
    a start (of equals the lowest charge) counts, and only its extended form. split_factor: with 5 peaks or
    more, a series is cut where intensities differ from the averagine expectation by that factor. The scan is
    order dependent; many spectra are scanned per batch, and only those with two peaks near each other one by one.
    """
    schema = ", ".join(f"`{c}` {peaks.schema[c].dataType.simpleString()}" for c in spectrum) + ", cluster_id int, charge int, peak int, place int, mz double, intensity double"
    held = peaks.withColumn("__z", F.lit(most_charge) if isinstance(most_charge, int) else most_charge).select(*spectrum, F.col(mz).cast("double").alias("mz"), F.col(intensity).cast("double").alias("intensity"), "__z")

    def scan(frame: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        x, y, top = frame["mz"].to_numpy(float), frame["intensity"].to_numpy(float), frame["__z"].fillna(1).to_numpy(int)
        rows: list[tuple[int, int, int, int]] = []
        for s in np.flatnonzero(_with_near_peaks(x, cuts)).tolist():
            at, end = cuts[s], cuts[s + 1]
            for number, (z, part) in enumerate(_series(x[at:end], y[at:end], int(top[at]) or 1, tolerance, most_ratio, split_factor, every)):
                rows += [(at + j, number, z, p) for p, j in enumerate(part)]
        row, number, z, place = np.array(rows, np.int64).reshape(-1, 4).T
        first = np.array(cuts)[np.searchsorted(cuts, row, "right") - 1] if len(row) else row
        out = frame[spectrum].iloc[row].reset_index(drop=True)
        return out.assign(cluster_id=number, charge=z, peak=row - first, place=place, mz=x[row], intensity=y[row])

    return _by_spectrum(held, spectrum, "mz", scan, schema)


def _by_spectrum(peaks: DataFrame, spectrum: list[str], mz: str, scan: Callable[[pd.DataFrame, list[int]], pd.DataFrame], schema) -> DataFrame:
    """scan(frame, cuts) over whole spectra, many in a frame: spectrum k is rows cuts[k] to cuts[k + 1], by ascending m/z.

    A spectrum that a frame ends in waits for the next frame, so only one spectrum has to fit beside a frame.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            frame = pd.concat([*waiting, frame], ignore_index=True) if waiting else frame
            keys = frame[spectrum]
            before = keys.shift()
            new = ((keys != before) & ~(keys.isna() & before.isna())).any(axis=1).to_numpy().copy()
            new[0] = True
            cuts = np.flatnonzero(new).tolist()
            if len(cuts) > 1:
                yield scan(frame.iloc[: cuts[-1]], cuts)
            waiting = [frame.iloc[cuts[-1] :]]
        if waiting:
            last = waiting[0].reset_index(drop=True)
            yield scan(last, [0, len(last)])

    return peaks.repartition(*spectrum).sortWithinPartitions(*spectrum, mz).mapInPandas(run, schema)


_NEAR = 1.1  #: a series starts only where the next peak is at most that far


def _with_near_peaks(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Which spectra have two neighbouring peaks that are near; without them there is no series, and no two peaks have one m/z."""
    near = ~(np.diff(x) > _NEAR)
    near[np.array(cuts[1:-1], np.int64) - 1] = False
    out = np.zeros(len(cuts) - 1, bool)
    out[np.searchsorted(cuts, np.flatnonzero(near), "right") - 1] = True
    return out


def _roll_plain(x: np.ndarray, y: np.ndarray, kept: np.ndarray, n: int, window: float) -> np.ndarray:
    """Peaks that stay, of spectra (rows) of one size without series, rolled side by side; see denoised()."""
    there, done, row = np.ones(x.shape, bool), kept.copy(), np.arange(len(x))
    order = np.argsort(-y, axis=1, kind="stable")
    for centre in order.T:
        c = x[row, centre][:, None]
        near = there & (x >= c - window / 2) & (x < c + window / 2) & ~done[row, centre][:, None]
        over = near.sum(1) - n
        full = np.flatnonzero(over > 0)
        if len(full):
            weakest = np.argsort(np.where(near[full], y[full], np.inf), axis=1, kind="stable")
            at, place = np.nonzero(np.arange(x.shape[1]) < over[full][:, None])
            there[full[at], weakest[at, place]], done[full[at], weakest[at, place]] = False, True
    return there


def _series(x: np.ndarray, y: np.ndarray, top: int, tolerance: Tolerance, most_ratio: float, split_factor: float | None, every: bool) -> list[tuple[int, list[int]]]:
    """Charge and peaks of the isotope series of one spectrum, whose m/z x ascend; see isotope_clusters()."""
    taken = np.zeros(len(x), bool)
    wide = (lambda v: v * tolerance.value * 1e-6) if tolerance.relative else (lambda v: tolerance.value)

    def at(v: float) -> int:
        lo, hi = np.searchsorted(x, [v - wide(v), v + wide(v)])
        return int(lo + np.argmin(np.abs(x[lo:hi] - v))) if hi > lo else -1

    out: list[tuple[int, list[int]]] = []
    for i in range(len(x) - 1):
        if taken[i] or x[i + 1] - x[i] > _NEAR:
            continue
        found: list[tuple[int, list[int]]] = []
        for z in range(1, top + 1):
            step = C13_DIFF / z
            series, k = [i], 1
            while (j := at(x[i] + k * step)) > i and not (k == 1 and y[j] >= most_ratio * y[i]):
                series.append(j)
                k += 1
            if len(series) > 1:
                found.append((z, series))
        if not every and found:
            found = [max(found, key=lambda f: len(f[1]))]
        for z, series in found:
            below, k = [], 1
            while (j := at(x[i] - k * C13_DIFF / z)) >= 0 and j < i:
                below.insert(0, j)
                k += 1
            taken[below + series] = True
            forms = [series] if every or not below else []
            for form in forms + ([below + series] if below else []):
                out += [(z, part) for part in _split(form, x, y, z, split_factor)]
    return out


def averagine_share(mass: float, k: int) -> float:
    """Expected share of isotope k for a peptide of this mass (Poisson in the number of C13)."""
    mean = mass / 111.1254 * 4.9384 * 0.0118
    out = np.exp(-mean)
    for i in range(1, k + 1):
        out *= mean / i
    return float(out)


def _split(series: list[int], x: np.ndarray, y: np.ndarray, z: int, factor: float | None) -> list[list[int]]:
    if factor is None or len(series) < 5:
        return [series]
    mass = (x[series[0]] - PROTON) * z
    for k in range(1, len(series)):
        expected = averagine_share(mass, k) / max(averagine_share(mass, k - 1), 1e-12)
        found = y[series[k]] / max(y[series[k - 1]], 1e-12)
        if found > factor * expected and len(series) - k >= 2:
            return [series[:k], series[k:]] if k >= 2 else [series]
    return [series]


def deisotoped(peaks: DataFrame, clusters: DataFrame, spectrum: list[str], mz: str = "mz", intensity: str = "intensity", each: bool = False) -> DataFrame:
    """One peak per series (at its monoisotopic m/z, the longest series winning, intensities summed) and the peaks of no series.

    each: series that start at the same m/z keep one peak each.
    """
    series = clusters.groupBy(*spectrum, "cluster_id", "charge").agg(F.min("mz").alias(mz), F.sum("intensity").alias(intensity), F.count(F.lit(1)).alias("size"))
    members = clusters.select(*spectrum, F.col("mz").alias(mz)).distinct()
    single = peaks.select(*spectrum, mz, intensity).join(members, [*spectrum, mz], "left_anti").withColumn("charge", F.lit(None).cast("int"))
    if each:
        return series.select(*spectrum, mz, intensity, "charge").unionByName(single)
    best = series.groupBy(*spectrum, mz).agg(F.max(F.struct("size", intensity, "charge")).alias("c"))
    merged = best.select(*spectrum, mz, F.col(f"c.{intensity}").alias(intensity), F.col("c.charge").alias("charge"))
    return merged.unionByName(single)


def decharged(peaks: DataFrame, spectrum: list[str], mz: str = "mz", charge: str = "charge", intensity: str = "intensity") -> DataFrame:
    """Every peak at charge 1 (unknown charge counts as 1), intensities at equal m/z summed."""
    z = F.coalesce(F.col(charge), F.lit(1))
    one = (F.col(mz) - F.lit(PROTON)) * z + F.lit(PROTON)
    return peaks.withColumn("__one", one).groupBy(*spectrum, "__one").agg(F.sum(intensity).alias(intensity)).withColumnRenamed("__one", mz)


def delossed(peaks: DataFrame, spectrum: str, loss: float, tolerance: Tolerance, mz: str = "mz", charge: str = "charge") -> DataFrame:
    """Drop peaks for which one of the same charge stands loss / charge above; unknown charge tries 1 to 4."""
    from .range_join import tolerance_join

    z = F.explode(F.when(F.col(charge).isNull(), F.sequence(F.lit(1), F.lit(4))).otherwise(F.array(F.col(charge))))
    low = peaks.select(F.col(spectrum).alias("__s"), F.col(mz).alias("__mz"), F.col(charge).alias("__c"), z.alias("__z"))
    low = low.withColumn("__target", F.col("__mz") + F.lit(loss) / F.col("__z"))
    hits = tolerance_join(low, peaks.select(spectrum, F.col(mz).alias("__up"), F.col(charge).alias("__uc")), "__target", "__up", tolerance)
    hits = hits.where((F.col("__s") == F.col(spectrum)) & (F.coalesce("__uc", "__z") == F.col("__z")))
    lossy = hits.select(F.col("__s").alias(spectrum), F.col("__mz").alias(mz)).distinct()
    return peaks.join(lossy, [spectrum, mz], "left_anti")


def linearised(peaks: DataFrame, spectrum: list[str], precursor_mass: str, mz: str = "mz", charge: str = "charge", intensity: str = "intensity", complements: bool = True, every: bool = False) -> DataFrame:
    """Charge-1 peaks and their complements against the precursor mass, intensities at equal m/z summed.

    A charge up to 2 (or unknown) keeps the peak; from 2 on (with every: always) the complement
    precursor - (mz - proton) + proton is added. complements=False gives the plain reduced spectrum.
    """
    one = peaks.withColumn("__z", F.coalesce(F.col(charge), F.lit(1))).withColumn(mz, (F.col(mz) - F.lit(PROTON)) * F.col("__z") + F.lit(PROTON))
    keep = one.where(F.col("__z") <= 2) if complements and not every else one
    out = keep.select(*spectrum, mz, intensity)
    if complements:
        other = (one if every else one.where(F.col("__z") >= 2)).withColumn(mz, F.col(precursor_mass) - (F.col(mz) - F.lit(PROTON)) + F.lit(PROTON))
        out = out.unionByName(other.where(F.col(mz) > 0).select(*spectrum, mz, intensity))
    return out.groupBy(*spectrum, mz).agg(F.sum(intensity).alias(intensity))


_SHORT = 64  #: spectra of more peaks are rolled one by one


def denoised(peaks: DataFrame, spectrum: list[str], n: int, window: float, most_charge: Column | int, tolerance: Tolerance, keep: str | None = None, least_mz: float = 0.0, most_mz: float = float("inf"), mz: str = "mz", intensity: str = "intensity", most_ratio: float = 8.0, split_factor: float | None = None) -> DataFrame:
    """Rolling top-n over isotope series: from the most intense on, the weakest of an overfull window around it are deleted.

    Peaks below least_mz or from most_mz on go first. Then a series counts as one peak at its monoisotopic m/z,
    with its summed intensity, and rows of equal m/z as one peak. In the end every series (of any charge) of
    which a peak is left comes back whole. Deletions change later windows, so a spectrum is rolled as a whole; short
    spectra without series are rolled side by side.
    keep: a boolean column of peaks that centre no window and that the limits spare.
    """
    schema = peaks.schema
    held = peaks.withColumn("__z", F.lit(most_charge) if isinstance(most_charge, int) else most_charge)

    def roll(frame: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        top = frame["__z"].fillna(1).to_numpy(int)
        x, y = frame[mz].to_numpy(float), frame[intensity].to_numpy(float)
        spared = frame[keep].fillna(False).to_numpy(bool) if keep else np.zeros(len(frame), bool)
        sizes = np.diff(cuts)
        alone = _with_near_peaks(x, cuts) | (sizes > _SHORT) | (np.bincount(np.repeat(np.arange(len(sizes)), sizes), ~(np.isfinite(x) & np.isfinite(y)), len(sizes)) > 0)
        stays = np.zeros(len(x), bool)
        for s in np.flatnonzero(alone).tolist():
            at, end = cuts[s], cuts[s + 1]
            stays[at + _rolled(x[at:end], y[at:end], spared[at:end], int(top[at]) or 1)] = True
        rows = np.flatnonzero(~np.repeat(alone, sizes) & (spared | (x >= least_mz) & (x < most_mz)))
        stays[rows] = True
        of = np.repeat(np.arange(len(sizes)), sizes)[rows]
        held = np.bincount(of, minlength=len(sizes))
        for size in np.unique(held[held > n]).tolist():
            some = rows[held[of] == size].reshape(-1, size)
            stays[some] = _roll_plain(x[some], y[some], spared[some], n, window)
        return frame.drop(columns="__z")[stays]

    def _rolled(x: np.ndarray, y: np.ndarray, kept: np.ndarray, top: int) -> np.ndarray:
        """Rows of one spectrum that stay."""
        rows = np.flatnonzero(kept | (x >= least_mz) & (x < most_mz))
        x, peak = np.unique(x[rows], return_inverse=True)
        y = np.bincount(peak, y[rows], len(x))
        done = np.bincount(peak, kept[rows], len(x)) > 0
        clusters = [part for _, part in _series(x, y, top, tolerance, most_ratio, split_factor, True)]
        there, longest = np.ones(len(x), bool), {}
        for part in clusters:
            there[part] = False
            longest[part[0]] = max(longest.get(part[0], []), part, key=lambda p: (len(p), y[p].sum()))
        level = y.copy()
        for first, part in longest.items():
            there[first], level[first] = True, y[part].sum()
        for i in np.flatnonzero(there)[np.argsort(-level[there], kind="stable")]:
            if done[i]:
                continue
            lo, hi = np.searchsorted(x, [x[i] - window / 2, x[i] + window / 2])
            near = np.flatnonzero(there[lo:hi]) + lo
            if len(near) > n:
                weakest = near[np.argsort(level[near], kind="stable")][: len(near) - n]
                there[weakest], done[weakest] = False, True
        back = there.copy()
        for part in clusters:
            if there[part].any():
                back[part] = True
        return rows[back[peak]]

    return _by_spectrum(held, spectrum, mz, roll, schema)


def without_single_peaks(peaks: DataFrame, clusters: DataFrame, spectrum: list[str], mz: str = "mz") -> DataFrame:
    """Only peaks that belong to an isotope series."""
    return peaks.join(clusters.select(*spectrum, F.col("mz").alias(mz)).distinct(), [*spectrum, mz], "left_semi")


def detect_precursors(clusters: DataFrame, spectra: DataFrame, spectrum: str, precursor_mz: str, window: float) -> DataFrame:
    """Candidate precursor m/z and charges from series inside the isolation window: key, mz_candidates, charge_candidates."""
    starts = clusters.where("place = 0").select(spectrum, "mz", "charge").join(spectra.select(spectrum, precursor_mz), spectrum)
    near = starts.where(F.abs(F.col("mz") - F.col(precursor_mz)) <= window)
    steps = F.round((F.col("mz") - F.col(precursor_mz)) * F.col("charge") / F.lit(C13_DIFF)) * F.lit(C13_DIFF) / F.col("charge")
    return near.groupBy(spectrum).agg(F.sort_array(F.collect_set(F.col(precursor_mz) + steps)).alias("mz_candidates"), F.sort_array(F.collect_set("charge")).alias("charge_candidates"))


# Expected height of isotope peak k of a peptide, max(0, a * mass + b); the last pair holds for all later peaks.
AVERAGINE_A = (-0.02576, 0.049889, 0.029321, 0.020406, 0.012126, 0.013333, 0.006667, 0.003333, 0.001667)
AVERAGINE_B = (136.0, 0.0, -2.93, -2.04, -12.0, -26.0, -39.0, -58.0, -87.0)


def averagine_height(mass: Column, k: Column) -> Column:
    """Expected relative height of the k-th isotope peak (from 0) at this mass, by the linear model."""
    at = F.least(k, F.lit(len(AVERAGINE_A) - 1)).cast("int")
    table = lambda values: F.get(F.array(*[F.lit(v) for v in values]), at)
    return F.greatest(mass * table(AVERAGINE_A) + table(AVERAGINE_B), F.lit(0.0))


def longest_precursor(clusters: DataFrame, peaks: DataFrame, spectra: DataFrame, spectrum: str, precursor_mz: str, charge: str, tolerance: Tolerance, other_charges: bool = False, artefacts: int = 1, ratio: float = 3.0) -> DataFrame:
    """Candidate precursors from the longest series that holds the precursor's peak: key, mz_candidates, charge_candidates.

    The series has the precursor's charge (with other_charges: at most that); of equal ones that with the lowest m/z, then the
    highest charge counts. It moves the precursor by whole C13 steps to where the series starts. Up to `artefacts` of its first
    peaks may be artefacts: where the next peak is more than `ratio` times what the linear averagine model expects after
    peak p, and at least three peaks follow, the precursor is also tried from peak p + 1's predecessor on. Spectra
    without a peak at the precursor, or without such a series, give no row.
    """
    window = lambda x: (x >= tolerance.lower(F.col(precursor_mz))) & (x < tolerance.upper(F.col(precursor_mz)))
    known = peaks.join(spectra.select(spectrum, precursor_mz, charge), spectrum).where(window(F.col("mz")))
    known = known.groupBy(spectrum).agg(F.min_by("mz", F.struct(F.abs(F.col("mz") - F.col(precursor_mz)), "mz")).alias("__peak"), F.first(precursor_mz).alias("__pmz"), F.first(charge).alias("__pz"))
    series = clusters.groupBy(spectrum, "cluster_id", F.col("charge").alias("__z")).agg(F.sort_array(F.collect_list(F.struct("place", "mz", "intensity"))).alias("__s"))
    fits = (F.col("__z") <= F.col("__pz")) if other_charges else F.col("__z") == F.col("__pz")
    held = series.join(known, spectrum).where(fits & F.exists("__s", lambda p: p["mz"] == F.col("__peak")))
    start = F.col("__s")[0]["mz"]
    best = held.groupBy(spectrum).agg(F.min_by(F.struct("__s", "__z", "__pmz", "__pz"), F.struct((-F.size("__s")).alias("n"), start.alias("m"), (-F.col("__z")).alias("z"))).alias("b")).select(spectrum, "b.*")
    step = F.lit(C13_DIFF) / F.col("__z")
    best = best.withColumn("__k", F.round((start - F.col("__pmz")) / step))
    shift = lambda k: F.col("__pmz") + k * step

    def artefact(p: Column) -> Column:
        here, after = F.get("__s", p)["intensity"], F.get("__s", p + 1)["intensity"]
        expected = here / averagine_height(start, p) * averagine_height(start, p + 1)
        return (F.size("__s") > p + 3) & (p != -F.col("__k")) & F.coalesce(expected < after / ratio, F.lit(False)) & (F.col("__k") + p != 0)

    extra = F.transform(F.filter(F.sequence(F.lit(0), F.lit(max(artefacts - 1, 0))), artefact), lambda p: shift(F.col("__k") + p)) if artefacts > 0 else F.array().cast("array<double>")
    moved = F.when(F.col("__k") != 0, F.array(shift(F.col("__k")))).otherwise(F.array().cast("array<double>"))
    charges = F.when(F.col("__z") != F.col("__pz"), F.array("__z")).otherwise(F.array().cast("array<int>"))
    return best.select(spectrum, F.sort_array(F.array_distinct(F.concat(moved, extra))).alias("mz_candidates"), charges.alias("charge_candidates"))


# Calibration: errors are measured - expected; each returns rows with a corrected m/z.


def exact_medians(rows: DataFrame, group: list[str], value: Column, name: str, cells: int = 4096) -> DataFrame:
    """group (not null) and its exact median of value, without all values of a group in one task.

    Values are counted in equal cells between the ends of a group; only the one or two cells that hold the middle ranks are then
    put in order, equal values as one. Infinities and NaN (the largest) have cells of their own. A group of nulls alone has a null median.
    """
    x = F.col("__x")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    held = rows.select(*group, value.cast("double").alias("__x"))
    ends = held.groupBy(*group).agg(F.min(finite).alias("__lo"), F.max(finite).alias("__hi"), F.count("__x").alias("__n"))
    spread = F.col("__hi") / 2 - F.col("__lo") / 2  # halves, so that the difference of the ends can't overflow
    cell = F.when(F.isnan(x), cells + 2).when(x == float("inf"), cells + 1).when(x == -float("inf"), -1).when(spread > 0, F.floor((x / 2 - F.col("__lo") / 2) / spread * cells)).otherwise(0)
    held = held.where("__x is not null").join(ends, group).withColumn("__cell", cell.cast("int"))
    own = Window.partitionBy(*group).orderBy("__cell")
    counts = held.groupBy(*group, "__cell", "__n").agg(F.count(F.lit(1)).alias("__k")).withColumn("__upto", F.sum("__k").over(own))
    low, high = F.expr("(__n - 1) div 2"), F.expr("__n div 2")  # the middle ranks, from 0
    middle = counts.where((F.col("__upto") > low) & (F.col("__upto") - F.col("__k") <= high)).select(*group, "__cell", (F.col("__upto") - F.col("__k")).alias("__before"))
    few = held.join(middle, [*group, "__cell"]).groupBy(*group, "__cell", "__n", "__before", "__x").agg(F.count(F.lit(1)).alias("__k"))
    last = F.col("__before") + F.sum("__k").over(Window.partitionBy(*group, "__cell").orderBy("__x"))
    few = few.withColumn("__last", last)
    at = lambda rank: F.max(F.when((F.col("__last") > rank) & (F.col("__last") - F.col("__k") <= rank), x))
    found = few.groupBy(*group).agg(at(low).alias("__a"), at(high).alias("__b")).withColumn(name, F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") * 0.5 + F.col("__b") * 0.5))
    return ends.select(*group).join(found.select(*group, name), group, "left")


def calibrate_shift(rows: DataFrame, run: list[str], measured: str, expected: str, relative: bool = False, exact: bool = False) -> DataFrame:
    """Subtract the run's median error, absolute or relative; the median is a sketch's, or exact (more passes, for runs of any size)."""
    error = F.col(measured) - F.col(expected)
    error = error / F.col(expected) if relative else error
    shift = exact_medians(rows, run, error, "shift") if exact else rows.groupBy(*run).agg(F.percentile_approx(error, 0.5).alias("shift"))
    fixed_ = F.col(measured) / (1 + F.col("shift")) if relative else F.col(measured) - F.col("shift")
    return rows.join(shift, run).withColumn("calibrated", fixed_)


def calibrate_regression(rows: DataFrame, spectrum: list[str], run: list[str], measured: str, expected: str, least: int = 3) -> DataFrame:
    """Subtract a linear fit of the error over m/z: of the spectrum with `least` points or more, else of the run."""
    error = F.col(measured) - F.col(expected)
    fit = lambda p: [F.regr_slope(error, F.col(measured)).alias(f"{p}_slope"), F.regr_intercept(error, F.col(measured)).alias(f"{p}_intercept"), F.count(error).alias(f"{p}_n")]
    own, all_ = rows.groupBy(*spectrum).agg(*fit("own")), rows.groupBy(*run).agg(*fit("run"))
    out = rows.join(own, spectrum).join(all_, run)
    use = (F.col("own_n") >= least) & F.col("own_slope").isNotNull()
    slope = F.when(use, F.col("own_slope")).otherwise(F.coalesce("run_slope", F.lit(0.0)))
    intercept = F.when(use, F.col("own_intercept")).otherwise(F.coalesce("run_intercept", F.lit(0.0)))
    return out.withColumn("calibrated", F.col(measured) - (slope * F.col(measured) + intercept)).drop(*[f"{p}_{k}" for p in ("own", "run") for k in ("slope", "intercept", "n")])


def calibrate_two_groups(rows: DataFrame, run: list[str], measured: str, expected: str, split: float, exact: bool = False) -> DataFrame:
    """Separate median shifts below and above an m/z."""
    return calibrate_shift(rows.withColumn("__g", F.col(measured) < split), [*run, "__g"], measured, expected, exact=exact).drop("__g")


def known_peak_errors(peaks: DataFrame, known: DataFrame, spectrum: list[str], tolerance: Tolerance, mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """spectrum, known_mz, error (relative), weight: of each known peak (known_mz, known_weight) the nearest one of a spectrum in its window.

    The weight is the known peak's times the intensity that was found.
    """
    from .range_join import tolerance_join

    near = tolerance_join(known.select("known_mz", "known_weight"), peaks.select(*spectrum, F.col(mz).alias("__mz"), F.col(intensity).alias("__i")), "known_mz", "__mz", tolerance)
    best = near.groupBy(*spectrum, "known_mz", "known_weight").agg(F.min_by(F.struct("__mz", "__i"), F.struct(F.abs(F.col("__mz") - F.col("known_mz")), F.col("__mz"), F.col("__i"))).alias("p"))
    return best.select(*spectrum, "known_mz", ((F.col("p.__mz") - F.col("known_mz")) / F.col("known_mz")).alias("error"), (F.col("known_weight") * F.col("p.__i")).alias("weight"))


def run_corrections(errors: DataFrame, run: list[str], step: float = 1e-9) -> DataFrame:
    """run, offset, found: the weighted median of each run's relative errors, and how many there are.

    Errors are first summed up in steps of 0.001 ppm, so what is sorted per run is bounded by the tolerance's width
    and not by the run's spectra; the smallest error in the median's step is the offset.
    """
    binned = errors.where("weight > 0").groupBy(*run, F.floor(F.col("error") / F.lit(step)).alias("__bin")).agg(F.sum("weight").alias("__w"), F.min("error").alias("__e"), F.count(F.lit(1)).alias("__n"))
    upto, whole = Window.partitionBy(*run).orderBy("__bin"), Window.partitionBy(*run)
    placed = binned.withColumns({"__upto": F.sum("__w").over(upto), "__all": F.sum("__w").over(whole), "found": F.sum("__n").over(whole)})
    return placed.where(F.col("__upto") * 2 >= F.col("__all")).groupBy(*run).agg(F.min_by("__e", "__bin").alias("offset"), F.max("found").alias("found"))


def corrected(rows: DataFrame, corrections: DataFrame, run: list[str], columns: list[str], least: int = 1, cutoff: float = 0.0) -> DataFrame:
    """rows with the m/z columns freed from their run's offset, where it was found in `least` peaks and is beyond the cutoff."""
    use = F.col("found").isNotNull() & (F.col("found") >= least) & (F.abs("offset") > cutoff)
    out = rows.join(F.broadcast(corrections), run, "left")
    return out.withColumns({c: F.when(use, F.col(c) / (1 + F.col("offset"))).otherwise(F.col(c)) for c in columns}).drop("offset", "found")


def y_ions(cleaved: tuple[str, ...] = ("K", "R"), weights: dict[str, float] | None = None) -> list[tuple[float, float]]:
    """Known peaks (m/z, weight) of tryptic spectra: y1 of weight 1, and y2 of the residues given with their shares (else none)."""
    one = [(RESIDUES[r] + WATER + PROTON, 1.0) for r in cleaved]
    return one + [(RESIDUES[x] + RESIDUES[r] + WATER + PROTON, w) for r in cleaved for x, w in (weights or {}).items()]


def with_top_copies(peaks: DataFrame, spectrum: list[str], n: int, mz: str = "mz", by: float = 0.0, intensity: str = "intensity", copy: str = "is_copy") -> DataFrame:
    """The peaks and a copy, moved by a mass, of the n most intense ones of each spectrum (ties by m/z)."""
    order = Window.partitionBy(*spectrum).orderBy(F.desc(intensity), mz)
    top = peaks.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")
    return peaks.withColumn(copy, F.lit(False)).unionByName(shifted(top, mz, by).withColumn(copy, F.lit(True)))


def peak_arrays(peaks: DataFrame, spectrum: list[str], mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """Peaks as one sorted array per spectrum."""
    return peaks.groupBy(*spectrum).agg(F.sort_array(F.collect_list(F.struct(F.col(mz).alias("mz"), F.col(intensity).alias("intensity")))).alias("peaks"))


def exploded(spectra: DataFrame, keep: list[str], peaks: str = "peaks") -> DataFrame:
    return spectra.select(*keep, F.inline(peaks))


def latest_rank(spectrum: list[str], intensity: str) -> Column:
    """Place of a peak by intensity in its spectrum."""
    return F.row_number().over(Window.partitionBy(*spectrum).orderBy(F.desc(intensity)))

