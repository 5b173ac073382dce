"""Score products, statistics and peak-mining aggregations. All aggregate before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tolerance import Tolerance
from .range_join import dealt, nearest_join, tolerance_join
from .ranking import top_scores


def product_score(df: DataFrame, group: list[str], factor: Column, name: str = "score") -> DataFrame:
    """-ln of the product of positive factors, as a sum of logs: no underflow, whatever the group size."""
    return df.groupBy(*group).agg(F.sum(-F.ln(factor)).alias(name), F.count(F.lit(1)).alias("factors"))


def alpha_scores(pairs: DataFrame, probe: list[str], entry: list[str], total: int | Column) -> DataFrame:
    """Each probe that meets k of `total` index entries gives its entries the factor k / total; scores per entry.

    k is counted in a window over the pairs, so the range join behind them runs once.
    """
    k = F.count(F.lit(1)).over(Window.partitionBy(*probe))
    return product_score(pairs.withColumn("__k", k), entry, F.col("__k") / (F.lit(total) if isinstance(total, int) else total))


def kinds(rows: DataFrame, member: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members with the same rows are one kind: (member, __kind) of all, and (__kind, values...), the rows of one member of each kind.

    Rows are compared by a SHA-256 of their sorted values. A kind is named by its smallest member, in a struct because it may be null.
    """
    own = rows.groupBy(member).agg(F.sort_array(F.collect_list(F.struct(*values))).alias("__rows"))
    own = own.select(member, F.unhex(F.sha2(F.to_json("__rows"), 256)).alias("__digest"))
    named = own.groupBy("__digest").agg(F.min(F.struct(F.col(member).alias("first"))).alias("__kind"))
    members = own.join(named, "__digest").select(member, "__kind")
    return members, rows.join(named.select("__kind"), F.col(member).eqNullSafe(F.col("__kind.first"))).select("__kind", *values)


def top_alphas(peaks: DataFrame, index: DataFrame, spectrum: str, peak: str, mz: str, entry: str, mass: str, tolerance: Tolerance, ranks: int, digits: int) -> DataFrame:
    """spectrum, entry, score (of alpha_scores, rounded), score_rank: the entries with the best `ranks` scores of each spectrum.

    Copies fare alike: each kind of spectrum meets each kind of entry once, so only what differs is joined, shuffled and ranked.
    Entries of a kind travel in lists of about 256 to the spectra, and nothing is shuffled after the lists are opened: the
    rows of all copies of a spectrum with all copies of an entry, which may be very many, are only returned.
    """
    spectra, own_peaks = kinds(peaks.dropna(subset=[spectrum, peak]), spectrum, [peak, mz])
    entries, own_masses = kinds(index, entry, [mass])
    sizes = entries.groupBy("__kind").agg(F.count(F.lit(1)).alias("__n"))
    lists = entries.join(sizes, "__kind").groupBy(F.col("__kind").alias("__entry"), F.pmod(F.xxhash64(entry), F.ceil(F.col("__n") / 256)).alias("__part")).agg(F.collect_list(F.struct(entry)).alias("__entries"))
    weighed = own_masses.join(sizes, "__kind").withColumnRenamed("__kind", "__entry")
    pairs = tolerance_join(own_peaks, weighed, mz, mass, tolerance)
    k = F.sum("__n").over(Window.partitionBy("__kind", peak))
    scored = product_score(pairs.withColumn("__k", k), ["__kind", "__entry"], F.col("__k") / F.lit(index.count()))
    best = top_scores(scored.select("__kind", "__entry", F.round("score", digits).alias("score")), ["__kind"], "score", ranks)
    best = dealt(best.join(lists, "__entry").select("__kind", "score", "score_rank", "__entries"), "__kind")
    return best.join(dealt(spectra, "__kind"), "__kind").select(spectrum, F.inline("__entries"), "score", "score_rank")


def merge_scores(parts: list[DataFrame], key: list[str], score: str, how: str = "sum") -> DataFrame:
    """Combine score maps: sum, highest, lowest, or count of the parts that hold a key."""
    all_ = parts[0].select(*key, score)
    for p in parts[1:]:
        all_ = all_.unionByName(p.select(*key, score))
    f = {"sum": F.sum, "highest": F.max, "lowest": F.min, "count": F.count}[how]
    return all_.groupBy(*key).agg(f(score).alias(score))


def statistics(df: DataFrame, group: list[str], value: str, exact: bool = False) -> DataFrame:
    """n, min, max, mean, population std, median and MAD of value.

    The quantiles are approximate, from bounded sketches; exact ones hold all distinct values of a group in
    one task and are for groups of bounded size.
    """
    median = F.median(value) if exact else F.percentile_approx(value, 0.5).cast("double")
    base = [F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), median.alias("median")]
    first = df.groupBy(*group).agg(*base)
    join = df.select(*group, value).join(first.select(*group, "median"), group) if group else df.select(value).join(F.broadcast(first.select("median")))
    gap = F.abs(F.col(value) - F.col("median"))
    mad = join.groupBy(*group).agg((F.median(gap) if exact else F.percentile_approx(gap, 0.5).cast("double")).alias("mad"))
    return first.join(mad, group) if group else first.join(F.broadcast(mad))


def score_statistics(df: DataFrame, scores: list[str], exact: bool = False) -> DataFrame:
    """statistics() of many score columns at once: one row per score."""
    long = df.unpivot([], scores, "score_name", "score_value").where(F.col("score_value").isNotNull() & ~F.isnan("score_value"))
    return statistics(long, ["score_name"], "score_value", exact)


def class_counts(df: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts by value and kind, a column per kind (peptides by length and target/decoy)."""
    return df.groupBy(by).pivot(kind, kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def histogram(df: DataFrame, value: Column, width: float, item: str | None = None) -> DataFrame:
    """Counts of bins of `width`; with item, an item counts once per bin."""
    binned = df.withColumn("bin", F.floor(value / F.lit(float(width))).cast("long")).where("bin is not null")
    n = F.count_distinct(item) if item else F.count(F.lit(1))
    return binned.groupBy("bin").agg(n.alias("n"))


def consistent_peaks(peaks: DataFrame, spectrum: str, mz: str, intensity: str, width: float, least_share: float = 0.0, target: Column | None = None) -> DataFrame:
    """Bins of m/z with the share of spectra that hold a peak there, and mean and std of m/z and intensity.

    A spectrum counts once per bin, by its most intense peak there. target: a boolean of the spectrum that
    splits counts in two groups.
    """
    rows = peaks.withColumn("bin", F.floor(F.col(mz) / F.lit(float(width))).cast("long"))
    rows = rows.withColumn("__t", target if target is not None else F.lit(True))
    best = rows.groupBy(spectrum, "bin").agg(F.max(F.struct(F.col(intensity).alias("i"), F.col(mz).alias("m"))).alias("p"), F.max("__t").alias("t"))
    total = peaks.agg(F.count_distinct(spectrum).alias("spectra"))
    out = best.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("t").cast("long")).alias("n_target"), F.avg("p.m").alias("mean_mz"), F.stddev_pop("p.m").alias("std_mz"), F.avg("p.i").alias("mean_intensity"), F.stddev_pop("p.i").alias("std_intensity")
    )
    return out.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("spectra")).where(F.col("share") >= least_share)


def neutral_loss_histogram(peaks: DataFrame, precursor: str, mz: str, width: float, spectrum: str) -> DataFrame:
    """Histogram of precursor mass minus peak mass, a spectrum counting once per bin."""
    return histogram(peaks, F.col(precursor) - F.col(mz), width, spectrum)


def cooccurrence(items: DataFrame, group: str, item: str) -> DataFrame:
    """For item pairs of one group: n_both, n_first and share = P(second in the group | first).

    The self-join expands pairs of distinct items within a group; items should be few per group (bins).
    """
    one = items.select(group, item).distinct()
    n = one.groupBy(item).agg(F.count(F.lit(1)).alias("n_first"))
    a, b = one.withColumnRenamed(item, "first"), one.withColumnRenamed(item, "second")
    both = a.join(b, group).where("first <> second").groupBy("first", "second").agg(F.count(F.lit(1)).alias("n_both"))
    return both.join(n.withColumnRenamed(item, "first"), "first").withColumn("share", F.col("n_both") / F.col("n_first"))


def target_occurrence(peaks: DataFrame, targets: DataFrame, spectrum: str, mz: str, target: str, tolerance: Tolerance, intensity: str | None = None) -> DataFrame:
    """Spectra with a peak in each target's window, and with intensity the mean of its strongest peak."""
    hits = tolerance_join(targets.select(target), peaks, target, mz, tolerance)
    best = hits.groupBy(target, spectrum).agg(F.max(intensity if intensity else mz).alias("__best"))
    out = [F.count(F.lit(1)).alias("spectra")] + ([F.avg("__best").alias("mean_intensity")] if intensity else [])
    return best.groupBy(target).agg(*out)


def peaks_in_scans(peaks: DataFrame, wanted: DataFrame, spectrum: str, mz: str, intensity: str, target: str, tolerance: Tolerance) -> DataFrame:
    """For each wanted (spectrum, target): nearest peak, ppm error, intensity relative to base and median peak."""
    levels = peaks.groupBy(spectrum).agg(F.max(intensity).alias("base"), F.median(intensity).alias("mid"))
    left = wanted.select(spectrum, target)
    hits = tolerance_join(left.withColumnRenamed(spectrum, "__s"), peaks, target, mz, tolerance).where(F.col("__s") == F.col(spectrum))
    best = hits.groupBy(spectrum, target).agg(F.min_by(F.struct(F.col(mz).alias("mz"), F.col(intensity).alias("intensity")), F.struct(F.abs(F.col(mz) - F.col(target)), F.col(mz))).alias("p"))
    out = left.join(best, [spectrum, target], "left").join(levels, spectrum, "left")
    p, i = F.col("p.mz"), F.col("p.intensity")
    return out.select(spectrum, target, p.isNotNull().alias("found"), p.alias("mz"), ((p - F.col(target)) / F.col(target) * 1e6).alias("error_ppm"), (i / F.col("base")).alias("to_base"), (i / F.col("mid")).alias("to_median"))


def exclusive_lookup(peaks: DataFrame, targets: DataFrame, key: list[str], mz: str, target: str, tolerance: Tolerance) -> DataFrame:
    """Each peak with the nearest target only."""
    return nearest_join(peaks, targets, mz, target, key, tolerance, [target])


def reporter_pair_top(peaks: DataFrame, spectrum: str, mz: str, intensity: str, first: float, second: float, tolerance: Tolerance, n: int) -> DataFrame:
    """The n spectra with the most intensity in two reporter peaks (a top-n report)."""
    near = lambda x: F.max(F.when((F.col(mz) >= tolerance.lower(F.lit(x))) & (F.col(mz) < tolerance.upper(F.lit(x))), F.col(intensity)))
    both = peaks.groupBy(spectrum).agg(near(first).alias("first"), near(second).alias("second")).where("first is not null and second is not null")
    return both.withColumn("total", F.col("first") + F.col("second")).orderBy(F.desc("total"), spectrum).limit(n)


def merge_intensity(peaks: DataFrame, spectrum: list[str], mz: str, intensity: str) -> DataFrame:
    """Sum the intensity of peaks at equal m/z."""
    return peaks.groupBy(*spectrum, mz).agg(F.sum(intensity).alias(intensity))


def rank_groups(df: DataFrame, group: list[str], value: str, groups: int) -> DataFrame:
    """Peaks in groups of equal size by intensity rank."""
    return df.withColumn("rank_group", F.ntile(groups).over(Window.partitionBy(*group).orderBy(F.desc(value))))


def residue_pair_counts(df: DataFrame, sequence: str, site: str) -> DataFrame:
    """Counts of the residues before and after a fragmentation site, with row and column totals (cube)."""
    pair = df.select(F.substring(sequence, F.col(site), 1).alias("n_side"), F.substring(sequence, F.col(site) + 1, 1).alias("c_side"))
    return pair.cube("n_side", "c_side").agg(F.count(F.lit(1)).alias("n"))


def matched_groups(matched: DataFrame, kinds: list[str], spectrum: str, intensity: str) -> DataFrame:
    """Peaks, spectra and intensity by kinds of explanation (ion type, losses, crosslinked or not), with totals over each kind (cube).

    Peaks are added up by spectrum and kinds before the totals are formed. All totals of a spectrum come from the task that has it, so only
    one shuffle moves peaks.
    """
    one = matched.groupBy(spectrum, *kinds).agg(F.count(F.lit(1)).alias("peaks"), F.sum(intensity).alias("intensity"))
    level = lambda g: F.struct(F.lit(g).alias("__level"), *[(F.lit(None).cast(matched.schema[k].dataType) if g >> i & 1 else F.col(k)).alias(f"__{k}") for i, k in enumerate(kinds)])
    key = ["__level", *[f"__{k}" for k in kinds]]
    each = one.select(F.col(spectrum).alias("__spectrum"), "peaks", "intensity", F.inline(F.array(*[level(g) for g in range(1 << len(kinds))])))
    each = each.groupBy("__spectrum", *key).agg(F.sum("peaks").alias("peaks"), F.sum("intensity").alias("intensity"))
    out = each.groupBy(*key).agg(F.sum("peaks").alias("peaks"), F.count("__spectrum").alias("spectra"), F.sum("intensity").alias("intensity"))
    return out.select(*[F.col(f"__{k}").alias(k) for k in kinds], "peaks", "spectra", "intensity")


def residue_occurrence(peptides: DataFrame, residues: str) -> DataFrame:
    """How often each residue stands in peptides, at their first place and at their last."""
    each = peptides.select(F.posexplode(residues).alias("place", "residue"), F.size(residues).alias("n"))
    return each.groupBy("residue").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("place") == 0).cast("long")).alias("n_first"), F.sum((F.col("place") == F.col("n") - 1).cast("long")).alias("n_last"))


def terminal_distance(matched: DataFrame, first: Column, last: Column, length: Column, intensity: str) -> DataFrame:
    """Fragmentation sites by their distance from the nearer terminus of the peptide: how many, and their mean intensity."""
    from_start = F.when(first > 0, first).otherwise(last + 1)
    return matched.groupBy(F.least(from_start, length - from_start).alias("distance")).agg(F.count(F.lit(1)).alias("n"), F.avg(intensity).alias("mean_intensity"))


def top_peaks_explained(peaks: DataFrame, spectrum: list[str], intensity: str, explained: Column, most: int) -> DataFrame:
    """Of the k-th most intense peaks of spectra (k up to most), how many there are and how many are explained."""
    order = Window.partitionBy(*spectrum).orderBy(F.desc(intensity), *[c for c in peaks.columns if c not in (intensity, *spectrum)])
    ranked = peaks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return ranked.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum(explained.cast("long")).alias("n_explained"))
