"""Sub-scores of matches and their weighted normalisation.

Matched fragments come as rows of matching.match_fragments with is_primary; scores come as one row per
match. Missing scores are NaN. A score registered under a name has an order, and is run in that order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from inspect import signature

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tolerance import Tolerance

NAN = float("nan")
NO_MATCH = 9999999.0  #: stands for the MS2 error of a match without fragments

_registry: dict[str, tuple[int, Callable[..., DataFrame]]] = {}


def register(name: str, order: int):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _registry[name] = (order, f)
        return f

    return add


def registered() -> list[tuple[str, Callable[..., DataFrame]]]:
    return [(n, f) for n, (_, f) in sorted(_registry.items(), key=lambda x: (x[1][0], x[0]))]


def run_registered(inputs: dict[str, object], names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the registered scores (or those named), in their order; each takes of `inputs` what its parameters are called.

    A score is left out when a parameter without default has no input.
    """
    out = {}
    for name, f in registered():
        parameters = signature(f).parameters
        if (names is None or name in names) and all(p in inputs or x.default is not x.empty for p, x in parameters.items()):
            out[name] = f(**{p: inputs[p] for p in parameters if p in inputs})
    return out


@register("coverage", 10)
def fragment_coverage(matched: DataFrame, matches: DataFrame, match: str = "match_id", length: str = "length", least_losses: int = 3) -> DataFrame:
    """Counts of distinct fragmentation sites of a peptide: all, lossy, intact, conservative, primary, and the coverages n / (2 (len - 1)).

    Conservative: the intact fragment, or at least least_losses different losses of it.
    """
    site = ["base_fragment"]
    per = matched.groupBy(match, *site).agg(
        F.max((F.col("loss_count") == 0).cast("int")).alias("intact"),
        F.max((F.col("loss_count") > 0).cast("int")).alias("lossy"),
        F.count_distinct(F.when(F.col("loss_count") > 0, F.col("fragment_id"))).alias("losses"),
        F.max(F.col("is_primary").cast("int")).alias("primary_"),
        F.max((F.col("is_primary") & (F.col("loss_count") == 0)).cast("int")).alias("primary_intact"),
        F.max(F.col("is_crosslinked").cast("int")).alias("xl"),
    )
    per = per.withColumn("conservative", ((F.col("intact") == 1) | (F.col("losses") >= least_losses)).cast("int"))
    n = per.groupBy(match).agg(F.count(F.lit(1)).alias("matched"), *[F.sum(c).alias(a) for c, a in (("intact", "non_lossy"), ("lossy", "lossy"), ("conservative", "conservative"), ("primary_", "unique"), ("primary_intact", "unique_non_lossy"), ("xl", "crosslinked"))])
    counts = ["matched", "non_lossy", "lossy", "conservative", "unique", "unique_non_lossy", "crosslinked"]
    out = matches.select(match, length).join(n, match, "left").na.fill(0, counts)
    most = 2 * (F.col(length) - 1)
    return out.select(match, *counts, *[F.when(most > 0, F.col(c) / most).otherwise(F.lit(0.0)).alias(f"{c}_coverage") for c in counts])


@register("sequence_tag", 11)
def sequence_tag(matched: DataFrame, match: str = "match_id", run: int = 3) -> DataFrame:
    """Share of matched sites of a series (ion type) that lie in runs of at least `run` consecutive ones."""
    sites = matched.select(match, "ion_type", "n").distinct()
    w = Window.partitionBy(match, "ion_type").orderBy("n")
    runs = sites.withColumn("__run", F.col("n") - F.row_number().over(w))
    size = runs.groupBy(match, "ion_type", "__run").agg(F.count(F.lit(1)).alias("k"))
    return size.groupBy(match).agg(F.sum(F.when(F.col("k") >= run, F.col("k")).otherwise(0)).alias("tagged"), F.sum("k").alias("sites")).select(match, "tagged", (F.col("tagged") / F.col("sites")).alias("tag_share"))


@register("precursor", 1)
def precursor_found(peaks: DataFrame, spectra: DataFrame, spectrum: str, precursor: str, tolerance: Tolerance, mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """Absolute intensity of the peak at the precursor, and relative to the base peak; 0 without one."""
    p = F.col(precursor)
    near = (F.col(mz) >= tolerance.lower(p)) & (F.col(mz) < tolerance.upper(p))
    joined = peaks.join(spectra.select(spectrum, precursor), spectrum)
    out = joined.groupBy(spectrum).agg(F.coalesce(F.max(F.when(near, F.col(intensity))), F.lit(0.0)).alias("precursor_absolute"), F.max(intensity).alias("__base"))
    return out.select(spectrum, "precursor_absolute", F.try_divide("precursor_absolute", "__base").alias("precursor_relative"))


@register("library", 20)
def library_score(shares: DataFrame, match: str = "match_id", share: str = "share", most: int = 50) -> DataFrame:
    """From the product p of the (up to 50) smallest distinct shares of peptides that a mass meets: 1 - p, exp(-1000 p), -ln p."""
    few = F.slice(F.sort_array(F.collect_set(share)), 1, most)
    out = shares.groupBy(match).agg(few.alias("__s")).withColumn("neg_log_p", F.aggregate("__s", F.lit(0.0), lambda acc, x: acc - F.ln(x)))
    p = F.exp(-F.col("neg_log_p"))
    return out.select(match, (1 - p).alias("library_score"), F.exp(-1000 * p).alias("library_score_exp"), F.col("neg_log_p").alias("library_score_log"))


@register("spectrum_coverage", 50)
def spectrum_coverage(peaks: DataFrame, match: str = "match_id", explained: str = "explained", intact: str = "intact", intensity: str = "intensity", tops: tuple[int, ...] = (10, 20, 40, 100)) -> DataFrame:
    """Share of intensity and of peaks that is explained, also by intact fragments, and of the most intense peaks."""
    w = Window.partitionBy(match).orderBy(F.desc(intensity), "mz")
    ranked = peaks.withColumn("__r", F.row_number().over(w))
    part = lambda c: F.try_divide(F.sum(F.when(c, F.col(intensity)).otherwise(F.lit(0.0))), F.sum(intensity))
    top = [(F.sum(F.when(F.col(explained) & (F.col("__r") <= n), 1).otherwise(0)) / F.sum(F.when(F.col("__r") <= n, 1).otherwise(0))).alias(f"top{n}_matched") for n in tops]
    return ranked.groupBy(match).agg(part(F.col(explained)).alias("intensity_coverage"), part(F.col(intact)).alias("intensity_coverage_intact"), F.avg(F.col(explained).cast("double")).alias("peak_coverage"), *top)


def conservative_coverage(peaks: DataFrame, match: str = "match_id", conservative: str = "conservative", intensity: str = "intensity") -> DataFrame:
    return peaks.groupBy(match).agg(F.try_divide(F.sum(F.when(F.col(conservative), F.col(intensity)).otherwise(F.lit(0.0))), F.sum(intensity)).alias("conservative_intensity"))


@register("charge", 10)
def fragment_charge(matched: DataFrame, match: str = "match_id", precursor_charge: str = "precursor_charge") -> DataFrame:
    """Highest and mean charge of matched fragments, also relative to the precursor's."""
    z = "match_charge"
    out = matched.groupBy(match).agg(F.max(z).alias("max_charge"), F.avg(z).alias("mean_charge"), F.median(z).alias("median_charge"), F.max(precursor_charge).alias("__p"))
    return out.select(match, "max_charge", "mean_charge", "median_charge", F.try_divide("max_charge", "__p").alias("relative_max_charge"), F.try_divide("mean_charge", "__p").alias("relative_mean_charge"))


@register("error", 10)
def errors(matched: DataFrame, matches: DataFrame, match: str = "match_id", limit: float = 10.0) -> DataFrame:
    """Mean, mean absolute, mean square and root mean square error of primary explanations, and relative to the limit."""
    e = F.col("error")
    rows = matched.where("is_primary").groupBy(match).agg(F.avg(e).alias("mean_error"), F.avg(F.abs(e)).alias("mean_absolute_error"), F.avg(e * e).alias("mean_square_error"))
    out = matches.select(match).join(rows, match, "left").na.fill(NO_MATCH, ["mean_error", "mean_absolute_error", "mean_square_error"])
    out = out.withColumn("root_mean_square_error", F.sqrt("mean_square_error"))
    rel = F.least(F.col("mean_absolute_error") / F.lit(limit), F.lit(2.0))
    return out.withColumn("relative_error", rel).withColumn("one_minus_relative_error", 1 - F.col("relative_error"))


def precursor_errors(mass: Column, expected: Column, tolerance: Tolerance) -> dict[str, Column]:
    e = tolerance.error(mass, expected)
    return {"precursor_error": e, "precursor_absolute_error": F.abs(e), "precursor_relative_error": F.abs(e) / F.lit(tolerance.value), "one_minus_precursor_error": 1 - F.abs(e) / F.lit(tolerance.value)}


def isotope_free_error(measured: Column, expected: Column) -> Column:
    """Error after taking off the nearest whole number of C13 steps."""
    from ..functions.masses import C13_DIFF

    d = measured - expected
    return d - F.round(d / F.lit(C13_DIFF)) * F.lit(C13_DIFF)


def loss_coverage(matched: DataFrame, match: str = "match_id") -> DataFrame:
    """Lossy over all matched fragments, and lossy ones whose intact form is there over all lossy ones."""
    intact = F.max((F.col("loss_count") == 0).cast("int")).over(Window.partitionBy(match, "base_fragment"))
    lossy = F.col("loss_count") > 0
    return matched.withColumn("__i", intact).groupBy(match).agg(F.avg(lossy.cast("double")).alias("loss_share"), F.try_divide(F.sum(F.when(lossy & (F.col("__i") == 1), 1).otherwise(0)), F.sum(lossy.cast("int"))).alias("supported_losses"))


def combined(scores: dict[str, float]) -> Column:
    """Weighted mean of score columns, leaving out NaN, null and infinite ones; NaN if none is left."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    top = reduce(lambda a, b: a + b, [F.when(ok(c), F.col(c) * w).otherwise(F.lit(0.0)) for c, w in scores.items()])
    bottom = reduce(lambda a, b: a + b, [F.when(ok(c), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in scores.items()])
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(NAN))


def normalised_score(long: DataFrame, parameters: DataFrame, match: str = "match_id", missing: float | None = None, scale: float = 7.0) -> DataFrame:
    """The match score: weighted, direction-aware z-scores of (match, score_name, score_value), times 7.

    parameters: score_name, average, stdev, direction, normalised_split, weight (one row per score).
    Rows without parameters, with weight 0 or a value of 999999 and more don't count. A z-score is divided
    by its normalised split times the direction (by the direction alone where the split is 0). A value
    that gives no number counts as `missing`, if that is set.
    """
    p = parameters.where("weight is not null and weight <> 0 and not isnan(weight)")
    rows = long.join(p, "score_name", "left")
    counts = F.coalesce(F.col("score_value") < 999999, F.lit(False)) & F.col("weight").isNotNull()
    z = F.try_divide(F.col("score_value") - F.col("average"), F.col("stdev"))
    split, d, w = F.col("normalised_split"), F.col("direction"), F.col("weight")
    part = F.when(split == 0, F.try_divide(z, d) * w).otherwise(F.try_divide(z, split) * d * w)
    good = part.isNotNull() & ~F.isnan(part) & (F.abs(part) < float("inf")) & (d != 0)
    value = F.when(good, part)
    if missing is not None:
        value = F.when(good, part).otherwise(F.lit(missing))
    rows = rows.withColumn("__v", F.when(counts, value))
    # One aggregate: a match none of whose rows count has a null sum, and the score 0.
    score = F.sum("__v") / F.sum(F.when(F.col("__v").isNotNull(), F.abs(w))) * scale
    return rows.groupBy(match).agg(score.alias("match_score")).na.fill(0.0, ["match_score"])


def mean_z_score(long: DataFrame, parameters: DataFrame, match: str = "match_id") -> DataFrame:
    """The older normalisation: mean of weighted z-scores."""
    rows = long.join(parameters, "score_name")
    z = F.try_divide(F.col("score_value") - F.col("average"), F.col("stdev")) * F.col("direction") * F.col("weight")
    return rows.withColumn("__z", z).where("__z is not null and not isnan(__z)").groupBy(match).agg(F.avg("__z").alias("match_score"))


def boosted(score: Column, noncovalent: Column, linear: Column, noncovalent_factor: float = 1.0, linear_factor: float = 1.0) -> Column:
    return score * F.when(noncovalent, F.lit(noncovalent_factor)).otherwise(F.lit(1.0)) * F.when(linear, F.lit(linear_factor)).otherwise(F.lit(1.0))


def votes(trees: list[Column], most_against: int = 3) -> Column:
    """1 when at most most_against of the boolean tree outputs say false; null outputs say false."""
    against = reduce(lambda a, b: a + b, [(~F.coalesce(t, F.lit(False))).cast("int") for t in trees])
    return (against <= most_against).cast("int")


def decision_tree(node: dict | bool) -> Column:
    """A tree {"score", "at_most", "yes", "no"} as nested conditions; leaves are booleans, NaN and null scores go to "no"."""
    if isinstance(node, bool):
        return F.lit(node)
    test = F.coalesce(~F.isnan(node["score"]) & (F.col(node["score"]) <= node["at_most"]), F.lit(False))
    return F.when(test, decision_tree(node["yes"])).otherwise(decision_tree(node["no"]))


def tree_outputs(scores: DataFrame, trees: DataFrame, names: list[str] | None = None) -> DataFrame:
    """scores with `trees`: a map from the name of each tree to what it says of the row.

    trees: a row per node: tree, node (from 0, the root), score, at_most, yes, no (nodes), says (boolean, of leaves). A score that is
    at most at_most goes to yes; larger, NaN and null ones go to no. The nodes go to every worker once (trees are a
    model, of bounded size), and the rows of a batch walk a tree side by side, so many or deep trees don't become nested conditions.
    A tree that says null, or that names a node it lacks, says null. names: the score columns, if not all that the trees name.
    """
    names = names or [r[0] for r in trees.where("score is not null").select("score").distinct().orderBy("score").collect()]
    missing = set(names) - set(scores.columns)
    if missing:
        raise ValueError(f"no column for scores {sorted(missing)} of the trees")
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    node = F.struct("tree", "node", F.array_position(listed, F.col("score")).cast("int").alias("score"), F.col("at_most").cast("double").alias("at_most"), F.col("yes").cast("int").alias("yes"), F.col("no").cast("int").alias("no"), F.col("says").cast("boolean").alias("says"))
    model = trees.groupBy("tree").agg(F.sort_array(F.collect_list(node)).alias("nodes")).agg(F.sort_array(F.collect_list(F.struct("tree", "nodes"))).alias("__model"))
    model = model.first()["__model"]
    if not model:
        return scores.withColumn("trees", F.create_map().cast("map<string,boolean>"))
    number = lambda values, none: np.array([none if v is None else v for v in values])
    held = scores.sparkSession.sparkContext.broadcast([
        (t["tree"], number([n["score"] for n in t["nodes"]], -1), np.array([np.nan if n["at_most"] is None else np.inf if n["at_most"] != n["at_most"] else n["at_most"] for n in t["nodes"]]),
         number([n["yes"] for n in t["nodes"]], -1), number([n["no"] for n in t["nodes"]], -1), number([None if n["says"] is None else int(n["says"]) for n in t["nodes"]], -1))
        for t in model
    ])

    @F.arrow_udf("map<string,boolean>")
    def walked(any_: pa.Array, *columns: pa.Array) -> pa.Array:
        rows = len(any_)
        values = np.array([np.full(rows, np.nan), *[c.to_numpy(zero_copy_only=False) for c in columns]])
        said = np.empty((rows, len(held.value)), np.int64)
        for k, (_, score, at_most, yes, no, says) in enumerate(held.value):
            at = np.zeros(rows, np.int64)
            for _ in range(len(score)):
                there = (at >= 0) & (at < len(score))
                here = np.where(there, at, 0)
                going = there & (score[here] >= 0)
                if not going.any():
                    break
                low = values[score[here], np.arange(rows)] <= at_most[here]
                at = np.where(going, np.where(low, yes[here], no[here]), at)
            there = (at >= 0) & (at < len(score))
            said[:, k] = np.where(there, says[np.where(there, at, 0)], -1)
        names_ = pa.array([t[0] for t in held.value], pa.string()).take(pa.array(np.tile(np.arange(said.shape[1]), rows)))
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * said.shape[1], pa.int32())
        return pa.MapArray.from_arrays(offsets, names_, pa.array(said.ravel() == 1, mask=said.ravel() < 0))

    return scores.withColumn("trees", walked(F.lit(True), *[F.col(f"`{n}`").cast("double") for n in names]))


def tree_votes(outputs: DataFrame, most_against: int = 3) -> DataFrame:
    """Rows of tree_outputs with auto_validation: 1 when at most most_against trees don't say true."""
    against = F.size(F.filter(F.map_values("trees"), lambda t: ~F.coalesce(t, F.lit(False))))
    return outputs.withColumn("auto_validation", (against <= most_against).cast("int"))


def table_probability(df: DataFrame, table: DataFrame, on: list[str], match: str = "match_id", probability: str = "probability") -> DataFrame:
    """-ln of the product of probabilities looked up by key columns (intensity group, residue pair)."""
    return df.join(table, on).groupBy(match).agg(F.sum(-F.ln(probability)).alias("table_score"))


def peak_intensities(peaks: DataFrame, spectrum: str, wanted: list[float], tolerance: Tolerance, mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """A column per wanted m/z: intensity of the nearest peak in its window, else 0. Ties go to the smaller m/z, then to the smaller intensity. Peaks of no (null) spectrum are in no window."""
    inside = lambda w: F.col(spectrum).isNotNull() & (F.col(mz) >= tolerance.lower(F.lit(w))) & (F.col(mz) < tolerance.upper(F.lit(w)))
    near = lambda w: F.coalesce(F.min(F.when(inside(w), F.struct(F.abs(F.col(mz) - F.lit(w)).alias("d"), F.col(mz).alias("m"), F.col(intensity).alias("i"))))["i"], F.lit(0.0))
    return peaks.groupBy(spectrum).agg(*[near(w).alias(f"mz_{w:g}".replace(".", "_")) for w in wanted])


def to_long(scores: DataFrame, match: str, names: list[str]) -> DataFrame:
    """(match, score_name, score_value); rows stay where they are, so scores dealt by match need no other shuffle."""
    return scores.select(match, F.inline(F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(n).cast("double").alias("score_value")) for n in names])))
