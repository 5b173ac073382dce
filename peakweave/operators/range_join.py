"""Tolerance-window joins as equi-joins on bins with an exact post-filter.

A plain range predicate plans as a nested loop. Here both sides get a bin number: either a window is repeated for each bin
that it touches, or a point for its bin and the one below, so that a usual window needs one row. The join is an equi-join
that shuffles, broadcasts and splits skewed bins like any other. Where windows have no usual width, each takes
bins of its own width and points are repeated for the few widths in use. Windows are half open: low <= x < high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tolerance import Tolerance

_BIN, _LOW, _HIGH = "__bin", "__low", "__high"


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """rows by key in a fixed number of tasks: where a few MB of rows meet in millions of pairs, the rows' size must not decide how many tasks make them."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *key)


_LIST = 256  #: points that one row of listed() holds


def listed(points: DataFrame, bins: list[str], cell: Column) -> DataFrame:
    """Points (with __point) of each bin in lists of _LIST at most, in their order: bins, __least and __most point, and __list of all other columns.

    A list lies in one cell, a part of a bin, so a narrow window opens little that lies outside it. Points are dealt by bin already.
    """
    nth = F.expr(f"monotonically_increasing_id() div {_LIST}")  # consecutive in a task
    held = points.where("__point is not null").sortWithinPartitions(*bins, "__point").withColumns({"__cell": cell, "__nth": nth})
    return held.groupBy(*bins, "__cell", "__nth").agg(F.min("__point").alias("__least"), F.max("__point").alias("__most"), F.collect_list(F.struct(*[F.col(f"`{c}`") for c in points.columns if c not in bins])).alias("__list")).drop("__cell", "__nth")


def _met_lists(windows: DataFrame, points: DataFrame, bins: list[str], own: list[str], cell: Column, low: Column, high: Column, parts: int) -> DataFrame:
    """Rows of windows with each of the points (with __point) in their bin and bounds: nothing is shuffled or sorted once a list is open, and a list's rows stand together."""
    if parts > 1:  # equal windows go to different parts
        windows = windows.withColumn("__part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in windows.columns]), F.lit(parts)).cast("int"))
        points = points.withColumn("__own", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        bins, own = [*bins, "__part"], [*own, "__own"]
    same = (F.col("__most") >= low) & (F.col("__least") < high)
    for mine, other in zip(bins, own, strict=True):
        same = same & (F.col(mine) == F.col(other))
    met = listed(dealt(points, *own), own, cell).hint("merge").join(dealt(windows, *bins), same)
    met = met.select(*[F.col(f"`{c}`") for c in met.columns if c not in ("__list", "__least", "__most", *bins, *own)], F.inline("__list"))
    return met.where((F.col("__point") >= low) & (F.col("__point") < high)).drop("__point")


def window_join(windows: DataFrame, points: DataFrame, low: Column, high: Column, point: Column, bin_width: float, how: str = "inner", relative: bool = False, repeat: str = "windows", value: Column | None = None, deal: bool = False, lists: int = 0) -> DataFrame:
    """Rows of windows with the rows of points where low <= point < high; how: inner, left, left_semi, left_anti.

    bin_width should be about the usual window: a window spans about two bins, and any number is right. relative: bins are
    equal steps of ln(x) (for positive values and windows that grow with x), else equal steps of x. Null bounds
    or points match nothing. The join key is the bin alone, so adaptive execution can split hot bins.
    Whether a window meets a point depends on its bounds alone: semi and anti joins look up the distinct bounds
    that meet one, a left join is the inner one and the rows that the anti join leaves.
    repeat: which side has about two rows for each, best the shorter one. value: what low and high are computed from,
    as columns of F.col("__centre"), which then travels in their stead. deal: see dealt(). lists (inner only, dealt too): points
    meet windows in lists, see listed(), for results far larger than both sides; the windows of a bin go to so many tasks, with all its points.
    """
    bin_of = (lambda c: F.floor(F.ln(c) / F.lit(bin_width))) if relative else (lambda c: F.floor(c / F.lit(bin_width)))
    right = points.withColumn("__point", point.cast("double"))
    if value is None:
        bounds, left, low_, high_ = [_LOW, _HIGH], windows.withColumn(_LOW, low.cast("double")).withColumn(_HIGH, high.cast("double")), F.col(_LOW), F.col(_HIGH)
    else:
        bounds, left, low_, high_ = ["__centre"], windows.withColumn("__centre", value.cast("double")), low, high
    first = bin_of(F.greatest(low_, F.lit(1e-300)) if relative else low_)
    inside = (F.col(_BIN) == F.col("__rbin")) & (F.col("__point") >= low_) & (F.col("__point") < high_)
    open_ = (high_ > (F.lit(0.0) if relative else low_)) & (high_ > low_)
    # A row of a repeated point stands for its bin or the one below, so a window takes every second bin from its first on.
    own = bin_of(F.col("__point"))
    right = right.withColumn("__rbin", own if repeat == "windows" else F.explode(F.array(own, own - 1)))
    step = F.lit(1 if repeat == "windows" else 2).cast("long")

    def binned(rows: DataFrame) -> DataFrame:
        rows = rows.where(open_).withColumn(_BIN, F.explode(F.sequence(first, bin_of(high_), step)))
        return dealt(rows, _BIN) if deal else rows

    if deal:
        right = dealt(right, "__rbin")
    if how == "inner" and lists:
        place = (F.ln("__point") if relative else F.col("__point")) / F.lit(bin_width / 8)
        return _met_lists(binned(left), right, [_BIN], ["__rbin"], F.floor(place), low_, high_, lists).drop(*bounds)
    if how == "inner":
        return binned(left).join(right, inside).drop(_BIN, *bounds, "__point", "__rbin")
    met = binned(left.select(*bounds).distinct()).join(right.select("__point", "__rbin"), inside, "left_semi").select(*bounds).distinct()
    if how in ("left_semi", "left_anti"):
        return left.join(met, bounds, how).select(*[F.col(f"`{c}`") for c in windows.columns])
    if how != "left":
        raise ValueError(f"unknown join {how}")
    none = left.join(met, bounds, "left_anti").select(*[F.col(f"`{c}`") for c in windows.columns], *[F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema])
    return binned(left).join(right, inside).drop(_BIN, *bounds, "__point", "__rbin").union(none)


def any_window_join(windows: DataFrame, points: DataFrame, low: Column, high: Column, point: Column, deal: bool = False, lists: int = 0) -> DataFrame:
    """As window_join (inner), for windows of unknown and unequal widths.

    The bins of a window are as wide as the next power of four, so it touches two at most, and a point gets a row for each power
    that some window has (a short list, found by one pass over the windows). deal, lists: see window_join; with lists, bins are a quarter
    as wide, so that few of them make more tasks.
    """
    left = windows.withColumn(_LOW, low.cast("double")).withColumn(_HIGH, high.cast("double")).where(F.col(_HIGH) > F.col(_LOW))
    left = left.withColumn("__level", F.least(F.greatest(F.ceil(F.log(4.0, F.col(_HIGH) - F.col(_LOW))), F.lit(-20)), F.lit(200)).cast("int"))
    bin_of = lambda c, level: F.floor(c / F.pow(F.lit(4.0), level - (1 if lists else 0)))
    levels = left.select(F.col("__level").alias("__rlevel")).distinct()
    right = points.withColumn("__point", point.cast("double")).where("__point is not null").join(F.broadcast(levels)).withColumn("__rbin", bin_of(F.col("__point"), F.col("__rlevel")))
    left = left.withColumn(_BIN, F.explode(F.sequence(bin_of(F.col(_LOW), F.col("__level")), bin_of(F.col(_HIGH), F.col("__level")))))
    if lists:
        cell = F.floor(F.col("__point") / F.pow(F.lit(4.0), F.col("__rlevel") - 1) * 4)
        return _met_lists(left, right, ["__level", _BIN], ["__rlevel", "__rbin"], cell, F.col(_LOW), F.col(_HIGH), lists).drop(_LOW, _HIGH)
    if deal:
        left, right = dealt(left, "__level", _BIN), dealt(right, "__rlevel", "__rbin")
    inside = (F.col("__level") == F.col("__rlevel")) & (F.col(_BIN) == F.col("__rbin")) & (F.col("__point") >= F.col(_LOW)) & (F.col("__point") < F.col(_HIGH))
    return left.join(right, inside).drop(_BIN, _LOW, _HIGH, "__point", "__rbin", "__level", "__rlevel")


def tolerance_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tolerance: Tolerance, how: str = "inner", reference: Column | None = None, repeat: str = "windows", deal: bool = False, lists: int = 0) -> DataFrame:
    """Rows whose right_on lies in the tolerance window around left_on (half open).

    reference: the value that a relative tolerance is taken of, if not left_on itself. repeat, deal, lists: see window_join.
    """
    value, point, v = F.col(f"`{left_on}`").cast("double"), F.col(f"`{right_on}`"), F.col("__centre")
    ref = value if reference is None else reference
    if tolerance.relative and reference is None:
        return window_join(left.where(value > 0) if how == "inner" else left, right, tolerance.lower(v), tolerance.upper(v), point, max(2.0 * tolerance.value * 1e-6, 1e-9), how, relative=True, repeat=repeat, value=value, deal=deal, lists=lists)
    if tolerance.relative and how == "inner":
        return any_window_join(left, right, tolerance.lower(value, ref), tolerance.upper(value, ref), point, deal, lists)
    if tolerance.relative:
        return window_join(left, right, tolerance.lower(value, ref), tolerance.upper(value, ref), point, 0.05, how)
    return window_join(left, right, tolerance.lower(v), tolerance.upper(v), point, max(2.0 * tolerance.value, 1e-9), how, repeat=repeat, value=value, deal=deal, lists=lists)


def here_type(points: DataFrame) -> T.StructType:
    """Of a point as nearest_join carries it: its place and the columns that it returns."""
    return T.StructType([T.StructField("p", points.schema["__p"].dataType), T.StructField("f", points.schema["__f"].dataType)])


def nearest_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, key: list[str], tolerance: Tolerance, right_columns: list[str]) -> DataFrame:
    """key, left_on and right_columns of the nearest row of right inside the window of each row of left; rows without one are left out.

    Ties go to the smaller right_on, then to the smallest right_columns. Equal values are looked up once and every row of left
    keeps its own result, so repeated keys lose nothing. The nearest is the last one up to a value or the first one after it, so no
    pairs are made: the work grows with the rows, however many lie in a window.
    """
    values = left.select(F.col(left_on).alias("__v")).distinct()
    found = F.struct(*[F.col(c) for c in right_columns])
    points = right.where(F.col(right_on).isNotNull()).groupBy(F.col(right_on).alias("__p")).agg(F.min(found).alias("__f"))
    inside = lambda x: (x["p"] >= tolerance.lower(F.col("__v"))) & (x["p"] < tolerance.upper(F.col("__v")))
    # Cells are wider than a window, so all that it can meet is in its value's cell or beside it.
    if tolerance.relative:
        values, cell = values.where("__v > 0"), lambda c: F.floor(F.ln(c) / F.lit(max(2.0 * tolerance.value * 1e-6, 1e-9)))
        points = points.where("__p > 0")
    else:
        cell = lambda c: F.floor(c / F.lit(max(2.0 * tolerance.value, 1e-9)))
    near = F.explode(F.array(*[cell(F.col("__p")) + i for i in (-1, 0, 1)])).alias("__cell")
    here = F.struct(F.col("__p").alias("p"), F.col("__f").alias("f"))
    both = points.select(near, F.col("__p").alias("__x"), F.lit(0).alias("__kind"), here.alias("__at")).unionByName(values.select(cell(F.col("__v")).alias("__cell"), F.col("__v").alias("__x"), F.lit(1).alias("__kind"), F.lit(None).cast(here_type(points)).alias("__at")))
    order = Window.partitionBy("__cell").orderBy("__x", "__kind")
    asked = both.withColumn("__below", F.last("__at", True).over(order)).withColumn("__above", F.expr("lead(__at, 1) IGNORE NULLS OVER (PARTITION BY __cell ORDER BY __x, __kind)")).where("__kind = 1").withColumn("__v", F.col("__x"))
    at = lambda name: F.when(inside(F.col(name)), F.struct(F.abs(F.col(name)["p"] - F.col("__v")).alias("d"), F.col(name)["p"].alias("v"), F.col(name)["f"].alias("f")))
    best = asked.select("__v", F.least(at("__below"), at("__above")).alias("__best")).where("__best is not null")
    return left.select(*key, left_on).join(best, F.col(left_on) == F.col("__v")).select(*key, left_on, "__best.f.*")


def distance_lookup(left: DataFrame, right: DataFrame, left_on: str, right_on: str, key: list[str], tolerance: Tolerance) -> DataFrame:
    """As nearest_join with the doubled tolerance; returns the signed distance."""
    found = nearest_join(left, right, left_on, right_on, key, Tolerance(2 * tolerance.value, tolerance.unit), [right_on])
    return found.withColumn("distance", F.col(right_on) - F.col(left_on))


def count_in_window(left: DataFrame, right: DataFrame, left_on: str, right_on: str, key: list[str], tolerance: Tolerance) -> DataFrame:
    """Number of rows of right in the window of each key; equal values of left are looked up once."""
    values = left.select(F.col(left_on).alias("__v")).distinct()
    counts = tolerance_join(values, right.groupBy(right_on).agg(F.count(F.lit(1)).alias("__n")), "__v", right_on, tolerance).groupBy("__v").agg(F.sum("__n").alias("n"))
    return left.join(counts, F.col(left_on) == F.col("__v"), "left").select(*key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def limited_candidates(left: DataFrame, right: DataFrame, left_on: str, right_on: str, probe: list[str], tolerance: Tolerance, most: int) -> DataFrame:
    """tolerance_join (relative) without the probes whose rows meet more than `most` distinct values of right together (they are uninformative).

    A window that holds more than `most` values by itself is dropped before anything is joined: its (most + 1)-th value from
    the lower bound on is looked up in the order of values. What is left makes at most `most` values a row, and probes of several
    rows are counted among them.
    """
    if not tolerance.relative:
        raise ValueError("limited_candidates takes a relative tolerance")
    cell = lambda c: F.floor(F.ln(c) / F.lit(max(4.0 * tolerance.value * 1e-6, 1e-9)))
    v = F.col("__x")
    values = left.select(F.col(left_on).cast("double").alias("__v")).where("__v > 0").distinct().select("__v", tolerance.lower(F.col("__v")).alias("__x"))
    points = right.select(F.col(right_on).cast("double").alias("__x")).where("__x > 0").distinct()
    both = points.select(F.explode(F.array(cell(v) - 1, cell(v))).alias("__cell"), "__x", F.lit(1).alias("__kind"), F.lit(None).cast("double").alias("__v"), v.alias("__p"))
    both = both.unionByName(values.select(cell(v).alias("__cell"), "__x", F.lit(0).alias("__kind"), "__v", F.lit(None).cast("double").alias("__p")))
    asked = both.withColumn("__next", F.expr(f"lead(__p, {most + 1}) IGNORE NULLS OVER (PARTITION BY __cell ORDER BY __x, __kind)")).where("__kind = 0")
    full = asked.where(F.col("__next") < tolerance.upper(F.col("__v"))).select("__v")
    crowded = left.join(full, F.col(left_on) == F.col("__v"), "left_semi").select(*[F.col(c).alias(f"__{c}") for c in probe]).distinct()
    same = F.lit(True)
    for c in probe:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    pairs = tolerance_join(left.join(crowded, same, "left_anti"), right, left_on, right_on, tolerance)
    many = pairs.select(*[F.col(c).alias(f"__{c}") for c in probe], right_on).distinct().groupBy(*[f"__{c}" for c in probe]).agg(F.count(F.lit(1)).alias("__masses")).where(F.col("__masses") > most)
    return pairs.join(many, same, "left_anti")


def gap_join(alphas: DataFrame, betas: DataFrame, linkers: DataFrame, total: str, alpha: str, beta: str, linker: str, tolerance: Tolerance, least: float = 0.0) -> DataFrame:
    """Betas whose mass fills total - alpha - linker, for each of the (few) linkers; the tolerance is taken of the total.

    linkers has one row per configured linker.
    """
    rows = linkers.collect() if linkers.count() <= 1000 else None
    if rows is None:
        raise ValueError("more than 1,000 linkers")
    each = F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in linkers.columns]) for r in rows]))
    wide = alphas.withColumn("__l", each).select(*[F.col(f"`{c}`") for c in alphas.columns], "__l.*")
    wide = wide.withColumn("gap", F.col(total) - F.col(alpha) - F.col(linker)).where(F.col("gap") > least)
    return tolerance_join(wide, betas, "gap", beta, tolerance, reference=F.col(total) if tolerance.relative else None, lists=1)


def unordered_pairs(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Of (a, b) and (b, a) in a group keep one, with a the smaller."""
    x, y = F.least(a, b), F.greatest(a, b)
    return pairs.withColumn("__a", x).withColumn("__b", y).drop(a, b).withColumnRenamed("__a", a).withColumnRenamed("__b", b).dropDuplicates([*group, a, b])


def pair_enumeration(items: DataFrame, key: str, mass: str, linker_mass: float, most: float, bin_width: float, parts: int = 16) -> DataFrame:
    """All pairs a <= b with a.mass + b.mass + linker_mass <= most: a, b, mass_a, mass_b.

    The number of pairs is the result's own size. Items are dealt to parts by key, and in a part they stand in lists by mass, each inside a bin; each
    pair of parts is a task's, where lists meet as one row and are opened last. So an item is shuffled once for each part, not for each bin and task.
    """
    held = items.select(F.col(key).alias("__k"), F.col(mass).alias("__point")).withColumn("__part", F.pmod(F.xxhash64("__k"), F.lit(parts)).cast("int"))
    lists = listed(dealt(held.where("__k is not null"), "__part"), ["__part"], F.floor(F.col("__point") / F.lit(bin_width)))
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = lists.select(F.col("__part").alias("__i"), each.alias("__j"), F.col("__least").alias("__least_a"), F.transform("__list", lambda x: F.struct(x["__k"].alias("a"), x["__point"].alias("mass_a"))).alias("__a"))
    b = lists.select(F.col("__part").alias("__y"), each.alias("__x"), F.col("__least").alias("__least_b"), F.transform("__list", lambda x: F.struct(x["__k"].alias("b"), x["__point"].alias("mass_b"))).alias("__b"))
    met = dealt(a, "__i", "__j").hint("merge").join(dealt(b, "__x", "__y"), (F.col("__i") == F.col("__x")) & (F.col("__j") == F.col("__y")) & (F.col("__least_a") + F.col("__least_b") + linker_mass <= most))
    pairs = met.select("__b", F.inline("__a")).select("a", "mass_a", F.inline("__b"))
    return pairs.where((F.col("a") <= F.col("b")) & (F.col("mass_a") + F.col("mass_b") + linker_mass <= most))
