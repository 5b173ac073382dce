"""What only larger tables show: ties, rows of one group, plans that broadcast or run in one task."""

import math

import numpy as np

from pyspark.sql import functions as F

from peakweave.functions.tolerance import Tolerance
from peakweave.operators import aggregates as A
from peakweave.operators import candidates as P
from peakweave.operators import matching as K
from peakweave.operators import range_join as J
from peakweave.operators import ranking as R
from peakweave.operators import scores as Q
from peakweave.operators import spectra as S
from peakweave.operators.crosslinkers import Crosslinker, Side
from peakweave.plans.queries import QUERIES
from peakweave.sources.tables import stored


def lineitem(spark, path, rows):
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return lambda name: sorted((tuple(r) for r in QUERIES[name].run(spark, str(path)).collect()), key=str)


def test_series_of_one_start_keep_a_peak_each(spark, tmp_path):
    run = lineitem(spark, tmp_path, [(1, 1, 4, 1000.0, 2.0), (1, 2, 5, 1000.0, 3.0), (1, 3, 5, 1001.0, 4.0), (1, 4, 6, 1000.5, 5.0)])
    assert run("deisotoped_peaks") == [(1, 1000.0, 2.0, 1), (1, 1000.0, 7.0, 2), (1, 1000.5, 5.0, None)]
    assert run("deisotoped_decharged") == [(1, 1000.0, 2.0), (1, 1000.5, 5.0), (1, 1998.9927, 7.0)]


def test_nearest_reporter_ties_go_to_the_smaller_mz(spark, tmp_path):
    run = lineitem(spark, tmp_path, [(1, 1, 1, 33714.89, 3.0), (1, 2, 1, 26285.11, 20.0), (2, 1, 1, 31000.0, 7.0), (2, 2, 1, 31000.0, 4.0), (3, 1, 1, 1.0, 9.0)])
    assert run("reporter_intensities") == [(1, 20.0), (2, 4.0), (3, 0.0)]


def test_reporters_of_no_spectrum_are_zero(spark, tmp_path):
    """The SQL joins peaks by their order, and null equals nothing."""
    run = lineitem(spark, tmp_path, [(None, 1, 1, 30000.0, 3.0), (7, 1, 1, 30000.0, 5.0)])
    assert run("reporter_intensities") == [(7, 5.0), (None, 0.0)]


def test_matched_peaks_of_one_mz_go_to_the_smallest_id(spark):
    peaks = spark.createDataFrame([(m, k, 100.0, 1.0, 1) for m in range(20) for k in (5, 3, 9, 1, 7)], "match_id long, peak_id int, mz double, intensity double, charge int")
    fragments = spark.createDataFrame([(m, 1, 99.0, 0) for m in range(20)], "match_id long, fragment_id int, neutral_mass double, loss_count int")
    for order in ("peak_id", "-peak_id"):
        found = K.match_fragments(peaks.coalesce(1).sortWithinPartitions(F.expr(order)), fragments, "match_id", Tolerance(1.0, "da")).collect()
        assert len(found) == 20 and {r.peak_id for r in found} == {1}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_are_never_broadcast_and_run_in_many_tasks(spark):
    for name in ("crosslinked_ions", "fragment_losses", "linker_modified_ions"):
        assert "Broadcast" not in plan(QUERIES[name].run(spark, "/root/testdata/sf0.001")), name
    for name in ("decoy_shuffle", "linear_candidates"):
        assert "REPARTITION_BY_NUM" in plan(QUERIES[name].run(spark, "/root/testdata/sf0.001")), name


def test_wide_relative_windows_touch_few_bins(spark):
    a = spark.createDataFrame([(1, 60000.0, 20000.0), (2, 900.0, 100.0), (3, 60000.0, 59999.0)], "a long, total double, alpha double")
    b = spark.createDataFrame([(k, k / 2) for k in range(100_000)], "b long, beta double")
    got = J.gap_join(a, b, spark.createDataFrame([("x", 0.0), ("y", 138.0)], "linker string, m double"), "total", "alpha", "beta", "m", Tolerance(300.0))
    want = {(i, lk, k) for i, t, m in ((1, 60000.0, 20000.0), (2, 900.0, 100.0), (3, 60000.0, 59999.0)) for lk, x in (("x", 0.0), ("y", 138.0)) if t - m - x > 0 for k in range(100_000) if t - m - x - t * 1e-6 * 300 <= k / 2 < t - m - x + t * 1e-6 * 300}
    assert {(r.a, r.linker, r.b) for r in got.collect()} == want
    # one bin of 0.05 as before would make 720 rows of a window
    assert "__level" in plan(got)


def test_points_meet_windows_in_lists(spark):
    """Results far larger than both sides: hot values, narrow windows and bounds are right, and nothing is shuffled once lists are open."""
    rng = np.random.default_rng(5)
    values = [float(x) for x in np.concatenate([np.full(700, 1000.0), 1000.0 + rng.integers(0, 400, 900) / 1000, rng.integers(900, 1100, 50), [1000.1] * 300])]
    points = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None, float("nan")])], "p long, y double")
    windows = spark.createDataFrame([(i, v, v and v * 1.5) for i, v in enumerate([*values[::40], None])], "w long, x double, total double")
    for parts in (1, 3):
        for tolerance, reference in ((Tolerance(100.0), None), (Tolerance(0.1, "da"), None), (Tolerance(70.0), "total")):
            found = J.tolerance_join(windows, points, "x", "y", tolerance, reference=reference and F.col(reference), repeat="windows" if parts == 1 else "points", lists=parts)
            width = lambda x: tolerance.value * (x * (1.5 if reference else 1.0) * 1e-6 if tolerance.relative else 1.0)
            want = sorted((i, k) for i, x in enumerate(values[::40]) for k, y in enumerate(values) if x - width(x) <= y < x + width(x))
            assert sorted((r.w, r.p) for r in found.collect()) == want
            text = plan(found)
            assert "inline" in text and "Exchange" not in text[: text.index("inline")]


def test_pairs_of_one_hypothesis_are_not_shuffled(spark):
    """Both orders of a pair, alphas of one rank and copies of one mass, against plain Python."""
    linker = Crosslinker("x", 138.0, Side({"K": 0.0}), Side({"S": 0.0}), kind="asymmetric")
    residues = [list("KAG"), list("SAG"), list("GAG"), list("KSG")]
    mass = lambda i: 1000.0 + i % 5
    peptides = spark.createDataFrame([(i, residues[i % 4], mass(i), False, False) for i in range(60)], "peptide_id long, peptide array<string>, mass double, n_term boolean, c_term boolean")
    lists = {h: (2142.0 + h % 3, [(i, (i * 7 + h) % 3) for i in range(h, 60, 7)]) for h in range(6)}
    alphas = spark.createDataFrame([(h, pre, i, rank) for h, (pre, own) in lists.items() for i, rank in own], "hyp long, precursor double, peptide_id long, alpha_rank int")
    found = P.crosslinked_pairs(alphas, peptides, [linker], ["hyp"], "precursor", Tolerance(1.0))
    has = lambda i, r: r in residues[i % 4][:-1]
    want = {}
    for h, (pre, own) in lists.items():
        for i, rank in own:
            betas = [b for b in range(60) if abs(pre - mass(i) - 138.0 - mass(b)) < 1e-3]
            for b in betas:
                if has(i, "K") and has(b, "S") or has(i, "S") and has(b, "K"):
                    key = (h, min(i, b), max(i, b))
                    want[key] = min(want.get(key, (9,)), (rank, i, b, len(betas)))
    assert sorted((r.hyp, r.alpha_rank, r.alpha_id, r.beta_id, r.beta_count) for r in found.collect()) == sorted((h, *x) for (h, _, _), x in want.items()) and len(want) > 100
    text = plan(found)
    assert "Exchange" not in text[: text.index("inline")] and "Window" not in text[: text.index("inline")]


def test_pair_enumeration_shuffles_items_once_for_each_part(spark):
    items = spark.createDataFrame([(i, 900.0 + i % 100) for i in range(900)] + [(None, 900.0), (901, None)], "id long, m double")
    found = J.pair_enumeration(items, "id", "m", 138.0, 1990.0, 100.0)
    want = {(a, b) for a in range(900) for b in range(a, 900) if a % 100 + b % 100 + 1938.0 <= 1990.0}
    rows = [(r.a, r.b) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "sequence(0, 31" not in plan(found) and "inline(__b" in plan(found)


def test_stored_tables_are_not_broadcast(spark):
    a, b = (stored(spark.range(100).withColumnRenamed("id", c).withColumn("k", F.col(c) % 7), c) for c in "ab")
    found = a.join(b.where("b > 3").groupBy("k").agg(F.max("b").alias("b")), "k")
    assert "Broadcast" not in plan(found) and found.count() == 100


def test_large_results_come_from_lists(spark):
    for name in ("gap_join", "linear_candidates", "range_join_ppm", "crosslinked_triples", "crosslinked_candidates"):
        assert "inline(__list" in plan(QUERIES[name].run(spark, "/root/testdata/sf0.001")), name


def test_nearest_and_limited_candidates_make_no_pairs(spark):
    """A thousand masses in each of a thousand windows: no operator of the plan may hand on a million rows."""
    left = spark.range(1000).select(F.col("id").alias("k"), (1000.0 + F.col("id") * 1e-5).alias("x"))
    right = spark.range(1000).select((1000.0 + F.col("id") * 1e-5 + 2e-6).alias("y"))
    got = {r.k: r.y for r in J.nearest_join(left, right, "x", "y", ["k"], Tolerance(100.0), ["y"]).collect()}
    assert len(got) == 1000 and all(abs(y - (1000.0 + k * 1e-5 + 2e-6)) < 1e-9 for k, y in got.items())
    assert J.limited_candidates(left, right, "x", "y", ["k"], Tolerance(100.0), 999).count() == 0
    assert J.limited_candidates(left.limit(3), right, "x", "y", ["k"], Tolerance(100.0), 1000).count() == 3000
    for made in (J.nearest_join(left, right, "x", "y", ["k"], Tolerance(100.0), ["y"]),):
        assert "__low" not in plan(made) and "__high" not in plan(made)


def test_pairs_of_one_mass_are_dealt_to_many_tasks(spark):
    items = spark.range(200).select("id", F.lit(900.0).alias("m"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pairs = J.pair_enumeration(items, "id", "m", 138.0, 1990.0, 100.0).withColumn("task", F.spark_partition_id())
    found = pairs.collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.a, r.b) for r in found) == [(a, b) for a in range(200) for b in range(a, 200)]
    assert len({r.task for r in found}) > 1


def test_repeated_points_meet_each_window_once(spark):
    """Windows of no, one and many bins: the same pairs whichever side is repeated."""
    left = spark.range(400).select(F.col("id").alias("w"), (F.col("id") * 0.37 - 20).alias("x"))
    right = spark.range(900).select(F.col("id").alias("n"), (F.col("id") * 0.17 - 25).alias("y"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for wide in (0.1, 0.5, 3.3):
        for how in ("inner", "left", "left_semi", "left_anti"):
            one, two = (J.window_join(left, right, F.col("x"), F.col("x") + wide, F.col("y"), 0.5, how, repeat=r) for r in ("windows", "points"))
            assert rows(one) == rows(two) and one.columns == two.columns, (wide, how)
    for t in (Tolerance(50000.0), Tolerance(0.4, "da")):
        got = J.tolerance_join(left, right, "x", "y", t, repeat="points")
        assert rows(got) == rows(J.tolerance_join(left, right, "x", "y", t)) and got.columns == ["w", "x", "n", "y"]


def test_range_joins_repeat_no_window(spark):
    """A peak goes to one bin, the fewer masses to two, and no bounds travel with them."""
    for name in ("range_join_da", "range_join_ppm", "range_left_join"):
        made = plan(QUERIES[name].run(spark, "/root/testdata/sf0.001"))
        assert "__low" not in made and "__high" not in made and "array(__rbin" not in made, name


def test_triples_are_not_shuffled_after_they_are_made(spark):
    """Every third of a gap is found once, those among the alphas too; only the latter are compared with each other."""
    query = QUERIES["crosslinked_triples"].run(spark, "/root/testdata/sf0.01")
    made = plan(query)
    assert made.count("Window") <= 3 and "count(1) windowspecdefinition" not in made
    rows = [(r.hyp, r.alpha_id, r.beta_id, r.gamma_id) for r in query.collect()]
    assert len({(h, *sorted(x)) for h, *x in rows}) == len(rows) == 6180


def test_exact_medians_hold_no_group_in_one_aggregate(spark):
    rows = [("a", 1.0), ("a", 9.0), ("b", 1.0), ("b", 2.0), ("b", 1e9), ("c", float("nan")), ("c", 3.0), ("c", float("-inf")), ("d", None), ("e", 5.0), ("e", 5.0), ("e", 5.0), ("e", 7.0), *[("f", (k * 37 % 1000) / 7) for k in range(1000)]]
    df = spark.createDataFrame(rows, "g string, v double")
    made = S.exact_medians(df, ["g"], F.col("v"), "m", 8)
    assert {r.g: r.m for r in made.collect()} == {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert "median" not in plan(QUERIES["shift_calibrate"].run(spark, "/root/testdata/sf0.001")).lower() and "ObjectHashAggregate" not in plan(made)


def test_a_formula_is_computed_once(spark):
    assert "Join" in plan(QUERIES["carbon_isotopes"].run(spark, "/root/testdata/sf0.001"))


def test_copies_of_spectra_and_entries_are_joined_once(spark):
    """Copies of a spectrum, of an entry, repeated peaks and null keys: rows as from all pairs; the pairs of copies are shuffled nowhere."""
    rows = [(s + 10 * i, p, mz) for i in range(5) for s, p, mz in ((1, 1, 100.0), (1, 1, 100.0), (1, 2, 200.0), (2, 1, 100.0), (2, 2, None), (3, 1, 300.0))]
    peaks = spark.createDataFrame([*rows, (None, 1, 100.0), (4, None, 100.0)], "s long, p int, mz double")
    index = spark.createDataFrame([*[(e + 1000 * i, m) for i in range(300) for e, m in ((1, 100.0), (1, 100.001), (2, 200.0), (3, 300.0), (3, None))], (None, 100.0), (7, 100.0), (7, 300.0)], "e long, m double")
    got = A.top_alphas(peaks, index, "s", "p", "mz", "e", "m", Tolerance(100.0), 2, 6)
    pairs = J.tolerance_join(peaks.where("s is not null and p is not null"), index, "mz", "m", Tolerance(100.0))
    plain = A.alpha_scores(pairs, ["s", "p"], ["s", "e"], index.count()).select("s", "e", F.round("score", 6).alias("score"))
    rows = lambda df: sorted(map(tuple, df.select("s", "e", "score", "score_rank").collect()), key=str)
    assert rows(got) == rows(R.top_scores(plain, ["s"], "score", 2)) and got.columns == ["s", "e", "score", "score_rank"]
    made = plan(QUERIES["alpha_candidates"].run(spark, "/root/testdata/sf0.001"))
    assert "inline(__entries" in made and "Exchange" not in made[: made.index("inline(__entries")]


def test_fragments_that_meet_no_peak_are_left_out_before_the_shuffle(spark):
    """Those left out change no match: known and unknown charges, C13 lower, relative and absolute windows, masses below 0."""
    peaks = spark.createDataFrame([(s, s * 100 + k, 400.0 + 37.3 * k + s, 1.0, [None, 1, 2, 3][k % 4]) for s in (1, 2) for k in range(40)], "s long, peak_id long, mz double, intensity double, charge int")
    fragments = spark.createDataFrame([(s, k, 397.0 + 0.31 * k, k % 3) for s in (1, 2, 3) for k in range(-1500, 9000)], "s long, fragment_id long, neutral_mass double, loss_count int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for t in (Tolerance(60.0), Tolerance(0.05, "da")):
        near = fragments.join(K.met_bins(peaks, "s", t), "s").where(K.may_meet(F.col("neutral_mass"), t)).drop("__met")
        want = rows(K.match_fragments(peaks, fragments, "s", t))
        assert want and rows(K.match_fragments(peaks, near, "s", t)) == want, t
        assert near.count() < fragments.count() / 10


def test_sites_are_opened_after_the_last_shuffle(spark):
    """A row for each match is shuffled, not one for each site and fragment; nulls, repeated matches and matches without fragments count as in rows."""
    matched = spark.createDataFrame([(1, 0, 2, True), (1, 1, 3, False), (1, None, 0, True), (2, 0, 0, None), (3, 2, 2, True), (3, 2, 2, True)], "m long, first int, last int, is_crosslinked boolean")
    peptides = spark.createDataFrame([(1, 4), (2, 2), (3, 3), (3, 3), (4, 5)], "m long, n int")
    out = P.site_probabilities(matched, peptides, "m", F.col("n"))
    log = {(1, s): (math.log(0.9) if 0 <= s <= 2 else math.log(0.1)) + (math.log(0.1) if 1 <= s <= 3 else math.log(0.9)) + (math.log(0.1) if s > 0 else 0) for s in range(4)}
    log |= {(2, 0): 0, (2, 1): 0} | {(3, s): 4 * math.log(0.9 if s == 2 else 0.1) for s in range(3)} | {(4, s): 0 for s in range(5)}
    want = {k: math.exp(x) / sum(math.exp(y) for (m, _), y in log.items() if m == k[0]) for k, x in log.items()}
    got = {(r.m, r.site): r.probability for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    made = plan(out)
    assert "posexplode" in made and "Exchange" not in made[: made.index("posexplode")] and "Window" not in made


def test_plain_spectra_are_denoised_side_by_side(spark):
    """Spectra without series, those with one, repeated m/z and long ones: the same peaks as when each is rolled by itself."""
    rng = np.random.default_rng(3)
    rows = [(s, float(m), float(rng.integers(1, 9)), bool(rng.random() < 0.1)) for s in range(300) for m in np.cumsum(rng.uniform(1.2 if s % 3 else 0.3, 30, 80 if s == 7 else s % 9 + 1)) + 100]
    rows += [(s, m, 5.0, False) for s, m, *_ in rows[:40]]
    peaks = spark.createDataFrame(rows, "s int, mz double, intensity double, keep boolean")
    run = lambda **more: sorted(tuple(r) for r in S.denoised(peaks, ["s"], 2, 40.0, 3, Tolerance(20.0), keep="keep", least_mz=103.0, **more).collect())
    at_once, short = run(), S._SHORT
    S._SHORT = 0  # each by itself
    try:
        assert run() == at_once and len(at_once) < len(rows) - 200
    finally:
        S._SHORT = short
    assert S._with_near_peaks(np.array([1.0, 2.0, 4.0, 4.5, 9.0, 9.0, float("nan"), 3.0]), [0, 2, 3, 5, 6, 8]).tolist() == [True, False, False, False, True]


def test_what_a_task_holds_does_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Rows are dealt by key to tasks of so many rows, parts to tasks of so many parts; nothing is shuffled again by that key."""
    from peakweave.plans import queries as N

    sf = "/root/testdata/sf0.001"
    rows = lambda name: sorted(map(tuple, QUERIES[name].run(spark, sf).collect()), key=str)
    names = ("neutral_loss_histogram", "reduced_spectrum", "weighted_normalise", "link_site_weights", "matched_groups")
    want = {name: rows(name) for name in names}
    monkeypatch.setattr(N, "_ROWS", 100)
    for name in names:
        query = QUERIES[name].run(spark, sf)
        assert "REPARTITION_BY_NUM" in plan(query) and int(plan(query).split(", REPARTITION_BY_NUM")[0].rpartition(", ")[2].rstrip(")")) >= 60, name
        assert rows(name) == want[name], name
    monkeypatch.setattr(N, "_PARTS", 2)
    for name in ("modified_forms", "embedded_modifications", "n_terminal_digest"):
        assert int(plan(QUERIES[name].run(spark, sf)).split(", REPARTITION_BY_NUM")[0].rpartition(", ")[2].rstrip(")")) == 100, name


def test_modified_forms_are_not_shuffled(spark, tmp_path):
    part = [(1, "mess", "", ""), (1, "mess", "", ""), (1, "sms", "", ""), (2, "aa", "", "")]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    query = QUERIES["modified_forms"].run(spark, str(tmp_path))
    assert {r.p_partkey: r.forms for r in query.collect()} == {1: 14, 2: 1}
    assert "distinct peptide" not in plan(query) and all("peptide" not in line for line in plan(query).split("\n") if "Exchange" in line)


def test_site_weights_meet_as_arrays(spark):
    """Null sites, repeated pairs, ties, losses, matches without fragments and null matches, held against plain Python; one shuffle a side."""
    pairs = spark.createDataFrame([(1, 0, 2, "x"), (1, 0, 2, "y"), (1, 1, 2, "x"), (1, None, 2, "z"), (2, 5, 5, "x"), (2, 6, 5, "x"), (None, 1, 1, "n")], "m int, site_a int, site_b int, note string")
    hits = spark.createDataFrame([(1, 0, 0, 0, 0, False, 0.5), (1, 1, 2, 3, 2, False, 0.4), (1, 0, 0, 9, 3, False, 9.0), (1, 0, 0, 9, 0, True, 9.0), (1, 0, 0, 9, 0, False, None), (1, 0, None, 9, 0, False, 1.0), (None, 0, 0, 9, 0, False, 1.0)], "m int, peptide_index int, first int, last int, loss_count int, is_crosslinked boolean, rel_intensity double")
    out = K.link_site_weights(pairs, hits, "m", F.lit(0.1))
    made = plan(out)
    want = [(None, 1, 1, "n", 0.1, True), (1, None, 2, "z", 0.1, True), (1, 0, 2, "x", 0.62, False), (1, 0, 2, "y", 0.62, False), (1, 1, 2, "x", 0.12, False), (2, 5, 5, "x", 0.1, False), (2, 6, 5, "x", 0.1, True)]
    got = out.collect()
    assert sorted(((r.m, r.site_a, r.site_b, r.note, round(r.weight, 9), r.is_best) for r in got), key=str) == sorted(want, key=str)
    for m in (None, 1, 2):
        total = sum(1 / (w[4] + 1e-4) for w in want if w[0] == m)
        assert all(abs(r.share - 1 / (r.weight + 1e-4) / total) < 1e-9 for r in got if r.m == m)
    assert "Window" not in made and made.count("Join") == 1


def test_scores_are_normalised_in_one_aggregate(spark):
    """Matches none of whose scores count have the score 0; nulls, NaN, 999999 and scores without parameters don't count."""
    nan = float("nan")
    wide = spark.createDataFrame([(1, 3.0, 5.0), (2, None, nan), (3, 999999.0, 1.0), (4, 999999.0, nan)], "match_id int, a double, b double")
    parameters = spark.createDataFrame([("a", 1.0, 2.0, 1, 0.5, 2.0), ("b", 1.0, 2.0, -1, 0.0, 1.0), ("c", 0.0, 1.0, 1, 1.0, 1.0)], "score_name string, average double, stdev double, direction int, normalised_split double, weight double")
    score = lambda **more: {r.match_id: round(r.match_score, 6) for r in Q.normalised_score(Q.to_long(wide.withColumn("d", F.lit(1)), "match_id", ["a", "b", "d"]), parameters, **more).collect()}
    assert score() == {1: round((4.0 - 2.0) / 3 * 7, 6), 2: 0.0, 3: 0.0, 4: 0.0} and score(missing=-1.0)[4] == 0.0
    made = plan(Q.normalised_score(Q.to_long(wide, "match_id", ["a", "b"]), parameters))
    assert made.count("HashAggregate") <= 4 and made.count("Join") == 1 and "Expand" not in made


def test_totals_of_kinds_come_from_one_shuffle_of_peaks(spark):
    """As the cube with distinct spectra; null kinds, null spectra and null intensities too."""
    rows = spark.createDataFrame([(s if s else None, "abc"[k % 3] if k % 5 else None, k % 2, float(k) if k % 7 else None) for s in range(6) for k in range(40 + s)], "s int, ion string, kind int, i double")
    cube = rows.cube("ion", "kind").agg(F.count(F.lit(1)).alias("peaks"), F.count_distinct("s").alias("spectra"), F.sum("i").alias("intensity"))
    got = A.matched_groups(rows, ["ion", "kind"], "s", "i")
    ordered = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert ordered(got) == ordered(cube) and got.columns == cube.columns
    assert "Expand" not in plan(got)


def test_rows_of_a_batch_walk_a_tree_side_by_side(spark):
    """Missing nodes, cycles, roots that are leaves, scores that no column has and null limits say what a walk node by node says."""
    nodes = [("a", 0, "x", 1.0, 1, 2, None), ("a", 1, None, None, None, None, True), ("a", 2, "y", None, 1, 3, None), ("a", 3, None, None, None, None, False), ("b", 0, "x", 2.0, 1, 9, None), ("b", 1, "y", 5.0, 0, 2, None), ("b", 2, None, None, None, None, None), ("c", 0, None, None, None, None, True), ("d", 0, "x", float("nan"), 1, 2, None), ("d", 1, None, None, None, None, True), ("d", 2, None, None, None, None, False)]
    trees = spark.createDataFrame(nodes, "tree string, node int, score string, at_most double, yes int, no int, says boolean")
    scores = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate((x, y) for x in (0.0, 1.0, 1.5, 7.0, float("nan"), None) for y in (4.0, 6.0, None))], "k int, x double, y double")
    table = {}
    for t, n, *rest in nodes:
        table.setdefault(t, {})[n] = rest

    def walk(t, row):
        at = 0
        for _ in table[t]:
            score, most, yes, no, _ = table[t].get(at, (None,) * 5)
            if score is None:
                break
            v = row[score]
            at = yes if v is not None and not math.isnan(v) and most is not None and (math.isnan(most) or v <= most) else no
        return table[t].get(at, (None,) * 5)[4]

    made = Q.tree_outputs(scores, trees)
    got = made.collect()
    assert len(got) == 18 and all(r.trees == {t: walk(t, r) for t in table} for r in got)
    assert "ArrowEvalPython" in plan(made) and "Join" not in plan(made)
