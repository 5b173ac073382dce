"""Registries, triples, embedded modifications, trees, cyclic decoys and precursor detection against plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_search import CONFIG, PROTEINS, ladder, mass

from peakweave.functions import isotopes as Z
from peakweave.functions import masses as M
from peakweave.functions.tolerance import Tolerance
from peakweave.operators import candidates as P
from peakweave.operators import decoys as C
from peakweave.operators import digest as D
from peakweave.operators import filters as L
from peakweave.operators import range_join as J
from peakweave.operators import scores as Q
from peakweave.operators import spectra as S
from peakweave.plans import config as conf
from peakweave.plans import database as B
from peakweave.plans import open_search as O
from peakweave.plans import registry as G
from peakweave.plans import search as X
from peakweave.plans.queries import QUERIES
from peakweave.sources import sinks
from peakweave.sources import tables as T

SPECTRA = "spectrum_id long, run string, scan int, scan_title string, peak_file string, rt_start double, rt_end double, precursor_mz double, precursor_intensity double, precursor_charge int, charge_alternatives array<int>, additional_mz array<double>, peaks array<struct<mz:double,intensity:double>>"


def spectra_of(spark, rows):
    """rows: (id, run, scan, precursor m/z, charge, peaks)."""
    return spark.createDataFrame([(i, r, s, f"{r}.{s}", "f", 1.0, 1.0, mz, 1.0, z, [], [], peaks) for i, r, s, mz, z, peaks in rows], SPECTRA)


def test_nearest_join_keeps_repeated_rows_and_wide_windows_join(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 10.0), (1, 10.2), (2, 99.0)], "k int, x double")
    right = spark.createDataFrame([(9.9, "a"), (10.1, "b"), (10.1, "c")], "y double, n string")
    got = sorted(map(tuple, J.nearest_join(left, right, "x", "y", ["k"], Tolerance(0.5, "da"), ["y", "n"]).collect()))
    assert got == [(1, 10.0, 9.9, "a"), (1, 10.0, 9.9, "a"), (1, 10.2, 10.1, "b")]
    windows = spark.createDataFrame([(1, 0.0, 1000.0), (1, 0.0, 1000.0), (2, 5000.0, 5000.5), (3, None, 4.0)], "w int, low double, high double")
    joined = {how: sorted(map(tuple, J.window_join(windows, right, F.col("low"), F.col("high"), F.col("y"), 1.0, how).select("w", *(["n"] if how in ("inner", "left") else [])).collect()), key=repr) for how in ("inner", "left", "left_semi", "left_anti")}
    assert joined["inner"] == [(1, n) for n in "aabbcc"] and joined["left"] == [(1, n) for n in "aabbcc"] + [(2, None), (3, None)]
    assert joined["left_semi"] == [(1,), (1,)] and joined["left_anti"] == [(2,), (3,)]


PEAKS = [[(100.0 + 10 * k + 0.01 * i, 1.0 + (k * 7 + i) % 5) for k in range(12)] + [(400.0 + k * M.C13_DIFF / 2, 9.0 - k) for k in range(3)] for i in range(4)]


def peak_rows(df):
    return {r.spectrum_id: [(p.mz, p.intensity) for p in r.peaks] for r in df.collect()}


@pytest.fixture(scope="module")
def few(spark):
    return spectra_of(spark, [(i, "ab"[i % 2], i, 400.0, 2, PEAKS[i]) for i in range(4)])


def direct(few):
    return S.exploded(few, ["spectrum_id"])


def test_filters_equal_direct_calls(spark, few):
    tol = Tolerance(20.0)
    run = lambda text: peak_rows(G.filtered(few, conf.parse(text).filters, tol))
    arrays = lambda peaks: peak_rows(S.peak_arrays(peaks.select("spectrum_id", "mz", "intensity"), ["spectrum_id"]))
    peaks = direct(few)
    series = S.isotope_clusters(peaks, ["spectrum_id"], G.CHARGES, tol, every=True)
    assert run("filter:deisotope") == arrays(S.deisotoped(peaks, series, ["spectrum_id"]))
    assert run("filter:RemoveSinglePeaks") == arrays(S.without_single_peaks(peaks, series, ["spectrum_id"]))
    assert run("filter:denoise:peaks:2;window:50;keepprecursor:false") == arrays(S.denoised(peaks, ["spectrum_id"], 2, 50.0, G.CHARGES, tol))
    kept = peaks.withColumn("k", F.abs(F.col("mz") - 110.0) < 0.0022)
    assert run("filter:denoise:peaks:2;window:50;minmz:105;keepprecursor:no;keeppeaks:110") == arrays(S.denoised(kept, ["spectrum_id"], 2, 50.0, G.CHARGES, tol, keep="k", least_mz=105.0))
    ids = lambda text: sorted(run(text))
    assert ids("filter:ScanFilteredSpectrumAccess:a:0,9;b:*") == [0, 1, 3] and ids("filter:ScanFilteredSpectrumAccess:b;blacklist") == [0, 2]
    wanted = [r[0] for r in L.contains_peaks(peaks, "spectrum_id", [100.02, 110.02], Tolerance(0.015, "da"), "all").orderBy("spectrum_id").collect()]
    assert ids("filter:containspeaks:peaks:100.02,110.02;tolerance:0.015 Da;match:all") == wanted == [1, 2, 3]
    assert ids("filter:containspeaks:peaks:100.02,777;tolerance:0.001 Da;match:1") == [2]


def test_filters_run_in_order_and_know_each_other(spark, few):
    tol = Tolerance(20.0)
    lines = conf.parse("filter:denoise:peaks:1;window:1000;keepprecursor:no\nfilter:rebase\nfilter:deisotope").filters
    out = G.filtered(few, lines, tol)
    peaks = S.denoised(direct(few), ["spectrum_id"], 1, 1000.0, G.CHARGES, tol)
    assert {r.spectrum_id: len(r.origin_peaks) for r in out.collect()} == {r[0]: r[1] for r in peaks.groupBy("spectrum_id").count().collect()}
    assert all(len(p) == 1 for p in peak_rows(out).values())
    first = G.stages(conf.parse("filter:denoise:keepprecursor:no\nfilter:containspeaks:peaks:5\nfilter:MS2PrecursorDetection").filters)[0]
    assert first.keep == [5.0] and first.keep_precursor
    for bad in ("filter:nothing", "filter:containspeaks:peaks:1;match:some"):
        with pytest.raises(ValueError):
            G.stages(conf.parse(bad).filters)
    with pytest.raises(ValueError):
        G.losses(conf.parse("loss:Unheard:NAME:x;MASS:1").losses)
    with pytest.raises(ValueError):
        G.ion_types(["QIon"])
    assert G.ion_types(["BIon", "YIon", "PeptideIon"]) == ("by", True, False) and G.ion_types([]) == ("by", False, False) and G.ion_types(["CIon", "z", "BLikeDoubleFragmentation"]) == ("cz", False, True)
    made = G.losses(conf.parse("loss:AminoAcidRestrictedLoss:NAME:H20;aminoacids:S,T;MASS:18.01;cterm\nloss:AIonLoss\nloss:CrosslinkerRestrictedLoss:NAME:q;MASS:5\nloss:CrosslinkerModified").losses)
    assert [(x.name, x.residues, x.c_term, x.crosslinked, x.once) for x in made] == [("H20", ("S", "T"), True, None, False), ("CO", (), False, None, False), ("q", (), False, True, True)]


def height(m, k):
    return max(0.0, m * S.AVERAGINE_A[min(k, 8)] + S.AVERAGINE_B[min(k, 8)])


def test_precursor_detection_by_the_longest_series(spark):
    step = M.C13_DIFF / 2
    rising = [(500.0 - step + k * step, i) for k, i in enumerate((1.0, 90.0, 60.0, 40.0, 20.0))]  # its first peak looks like an artefact
    plain = [(500.0 + k * step, 100.0 - 20 * k) for k in range(4)]
    rows = [(1, "a", 1, 500.0, 2, rising), (2, "a", 2, 500.0, 2, plain), (3, "a", 3, 500.0, 3, plain), (4, "a", 4, 700.0, 2, plain)]
    out = G.filtered(spectra_of(spark, rows), conf.parse("filter:MS2PrecursorDetection:window:3;charge:true").filters, Tolerance(20.0))
    got = {r.spectrum_id: ([round(x, 6) for x in r.additional_mz], r.charge_alternatives) for r in out.collect()}
    start = rising[0][0]
    expected = 1.0 / height(start, 0) * height(start, 1)
    assert expected < 90.0 / 3
    assert got == {1: ([round(500.0 - step, 6)], []), 2: ([], []), 3: ([], [2]), 4: ([], [])}
    other = G.filtered(spectra_of(spark, rows), conf.parse("filter:MS2PrecursorDetection:longest:false").filters, Tolerance(20.0))
    assert all(r.charge_alternatives for r in other.where("spectrum_id < 4").collect())


def test_planted_triple_wins(spark):
    link = 205.3
    text = CONFIG + f"crosslinker:SymetricNarrySingleAminoAcidRestrictedCrossLinker:Name:three;MASS:{link};LINKEDAMINOACIDS:K(0);MOIETIES:3\n"
    a, b, c = "SWWGHKNLDYEVR", "IINTKAWSLDER", "AAVEFGHLKPWDNR"
    whole = mass(a) + mass(b) + mass(c) + link
    peaks = []
    for s, at in ((a, 5), (b, 4), (c, 8)):
        peaks += [((m + whole - mass(s) if first <= at <= last else m) + M.PROTON, 50.0 + n) for _, n, first, last, m in ladder(s)]
    spectra = spectra_of(spark, [(1, "run", 1, whole / 5 + M.PROTON, 5, sorted(peaks))])
    proteins = spark.createDataFrame([(k, n, n, list(s)) for k, (n, s) in enumerate(PROTEINS.items())], "protein_id long, header string, accession string, residues array<string>")
    results = X.search(spectra, proteins, conf.parse(text))
    top = results.matches.where("match_rank = 1").first()
    assert {top.peptide1, top.peptide2, top.peptide3} == {a, b, c} and top.linker == "three" and not top.is_decoy
    table = X.match_table(results, spectra).where("MatchRank = 1").first()
    assert abs(table.CalcMass - whole) < 1e-3 and table.Peptide3 == top.peptide3


def test_configuration_changes_the_search(spark):
    seq = "TYSSEEKVILQMR"
    spectra = spectra_of(spark, [(9, "run", 9, mass(seq) / 2 + M.PROTON, 2, sorted((m + M.PROTON, 50.0) for *_, m in ladder(seq)))])
    proteins = spark.createDataFrame([(k, n, n, list(s)) for k, (n, s) in enumerate(PROTEINS.items())], "protein_id long, header string, accession string, residues array<string>")
    kinds = lambda text: {r[0] for r in X.search(spectra, proteins, conf.parse(CONFIG + text)).matched.select("ion_type").distinct().collect()}
    assert kinds("") == {"b", "y"} and kinds("fragment:YIon\n") == {"y"}
    lossy = lambda text: {r[0] for r in X.search(spectra, proteins, conf.parse(CONFIG + text)).matched.where("loss_count > 0").select("loss_name").distinct().collect()}
    assert all(n.startswith("_q") for n in lossy("loss:AminoAcidRestrictedLoss:NAME:q;aminoacids:E;MASS:128.094963\n"))
    results = X.search(spectra, proteins, conf.parse(CONFIG + "proteingroup:g:D\nfilter:ScanFilteredSpectrumAccess:run:9\n"))
    assert {p.protein.removeprefix("REV_") for r in results.peptides.collect() for p in r.positions} == {"D"} and results.matches.count() > 0
    assert X.search(spectra, proteins, conf.parse(CONFIG + "filter:ScanFilteredSpectrumAccess:run:8\n")).matches.count() == 0
    parameters = spark.createDataFrame([("matched_coverage", 0.2, 0.1, 1, 1.0, 2.0), ("mean_absolute_error", 5.0, 5.0, -1, 1.0, 1.0)], "score_name string, average double, stdev double, direction int, normalised_split double, weight double")
    best = X.search(spectra, proteins, conf.parse(CONFIG), parameters=parameters).matches.where("match_rank = 1").first()
    by_hand = ((best.matched_coverage - 0.2) / 0.1 * 2 - (best.mean_absolute_error - 5) / 5) / 3 * 7
    assert best.peptide1 == seq and math.isclose(best.match_score, by_hand, rel_tol=1e-9)


def test_embedded_modifications_reach_the_search(spark):
    extra = "modification:known::SYMBOLEXT:ph;MODIFIED:S;DELTAMASS:79.966331\n"
    text = PROTEINS["D"].replace("YSSEE", "YS(ph|[11.5])SEE")
    rows = spark.createDataFrame([(0, "D", "D", text)], "protein_id long, header string, accession string, s string")
    proteins = rows.select("protein_id", "header", "accession", M.tokens(F.col("s")).alias("residues"))
    table = X.peptide_table(proteins, conf.parse(CONFIG + extra))
    found = {r.seq: r.mass for r in table.where("not is_decoy and seq like '%SEEKVILQMR'").collect()}
    seq = "TYSSEEKVILQMR"
    for s, more in ((seq, 0), ("TYSphSEEKVILQMR", 79.966331), ("TYS[11.5]SEEKVILQMR", 11.5)):
        assert math.isclose(found[s], mass(seq) + more, abs_tol=1e-6)
    decoys = {r.seq for r in table.where("is_decoy").collect()}
    assert any("Sph" in d for d in decoys) and any("S[11.5]" in d for d in decoys)


def forms_by_hand(sites, most_mods, most_forms):
    out, last = [], [()]
    for _ in range(most_mods):
        last = [(*f, (at, o)) for f in last for at, options in sites if not f or at > f[-1][0] for o in options]
        out += last
        if len(out) >= most_forms:
            break
    return [()] + out


def test_embedded_forms_by_hand(spark):
    rng = random.Random(4)
    cases = [(k, [(at, [f"m{j}" for j in range(rng.randint(1, 3))]) for at in sorted(rng.sample(range(12), rng.randint(0, 6)))]) for k in range(60)]
    rows = spark.createDataFrame([(k, ["A"] * 12, 0, 12, [(at, o) for at, o in s]) for k, s in cases], "k int, peptide array<string>, start int, stop int, embedded array<struct<at:int,options:array<string>>>")
    for most_mods, most_forms in ((1, 20), (2, 4), (3, 20), (3, 1)):
        got = {}
        for r in D.embedded_forms(rows, most_mods=most_mods, most_forms=most_forms).collect():
            got.setdefault(r.k, []).append(tuple((i, t) for i, t in enumerate(r.peptide) if t != "A"))
            assert r.changes == len(got[r.k][-1])
        for k, sites in cases:
            assert sorted(got[k]) == sorted(forms_by_hand(sites, most_mods, most_forms))


def test_every_embedded_form_by_hand(spark):
    """Without limits all choices at all sites are made, also of peptides with more forms than one row lists."""
    sites = [(k, [f"m{j}" for j in range(1 + k % 3)]) for k in range(9)]
    cases = [[], sites[:1], sites[:5], sites]
    rows = spark.createDataFrame([(k, ["A"] * 12, 0, 12, s) for k, s in enumerate(cases)], "k int, peptide array<string>, start int, stop int, embedded array<struct<at:int,options:array<string>>>")
    got = Counter((r.k, r.changes, tuple(r.peptide)) for r in D.embedded_forms(rows, most_mods=None, most_forms=None).collect())
    want = Counter()
    for k, case in enumerate(cases):
        for picks in itertools.product(*[[None, *options] for _, options in case]):
            tokens = ["A"] * 12
            for (at, _), pick in zip(case, picks, strict=True):
                tokens[at] = pick or "A"
            want[k, sum(p is not None for p in picks), tuple(tokens)] += 1
    assert got == want and max(Counter(k for k, *_ in got).values()) > 4096


def test_pieces_with_many_changes_are_whole(spark, tmp_path):
    """Three M make 27 forms, the last of which changes all three; the query made 7 of them before."""
    spark.createDataFrame([(1, "aMcMdMe", "f", "g")], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["embedded_modifications"].run(spark, str(tmp_path)).collect()
    assert len(found) == 27 and sum(r.changes == 3 for r in found) == 8


def test_trees_equal_plain_python(spark):
    rng = random.Random(6)
    rows, trees = [], {}
    for t in range(500):
        size = rng.randrange(1, 8)
        nodes = [None] * (2 * size - 1)
        for i in range(2 * size - 1):
            nodes[i] = (rng.choice("abc"), round(rng.uniform(-1, 1), 2), 2 * i + 1, 2 * i + 2, None) if 2 * i + 2 < len(nodes) else (None, None, None, None, rng.random() < 0.5)
        trees[f"t{t}"] = nodes
        rows += [(f"t{t}", i, *n) for i, n in enumerate(nodes)]
    table = spark.createDataFrame(rows, "tree string, node int, score string, at_most double, yes int, no int, says boolean")
    values = [(k, *[rng.choice([None, math.nan, rng.uniform(-1, 1)]) for _ in "abc"]) for k in range(40)]
    scores = spark.createDataFrame(values, "k int, a double, b double, c double")

    def walk(nodes, row):
        at = 0
        while nodes[at][0] is not None:
            x = row[1 + "abc".index(nodes[at][0])]
            at = nodes[at][2] if x is not None and not math.isnan(x) and x <= nodes[at][1] else nodes[at][3]
        return nodes[at][4]

    out = {r.k: r for r in Q.tree_votes(Q.tree_outputs(scores, table), 240).collect()}
    for row in values:
        want = {t: walk(n, row) for t, n in trees.items()}
        assert out[row[0]].trees == want and out[row[0]].auto_validation == int(sum(not v for v in want.values()) <= 240)
    with pytest.raises(ValueError):
        Q.tree_outputs(scores.drop("a"), table)
    assert Q.tree_votes(Q.tree_outputs(scores, table.limit(0))).where("auto_validation = 1 and size(trees) = 0").count() == 40


def test_cyclic_and_swapping_decoys(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice("AKRSM") for _ in range(rng.randrange(0, 25))]) for i in range(500)]

    def swap(r, special):
        r, first = list(r), 2 if r[:1] == ["M"] else 1
        for i in range(first, len(r)):
            if r[i] in special:
                r[i - 1], r[i] = r[i], r[i - 1]
        return r

    def cyclic(r, special):
        last, out = -1, []
        for x in r:
            if x in special:
                last = (last + 1) % len(special) if special.index(x) == last else special.index(x)
                x = special[last]
            out.append(x)
        out.reverse()
        if len(out) > 1 and out[-1] == "M" != out[0]:
            out[0], out[-1] = "M", out[0]
        return out

    r = F.col("r")
    df = spark.createDataFrame(rows, "i int, r array<string>")
    for g in df.select("i", C.swap_with_predecessor(r, ["K", "R"]).alias("s"), C.reverse_cyclic(r, ["K", "R"]).alias("two"), C.reverse_cyclic(r, ["S", "K", "R"]).alias("three")).collect():
        own = rows[g.i][1]
        assert (g.s, g.two, g.three) == (swap(own, "KR"), cyclic(own, ["K", "R"]), cyclic(own, ["S", "K", "R"]))


def test_shifted_pairs_equal_a_nested_loop(spark):
    rng = random.Random(9)
    rows = [(h, 2000.0 + h, k, rng.uniform(300, 2000), round(rng.expovariate(0.3), 1)) for h in range(12) for k in range(rng.choice([0, 1, 5, 60]))]
    links, tol = [100.0, 0.0], 2.0
    got = {r.hyp: (r.pair_score, r.linear_score) for r in P.shifted_pairs(spark.createDataFrame(rows, "hyp int, precursor double, peptide_id int, mass double, score double"), links, ["hyp"], "precursor", Tolerance(tol, "da"), quick=4).collect()}
    want = {}
    for h in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == h]
        near = lambda m: abs(m - 2000.0 - h) <= tol  # noqa: B023, E731
        want[h] = (max((a[4] + b[4] for a in own for b in own for x in links if near(a[3] + b[3] + x)), default=None), max((a[4] for a in own if near(a[3])), default=None))
    assert set(got) == set(want)
    for h, (pair, single) in want.items():
        assert got[h] == (pytest.approx(pair) if pair is not None else None, single)


def convolve(a, b, peaks):
    return [sum(a[i] * b[k - i] for i in range(k + 1)) for k in range(peaks)]


def test_isotopes_equal_direct_convolution(spark):
    peaks = 8
    formulas = {"C6H12O6": {"C": 6, "H": 12, "O": 6}, "C254H377N65O75S6": {"C": 254, "H": 377, "N": 65, "O": 75, "S": 6}, "NaCl2": {"Na": 1, "Cl": 2}, "H": {"H": 1}, "CCl4C2": {"C": 3, "Cl": 4}, "": {}, "C5H-3": {"C": 5}}
    got = {r.f: r.d for r in spark.createDataFrame([(f,) for f in formulas], "f string").select("f", Z.of_formula(F.col("f"), peaks).alias("d")).collect()}

    def direct(counts):
        out = [1.0] + [0.0] * (peaks - 1)
        for e, n in counts.items():
            for _ in range(n):
                out = convolve(out, (list(Z.SHARES[e]) + [0.0] * peaks)[:peaks], peaks)
        return out

    for f, counts in formulas.items():
        assert got[f] == pytest.approx(direct(counts), abs=1e-9)
    peptide = spark.createDataFrame([(list("PEPTIDEM"),)], "r array<string>").select(Z.of_peptide(F.col("r"), peaks)).first()[0]
    total = {e: sum(Z.ATOMS[x][k] for x in "PEPTIDEM") + more for k, (e, more) in enumerate((("C", 0), ("H", 2), ("N", 0), ("O", 1), ("S", 0)))}
    assert peptide == pytest.approx(direct(total), abs=1e-9)


def test_planted_shift_is_removed(spark):
    rng = random.Random(5)
    known = S.y_ions(weights={"A": 0.5, "L": 0.3})
    assert known[0] == (pytest.approx(M.RESIDUES["K"] + M.WATER + M.PROTON), 1.0) and len(known) == 6
    shift = {"a": 12e-6, "b": -7e-6, "c": 0.0}
    rows = []
    for run, d in shift.items():
        for s in range(60):
            rows += [(run, f"{run}{s}", mz * (1 + d + rng.gauss(0, 3e-7)), rng.uniform(1, 9)) for mz, _ in known if rng.random() < 0.8]
            rows += [(run, f"{run}{s}", rng.uniform(100, 900), 1.0) for _ in range(10)]
    peaks = spark.createDataFrame(rows, "run string, spectrum string, mz double, intensity double")
    errors = S.known_peak_errors(peaks, spark.createDataFrame(known, "known_mz double, known_weight double"), ["run", "spectrum"], Tolerance(50.0))
    found = S.run_corrections(errors, ["run"])
    offsets = {r.run: r.offset for r in found.collect()}
    assert all(abs(offsets[run] - d) < 3e-7 for run, d in shift.items())
    fixed = S.corrected(peaks, found, ["run"], ["mz"], least=50, cutoff=1e-6).collect()
    near = [min((r.mz / mz - 1 for mz, _ in known), key=abs) for r in fixed]
    assert sum(abs(e) < 2e-6 for e in near) > 0.95 * sum(abs(e) < 50e-6 for e in near)
    untouched = S.corrected(peaks, found, ["run"], ["mz"], least=10**6).collect()
    assert sorted(map(tuple, untouched)) == sorted(map(tuple, peaks.collect()))


def test_flavours_and_open_modifications(spark):
    assert O.flavour(conf.parse("")) == "default" and O.flavour(conf.parse("flavour:Open")) == "open"
    assert O.flavour(conf.parse("crosslinker:LinearCrosslinker:Name:OpenModification")) == "open"
    with pytest.raises(ValueError):
        O.flavour(conf.parse("flavour:mine"))
    seq, at, more = "TYSSEEKVILQMR", 3, 79.966331
    peaks = sorted(((m + more if first <= at <= last else m) + M.PROTON, 50.0) for _, _, first, last, m in ladder(seq))
    spectra = spectra_of(spark, [(9, "run", 9, (mass(seq) + more) / 2 + M.PROTON, 2, peaks)])
    proteins = spark.createDataFrame([(k, n, n, list(s)) for k, (n, s) in enumerate(PROTEINS.items())], "protein_id long, header string, accession string, residues array<string>")
    for text in ("flavour:open\nom_min_mass:50\nom_max_mass:100\n", "flavour:targeted\ntargetmodificationmasses:15.99491,79.966331\n"):
        found = O.run(spectra, proteins, conf.parse(CONFIG + text))
        top = found.matches.where("match_rank = 1").collect()
        assert [(r.peptide1, r.site) for r in top] == [(seq, at)] and math.isclose(top[0].open_mass, more, abs_tol=1e-3) and top[0].pseudo_peptide.startswith("X79.966")
        sums = found.sites.groupBy("match_id").agg(F.sum("probability").alias("p")).collect()
        assert sums and all(math.isclose(r.p, 1.0, rel_tol=1e-9) for r in sums)
        assert top[0].site_probability > 0.9
    none = O.run(spectra, proteins, conf.parse(CONFIG + "flavour:open\nom_min_mass:200\nom_max_mass:300\n")).matches
    assert none.where(F.col("peptide1") == seq).count() == 0


def test_numbers_of_distinct_values(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("zz",)] + [(f"k{i:03d}",) for i in range(300)], "v string")
    got = {r.v: r.n for r in T.auto_increment(df, "v", "n").collect()}
    order = sorted(got, key=lambda x: (x is not None, x or ""))
    assert [got[v] for v in order] == list(range(1, len(order) + 1)) and T.auto_increment(df.limit(0), "v", "n").count() == 0


def series_by_hand(x, y, top, near, ratio=8.0):
    """Isotope series of one spectrum by plain scans: every charge, and series extended below."""
    def at(v):
        hits = [j for j, m in enumerate(x) if v - near(v) <= m < v + near(v)]
        return min(hits, key=lambda j: (abs(x[j] - v), j)) if hits else -1

    taken, out = set(), []
    for i in range(len(x) - 1):
        if i in taken or x[i + 1] - x[i] > 1.1:
            continue
        found = []
        for z in range(1, top + 1):
            part, k = [i], 1
            while (j := at(x[i] + k * (M.C13_DIFF / z))) > i and not (k == 1 and y[j] >= ratio * y[i]):
                part.append(j)
                k += 1
            if len(part) > 1:
                found.append((z, part))
        for z, part in found:
            below, k = [], 1
            while 0 <= (j := at(x[i] - k * M.C13_DIFF / z)) < i:
                below.insert(0, j)
                k += 1
            taken |= {*below, *part}
            out += [(z, part)] + ([(z, below + part)] if below else [])
    return out


def test_isotope_series_by_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for s in range(80):
        peaks = {}
        for _ in range(rng.randrange(1, 6)):
            start, z = rng.uniform(200, 210), rng.randint(1, 4)
            for k in range(rng.randint(1, 6)):
                peaks[round(start + k * M.C13_DIFF / z + rng.gauss(0, 0.0005), 5)] = round(rng.uniform(1, 30), 2)
        rows += [(f"r{s % 3}", s if s else None, mz, i) for mz, i in peaks.items()]
    table = spark.createDataFrame(rows, "run string, scan int, mz double, intensity double").repartition(5)
    got = {}
    for r in S.isotope_clusters(table, ["run", "scan"], 4, Tolerance(0.002, "da"), every=True).collect():
        got.setdefault((r.run, r.scan), {}).setdefault((r.cluster_id, r.charge), []).append((r.place, r.peak, r.mz, r.intensity))
    for key in {r[:2] for r in rows}:
        own = sorted(r[2:] for r in rows if r[:2] == key)
        x, y = [p[0] for p in own], [p[1] for p in own]
        want = [(z, [(x[j], y[j]) for j in part]) for z, part in series_by_hand(x, y, 4, lambda v: 0.002)]
        have = got.get(key, {})
        assert [(z, [(m, i) for _, _, m, i in sorted(have[n, z])]) for n, z in sorted(have)] == want
        assert all(x[j] == m for part in have.values() for _, j, m, _ in part)


def test_search_in_a_database(spark, tmp_path):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    seq = "TYSSEEKVILQMR"
    lines = CONFIG.strip().splitlines()
    put = lambda df, name: df.write.mode("overwrite").jdbc(url, name)
    put(spark.createDataFrame(list(enumerate(lines)), "line_number int, line string"), "configuration")
    put(spark.createDataFrame([(7, "run", 7, "run.7", "f", 1.0, 1.0, mass(seq) / 2 + M.PROTON, 1.0, 2)], "spectrum_id long, run string, scan int, scan_title string, peak_file string, rt_start double, rt_end double, precursor_mz double, precursor_intensity double, precursor_charge int"), "spectrum")
    put(spark.createDataFrame([(7, m + M.PROTON, 50.0) for *_, m in ladder(seq)], "spectrum_id long, mz double, intensity double"), "spectrum_peak")
    put(spark.createDataFrame([(k, n, n, s) for k, (n, s) in enumerate(PROTEINS.items())], "protein_id long, header string, accession string, sequence string"), "protein")
    found = B.search_database(spark, url)
    top = found.matches.where("match_rank = 1").first()
    assert top.peptide1 == seq
    back = {n: T.read_jdbc(spark, url, n) for n in B.result_tables(found)}
    assert {n: df.count() for n, df in back.items()} == {n: df.count() for n, df in B.result_tables(found).items()}
    stored = {(r[0], r[1]): r[2] for r in back["match_value"].collect()}
    assert math.isclose(stored[top.match_id, "match_score"], top.match_score, rel_tol=1e-12)
    with pytest.raises(Exception, match="already exists"):
        B.search_database(spark, url)


def test_deisotoped_list_names_every_peak(spark, tmp_path):
    charged = spark.createDataFrame([(1, 100.0, 5.0, 1), (1, 200.0, 6.0, None), (2, 50.0, 1.0, 1)], "spectrum_id int, mz double, intensity double, charge int")
    matched = spark.createDataFrame([(11, 1, 100.0, "b", 2, "", False, 0, False), (11, 1, 100.0, "y", 3, "_H2Ox1", True, 1, True), (12, 1, 200.0, "b", 4, "", False, 0, True)], "match_id int, spectrum_id int, mz double, ion_type string, n int, loss_name string, is_crosslinked boolean, peptide_index int, is_primary boolean")
    got = sorted((r.match_id, r.mz, r.explanations) for r in sinks.deisotoped_list(charged, matched).collect())
    assert got == [(11, 100.0, "+y3_H2Ox1_p2;b2_p1"), (11, 200.0, ""), (12, 100.0, ""), (12, 200.0, "b4_p1")]
    sinks.write_deisotoped_list(charged, matched, str(tmp_path / "list"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "list")).count() == 4


def test_relaxed_precursors_and_readded_decoys(spark):
    spectra = spectra_of(spark, [(1, "r", 1, 1200.0, 4, PEAKS[0]), (2, "r", 2, 400.0, 2, PEAKS[1])])
    plain, more = (X.hypotheses(spectra, conf.parse(t)).groupBy("spectrum_id").count().collect() for t in ("", "relaxed_precursor_matching:true"))
    assert {r[0]: r[1] for r in plain} == {1: 1, 2: 1} and {r[0]: r[1] for r in more} == {1: 2, 2: 1}
    # The second protein is the first one's decoy, so its peptides oust the decoys, which come back permuted.
    one = list("MAEGVTTWGESKDLVYNR")
    two = spark.createDataFrame([(one,)], "r array<string>").select(C.reverse_digest_aware(F.col("r"), ["K", "R"])).first()[0]
    proteins = spark.createDataFrame([(1, "P", "P", one), (2, "Q", "Q", two)], "protein_id long, header string, accession string, residues array<string>")
    peptides = lambda text: X.peptide_table(proteins, conf.parse(CONFIG + text)).collect()
    without, with_ = peptides(""), peptides("readd_decoys:yes\n")
    assert sum(r.is_decoy for r in with_) > sum(r.is_decoy for r in without)
    assert not {r.seq for r in with_ if r.is_decoy} & {r.seq for r in with_ if not r.is_decoy}
