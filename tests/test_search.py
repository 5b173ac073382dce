"""The search on planted pairs, and its candidate scores against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from peakweave.functions import masses as M
from peakweave.functions.tolerance import Tolerance
from peakweave.operators import candidates as P
from peakweave.operators.crosslinkers import Crosslinker, Side
from peakweave.plans import config as conf
from peakweave.plans import search as X
from peakweave.sources.tables import stored

LINK = 150.25
CONFIG = f"""
tolerance:precursor:8ppm
tolerance:fragment:15ppm
crosslinker:SymetricSingleAminoAcidRestrictedCrossLinker:Name:demo;MASS:{LINK};LINKEDAMINOACIDS:K(0),S(0.3)
digestion:PostAAConstrainedDigestion:DIGESTEDAMINOACIDS:K,R;ConstrainingAminoAcids:P
missedcleavages:1
TOPMGCHITS:8
TOPMGXHITS:6
"""
PROTEINS = {"A": "MAGTKVLEFDRSWWGHKNLDYEVRTTPLK", "B": "GDLKHEFVYRIINTKAWSLDERCVHGK", "C": "PPGAVLKEEDTYRMMNQFWKLLSTGHR", "D": "AAVEFGHLKPWDNRTYSSEEKVILQMR"}


def mass(seq):
    return sum(M.RESIDUES[r] for r in seq) + M.WATER


def ladder(seq):
    b = [sum(M.RESIDUES[r] for r in seq[:n]) for n in range(1, len(seq))]
    y = [sum(M.RESIDUES[r] for r in seq[-n:]) + M.WATER for n in range(1, len(seq))]
    return [("b", n, 0, n - 1, m) for n, m in enumerate(b, 1)] + [("y", n, len(seq) - n, len(seq) - 1, m) for n, m in enumerate(y, 1)]


def spectrum(a, b, at_a, at_b, rng):
    peaks = []
    for seq, other, at in ((a, b, at_a), (b, a, at_b)):
        for _, _, first, last, m in ladder(seq):
            if rng.random() < 0.85:
                whole = m + mass(other) + LINK if first <= at <= last else m
                peaks.append((whole + M.PROTON, rng.uniform(20, 100)))
    return sorted(peaks + [(rng.uniform(150, 1200), rng.uniform(1, 5)) for _ in range(12)])


PLANTED = [("SWWGHKNLDYEVR", "IINTKAWSLDER", 5, 4), ("MMNQFWKLLSTGHR", "AAVEFGHLKPWDNR", 6, 8)]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(7)
    rows = []
    for i, (a, b, x, y) in enumerate(PLANTED):
        precursor = (mass(a) + mass(b) + LINK) / 4 + M.PROTON
        rows.append((i, "run", i, f"run.{i}.{i}.4", "f", 1.0, 1.0, precursor, 5.0, 4, [], [], spectrum(a, b, x, y, rng)))
    rows.append((9, "run", 9, "run.9.9.2", "f", 1.0, 1.0, mass("TYSSEEKVILQMR") / 2 + M.PROTON, 5.0, 2, [], [], sorted((m + M.PROTON, 50.0) for *_, m in ladder("TYSSEEKVILQMR"))))
    schema = "spectrum_id long, run string, scan int, scan_title string, peak_file string, rt_start double, rt_end double, precursor_mz double, precursor_intensity double, precursor_charge int, charge_alternatives array<int>, additional_mz array<double>, peaks array<struct<mz:double,intensity:double>>"
    spectra = spark.createDataFrame(rows, schema)
    proteins = spark.createDataFrame([(k, n, n, list(s)) for k, (n, s) in enumerate(PROTEINS.items())], "protein_id long, header string, accession string, residues array<string>")
    return spectra, X.search(spectra, proteins, conf.parse(CONFIG))


def test_planted_pairs_win(found):
    spectra, results = found
    top = {r.spectrum_id: r for r in results.matches.where("match_rank = 1").collect()}
    for i, (a, b, *_) in enumerate(PLANTED):
        assert {top[i].peptide1, top[i].peptide2} == {a, b} and not top[i].is_decoy and top[i].linker == "demo"
    assert top[9].peptide1 == "TYSSEEKVILQMR" and top[9].peptide2 is None
    table = X.match_table(results, spectra)
    assert table.columns[:3] == ["Run", "Scan", "ScanTitle"] and {"Peptide1", "Peptide2", "Crosslinker", "MatchRank"} <= set(table.columns)
    row = table.where("Scan = 0 and MatchRank = 1").first()
    assert abs(row.CalcMass - row.PrecursorMass) < 0.05 and row.PrecoursorCharge == 4 and row.Protein1 in "ABCD"


def test_internal_search_keeps_pairs_of_one_protein(spark):
    peptides = spark.createDataFrame([(1, ["A"]), (2, ["B", "REV_A"]), (3, ["C"])], "peptide_id long, p array<string>").select("peptide_id", F.transform("p", lambda p: F.struct(p.alias("protein"))).alias("positions"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "alpha_id long, beta_id long")
    assert [(r.alpha_id, r.beta_id) for r in P.internal_pairs(pairs, peptides).collect()] == [(1, 2)]
    assert {r.peptide_id for r in P.same_protein(peptides).collect()} == {1, 3}


def close(x, low, high):
    return low <= x < high


def test_scores_against_plain_python(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("AGVLKSTE") for _ in range(rng.randint(4, 7))) for _ in range(40)]
    seqs = sorted(set(seqs))
    linker = Crosslinker("demo", LINK, Side({"K": 0.0, "S": 0.3}))
    ids = {k: s for k, s in enumerate(seqs)}
    peptides = spark.createDataFrame([(k, s, s, list(s), mass(s), True, True) for k, s in ids.items()], "peptide_id long, seq string, base_seq string, peptide array<string>, mass double, n_term boolean, c_term boolean")
    index = P.fragment_index(peptides)
    entries = [(k, t, n, m + M.PROTON) for k, s in ids.items() for t, n, _, _, m in ladder(s)]
    tol, wide = Tolerance(30.0), Tolerance(300.0, "da")
    spectra = []
    for h in range(4):
        a, b = rng.sample(seqs, 2)
        spectra.append((h // 2, h, mass(a) + mass(b) + LINK, sorted({round(m + M.PROTON, 5) for *_, m in ladder(a) + ladder(b)})))
    hyp = ["spectrum_id", "hyp"]
    peaks = spark.createDataFrame([(s, h, p, x, 1.0) for s, h, p, xs in spectra for x in xs], "spectrum_id long, hyp long, precursor double, mz double, intensity double")
    got = {(r.hyp, r.peptide_id): r.score for r in P.alphas(peaks, index, hyp, "precursor", len(entries), tol, tol).collect()}
    want = {}
    near = lambda x: [e for e in entries if close(e[3], x - x * 30e-6, x + x * 30e-6)]
    for _, h, p, xs in spectra:
        for x in xs:
            hit = [e for e in near(x) if mass(ids[e[0]]) <= p + p * 30e-6]
            for e in hit:
                want[h, e[0]] = want.get((h, e[0]), 0.0) - math.log(len(hit) / len(entries))
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
    peaks, index, peptides = stored(peaks, "peaks"), stored(index, "index"), stored(peptides, "peptides")
    alphas = stored(P.ranked_alphas(P.alphas(peaks, index, hyp, "precursor", len(entries), tol, tol), peptides, hyp, 5), "alphas")
    for r in alphas.collect():
        scores = sorted({v for (h, _), v in want.items() if h == r.hyp}, reverse=True)
        assert min(abs(r.score - v) for v in scores[: 5 * 10]) < 1e-9 and r.alpha_rank <= 5
    precursors = {h: p for _, h, p, _ in spectra}
    held = alphas.join(peaks.select(*hyp, "precursor").distinct(), hyp)
    pairs = P.crosslinked_pairs(held.select(*hyp, "precursor", "peptide_id", "alpha_rank"), peptides, [linker], hyp, "precursor", Tolerance(0.5, "da"))
    pairs = stored(pairs, "pairs")
    can = lambda s: any(r in "KS" for r in s)
    chosen = {(r.hyp, r.peptide_id): r.alpha_rank for r in alphas.collect()}
    expected = set()
    for (h, a), rank in chosen.items():
        for b in ids:
            gap = precursors[h] - mass(ids[a]) - LINK
            if gap > 57 and close(mass(ids[b]), gap - 0.5, gap + 0.5) and can(ids[a]) and can(ids[b]) and abs(mass(ids[a]) - precursors[h]) > 0.5:
                other = chosen.get((h, b))
                back = precursors[h] - mass(ids[b]) - LINK
                if other is None or (rank, a) <= (other, b) or not close(mass(ids[a]), back - 0.5, back + 0.5):
                    expected.add((h, a, b))
    rows = pairs.collect()
    assert {(r.hyp, r.alpha_id, r.beta_id) for r in rows} == expected and len(rows) == len(expected) > 3
    scored = P.pair_scores(pairs, peaks, index, hyp, len(entries), tol).collect()
    for r in scored:
        a, b = ids[r.alpha_id], ids[r.beta_id]
        xs = next(x for _, h, _, x in spectra if h == r.hyp)
        made = [(0, 0, t, n, m + M.PROTON, None) for t, n, _, _, m in ladder(a)] + [(2, 2, t, n, m + M.PROTON, None) for t, n, _, _, m in ladder(b)]
        for side, seq, other in ((0, a, b), (2, b, a)):
            made += [(1, side, t, n, m + M.PROTON + mass(other) + LINK, mass(seq) - m + 2 * M.PROTON) for t, n, _, _, m in ladder(seq)]
        used, score = set(), 0.0
        for order, _, _, _, mz, at in sorted(made, key=lambda f: f[:4]):
            hits = sorted((abs(x - mz), x) for x in xs if close(x, mz - mz * 30e-6, mz + mz * 30e-6))
            if hits and hits[0][1] not in used:
                used.add(hits[0][1])
                score -= math.log(len(near(at or hits[0][1])) / len(entries)) * (2 if order == 1 else 1)
        assert math.isclose(r.pre_score, score, rel_tol=1e-9, abs_tol=1e-9) and r.pre_peaks == len(used)
    assert P.targeted_modifications(held.join(peptides.select("peptide_id", "mass"), "peptide_id"), [10.0, 600.0], hyp, "precursor", wide).count() >= 1
