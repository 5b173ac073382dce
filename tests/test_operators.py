"""Hand-computed cases and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from peakweave.functions import masses as M
from peakweave.functions.tolerance import Tolerance
from peakweave.operators import decoys, digest, fragments, matching, range_join, ranking, spectra


def seqs(spark, *texts):
    return spark.createDataFrame([(i, list(t)) for i, t in enumerate(texts)], "id long, residues array<string>")


def test_peptide_mass(spark):
    assert seqs(spark, "GG").select(M.peptide_mass(F.col("residues"))).first()[0] == pytest.approx(2 * 57.021464 + 18.01056027, abs=1e-9)


def test_tolerance_takes_the_larger_value(spark):
    row = spark.range(1).select(Tolerance(6).compare(F.lit(1000.0), F.lit(1000.006)), Tolerance(5).compare(F.lit(1000.0), F.lit(1000.006)), Tolerance(0.1, "da").compare(F.lit(2.0), F.lit(1.0))).first()
    assert tuple(row) == (0, -1, 1)


def test_digest_with_methionine_loss(spark):
    got = digest.pieces(seqs(spark, "MAKR"), "residues", digest.Protease(after=("K", "R")), 0)
    assert sorted("".join(r.peptide) for r in got.collect()) == ["AK", "MAK", "R"]


def test_digest_constraint_and_pieces_join_up(spark):
    got = digest.pieces(seqs(spark, "AKPRGK"), "residues", digest.TRYPSIN, 0, methionine_loss=False).orderBy("start").collect()
    assert ["".join(r.peptide) for r in got] == ["AKPR", "GK"]
    assert got[-1].c_term and got[0].n_term


def test_missed_cleavages(spark):
    got = digest.pieces(seqs(spark, "AKCKDK"), "residues", digest.TRYPSIN, 1, methionine_loss=False)
    assert sorted("".join(r.peptide) for r in got.collect()) == ["AK", "AKCK", "CK", "CKDK", "DK"]


def test_b_and_y_ladders_sum_to_the_peptide(spark):
    peptides = seqs(spark, "PEPTIDEK")
    ions = {(r.ion_type, r.n): r.neutral_mass for r in fragments.ions(peptides, ["id"], "residues").collect()}
    total = peptides.select(M.peptide_mass(F.col("residues"))).first()[0]
    for n in range(1, 8):
        assert ions["b", n] + ions["y", 8 - n] == pytest.approx(total, abs=1e-6)


def test_ranks_and_deltas(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (1, 5.0, "b"), (1, 3.0, "c"), (2, 4.0, "a")], "s int, score double, base string")
    got = {(r.s, r.base): (r.match_rank, r.delta, r.delta_mod, r.combined_delta) for r in ranking.match_ranks(df, ["s"], "score", "base").collect()}
    assert [got[1, b][0] for b in "abc"] == [1, 1, 2]
    assert got[1, "a"][1:3] == (2.0, 0.0)
    assert got[2, "a"] == (1, 4.0, 4.0, 4.0)


def test_row_limit_keeps_whole_tie_groups(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 2, 3)], "s int, score double")
    assert sorted(r.score for r in ranking.top_scores(df, ["s"], "score", 3, most_rows=2, highest=False).collect()) == [1.0]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_binned_join_equals_nested_loop(spark, how):
    rng = random.Random(5)
    a = spark.createDataFrame([(i, rng.uniform(1, 2000)) for i in range(300)] + [(999, None)], "i long, x double")
    b = spark.createDataFrame([(i, rng.uniform(1, 2000)) for i in range(400)] + [(998, None)], "k long, y double")
    t = Tolerance(3000)
    got = range_join.tolerance_join(a, b, "x", "y", t, how)
    want = a.join(b, (F.col("y") >= t.lower(F.col("x"))) & (F.col("y") < t.upper(F.col("x"))), how)
    rows = lambda d: sorted(map(tuple, d.select(sorted(d.columns)).collect()), key=repr)
    assert rows(got) == rows(want)


def test_window_is_half_open(spark):
    a, b = spark.createDataFrame([(10.0,)], "x double"), spark.createDataFrame([(9.0,), (11.0,)], "y double")
    assert [r.y for r in range_join.tolerance_join(a, b, "x", "y", Tolerance(1.0, "da")).collect()] == [9.0]


def test_decoys_keep_length_and_composition(spark):
    df = seqs(spark, "MAKRCDEK", "ACDEFGM", "K")
    for make in (decoys.reverse, lambda r: decoys.reverse_digest_aware(r, ["K", "R"]), lambda r: decoys.shuffle(r, F.col("id"), ["K"])):
        for row in df.select("residues", make(F.col("residues")).alias("d")).collect():
            assert sorted(row.residues) == sorted(row.d)
    assert "".join(df.where("id = 1").select(decoys.reverse(F.col("residues"))).first()[0]) == "MGFEDCA"


def test_isotope_series(spark):
    step = M.C13_DIFF / 2
    peaks = spark.createDataFrame([(1, 500.0 + k * step, 100.0 / (k + 1)) for k in range(4)] + [(1, 700.3, 5.0)], "s int, mz double, intensity double")
    got = spectra.isotope_clusters(peaks, ["s"], 3, Tolerance(10)).collect()
    assert len(got) == 4 and {r.charge for r in got} == {2} and {r.cluster_id for r in got} == {0}
    merged = spectra.deisotoped(peaks, spectra.isotope_clusters(peaks, ["s"], 3, Tolerance(10)), ["s"]).orderBy("mz").collect()
    assert [round(r.mz, 1) for r in merged] == [500.0, 700.3]


def test_isotope_query_keeps_every_row_and_grows(spark, tmp_path):
    from peakweave.plans.queries import QUERIES

    rows = [(k + extra, price, 3.0) for extra in (0, 500, 1000) for k in (1, 2) for price in (1000.0, 1001.0, 1011.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["isotope_clusters"].run(spark, str(tmp_path)).where("charge = 2").collect()
    assert sorted({r.spectrum for r in got}) == [0, 16, 33]
    assert sorted((r.place, r.intensity) for r in got) == [(0, 12.0)] * 3 + [(1, 6.0)] * 3


def test_isotope_series_of_every_charge(spark):
    step = M.C13_DIFF / 2
    rows = [(1, 500.0 + k * step, 100.0) for k in range(5)]
    # in spectrum 2 the third peak is 9 times as intense as the second, which starts no series; the third one extends downwards
    rows += [(2, 500.0, 1.0), (2, 500.0 + M.C13_DIFF, 9.0), (2, 500.0 + 2 * M.C13_DIFF, 8.0)]
    peaks = spark.createDataFrame(rows, "s int, mz double, intensity double")
    clusters = spectra.isotope_clusters(peaks, ["s"], 2, Tolerance(10), every=True).cache()
    got = {}
    for r in clusters.orderBy("s", "cluster_id", "place").collect():
        got.setdefault((r.s, r.cluster_id, r.charge), []).append(r.peak)
    assert got == {(1, 0, 1): [0, 2, 4], (1, 1, 2): [0, 1, 2, 3, 4], (2, 0, 1): [1, 2], (2, 1, 1): [0, 1, 2]}
    merged = spectra.deisotoped(peaks, clusters, ["s"]).where("s = 1").collect()
    assert [(r.mz, r.charge, r.intensity) for r in merged] == [(500.0, 2, 500.0)]


def test_rolling_denoise_counts_series_once_and_refills(spark):
    one, half = M.C13_DIFF, M.C13_DIFF / 2
    rows = [(500.0, 50.0, False), (500.0 + one, 30.0, False), (500.0 + 2 * one, 10.0, False), (510.3, 60.0, False), (515.7, 20.0, False), (99.0, 500.0, False), (98.0, 7.0, True), (900.0, 500.0, False)]
    rows += [(700.0 + k * half, 10.0 - k, False) for k in range(4)] + [(705.2, 20.0, False), (706.4, 21.0, False)]
    peaks = spark.createDataFrame([(1, *r) for r in rows], "s int, mz double, intensity double, keep boolean")
    got = {round(r.mz, 4) for r in spectra.denoised(peaks, ["s"], 2, 100.0, 2, Tolerance(10), keep="keep", least_mz=100.0, most_mz=900.0).collect()}
    # of three series around 500 the two best stay, one of them with its isotopes; the series at 700 (summed 34) beats 705.2
    assert got == {round(x, 4) for x in (98.0, 500.0, 500.0 + one, 500.0 + 2 * one, 510.3, 706.4, *(700.0 + k * half for k in range(4)))}


def brute_denoise(clusters, peaks, n, window):
    """By dictionaries, with windows looked through peak by peak; clusters as lists of m/z."""
    series = {}
    for c in clusters:
        if len(c) > len(series.get(c[0], [])) or len(c) == len(series[c[0]]) and sum(peaks[m] for m in c) > sum(peaks[m] for m in series[c[0]]):
            series[c[0]] = c
    members = {m for c in clusters for m in c}
    level = {m: i for m, i in peaks.items() if m not in members} | {m: sum(peaks[p] for p in c) for m, c in series.items()}
    gone = set()
    for m in sorted(level, key=lambda m: (-level[m], m)):
        near = [k for k in level if k not in gone and m - window / 2 <= k < m + window / 2]
        if m not in gone:
            gone |= set(sorted(near, key=lambda k: (level[k], k))[: max(0, len(near) - n)])
    left = set(level) - gone
    return left | {m for c in clusters if left & set(c) for m in c}


def test_rolling_denoise_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(s, 400 + rng.randrange(400) * M.C13_DIFF / 6 + rng.choice([0, 0.31]), float(rng.randrange(1, 500))) for s in range(6) for _ in range(150)]
    rows = list({(s, m): (s, m, i) for s, m, i in rows}.values())
    peaks = spark.createDataFrame(rows, "s int, mz double, intensity double")
    clusters, want = {}, {}
    for r in spectra.isotope_clusters(peaks, ["s"], 3, Tolerance(10), every=True).orderBy("s", "cluster_id", "place").collect():
        clusters.setdefault(r.s, {}).setdefault(r.cluster_id, []).append(r.mz)
    for s in range(6):
        want[s] = brute_denoise(list(clusters[s].values()), {m: i for t, m, i in rows if t == s}, 4, 12.0)
    got = {s: set() for s in range(6)}
    for r in spectra.denoised(peaks, ["s"], 4, 12.0, 3, Tolerance(10)).collect():
        got[r.s].add(r.mz)
    assert got == want and any(len(w) < 150 for w in want.values())


def test_variable_modifications_prefer_few_changes(spark):
    df = seqs(spark, "MSM").withColumnRenamed("residues", "peptide")
    mods = [digest.Modification("Mox", "M", 15.99)]
    assert sorted("".join(r.peptide) for r in digest.variable(df, mods, 2, 2).collect()) == ["MSM", "MSMox", "MoxSM"]


def test_link_site_shares_sum_to_one(spark):
    pairs = spark.createDataFrame([(1, 0, 0), (1, 2, 0)], "m int, site_a int, site_b int")
    hits = spark.createDataFrame([(1, 0, 0, 1, 0, False, 0.4)], "m int, peptide_index int, first int, last int, loss_count int, is_crosslinked boolean, rel_intensity double")
    got = matching.link_site_weights(pairs, hits, "m", F.lit(0.0)).orderBy("site_a").collect()
    assert sum(r.share for r in got) == pytest.approx(1) and [r.is_best for r in got] == [False, True]


def test_mgf_and_fasta(spark, tmp_path):
    from peakweave.sources import peaklists, sinks, tables

    (tmp_path / "a.mgf").write_text("BEGIN IONS\nTITLE=run1.100.100.2\nPEPMASS=500.5 1e4\nCHARGE=2+\nRTINSECONDS=60.5\n100.1 5\n200.2 7.5\nEND IONS\n\nBEGIN IONS\nTITLE=run1.101.101.\nPEPMASS=600.5\nCHARGE=2+ and 3+\n150 1\nEND IONS\n")
    got = peaklists.read_spectra(spark, str(tmp_path / "a.mgf")).orderBy("scan").collect()
    assert [(r.run, r.scan, r.precursor_charge, r.precursor_mz, len(r.peaks)) for r in got] == [("run1", 100, 2, 500.5, 2), ("run1", 101, -1, 600.5, 1)]
    assert got[1].charge_alternatives == [2, 3]
    (tmp_path / "p.fasta").write_text(">sp|P1|ONE_X First protein OS=Y GN=abc\nMAK\nRC*\n>sp|P2|TWO_X\n\n>three\nGG\n")
    proteins = {r.accession: r for r in tables.read_fasta(spark, str(tmp_path / "p.fasta")).collect()}
    assert sorted(proteins) == ["P1", "three"] and "".join(proteins["P1"].residues) == "MAKRC" and proteins["P1"].gene == "abc"
    assert spark.range(1).select(sinks.number(F.lit(1.50))).first()[0] == "1.5"


TITLES = [
    ("RawFile: my run FinneganScanNumber: 123 _sil_", "my run", 123, None, -1),
    ("RawFile: raw_1 Index: 77 Precursor", "raw_1", 77, None, -1),
    ("12: Scan 4711 (rt=13.25) [D:\\data\\sub\\run_7.raw]", "run_7.raw", 4711, 13.25, -1),
    ("12: Sum of 3 scans in range 4711 (rt=13.25) [D:\\data\\run_7.raw]", "run_7.raw", 4711, 13.25, -1),
    ("some file.raw Spectrum9 scans: 815", "some file.raw", 815, None, -1),
    ("File:run_A Scans:99 RT:1.5min Charge:3+ Fragmentation:hcd", "run_A", 99, None, 3),
    ("my.run.100.101.2", "my.run", 100, None, 2),
    ("my.run.100.101. extra words", "my.run", 100, None, -1),
    ("spectrum scan=42_run_x", "run_x", 42, None, -1),
    ("plain12345 other", "plain12345", 12345, None, -1),
]


def test_title_forms(spark, tmp_path):
    from peakweave.sources import peaklists

    block = "BEGIN IONS\nTITLE={}\nPEPMASS=500.5 1e4\nRTINSECONDS={}\n100.1 5\nEND IONS\n"
    (tmp_path / "t.mgf").write_text("".join(block.format(t[0], "" if t[3] else "60.5-61.2") for t in TITLES))
    got = {r.scan_title: r for r in peaklists.read_mgf(spark, str(tmp_path / "t.mgf")).collect()}
    for title, run, scan, rt, charge in TITLES:
        r = got[title]
        assert (r.run, r.scan, r.precursor_charge, r.precursor_intensity) == (run, scan, charge, 10000.0), title
        assert (r.rt_start, r.rt_end) == ((rt, rt) if rt else (60.5, 61.2))


def test_readded_and_directed_decoys(spark):
    from peakweave.operators import decoys

    kept = spark.createDataFrame([(list("AGVK"),), (list("GAVK"),), (list("VGAK"),)], "peptide array<string>")
    gone = spark.createDataFrame([(list("GAVK"), 1), (list("TSLMK"), 2), (list("AK"), 3), (list("AAAK"), 4)], "peptide array<string>, n int")
    got = {r.n: "".join(r.peptide) for r in digest.readded_decoys(gone, kept).collect()}
    assert sorted(got) in ([1, 2, 4], [2, 4]) and all(p.endswith("K") for p in got.values()) and sorted(got[2]) == sorted("TSLMK")
    assert not set(got.values()) & {"AGVK", "GAVK", "VGAK"} and len(set(got.values())) == len(got)
    proteins = spark.createDataFrame([(i, f"p{i}", list("MAKGDEWWKLR")) for i in range(20)], "protein_id long, header string, residues array<string>")
    weight = lambda rs: sum(M.RESIDUES[r] for r in rs)
    near = {}
    for mode in ("random", "random_directed"):
        made = decoys.with_decoys(proteins, "residues", mode, ["K", "R"]).where("is_decoy").collect()
        assert all(r.header.startswith("RAN_") and [x for x in r.residues if x in "KR"] == ["K", "K", "R"] and r.residues[0] == "M" for r in made)
        near[mode] = sum(abs(weight(r.residues) - weight("MAKGDEWWKLR")) for r in made)
    assert near["random_directed"] < near["random"]


def test_registered_scores_run_in_order(spark):
    from peakweave.operators import scores

    matched = spark.createDataFrame([(1, "b", 1, 5, 50, 0, True, False, 0.1, 2, 3), (1, "b", 2, 6, 60, 1, False, False, 0.2, 1, 3)], "match_id long, ion_type string, n int, base_fragment long, fragment_id long, loss_count int, is_primary boolean, is_crosslinked boolean, error double, match_charge int, precursor_charge int")
    matches = spark.createDataFrame([(1, 5)], "match_id long, length int")
    got = scores.run_registered({"matched": matched, "matches": matches})
    assert list(got) == ["charge", "coverage", "error", "sequence_tag"] and got["coverage"].first().matched == 2 and got["charge"].first().max_charge == 2
    assert list(scores.run_registered({"matched": matched, "matches": matches}, ["error"])) == ["error"]


def test_sorted_by_several_keys(spark):
    from peakweave.sources import tables

    df = spark.createDataFrame([("b", "10"), ("a", "9"), ("a", "100"), ("a", None), ("b", "x")], "k string, v string")
    assert [tuple(r) for r in tables.sorted_by(df, ["k", "-#v"]).collect()] == [("a", "100"), ("a", "9"), ("a", None), ("b", "10"), ("b", "x")]


def test_range_joins_after_a_shuffle(spark):
    from peakweave.operators.range_join import window_join

    left = spark.createDataFrame([(float(i % 7), 1) for i in range(60)] + [(None, 1)], "x double, k int").repartition(5)
    right = spark.createDataFrame([(1.2,), (1.3,), (5.0,)], "y double")
    rows = lambda how: window_join(left, right, F.col("x"), F.col("x") + 0.5, F.col("y"), 0.25, how)
    n = sum(i % 7 in (1, 5) for i in range(60))
    twice = sum(i % 7 == 1 for i in range(60))
    assert (rows("left_semi").count(), rows("left_anti").count(), rows("left").count(), rows("inner").count()) == (n, 61 - n, 61 + twice, n + twice)
    wide = lambda how: window_join(left, right, F.col("x") - 500, F.col("x") + 500, F.col("y"), 0.25, how).count()
    assert (wide("left_semi"), wide("left_anti"), wide("left")) == (60, 1, 181)
    with pytest.raises(ValueError, match="unknown join"):
        rows("full")


def test_zip_members_of_every_format(spark, tmp_path):
    import gzip
    import io
    import zipfile

    from peakweave.sources import peaklists

    mgf = lambda scan: f"BEGIN IONS\nTITLE=run1.{scan}.{scan}.2\nPEPMASS=500.5 1.5e4\nCHARGE=2+\n100.1 5\nEND IONS\n"
    apl = "peaklist start\nmz=600.25\ncharge=3\nheader=RawFile: run2 Index: 7\n100.5\t10\n200.5\t20\npeaklist end\n"
    nested = io.BytesIO()
    with zipfile.ZipFile(nested, "w") as z:
        z.writestr("deep/e.msm", mgf(5))
        z.writestr("f.apl", apl.replace("Index: 7", "Index: 8"))
    with zipfile.ZipFile(tmp_path / "all of it.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.mgf", mgf(1) + mgf(2))
        z.writestr("b.txt", mgf(3))
        z.writestr("c.mgf.gz", gzip.compress(mgf(4).encode()))
        z.writestr("d.apl", apl)
        z.writestr("g.zip", nested.getvalue())
        z.writestr("__MACOSX/._a.mgf", b"\0junk")
        z.writestr("h.mzML", '<mzML><spectrum id="scan=9"><cvParam accession="MS:1000511" value="2"/><cvParam accession="MS:1000744" value="700.5"/></spectrum></mzML>')
    got = peaklists.read_spectra(spark, str(tmp_path / "all of it.zip")).collect()
    assert sorted(r.scan for r in got) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert {r.precursor_intensity for r in got if r.precursor_mz == 500.5} == {15000.0}
    assert {len(r.peaks) for r in got if r.precursor_charge == 3} == {2}
    import tarfile

    for suffix, mode in ((".tar", "w"), (".tar.gz", "w:gz"), (".tar.bz2", "w:bz2")):
        with tarfile.open(tmp_path / f"acc{suffix}", mode) as t:
            for name, data in (("x/a.mgf", mgf(1) + mgf(2)), ("d.apl", apl), ("z/c.mgf.gz", gzip.compress(mgf(4).encode())), ("in.zip", (tmp_path / "all of it.zip").read_bytes()), ("._a.mgf", b"\0")):
                data = data.encode() if isinstance(data, str) else data
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        tarred = peaklists.read_spectra(spark, str(tmp_path / f"acc{suffix}")).collect()
        assert sorted(r.scan for r in tarred) == sorted([1, 2, 4, 7, 1, 2, 3, 4, 5, 7, 8, 9])
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder/a.mgf").write_text(mgf(1))
    (tmp_path / "folder/b.apl").write_text(apl)
    (tmp_path / "folder/c.mgf").write_text(mgf(3))
    (tmp_path / "folder/_SUCCESS").write_text("")
    assert sorted(r.scan for r in peaklists.read_spectra(spark, f"{tmp_path}/folder/").collect()) == [1, 3, 7]
    (tmp_path / "these.list").write_text(f"# files\n{tmp_path}/folder/a.mgf\n{tmp_path}/acc.tar\n{tmp_path}/folder/c.mgf\n")
    assert sorted(r.scan for r in peaklists.read_spectra(spark, f"{tmp_path}/these.list").collect()) == sorted([1, 3, *[r.scan for r in tarred]])
    with zipfile.ZipFile(tmp_path / "raw.zip", "w") as z:
        z.writestr("a.raw", b"\0\1\2")
    with pytest.raises(Exception, match="not a peak list"):
        peaklists.read_spectra(spark, str(tmp_path / "raw.zip")).collect()


def test_guess_delimiter():
    from peakweave.sources.tables import guess_format

    assert guess_format(["a;b;c", "1;2;3"])[0] == ";"
    assert guess_format(["a\tb", "1\t2"])[0] == "\t"
