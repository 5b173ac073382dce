"""Registered queries of matching, scores and the steps of a search, beside those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tolerance import Tolerance
from ..operators import matching as K
from ..operators import scores as Q
from .queries import _PEAKS, _peaks, _t, query

# Matches. A match is an order; its peaks are lineitems, its fragments those of the neighbouring supplier keys.

_MATCHED = """m AS (SELECT l_orderkey AS match_id, l_linenumber AS peak_id, l_suppkey * 10 + l_linenumber AS fragment_id, l_suppkey % 4 AS base_fragment, l_partkey % 4 AS loss_count,
    l_returnflag = 'A' AS is_crosslinked, l_discount > 0.07 AS missing_mono, l_tax - 0.04 AS error, l_quantity / 50 AS rel_intensity, 1 + l_partkey % 3 AS match_charge, 4 AS precursor_charge FROM lineitem)"""


def _matched(spark, sf_dir):
    c = F.col
    return _t(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("match_id"), c("l_linenumber").alias("peak_id"), (c("l_suppkey") * 10 + c("l_linenumber")).alias("fragment_id"), (c("l_suppkey") % 4).alias("base_fragment"), (c("l_partkey") % 4).alias("loss_count"),
        (c("l_returnflag") == "A").alias("is_crosslinked"), (c("l_discount") > 0.07).alias("missing_mono"), (c("l_tax") - 0.04).alias("error"), (c("l_quantity") / 50).alias("rel_intensity"), (1 + c("l_partkey") % 3).alias("match_charge"), F.lit(4).alias("precursor_charge"),
    )


_PEAK_MATCHES = """k AS (SELECT l_orderkey AS match_id, l_linenumber AS peak_id, l_extendedprice / 20 AS mz, (l_extendedprice / 20 - 1.00727646677) AS neutral FROM lineitem),
    f AS (SELECT l_orderkey AS match_id, l_linenumber AS fragment_id, l_quantity * 50 AS neutral_mass, l_partkey % 3 AS loss_count FROM lineitem),
    d AS (SELECT match_id, k.peak_id, k.mz, f.fragment_id, f.loss_count, false AS mono FROM k JOIN f USING (match_id) WHERE neutral_mass >= neutral - 60 AND neutral_mass < neutral + 60),
    s AS (SELECT match_id, peak_id, min(loss_count) AS least FROM d GROUP BY 1, 2),
    r AS (SELECT k.match_id, k.peak_id, k.mz, f.fragment_id, f.loss_count, true AS mono FROM k LEFT JOIN s USING (match_id, peak_id) JOIN f ON f.match_id = k.match_id AND neutral_mass >= neutral - 1.0033548 - 60 AND neutral_mass < neutral - 1.0033548 + 60
        WHERE neutral > 1000 AND (least IS NULL OR (neutral > 2000 AND least > 0 AND f.loss_count = 0))),
    b AS (SELECT *, row_number() OVER (PARTITION BY match_id, fragment_id ORDER BY mono, mz) AS place FROM (SELECT * FROM d UNION ALL SELECT * FROM r))"""


@query(f"WITH {_PEAK_MATCHES} SELECT match_id, peak_id, fragment_id, mono AS missing_mono FROM b WHERE place = 1")
def matched_fragments(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    peaks = t.select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("peak_id"), (F.col("l_extendedprice") / 20).alias("mz"), F.lit(1.0).alias("intensity"), F.lit(1).alias("charge"))
    fragments = t.select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("fragment_id"), (F.col("l_quantity") * 50).alias("neutral_mass"), (F.col("l_partkey") % 3).alias("loss_count"))
    return K.match_fragments(peaks, fragments, "match_id", Tolerance(60.0, "da")).select("match_id", "peak_id", "fragment_id", "missing_mono")


_SUPPORT = "(CASE WHEN loss_count = 0 THEN CASE WHEN is_crosslinked THEN 9.0::DOUBLE ELSE 10.0::DOUBLE END ELSE 1.0::DOUBLE / loss_count END) / CASE WHEN missing_mono THEN 10 ELSE 1 END"


@query(f"""WITH {_MATCHED}, p AS (SELECT *, peak_id % 3 AS place FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY match_id, place ORDER BY {_SUPPORT} DESC, abs(error), fragment_id) = 1 AS is_primary FROM p)
    SELECT match_id, peak_id, is_primary FROM r""")
def primary_explanations(spark, sf_dir):
    held = _matched(spark, sf_dir).withColumn("line", F.col("peak_id")).withColumn("peak_id", F.col("peak_id") % 3)
    return K.primary_explanations(held, "match_id").select("match_id", F.col("line").alias("peak_id"), "is_primary")


@query(f"""WITH {_MATCHED}, p AS (SELECT *, peak_id % 3 AS place, max((loss_count = 0)::INT) OVER (PARTITION BY match_id, base_fragment) AS intact FROM m),
    c AS (SELECT *, max((NOT missing_mono)::INT) OVER (PARTITION BY match_id, place) AS whole FROM p WHERE loss_count <= 2 OR intact = 1) SELECT match_id, peak_id FROM c WHERE NOT missing_mono OR whole = 0""")
def cleaned_matches(spark, sf_dir):
    held = _matched(spark, sf_dir).withColumn("line", F.col("peak_id")).withColumn("peak_id", F.col("peak_id") % 3)
    return K.clean_matches(held, "match_id").select("match_id", F.col("line").alias("peak_id"))


@query("""WITH c AS (SELECT l_orderkey AS spectrum, l_partkey % 3 AS id, l_quantity::BIGINT % 4 AS peak FROM lineitem), d AS (SELECT DISTINCT * FROM c), z AS (SELECT spectrum, id, count(*) AS n FROM d GROUP BY 1, 2),
    s AS (SELECT a.spectrum, a.id, b.id AS other, count(*) AS n FROM d a JOIN d b ON a.spectrum = b.spectrum AND a.peak = b.peak AND a.id <> b.id GROUP BY 1, 2, 3),
    gone AS (SELECT DISTINCT s.spectrum, s.id FROM s JOIN z x ON x.spectrum = s.spectrum AND x.id = s.id JOIN z y ON y.spectrum = s.spectrum AND y.id = s.other WHERE s.n = x.n AND (x.n < y.n OR (x.n = y.n AND s.id > s.other)))
    SELECT spectrum, id AS cluster_id, peak FROM c ANTI JOIN gone USING (spectrum, id)""")
def without_redundant_clusters(spark, sf_dir):
    c = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spectrum"), (F.col("l_partkey") % 3).alias("cluster_id"), (F.col("l_quantity").cast("long") % 4).alias("peak"))
    return K.redundant_clusters(c, ["spectrum"]).select("spectrum", "cluster_id", "peak")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > l_discount * 500 THEN l_partkey ELSE l_suppkey END AS second, CASE WHEN l_quantity > l_discount * 500 THEN l_suppkey ELSE l_partkey END AS first FROM lineitem")
def peptides_in_order(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("first"), F.col("l_suppkey").alias("second"), (F.col("l_discount") * 500).alias("na"), F.col("l_quantity").alias("nb"))
    return K.in_order(t, "na", "nb", [("first", "second")]).select("l_orderkey", "l_linenumber", "first", "second")


@query("""SELECT l_orderkey, l_linenumber, (l_partkey % 3 = l_suppkey % 3 AND (l_linenumber + 2 = l_quantity::BIGINT % 8 OR l_quantity::BIGINT % 8 + 3 = l_linenumber)) AS might_be_linear, l_partkey % 3 = l_suppkey % 3 AS is_internal,
    least(l_returnflag || ':1', l_linestatus_ || ':2') || '|' || greatest(l_returnflag || ':1', l_linestatus_ || ':2') AS key FROM (SELECT *, (['A', 'N', 'Z'])[1 + l_partkey % 3] AS l_linestatus_ FROM lineitem)""")
def pair_relations(spark, sf_dir):
    c = F.col
    t = _t(spark, sf_dir, "lineitem")
    spot = lambda protein, start: F.array(F.struct(protein.alias("protein_id"), start.cast("long").alias("start")))
    a, b = spot(c("l_partkey") % 3, c("l_linenumber")), spot(c("l_suppkey") % 3, c("l_quantity").cast("long") % 8)
    other = F.get(F.array(F.lit("A"), F.lit("N"), F.lit("Z")), (c("l_partkey") % 3).cast("int"))
    return t.select("l_orderkey", "l_linenumber", K.might_be_linear(a, F.lit(2), b, F.lit(3)).alias("might_be_linear"), K.is_internal(F.array(c("l_partkey") % 3), F.array(c("l_suppkey") % 3)).alias("is_internal"), K.canonical_key(c("l_returnflag"), other, F.lit("1"), F.lit("2")).alias("key"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' OR l_linenumber % 2 = 1 AS is_decoy FROM lineitem")
def decoy_matches(spark, sf_dir):
    flag = F.when(F.col("l_linenumber") % 2 == 1, True)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", K.is_decoy(F.col("l_returnflag") == "R", flag).alias("is_decoy"))


@query(f"""WITH {_MATCHED} SELECT match_id, round(sum(CASE WHEN is_crosslinked THEN rel_intensity ELSE 0 END), 9) AS crosslinked_intensity, round(sum(CASE WHEN NOT is_crosslinked THEN rel_intensity ELSE 0 END), 9) AS linear_intensity FROM m WHERE error < 0.02 GROUP BY 1""")
def crosslink_support(spark, sf_dir):
    out = K.supports_crosslink(_matched(spark, sf_dir).withColumn("is_primary", F.col("error") < 0.02), "match_id")
    return out.select("match_id", *[F.round(c, 9).alias(c) for c in ("crosslinked_intensity", "linear_intensity")])


@query("""WITH r AS (SELECT l_orderkey AS match_id, l_quantity AS weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS k FROM lineitem)
    SELECT match_id, coalesce(max(CASE WHEN k = 2 THEN weight END) - max(CASE WHEN k = 1 THEN weight END), 0) AS link_site_delta FROM r GROUP BY 1""")
def link_site_delta(spark, sf_dir):
    return K.link_site_delta(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_quantity").alias("weight")), "match_id")


@query("""WITH c AS (SELECT l_orderkey AS match_id, l_linenumber AS site_a, l_suppkey % 5 AS site_b, l_quantity AS hits, l_discount AS intensity, l_returnflag = 'A' AS preferred FROM lineitem)
    SELECT match_id, site_a, site_b, row_number() OVER (PARTITION BY match_id ORDER BY hits DESC, intensity DESC, preferred DESC, site_a DESC, site_b DESC) = 1 AS is_best FROM c""")
def unweighted_link_sites(spark, sf_dir):
    c = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("site_a"), (F.col("l_suppkey") % 5).alias("site_b"), F.col("l_quantity").alias("hits"), F.col("l_discount").alias("intensity"), (F.col("l_returnflag") == "A").alias("preferred"))
    return K.best_sites_by_count(c, "match_id").select("match_id", "site_a", "site_b", "is_best")


@query(f"""WITH {_MATCHED}, k AS (SELECT *, CASE WHEN loss_count = 0 AND NOT missing_mono THEN 4 WHEN loss_count = 0 THEN 3 WHEN NOT missing_mono THEN 2 ELSE 1 END AS class FROM m)
    SELECT match_id, peak_id, row_number() OVER (PARTITION BY match_id, peak_id % 3 ORDER BY class DESC, abs(error), fragment_id) = 1 AS is_primary FROM k""")
def primary_by_class(spark, sf_dir):
    held = _matched(spark, sf_dir).withColumn("line", F.col("peak_id")).withColumn("peak_id", F.col("peak_id") % 3)
    return K.primary_by_class(held, "match_id").select("match_id", F.col("line").alias("peak_id"), "is_primary")


# Scores


@query(f"""WITH {_PEAKS}, j AS (SELECT l_orderkey, mz, intensity, o_totalprice / 3 AS pre FROM p JOIN orders ON o_orderkey = l_orderkey)
    SELECT l_orderkey, coalesce(max(CASE WHEN mz >= pre - pre * 0.000001 * 50000 AND mz < pre + pre * 0.000001 * 50000 THEN intensity END), 0) AS precursor_absolute FROM j GROUP BY 1""")
def precursor_found(spark, sf_dir):
    spectra = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 3).alias("pre"))
    return Q.precursor_found(_peaks(spark, sf_dir), spectra, "l_orderkey", "pre", Tolerance(50000.0)).select("l_orderkey", "precursor_absolute")


@query(f"WITH {_MATCHED} SELECT match_id, max(match_charge) AS max_charge, round(avg(match_charge), 9) AS mean_charge, median(match_charge)::DOUBLE AS median_charge, max(match_charge) / 4.0::DOUBLE AS relative_max_charge FROM m GROUP BY 1")
def fragment_charges(spark, sf_dir):
    return Q.fragment_charge(_matched(spark, sf_dir)).select("match_id", "max_charge", F.round("mean_charge", 9).alias("mean_charge"), "median_charge", "relative_max_charge")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN l_quantity * 2 / 2 ELSE (l_quantity * 2 + 1 / l_discount * 3) / 5 END, 6) AS score FROM lineitem""")
def combined_scores(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").withColumn("inverse", F.when(F.col("l_discount") == 0, float("inf")).otherwise(1 / F.col("l_discount"))).withColumn("nan", F.lit(float("nan")))
    return t.select("l_orderkey", "l_linenumber", F.round(Q.combined({"l_quantity": 2.0, "inverse": 3.0, "nan": 7.0}), 6).alias("score"))


@query(f"""WITH {_MATCHED}, e AS (SELECT match_id, avg(error) AS a, avg(abs(error)) AS b, avg(error * error) AS c FROM m WHERE rel_intensity > 0.6 GROUP BY 1)
    SELECT o_orderkey AS match_id, round(coalesce(a, 9999999), 9) AS mean_error, round(sqrt(coalesce(c, 9999999)), 9) AS root_mean_square_error, round(1 - least(coalesce(b, 9999999) / 0.05, 2), 9) AS one_minus_relative_error FROM orders LEFT JOIN e ON match_id = o_orderkey""")
def match_errors(spark, sf_dir):
    held = _matched(spark, sf_dir).withColumn("is_primary", F.col("rel_intensity") > 0.6)
    out = Q.errors(held, _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id")), limit=0.05)
    return out.select("match_id", *[F.round(c, 9).alias(c) for c in ("mean_error", "root_mean_square_error", "one_minus_relative_error")])


@query("SELECT l_orderkey, l_linenumber, round(d - round(d / 1.0033548) * 1.0033548, 6) AS error FROM (SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity * 1000 AS d FROM lineitem)")
def isotope_free_errors(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(Q.isotope_free_error(F.col("l_extendedprice"), F.col("l_quantity") * 1000), 6).alias("error"))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - x) / x / 0.000001, 7) AS precursor_error, round(1 - abs((l_extendedprice - x) / x / 0.000001) / 40000, 9) AS one_minus_precursor_error FROM (SELECT *, l_quantity * 1000 AS x FROM lineitem)")
def precursor_errors(spark, sf_dir):
    e = Q.precursor_errors(F.col("l_extendedprice"), F.col("l_quantity") * 1000, Tolerance(40000.0))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(e["precursor_error"], 7).alias("precursor_error"), F.round(e["one_minus_precursor_error"], 9).alias("one_minus_precursor_error"))


@query(f"""WITH {_MATCHED}, i AS (SELECT *, max((loss_count = 0)::INT) OVER (PARTITION BY match_id, base_fragment) AS intact FROM m)
    SELECT match_id, round(avg((loss_count > 0)::INT), 9) AS loss_share, round(sum(CASE WHEN loss_count > 0 AND intact = 1 THEN 1 ELSE 0 END) / nullif(sum((loss_count > 0)::INT), 0), 9) AS supported_losses FROM i GROUP BY 1""")
def loss_coverage(spark, sf_dir):
    out = Q.loss_coverage(_matched(spark, sf_dir))
    return out.select("match_id", *[F.round(c, 9).alias(c) for c in ("loss_share", "supported_losses")])


_PARAMETERS = "SELECT * FROM VALUES ('l_quantity', 25.0D, 14.0D, 1, 2.0D), ('l_discount', 0.05D, 0.03D, -1, 1.0D) AS x(score_name, average, stdev, direction, weight)"


@query("SELECT l_orderkey * 10 + l_linenumber AS match_id, round(avg((l_quantity - 25) / 14 * 2 - (l_discount - 0.05) / 0.03) / 2, 6) AS match_score FROM lineitem GROUP BY 1")
def mean_z_scores(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumn("match_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return Q.mean_z_score(Q.to_long(rows, "match_id", ["l_quantity", "l_discount"]), spark.sql(_PARAMETERS)).withColumn("match_score", F.round("match_score", 6))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * CASE WHEN l_returnflag = 'A' THEN 0.8 ELSE 1 END * CASE WHEN l_linenumber = 1 THEN 1.1 ELSE 1 END, 6) AS score FROM lineitem")
def boosted_scores(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(Q.boosted(F.col("l_quantity"), F.col("l_returnflag") == "A", F.col("l_linenumber") == 1, 0.8, 1.1), 6).alias("score"))


@query("""WITH t AS (SELECT *, l_quantity <= 25 AS a, CASE WHEN l_discount <= 0.05 THEN l_tax <= 0.03 ELSE l_quantity <= 40 END AS b, l_tax <= 0.06 AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, ((NOT a)::INT + (NOT b)::INT + (NOT c)::INT <= 1)::INT AS valid FROM t""")
def validation_votes(spark, sf_dir):
    leaf = lambda score, most: {"score": score, "at_most": most, "yes": True, "no": False}
    trees = [leaf("l_quantity", 25.0), {"score": "l_discount", "at_most": 0.05, "yes": leaf("l_tax", 0.03), "no": leaf("l_quantity", 40.0)}, leaf("l_tax", 0.06)]
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Q.votes([Q.decision_tree(t) for t in trees], 1).alias("valid"))


@query("""WITH t AS (SELECT * FROM (VALUES ('A', 0.5::DOUBLE), ('N', 0.25::DOUBLE)) AS x(l_returnflag, probability)) SELECT l_orderkey AS match_id, round(sum(-ln(probability)), 9) AS table_score FROM lineitem JOIN t USING (l_returnflag) GROUP BY 1""")
def table_probabilities(spark, sf_dir):
    table = spark.sql("SELECT * FROM VALUES ('A', 0.5D), ('N', 0.25D) AS x(l_returnflag, probability)")
    rows = _t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "match_id")
    return Q.table_probability(rows, table, ["l_returnflag"]).withColumn("table_score", F.round("table_score", 9))


@query(f"""WITH {_PEAKS}, n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(mz - 30000)) AS k FROM p WHERE mz >= 25000 AND mz < 35000)
    SELECT l_orderkey, coalesce(max(n.intensity), 0) AS mz_30000 FROM (SELECT DISTINCT l_orderkey FROM p) LEFT JOIN (SELECT * FROM n WHERE k = 1) n USING (l_orderkey) GROUP BY 1""")
def reporter_intensities(spark, sf_dir):
    return Q.peak_intensities(_peaks(spark, sf_dir), "l_orderkey", [30000.0], Tolerance(5000.0, "da"))
