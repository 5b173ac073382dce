"""Registered queries: each operator on the driver's tables, with the SQL that returns the same rows.

Stand-ins: lineitem rows are peaks (order = spectrum, extended price = m/z, quantity = intensity),
orders are indexed masses (total price) of an entry (customer), parts give residue strings.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masses as M
from ..functions.tolerance import Tolerance
from ..operators import aggregates as A
from ..operators import crosslinkers as X
from ..operators import decoys as C
from ..operators import digest as D
from ..operators import filters as L
from ..operators import fragments as I
from ..operators import matching as K
from ..operators import range_join as J
from ..operators import ranking as R
from ..operators import scores as Q
from ..operators import spectra as S


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROWS = 400_000  #: of a table that is dealt by a key, in one task


def _dealt(spark: SparkSession, sf_dir: str, name: str, key: str | Column, *columns: str | Column) -> DataFrame:
    """Columns of a table, dealt by its key to tasks of about _ROWS rows, which the files' footers count.

    What a task groups or sorts by that key then doesn't grow with the table, and it needs no other shuffle. A table that gives
    every core no more than that is left as it is.
    """
    rows = _t(spark, sf_dir, name)
    tasks = -(-rows.count() // _ROWS)
    rows = rows.select(key, *columns)
    return rows.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), rows.columns[0]) if tasks > spark.sparkContext.defaultParallelism else rows


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))


def _masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("mass"))


_PEAKS = "p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS mz, l_quantity AS intensity FROM lineitem)"
_MASSES = "m AS (SELECT o_orderkey, o_custkey, o_totalprice AS mass FROM orders)"


def _window(ppm: float) -> str:
    return f"m.mass >= p.mz - p.mz * 0.000001 * {ppm} AND m.mass < p.mz + p.mz * 0.000001 * {ppm}"


# Joins


@query(f"WITH {_PEAKS}, {_MASSES} SELECT l_orderkey, l_linenumber, o_orderkey FROM p JOIN m ON {_window(20.0)}")
def range_join_ppm(spark, sf_dir):
    return J.tolerance_join(_peaks(spark, sf_dir), _masses(spark, sf_dir), "mz", "mass", Tolerance(20.0), repeat="points", lists=1).select("l_orderkey", "l_linenumber", "o_orderkey")


@query(f"WITH {_PEAKS}, {_MASSES} SELECT l_orderkey, l_linenumber, o_orderkey FROM p JOIN m ON m.mass >= p.mz - 0.4 AND m.mass < p.mz + 0.4")
def range_join_da(spark, sf_dir):
    return J.tolerance_join(_peaks(spark, sf_dir), _masses(spark, sf_dir), "mz", "mass", Tolerance(0.4, "da"), repeat="points").select("l_orderkey", "l_linenumber", "o_orderkey")


@query(f"WITH {_PEAKS}, {_MASSES} SELECT l_orderkey, l_linenumber FROM p WHERE EXISTS (SELECT 1 FROM m WHERE {_window(20.0)})")
def range_semi_join(spark, sf_dir):
    return J.tolerance_join(_peaks(spark, sf_dir), _masses(spark, sf_dir), "mz", "mass", Tolerance(20.0), "left_semi", repeat="points").select("l_orderkey", "l_linenumber")


@query(f"WITH {_PEAKS}, {_MASSES} SELECT l_orderkey, l_linenumber FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE {_window(20.0)})")
def range_anti_join(spark, sf_dir):
    return J.tolerance_join(_peaks(spark, sf_dir), _masses(spark, sf_dir), "mz", "mass", Tolerance(20.0), "left_anti", repeat="points").select("l_orderkey", "l_linenumber")


@query(f"WITH {_PEAKS}, {_MASSES} SELECT l_orderkey, l_linenumber, o_orderkey FROM p LEFT JOIN m ON {_window(20.0)}")
def range_left_join(spark, sf_dir):
    return J.tolerance_join(_peaks(spark, sf_dir), _masses(spark, sf_dir), "mz", "mass", Tolerance(20.0), "left", repeat="points").select("l_orderkey", "l_linenumber", "o_orderkey")


@query(f"""WITH {_PEAKS}, {_MASSES}, k AS (SELECT *, row_number() OVER () AS row FROM p), c AS (SELECT l_orderkey, l_linenumber, mass, row_number() OVER (PARTITION BY row ORDER BY abs(mass - mz), mass) AS r FROM k AS p JOIN m ON {_window(100.0)})
    SELECT l_orderkey, l_linenumber, mass FROM c WHERE r = 1""")
def nearest_within_tolerance(spark, sf_dir):
    return J.nearest_join(_peaks(spark, sf_dir), _masses(spark, sf_dir), "mz", "mass", ["l_orderkey", "l_linenumber"], Tolerance(100.0), ["mass"]).select("l_orderkey", "l_linenumber", "mass")


@query(f"""WITH {_PEAKS}, {_MASSES}, k AS (SELECT *, row_number() OVER () AS row FROM p), c AS (SELECT l_orderkey, l_linenumber, mass - mz AS distance, row_number() OVER (PARTITION BY row ORDER BY abs(mass - mz), mass) AS r FROM k AS p JOIN m ON {_window(100.0)})
    SELECT l_orderkey, l_linenumber, round(distance, 4) AS distance FROM c WHERE r = 1""")
def distance_lookup(spark, sf_dir):
    return J.distance_lookup(_peaks(spark, sf_dir), _masses(spark, sf_dir), "mz", "mass", ["l_orderkey", "l_linenumber"], Tolerance(50.0)).select("l_orderkey", "l_linenumber", F.round("distance", 4).alias("distance"))


@query(f"WITH {_PEAKS}, {_MASSES}, r AS (SELECT *, row_number() OVER () AS k FROM p), c AS (SELECT k, count(*) AS n FROM r AS p JOIN m ON {_window(50.0)} GROUP BY k) SELECT l_orderkey, l_linenumber, coalesce(n, 0) AS n FROM r LEFT JOIN c USING (k)")
def count_in_window(spark, sf_dir):
    return J.count_in_window(_peaks(spark, sf_dir), _masses(spark, sf_dir), "mz", "mass", ["l_orderkey", "l_linenumber"], Tolerance(50.0))


@query(f"""WITH {_PEAKS}, {_MASSES}, pairs AS (SELECT l_orderkey, l_linenumber, mass FROM p JOIN m ON {_window(100.0)}),
    many AS (SELECT l_orderkey, l_linenumber FROM pairs GROUP BY 1, 2 HAVING count(DISTINCT mass) > 2)
    SELECT l_orderkey, l_linenumber, mass FROM pairs ANTI JOIN many USING (l_orderkey, l_linenumber)""")
def limited_candidates(spark, sf_dir):
    return J.limited_candidates(_peaks(spark, sf_dir), _masses(spark, sf_dir), "mz", "mass", ["l_orderkey", "l_linenumber"], Tolerance(100.0), 2).select("l_orderkey", "l_linenumber", "mass")


@query("""WITH l AS (SELECT * FROM (VALUES ('a', 138.068), ('b', 0.0)) AS x(linker, linker_mass)),
    a AS (SELECT s_suppkey, s_acctbal AS alpha, 12000.0 AS total FROM supplier WHERE s_acctbal > 0), b AS (SELECT c_custkey, c_acctbal AS beta FROM customer)
    SELECT s_suppkey, c_custkey, linker FROM a CROSS JOIN l JOIN b ON beta >= total - alpha - linker_mass - total * 0.000001 * 3000 AND beta < total - alpha - linker_mass + total * 0.000001 * 3000
    WHERE total - alpha - linker_mass > 0""")
def gap_join(spark, sf_dir):
    linkers = spark.sql("SELECT * FROM VALUES ('a', 138.068D), ('b', 0.0D) AS x(linker, linker_mass)")
    a = _t(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_acctbal").alias("alpha"), F.lit(12000.0).alias("total"))
    b = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("beta"))
    return J.gap_join(a, b, linkers, "total", "alpha", "beta", "linker_mass", Tolerance(3000.0)).select("s_suppkey", "c_custkey", "linker")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey <= b.p_partkey AND a.p_retailprice + b.p_retailprice + 138.0 <= 1990.0")
def pair_enumeration(spark, sf_dir):
    return J.pair_enumeration(_t(spark, sf_dir, "part"), "p_partkey", "p_retailprice", 138.0, 1990.0, 100.0).select("a", "b")


@query("SELECT DISTINCT l_orderkey, least(l_partkey, l_suppkey) AS l_partkey, greatest(l_partkey, l_suppkey) AS l_suppkey FROM lineitem")
def unordered_pairs(spark, sf_dir):
    return J.unordered_pairs(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), ["l_orderkey"], "l_partkey", "l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey")


# Scores and ranks


@query(f"""WITH {_PEAKS}, {_MASSES}, pairs AS (SELECT l_orderkey, l_linenumber, o_custkey FROM p JOIN m ON {_window(100.0)}),
    k AS (SELECT l_orderkey, l_linenumber, count(*) AS k FROM pairs GROUP BY 1, 2), total AS (SELECT count(*) AS n FROM m),
    s AS (SELECT l_orderkey, o_custkey, round(sum(-ln(k / n)), 6) AS score FROM pairs JOIN k USING (l_orderkey, l_linenumber), total GROUP BY 1, 2),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY score DESC) AS score_rank FROM s) SELECT * FROM r WHERE score_rank <= 3""")
def alpha_candidates(spark, sf_dir):
    """Flagship: tolerance join, product score, tie-aware top ranks."""
    return A.top_alphas(_peaks(spark, sf_dir), _masses(spark, sf_dir), "l_orderkey", "l_linenumber", "mz", "o_custkey", "mass", Tolerance(100.0), 3, 6)


@query("SELECT l_orderkey, round(sum(-ln(1 - l_discount + 0.0)), 6) AS score, count(*) AS factors FROM lineitem GROUP BY 1")
def product_score(spark, sf_dir):
    return A.product_score(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], 1 - F.col("l_discount")).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT l_orderkey, l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_tax FROM lineitem) SELECT l_orderkey, max(l_discount) AS best FROM s GROUP BY 1""")
def merge_scores(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem")
    return A.merge_scores([t.select("l_orderkey", F.col("l_discount").alias("best")), t.select("l_orderkey", F.col("l_tax").alias("best"))], ["l_orderkey"], "best", "highest")


@query("SELECT l_orderkey, l_linenumber, l_quantity, score_rank FROM (SELECT *, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS score_rank FROM lineitem) WHERE score_rank <= 3")
def topn_with_ties(spark, sf_dir):
    return R.top_scores(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 3).select("l_orderkey", "l_linenumber", "l_quantity", "score_rank")


@query("""WITH r AS (SELECT *, dense_rank() OVER w AS score_rank, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE UNBOUNDED PRECEDING) AS upto FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity))
    SELECT l_orderkey, l_linenumber, score_rank FROM r WHERE score_rank <= 5 AND upto <= 40""")
def topn_with_row_limit(spark, sf_dir):
    return R.top_scores(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 5, most_rows=40, highest=False).select("l_orderkey", "l_linenumber", "score_rank")


@query("""WITH f AS (SELECT l_suppkey, l_partkey, max(l_quantity) AS best FROM lineitem GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY best DESC) AS base_rank FROM f)
    SELECT l_orderkey, l_linenumber, base_rank FROM lineitem JOIN r USING (l_suppkey, l_partkey)""")
def first_appearance_rank(spark, sf_dir):
    return R.first_appearance_rank(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_partkey").select("l_orderkey", "l_linenumber", "base_rank")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, l_returnflag AS base, max(l_quantity) OVER w AS top, count(*) OVER w AS n,
        dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS match_rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS place FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
    tb AS (SELECT DISTINCT l_orderkey, base FROM x WHERE s = top),
    o AS (SELECT x.l_orderkey, max(s) AS other FROM x ANTI JOIN tb ON x.l_orderkey = tb.l_orderkey AND x.base = tb.base GROUP BY 1),
    sec AS (SELECT l_orderkey, max(s) AS second FROM x WHERE place = 2 GROUP BY 1)
    SELECT l_orderkey, l_linenumber, match_rank, CASE WHEN n = 1 THEN s ELSE s - coalesce(other, 0) END AS delta, CASE WHEN n = 1 THEN s ELSE s - greatest(0, second) END AS delta_mod,
        CASE WHEN n = 1 THEN s ELSE (s - coalesce(other, 0) + top) / 2 END AS combined_delta FROM x LEFT JOIN o USING (l_orderkey) LEFT JOIN sec USING (l_orderkey)""")
def match_rank_delta(spark, sf_dir):
    return R.match_ranks(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_returnflag").select("l_orderkey", "l_linenumber", "match_rank", "delta", "delta_mod", "combined_delta")


@query("""WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_quantity - coalesce(max(CASE WHEN k = 2 THEN l_quantity END) OVER (PARTITION BY l_orderkey), 0) AS score_delta FROM r""")
def second_best_delta(spark, sf_dir):
    return R.second_best_delta(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "score_delta")


@query(f"""WITH {_PEAKS}, b AS (SELECT *, floor((mz - min(mz) OVER (PARTITION BY l_orderkey)) / 20000.0) AS bin FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, bin ORDER BY intensity DESC, mz) AS k FROM b) SELECT l_orderkey, mz, intensity FROM r WHERE k <= 1""")
def bin_top_peaks(spark, sf_dir):
    return R.bin_top_peaks(_peaks(spark, sf_dir), ["l_orderkey"], "mz", "intensity", 20000.0, 1).select("l_orderkey", "mz", "intensity")


@query("""SELECT l_orderkey, l_linenumber, ntile(4) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank_group FROM lineitem""")
def rank_groups(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").withColumn("v", F.struct(F.col("l_extendedprice"), -F.col("l_orderkey"), -F.col("l_linenumber")))
    return A.rank_groups(t, ["l_suppkey"], "v", 4).select("l_orderkey", "l_linenumber", "rank_group")


# Statistics and peak mining


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std, median(l_extendedprice) AS median FROM lineitem GROUP BY 1),
    m AS (SELECT l_suppkey, median(abs(l_extendedprice - median)) AS mad FROM lineitem JOIN s USING (l_suppkey) GROUP BY 1)
    SELECT l_suppkey, n, min, max, round(mean, 4) AS mean, round(std, 4) AS std, round(median, 4) AS median, round(mad, 4) AS mad FROM s JOIN m USING (l_suppkey)""")
def value_statistics(spark, sf_dir):
    out = A.statistics(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", exact=True)
    return out.select("l_suppkey", "n", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median", "mad")])


@query("""WITH l AS (SELECT 'l_tax' AS score_name, l_tax AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
    SELECT score_name, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM l GROUP BY 1""")
def score_statistics(spark, sf_dir):
    return A.score_statistics(_t(spark, sf_dir, "lineitem"), ["l_tax", "l_discount"], exact=True).select("score_name", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def class_counts(spark, sf_dir):
    return A.class_counts(_t(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", ["A", "N", "R"])


@query("SELECT floor(value / 5.0)::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def mz_histogram(spark, sf_dir):
    return A.histogram(_t(spark, sf_dir, "events"), F.col("value"), 5.0)


@query("SELECT floor((o_totalprice - l_extendedprice) / 1000.0)::BIGINT AS bin, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def neutral_loss_histogram(spark, sf_dir):
    rows = _dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.neutral_loss_histogram(rows, "o_totalprice", "l_extendedprice", 1000.0, "l_orderkey")


@query("""WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber + 10 * (l_suppkey % 5) AS item FROM lineitem), n AS (SELECT item, count(*) AS n_first FROM i GROUP BY 1)
    SELECT a.item AS first, b.item AS second, count(*) AS n_both, any_value(n_first) AS n_first, round(count(*) / any_value(n_first), 9) AS share
    FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.item <> b.item JOIN n ON n.item = a.item GROUP BY 1, 2""")
def cooccurrence(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") + 10 * (F.col("l_suppkey") % 5)).alias("item"))
    return A.cooccurrence(items, "l_orderkey", "item").select("first", "second", "n_both", "n_first", F.round("share", 9).alias("share"))


@query(f"""WITH {_PEAKS}, b AS (SELECT l_orderkey, floor(mz / 2000.0)::BIGINT AS bin, max(struct_pack(i := intensity, m := mz)) AS x FROM p GROUP BY 1, 2)
    SELECT bin, count(*) AS n, round(avg(x.m), 4) AS mean_mz, round(avg(x.i), 4) AS mean_intensity, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM p), 9) AS share FROM b GROUP BY 1""")
def consistent_peaks(spark, sf_dir):
    out = A.consistent_peaks(_peaks(spark, sf_dir), "l_orderkey", "mz", "intensity", 2000.0)
    return out.select("bin", "n", F.round("mean_mz", 4).alias("mean_mz"), F.round("mean_intensity", 4).alias("mean_intensity"), F.round("share", 9).alias("share"))


@query(f"""WITH {_PEAKS}, t AS (SELECT DISTINCT p_retailprice * 20 AS target FROM part),
    h AS (SELECT target, l_orderkey, max(intensity) AS best FROM t JOIN p ON mz >= target - target * 0.000001 * 200 AND mz < target + target * 0.000001 * 200 GROUP BY 1, 2)
    SELECT target, count(*) AS spectra, round(avg(best), 6) AS mean_intensity FROM h GROUP BY 1""")
def target_occurrence(spark, sf_dir):
    targets = _t(spark, sf_dir, "part").select((F.col("p_retailprice") * 20).alias("target")).distinct()
    return A.target_occurrence(_peaks(spark, sf_dir), targets, "l_orderkey", "mz", "target", Tolerance(200.0), "intensity").withColumn("mean_intensity", F.round("mean_intensity", 6))


@query(f"""WITH {_PEAKS}, b AS (SELECT l_orderkey, max(CASE WHEN mz >= 30000 - 6000 AND mz < 36000 THEN intensity END) AS first, max(CASE WHEN mz >= 60000 - 6000 AND mz < 66000 THEN intensity END) AS second FROM p GROUP BY 1)
    SELECT l_orderkey, first, second, first + second AS total FROM b WHERE first IS NOT NULL AND second IS NOT NULL ORDER BY total DESC, l_orderkey LIMIT 20""")
def reporter_pair_top(spark, sf_dir):
    return A.reporter_pair_top(_peaks(spark, sf_dir), "l_orderkey", "mz", "intensity", 30000.0, 60000.0, Tolerance(6000.0, "da"), 20)


@query("SELECT l_suppkey, l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def merge_intensity(spark, sf_dir):
    return A.merge_intensity(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").withColumn("l_extendedprice", F.round("l_extendedprice", 2))


# Sequences


_PARTS = 10_000  #: parts whose residues one task holds


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue strings of the parts. A few MB of a file make millions of fragments, so rows are dealt to many tasks, of _PARTS at most, before anything is computed."""
    letters = F.regexp_replace(F.upper(F.concat_ws("", "p_name", "p_type", "p_brand")), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    parts = _t(spark, sf_dir, "part")
    tasks = max(8 * spark.sparkContext.defaultParallelism, -(-parts.count() // _PARTS))
    rows = parts.select("p_partkey", "p_name", "p_type", "p_brand").repartition(tasks, "p_partkey")
    return rows.select("p_partkey", letters.alias("seq")).where("seq <> ''").withColumn("residues", M.tokens(F.col("seq")))


_SEQ = "s AS (SELECT p_partkey, regexp_replace(upper(p_name || p_type || p_brand), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq FROM part), q AS (SELECT * FROM s WHERE seq <> '')"
_MASS = "list_sum(list_transform(string_split({0}, ''), lambda c: (MAP {{" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in M.RESIDUES.items() if v < 1e9) + "}})[c]))"


@query(f"WITH {_SEQ} SELECT p_partkey, round({_MASS.format('seq')} + 18.01056027, 4) AS mass FROM q")
def peptide_mass(spark, sf_dir):
    return _sequences(spark, sf_dir).select("p_partkey", F.round(M.peptide_mass(F.col("residues")), 4).alias("mass"))


_PIECES = "list_filter(string_split(replace(regexp_replace({0}, '([KR])', '\\1|', 'g'), '|P', 'P'), '|'), lambda x: x <> '')"


@query(f"""WITH {_SEQ}, c AS (SELECT p_partkey, {_PIECES.format('seq')} AS ps FROM q), n AS (SELECT p_partkey, ps, unnest(range(1, len(ps) + 1)) AS i FROM c)
    SELECT p_partkey, 0 AS missed, ps[i] AS peptide, count(*) AS n FROM n GROUP BY 1, 2, 3 UNION ALL SELECT p_partkey, 1, ps[i] || ps[i + 1], count(*) FROM n WHERE i < len(ps) GROUP BY 1, 2, 3""")
def digest_sequences(spark, sf_dir):
    peptides = D.pieces(_sequences(spark, sf_dir), "residues", D.TRYPSIN, 1, methionine_loss=False)
    return peptides.groupBy("p_partkey", "missed", F.array_join("peptide", "").alias("peptide")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SEQ}, r AS (SELECT p_partkey, reverse(seq) AS v FROM q)
    SELECT p_partkey, CASE WHEN right(v, 1) = 'M' AND left(v, 1) <> 'M' AND length(v) > 1 THEN 'M' || substr(v, 2, length(v) - 2) || left(v, 1) ELSE v END AS decoy FROM r""")
def decoy_reverse(spark, sf_dir):
    return _sequences(spark, sf_dir).select("p_partkey", F.array_join(C.reverse(F.col("residues")), "").alias("decoy"))


@query(f"""WITH {_SEQ}, c AS (SELECT p_partkey, {_PIECES.format('seq')} AS ps FROM q), t AS (SELECT p_partkey, unnest(ps) AS peptide, false AS d FROM c UNION ALL SELECT p_partkey, reverse(unnest(ps)), true FROM c)
    SELECT peptide, bool_and(d) AS is_decoy, count(DISTINCT CASE WHEN NOT d THEN p_partkey END) AS targets, count(DISTINCT CASE WHEN d THEN p_partkey END) AS decoys FROM t GROUP BY 1""")
def target_decoy_dedup(spark, sf_dir):
    target = D.pieces(_sequences(spark, sf_dir), "residues", D.TRYPSIN, 0, methionine_loss=False).select("p_partkey", "peptide", F.lit(False).alias("d"))
    both = target.unionByName(target.select("p_partkey", F.reverse("peptide").alias("peptide"), F.lit(True).alias("d")))
    both = both.withColumn("peptide", F.array_join("peptide", ""))
    kept, discarded = D.deduplicated(both, ["peptide"], F.col("p_partkey"), "d")
    out = kept.join(discarded.select("peptide", F.col("positions").alias("gone")), "peptide", "left")
    mine = F.size("positions").cast("long")
    return out.select("peptide", "is_decoy", F.when(~F.col("is_decoy"), mine).otherwise(F.lit(0)).alias("targets"), F.when(F.col("is_decoy"), mine).otherwise(F.coalesce(F.size("gone"), F.lit(0))).cast("long").alias("decoys"))


@query(f"""WITH {_SEQ}, i AS (SELECT p_partkey, seq, unnest(range(1, length(seq))) AS n FROM q)
    SELECT p_partkey, 'b' AS ion_type, n, round({_MASS.format('left(seq, n::INT)')}, 4) AS neutral_mass FROM i
    UNION ALL SELECT p_partkey, 'y', n, round({_MASS.format('right(seq, n::INT)')} + 18.01056027, 4) FROM i""")
def fragment_ions(spark, sf_dir):
    return I.ions(_sequences(spark, sf_dir), ["p_partkey"], "residues", "by").select("p_partkey", "ion_type", "n", F.round("neutral_mass", 4).alias("neutral_mass"))


@query(f"""WITH {_SEQ}, i AS (SELECT p_partkey, seq, unnest(range(1, length(seq))) AS n FROM q), f AS (SELECT p_partkey, n, left(seq, n::INT) AS piece FROM i),
    k AS (SELECT *, least(4, length(regexp_replace(piece, '[^STDE]', '', 'g'))) AS most FROM f), l AS (SELECT *, unnest(range(0, most + 1)) AS loss_count FROM k)
    SELECT p_partkey, n, loss_count, round({_MASS.format('piece')} - loss_count * 18.01056027, 4) AS neutral_mass FROM l""")
def fragment_losses(spark, sf_dir):
    seqs = _sequences(spark, sf_dir)
    out = I.with_losses(I.ions(seqs, ["p_partkey"], "residues", "b"), seqs, ["p_partkey"], [I.Loss("H2O", M.WATER, ("S", "T", "D", "E"))], "residues")
    return out.select("p_partkey", "n", "loss_count", F.round("neutral_mass", 4).alias("neutral_mass"))


@query(f"WITH {_SEQ} SELECT p_partkey, length(regexp_replace(left(seq, length(seq) - 1), '[^KSTY]', '', 'g')) AS sites, length(regexp_replace(left(seq, length(seq) - 1), '[^KSTY]', '', 'g')) > 0 AS can_link FROM q")
def crosslink_sites(spark, sf_dir):
    linker = X.Crosslinker("demo", 138.068, X.Side({"K": 0.0, "S": 0.2, "T": 0.2, "Y": 0.2}))
    no = F.lit(False)
    r: Column = F.col("residues")
    return _sequences(spark, sf_dir).select("p_partkey", F.size(linker.sites_of(r, linker.first, no, no)).cast("long").alias("sites"), linker.can_link(r).alias("can_link"))


@query(f"""WITH {_SEQ}, i AS (SELECT seq, unnest(range(1, length(seq))) AS n FROM q)
    SELECT substr(seq, n, 1) AS n_side, substr(seq, n + 1, 1) AS c_side, count(*) AS n FROM i GROUP BY CUBE (substr(seq, n, 1), substr(seq, n + 1, 1))""")
def residue_pair_counts(spark, sf_dir):
    rows = _sequences(spark, sf_dir).where("length(seq) > 1").select("seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 1)).alias("site"))
    return A.residue_pair_counts(rows, "seq", "site")


# Spectra and filters


@query("""WITH z AS (SELECT o_orderkey, o_totalprice AS mz, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [3, 4] ELSE [2] END) AS hyp_charge FROM orders), a AS (SELECT *, unnest([0.0, -1.0033548, 500.5]) AS alt FROM z)
    SELECT o_orderkey, hyp_charge, round(CASE WHEN alt < 100 THEN mz + alt / hyp_charge ELSE alt END, 6) AS hyp_mz FROM a""")
def precursor_expand(spark, sf_dir):
    t = _t(spark, sf_dir, "orders").withColumn("charge", F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(2))
    out = S.precursor_variants(t, "o_totalprice", "charge", F.array(F.lit(3), F.lit(4)), F.array(F.lit(-1.0033548), F.lit(500.5)))
    return out.select("o_orderkey", "hyp_charge", F.round("hyp_mz", 6).alias("hyp_mz"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, (l_extendedprice - 1.00727646677) * l_linenumber + 1.00727646677 AS one, l_quantity FROM lineitem)
    SELECT l_orderkey, round(one, 4) AS mz, sum(l_quantity) AS intensity FROM x GROUP BY l_orderkey, one""")
def decharged_peaks(spark, sf_dir):
    peaks = _peaks(spark, sf_dir).withColumnRenamed("l_linenumber", "charge")
    return S.decharged(peaks, ["l_orderkey"]).select("l_orderkey", F.round("mz", 4).alias("mz"), "intensity")


@query("""WITH x AS (SELECT l_orderkey, o_totalprice, l_linenumber AS z, (l_extendedprice - 1.00727646677) * l_linenumber + 1.00727646677 AS mz, l_quantity AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    u AS (SELECT l_orderkey, mz, i FROM x WHERE z <= 2 UNION ALL SELECT l_orderkey, o_totalprice - (mz - 1.00727646677) + 1.00727646677, i FROM x WHERE z >= 2)
    SELECT l_orderkey, round(mz, 3) AS mz, sum(i) AS intensity FROM u WHERE mz > 0 GROUP BY l_orderkey, mz""")
def linearised_peaks(spark, sf_dir):
    peaks = _peaks(spark, sf_dir).withColumnRenamed("l_linenumber", "charge").join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return S.linearised(peaks, ["l_orderkey"], "o_totalprice").select("l_orderkey", F.round("mz", 3).alias("mz"), "intensity")


@query("""WITH e AS (SELECT *, l_extendedprice - l_quantity * 1000 AS err FROM lineitem), f AS (SELECT l_suppkey, regr_slope(err, l_extendedprice) AS s, regr_intercept(err, l_extendedprice) AS i FROM e GROUP BY 1)
    SELECT l_orderkey, l_linenumber, round(l_extendedprice - (s * l_extendedprice + i), 3) AS calibrated FROM e JOIN f USING (l_suppkey)""")
def regression_calibrate(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").withColumn("expected", F.col("l_quantity") * 1000)
    return S.calibrate_regression(t, ["l_suppkey"], ["l_returnflag"], "l_extendedprice", "expected").select("l_orderkey", "l_linenumber", F.round("calibrated", 3).alias("calibrated"))


@query("""WITH f AS (SELECT l_returnflag, median(l_extendedprice - l_quantity * 1000) AS shift FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round(l_extendedprice - shift, 3) AS calibrated FROM lineitem JOIN f USING (l_returnflag)""")
def shift_calibrate(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").withColumn("expected", F.col("l_quantity") * 1000)
    return S.calibrate_shift(t, ["l_returnflag"], "l_extendedprice", "expected", exact=True).select("l_orderkey", "l_linenumber", F.round("calibrated", 3).alias("calibrated"))


@query("SELECT event_id FROM events SEMI JOIN (SELECT l_suppkey AS user_id FROM lineitem WHERE l_quantity > 45) USING (user_id)")
def whitelist_filter(spark, sf_dir):
    listed = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.lit("*").alias("run"), F.col("l_suppkey").alias("scan"))
    return L.by_scan(_t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("run"), F.col("user_id").alias("scan")), listed).select("event_id")


@query("SELECT event_id FROM events ANTI JOIN (SELECT l_suppkey AS user_id FROM lineitem WHERE l_quantity > 45) USING (user_id)")
def blacklist_filter(spark, sf_dir):
    listed = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.lit("*").alias("run"), F.col("l_suppkey").alias("scan"))
    return L.by_scan(_t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("run"), F.col("user_id").alias("scan")), listed, keep=False).select("event_id")


@query(f"""WITH {_PEAKS}, b AS (SELECT l_orderkey, max(intensity) AS base, max(CASE WHEN mz >= 25000 AND mz < 35000 THEN intensity END) AS x, max(CASE WHEN mz >= 45000 AND mz < 55000 THEN intensity END) AS y FROM p GROUP BY 1)
    SELECT l_orderkey FROM b WHERE x >= 0.5 * base AND y >= 0.5 * base""")
def contains_peaks(spark, sf_dir):
    return L.contains_peaks(_peaks(spark, sf_dir), "l_orderkey", [30000.0, 50000.0], Tolerance(5000.0, "da"), "all", least_relative=0.5)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity <= 1 OR l_tax > 0.07) AND (l_linenumber <= 2 OR (l_discount > 0.025 AND l_quantity > 2 AND -2 * (l_tax - 0.5) < l_extendedprice / 50000))")
def minimum_requirements(spark, sf_dir):
    c = F.col
    keep = L.minimum_requirements(c("l_quantity"), [c("l_tax")], c("l_linenumber"), [c("l_discount")], c("l_quantity"), c("l_tax") - 0.5, c("l_extendedprice") / 50000, ms2_limit=0.07)
    return _t(spark, sf_dir, "lineitem").where(keep).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > l_quantity * 1000 AND l_extendedprice - l_extendedprice * 0.000001 * 5000 > l_quantity * 1000 THEN 1
    WHEN l_extendedprice <= l_quantity * 1000 AND l_quantity * 1000 - l_quantity * 1000 * 0.000001 * 5000 > l_extendedprice THEN -1 ELSE 0 END AS cmp FROM lineitem""")
def tolerance_compare(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Tolerance(5000.0).compare(F.col("l_extendedprice"), F.col("l_quantity") * 1000).alias("cmp"))


# Matches


@query("""WITH p AS (SELECT * FROM (VALUES ('l_quantity', 25.0, 14.0, 1, 1.5, 2.0), ('l_discount', 0.05, 0.03, -1, 0.0, 1.0), ('l_tax', 0.04, 0.02, 1, 2.0, 0.0)) AS x(score_name, average, stdev, direction, split, weight)),
    l AS (SELECT l_orderkey, l_linenumber, 'l_quantity' AS score_name, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem),
    z AS (SELECT l_orderkey, l_linenumber, weight, CASE WHEN split = 0 THEN (v - average) / stdev / direction * weight ELSE (v - average) / stdev / split * direction * weight END AS s FROM l JOIN p USING (score_name) WHERE weight <> 0)
    SELECT l_orderkey * 10 + l_linenumber AS match_id, round(sum(s) / sum(abs(weight)) * 7, 6) AS match_score FROM z GROUP BY 1""")
def weighted_normalise(spark, sf_dir):
    parameters = spark.sql("SELECT * FROM VALUES ('l_quantity', 25.0D, 14.0D, 1, 1.5D, 2.0D), ('l_discount', 0.05D, 0.03D, -1, 0.0D, 1.0D), ('l_tax', 0.04D, 0.02D, 1, 2.0D, 0.0D) AS x(score_name, average, stdev, direction, normalised_split, weight)")
    match_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("match_id")
    rows = _dealt(spark, sf_dir, "lineitem", match_id, "l_quantity", "l_discount", "l_tax")
    return Q.normalised_score(Q.to_long(rows, "match_id", ["l_quantity", "l_discount", "l_tax"]), parameters).withColumn("match_score", F.round("match_score", 6))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS match_id, l_returnflag AS ion_type, l_quantity::BIGINT AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY match_id, ion_type ORDER BY n) AS run FROM s),
    k AS (SELECT match_id, ion_type, run, count(*) AS k FROM g GROUP BY 1, 2, 3) SELECT match_id, sum(CASE WHEN k >= 3 THEN k ELSE 0 END)::BIGINT AS tagged, round(sum(CASE WHEN k >= 3 THEN k ELSE 0 END) / sum(k), 9) AS tag_share FROM k GROUP BY 1""")
def sequence_tag(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("match_id"), F.col("l_returnflag").alias("ion_type"), F.col("l_quantity").cast("long").alias("n"))
    return Q.sequence_tag(rows).withColumn("tag_share", F.round("tag_share", 9))


@query("""WITH f AS (SELECT l_orderkey AS match_id, l_suppkey % 7 AS b, max((l_linenumber % 3 = 0)::INT) AS intact, max((l_linenumber % 3 > 0)::INT) AS lossy, count(DISTINCT CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber END) AS losses FROM lineitem GROUP BY 1, 2)
    SELECT match_id, count(*) AS matched, sum(intact)::BIGINT AS non_lossy, sum(lossy)::BIGINT AS lossy, sum((intact = 1 OR losses >= 3)::INT)::BIGINT AS conservative, round(count(*) / 18.0, 9) AS matched_coverage FROM f GROUP BY 1""")
def conservative_coverage(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), (F.col("l_suppkey") % 7).alias("base_fragment"), F.col("l_linenumber").alias("fragment_id"), (F.col("l_linenumber") % 3).alias("loss_count"), F.lit(True).alias("is_primary"), F.lit(False).alias("is_crosslinked"))
    matches = t.select("match_id").distinct().withColumn("length", F.lit(10))
    out = Q.fragment_coverage(t, matches)
    return out.select("match_id", "matched", "non_lossy", "lossy", "conservative", F.round("matched_coverage", 9).alias("matched_coverage"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice) AS k FROM lineitem)
    SELECT l_orderkey AS match_id, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS intensity_coverage, round(avg((l_linenumber % 2 = 0)::INT), 9) AS peak_coverage FROM r GROUP BY 1""")
def spectrum_coverage(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"), (F.col("l_linenumber") % 2 == 0).alias("explained"), F.lit(True).alias("intact"))
    return Q.spectrum_coverage(t).select("match_id", F.round("intensity_coverage", 9).alias("intensity_coverage"), F.round("peak_coverage", 9).alias("peak_coverage"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS match_id, l_discount + 0.01 AS share FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY share) AS k FROM d)
    SELECT match_id, round(-sum(ln(share)), 6) AS library_score_log FROM r WHERE k <= 5 GROUP BY 1""")
def library_score(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("match_id"), (F.col("l_discount") + 0.01).alias("share"))
    return Q.library_score(t, most=5).select("match_id", F.round("library_score_log", 6).alias("library_score_log"))


@query("""WITH w AS (SELECT l_orderkey AS match_id, l_linenumber AS site_a, l_linenumber AS site_b, l_discount AS penalty FROM lineitem),
    f AS (SELECT l_orderkey AS match_id, l_linenumber AS first, l_linenumber + 1 AS last, l_tax AS rel FROM lineitem),
    h AS (SELECT w.match_id, site_a, sum(rel) AS mis FROM (SELECT DISTINCT match_id, site_a FROM w) w JOIN f ON w.match_id = f.match_id AND first <= site_a AND last >= site_a GROUP BY 1, 2),
    t AS (SELECT match_id, site_a, penalty + coalesce(mis, 0) AS weight FROM w LEFT JOIN h USING (match_id, site_a))
    SELECT match_id, site_a, round(weight, 6) AS weight, round(1 / (weight + 0.0001) / sum(1 / (weight + 0.0001)) OVER (PARTITION BY match_id), 6) AS share FROM t""")
def link_site_weights(spark, sf_dir):
    t = _dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    pairs = t.select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("site_a"), F.col("l_linenumber").alias("site_b"), "l_discount")
    hits = t.select(F.col("l_orderkey").alias("match_id"), F.lit(0).alias("peptide_index"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + 1).alias("last"), F.lit(0).alias("loss_count"), F.lit(False).alias("is_crosslinked"), F.col("l_tax").alias("rel_intensity"))
    return K.link_site_weights(pairs, hits, "match_id", F.col("l_discount")).select("match_id", "site_a", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"))


@query("SELECT round(l_tax - l_discount, 2) AS error, count(*) AS n FROM lineitem GROUP BY 1")
def error_histogram(spark, sf_dir):
    from ..sources.sinks import error_table

    return error_table(_t(spark, sf_dir, "lineitem").select((F.col("l_tax") - F.col("l_discount")).alias("error")))


@query("SELECT n_name AS name, n_regionkey AS region, NULL::VARCHAR AS brand FROM nation UNION ALL SELECT r_name, NULL, NULL FROM region UNION ALL SELECT p_name, NULL, p_brand FROM part")
def union_by_name(spark, sf_dir):
    a = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = _t(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    c = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).select("name", "region", "brand")


@query(f"""WITH {_PEAKS}, w AS (SELECT o_orderkey AS l_orderkey, o_totalprice / 3 AS target FROM orders), l AS (SELECT l_orderkey, max(intensity) AS base FROM p GROUP BY 1),
    c AS (SELECT w.l_orderkey, target, mz, intensity, row_number() OVER (PARTITION BY w.l_orderkey ORDER BY abs(mz - target), mz) AS r FROM w JOIN p ON w.l_orderkey = p.l_orderkey AND mz >= target - target * 0.000001 * 50000 AND mz < target + target * 0.000001 * 50000)
    SELECT w.l_orderkey, c.mz IS NOT NULL AS found, c.mz, round(intensity / base, 6) AS to_base FROM w LEFT JOIN c ON c.l_orderkey = w.l_orderkey AND r = 1 LEFT JOIN l ON l.l_orderkey = w.l_orderkey""")
def peaks_in_scans(spark, sf_dir):
    wanted = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 3).alias("target"))
    out = A.peaks_in_scans(_peaks(spark, sf_dir), wanted, "l_orderkey", "mz", "intensity", "target", Tolerance(50000.0))
    return out.select("l_orderkey", "found", "mz", F.round("to_base", 6).alias("to_base"))


@query(None)
def isotope_clusters(spark, sf_dir):
    """Peaks of a spectrum squeezed together so that isotope series occur; 30 orders are a spectrum, so spectra grow with the table."""
    peaks = _t(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 30").alias("spectrum"), (500 + F.floor(F.col("l_extendedprice") / 10) * 1.0033548 / 2).alias("mz"), F.col("l_quantity").alias("intensity"))
    return S.isotope_clusters(A.merge_intensity(peaks, ["spectrum"], "mz", "intensity"), ["spectrum"], 3, Tolerance(10.0), every=True)


@query(None)
def rolling_denoise(spark, sf_dir):
    peaks = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))
    return S.denoised(peaks, ["l_suppkey"], 10, 5000.0, 3, Tolerance(10.0))


@query(None)
def decoy_shuffle(spark, sf_dir):
    return _sequences(spark, sf_dir).select("p_partkey", F.array_join(C.shuffle(F.col("residues"), F.col("p_partkey"), ["K", "R"]), "").alias("decoy"))


@query(f"""WITH {_SEQ}, e AS (SELECT p_partkey, seq, unnest(list_filter(range(1, length(seq) + 1), lambda k: substr(seq, k::INT, 1) IN ('M', 'S')))::INT AS i FROM q),
    t AS (SELECT *, CASE substr(seq, i, 1) WHEN 'M' THEN 'ox' ELSE 'ph' END AS m FROM e),
    f AS (SELECT p_partkey, 1 AS k, i, 0 AS j, left(seq, i) || m || substr(seq, i + 1) AS peptide FROM t
        UNION ALL SELECT a.p_partkey, 2, a.i, b.i, left(a.seq, a.i) || a.m || substr(a.seq, a.i + 1, b.i - a.i) || b.m || substr(a.seq, b.i + 1) FROM t a JOIN t b ON a.p_partkey = b.p_partkey AND a.i < b.i),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY k, i, j) AS n FROM f) SELECT p_partkey, peptide FROM r WHERE n <= 10 UNION ALL SELECT p_partkey, seq FROM q""")
def variable_modifications(spark, sf_dir):
    mods = [D.Modification("Mox", "M", 15.99491), D.Modification("Sph", "S", 79.966331)]
    out = D.variable(_sequences(spark, sf_dir).select("p_partkey", F.col("residues").alias("peptide")), mods, 2, 10)
    return out.select("p_partkey", F.array_join("peptide", "").alias("peptide"))
