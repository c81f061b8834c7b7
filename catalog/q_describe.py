"""Descriptive, exploratory and test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base_sql import BASE, SCORED, mixed_hash_sql
from catalog.q_quality import erfc_sql, long_sql
from catalog.registry import query, rounded, sql
from loyaltide.functions.expressions import left_closed_bins
from loyaltide.operators import describe, hypothesis_tests as ht
from loyaltide.operators.segments_by_rule import business_segments, rule_segment
from loyaltide.plans.score_table import Tuning
from loyaltide.sources.customer_base import load_customer_base as base

NUM = ["rev_Mean", "mou_Mean", "change_mou", "months", "eqpdays", "custcare_Mean", "hnd_price",
       "avg3mou"]
CAT = ["crclscod", "area", "hnd_webcap", "marital", "prizm_social_one"]
Z = "1.959964::DOUBLE"


def wilson(k: str, n: str, sign: str) -> str:
    p, m = f"(CAST({k} AS DOUBLE) / {n})", f"CAST({n} AS DOUBLE)"
    return (f"((({p} + {Z}*{Z}/(2*{m})) {sign} {Z}*sqrt({p}*(1-{p})/{m} + {Z}*{Z}/(4*{m}*{m}))) / (1 + {Z}*{Z}/{m}))")


def rates_sql(group: str, source: str, where: str = "true") -> str:
    return f"""SELECT coalesce(CAST({group} AS VARCHAR), 'Manquant') AS groupe, count(*) AS n, sum(churn) AS churners,
  round_even(100 * CAST(sum(churn) AS DOUBLE) / count(*), 2) AS taux, round_even(100 * {wilson('sum(churn)', 'count(*)', '-')}, 2) AS ic_bas,
  round_even(100 * {wilson('sum(churn)', 'count(*)', '+')}, 2) AS ic_haut, round_even(100 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 2) AS part
  FROM {source} WHERE {where} GROUP BY {group}"""


_DESC = BASE + f", l AS ({long_sql(NUM)}), d AS (" + """
  SELECT variable, round_even(avg(value), 2) AS moyenne, round_even(median(value), 2) AS mediane, round_even(stddev_samp(value), 2) AS ecart_type,
    round_even(min(value), 2) AS min, round_even(max(value), 2) AS max, round_even(skewness(value), 2) AS asymetrie, round_even(kurtosis(value), 2) AS aplatissement,
    round_even(100 * CAST(count(*) FILTER (WHERE value = 0) AS DOUBLE) / count(*), 2) AS pct_zero, round_even(100 * CAST(count(*) - count(value) AS DOUBLE) / count(*), 2) AS pct_manquant
  FROM l GROUP BY 1), fl AS (SELECT variable, abs(asymetrie) > 1 AS tres_asymetrique, pct_zero > 20 AS concentree_sur_zero FROM d)"""
_DESC_COLS = "moyenne mediane ecart_type min max asymetrie aplatissement pct_zero pct_manquant"


@query("c01_describe_numeric", sql(_DESC, "SELECT * FROM d", _DESC_COLS))
def c01(spark, sf):
    return rounded(describe.describe_numeric(base(spark, sf), NUM))


@query("c02_shape_flags", _DESC + " SELECT * FROM fl")
def c02(spark, sf):
    return describe.shape_flags(describe.describe_numeric(base(spark, sf), NUM), 1.0, 20.0)


_BLOCK = """CASE WHEN variable = 'rev_Mean' THEN 'Revenu / facture' WHEN variable IN ('mou_Mean', 'avg3mou') THEN 'Usage' WHEN variable = 'change_mou' THEN 'Tendance'
  WHEN variable IN ('eqpdays', 'hnd_price') THEN 'Terminal' WHEN variable = 'months' THEN 'Compte' ELSE 'Service client' END"""


@query("c03_block_summary", _DESC + f""" SELECT coalesce(b, 'Total') AS bloc, count(*) AS variables, count(*) FILTER (WHERE tres_asymetrique) AS tres_asymetriques,
  count(*) FILTER (WHERE concentree_sur_zero) AS concentrees_sur_zero FROM (SELECT *, {_BLOCK} AS b FROM fl) GROUP BY ROLLUP (b)""")
def c03(spark, sf):
    flags = describe.shape_flags(describe.describe_numeric(base(spark, sf), NUM), 1.0, 20.0)
    return describe.block_summary(flags)


@query("c04_category_frequencies", sql(BASE, """SELECT coalesce(hnd_webcap, 'Manquant') AS niveau, count(*) AS n,
  round_even(100 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 2) AS pct FROM cust GROUP BY 1""", "pct"))
def c04(spark, sf):
    return rounded(describe.category_frequencies(base(spark, sf), "hnd_webcap"))


_LEVELS = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS niveau, churn FROM cust" for c in CAT)


@query("c05_level_dominance", sql(BASE + f", lv AS ({_LEVELS}), lc AS (SELECT variable, niveau, count(*) AS n FROM lv GROUP BY 1, 2)",
    """SELECT variable, count(niveau) AS n_niveaux, arg_max(niveau, n * 1000 + ascii(niveau)) FILTER (WHERE niveau IS NOT NULL) AS niveau_dominant,
  100 * CAST(max(n) FILTER (WHERE niveau IS NOT NULL) AS DOUBLE) / sum(n) AS part_dominant,
  100 * CAST(coalesce(sum(n) FILTER (WHERE niveau IS NULL), 0) AS DOUBLE) / sum(n) AS part_manquant FROM lc GROUP BY 1""", "part_dominant part_manquant"))
def c05(spark, sf):
    return rounded(describe.level_dominance(base(spark, sf), CAT))


@query("c06_credit_class", BASE + """, s AS (SELECT substr(crclscod, 1, 1) AS l, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM cust) AS share FROM cust GROUP BY 1)
  SELECT customer_id, CASE WHEN share < 0.2 THEN 'Autres' ELSE l END AS classe_credit FROM cust JOIN s ON l = substr(crclscod, 1, 1)""")
def c06(spark, sf):
    return describe.credit_class(base(spark, sf), min_share=0.2).select("customer_id",
                                                                        "classe_credit")


@query("c07_churn_rate_table", sql(BASE + ", t AS (" + rates_sql("hnd_webcap", "cust") + ")",
    "SELECT *, row_number() OVER (ORDER BY groupe = 'Manquant', groupe) AS ordre FROM t", "taux ic_bas ic_haut part"))
def c07(spark, sf):
    return rounded(describe.churn_rate_table(base(spark, sf), F.col("hnd_webcap")))


@query("c07_churn_rate_numeric_group", sql(BASE + ", t AS (" + rates_sql("income", "cust") + ")",
    "SELECT *, row_number() OVER (ORDER BY groupe = 'Manquant', try_cast(groupe AS INTEGER)) AS ordre FROM t", "taux ic_bas ic_haut part"))
def c07b(spark, sf):
    return rounded(describe.churn_rate_table(base(spark, sf), F.col("income")))


def edges_sql(columns: list[str], q: int = 10, source: str = "l") -> str:
    probs = ", ".join(str(i / q) for i in range(q + 1))
    return f""", edges AS (SELECT variable, list_distinct(quantile_cont(value, [{probs}])) AS e0 FROM {source} WHERE value IS NOT NULL GROUP BY 1
), es AS (SELECT variable, list_sort(e0) AS e FROM edges
), bins AS (SELECT {source}.*, greatest(len(list_filter(e, lambda x: x < value)), 1) AS classe, e FROM {source} JOIN es USING (variable) WHERE value IS NOT NULL)"""


@query("c08_decile_bins", sql(BASE + f", l AS ({long_sql(NUM)})" + edges_sql(NUM),
    "SELECT variable, CAST(classe AS INTEGER) AS classe, e[classe] AS gauche, e[least(classe + 1, len(e))] AS droite, count(*) AS n FROM bins GROUP BY ALL", "gauche droite"))
def c08(spark, sf):
    return rounded(describe.quantile_bins(base(spark, sf), NUM).groupBy(
        "variable", "classe", "gauche", "droite").agg(F.count(F.lit(1)).alias("n")))


@query("c09_fixed_bins", BASE + """ SELECT CASE WHEN eqpdays < 100 THEN '[0;100[' WHEN eqpdays < 300 THEN '[100;300[' WHEN eqpdays < 900 THEN '[300;900[' END AS classe, count(*) AS n FROM cust GROUP BY 1""")
def c09(spark, sf):
    return base(spark, sf).groupBy(left_closed_bins(
        "eqpdays", [0, 100, 300, 900], ["[0;100[", "[100;300[", "[300;900["]).alias("classe")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("c10_two_way_rate", sql(BASE, "SELECT area, hnd_webcap, round_even(100 * avg(churn), 1) AS taux, count(*) AS n FROM cust WHERE hnd_webcap IS NOT NULL GROUP BY 1, 2", "taux"))
def c10(spark, sf):
    return rounded(describe.two_way_rate(base(spark, sf), "area", "hnd_webcap"))


@query("c10_two_way_pivot", sql(BASE, "SELECT area, " + ", ".join(
    f"round_even(100 * avg(churn) FILTER (WHERE hnd_webcap = '{v}'), 1) AS \"{v}_taux\", count(*) FILTER (WHERE hnd_webcap = '{v}') AS \"{v}_n\"" for v in ("UNKW", "WC", "WCMB"))
    + " FROM cust GROUP BY 1", "UNKW_taux WC_taux WCMB_taux"))
def c10b(spark, sf):
    return rounded(describe.two_way_pivot(base(spark, sf), "area", "hnd_webcap",
                                          ["UNKW", "WC", "WCMB"]))


_SP = ["rev_Mean", "mou_Mean", "months", "eqpdays", "totrev", "totcalls", "lor", "income"]


def spearman_sql(columns: list[str]) -> str:
    """Each pair ranked over its own common rows."""
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS var_1, '{b}' AS var_2, corr(ra, rb) AS rho FROM (SELECT {rank.format(a)} AS ra, {rank.format(b)} AS rb FROM cust WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for i, a in enumerate(columns) for b in columns[i + 1:])
    return f", sm AS ({cells})"


@query("c11_spearman_matrix", sql(BASE + spearman_sql(_SP), "SELECT * FROM sm", "rho"))
def c11(spark, sf):
    return rounded(describe.spearman_matrix(base(spark, sf), _SP, digits=None))


@query("c12_top_correlated_pairs", sql(BASE + spearman_sql(_SP), "SELECT * FROM sm WHERE abs(rho) >= 0.3", "rho"))
def c12(spark, sf):
    return rounded(describe.top_correlated_pairs(
        describe.spearman_matrix(base(spark, sf), _SP, digits=None), 0.3))


def segmented(spark, sf):
    t = Tuning()
    return business_segments(base(spark, sf), t.tenure, t.usage, t.device)


@query("c13_business_segments", SCORED + " SELECT customer_id, anciennete, usage, terminal FROM labelled")
def c13(spark, sf):
    return segmented(spark, sf).select("customer_id", "anciennete", "usage", "terminal")


_SEG_TABLE = SCORED + f""", st AS (SELECT anciennete, usage, terminal, count(*) AS n, round_even(100 * CAST(sum(churn) AS DOUBLE) / count(*), 2) AS taux,
  round_even(100 * {wilson('sum(churn)', 'count(*)', '-')}, 2) AS ic_bas, round_even(100 * {wilson('sum(churn)', 'count(*)', '+')}, 2) AS ic_haut,
  round_even(100 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM labelled), 2) AS part,
  round_even(100 * (CAST(sum(churn) AS DOUBLE) / count(*) - (SELECT avg(churn) FROM labelled)), 2) AS ecart_pts
  FROM labelled WHERE usage IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 20)"""


@query("c14_segment_table", sql(_SEG_TABLE, "SELECT * FROM st", "taux ic_bas ic_haut part ecart_pts"))
def c14(spark, sf):
    return rounded(describe.segment_table(segmented(spark, sf), ["anciennete", "usage", "terminal"],
                                          min_size=20))


@query("c15_rule_segment_labels", SCORED + " SELECT customer_id, segment_regles FROM labelled")
def c15(spark, sf):
    return rule_segment(segmented(spark, sf)).select("customer_id", "segment_regles")


@query("c24_pooled_segments", sql(_SEG_TABLE, """SELECT CASE WHEN taux < 40 THEN 1 WHEN taux < 50 THEN 2 WHEN taux < 60 THEN 3 ELSE 4 END AS bande, count(*) AS n_segments,
  CAST(sum(n) AS BIGINT) AS clients, sum(n * taux) / sum(n) AS taux_pondere FROM st GROUP BY 1""", "taux_pondere"))
def c24(spark, sf):
    return rounded(describe.pooled_segments(describe.segment_table(
        segmented(spark, sf), ["anciennete", "usage", "terminal"], min_size=20)))


RHO_Y = """, rt AS (SELECT variable, value, churn, rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2 AS r FROM l WHERE value IS NOT NULL
), rho AS (SELECT variable, corr(r, churn) AS rho FROM rt GROUP BY 1)"""
BIN_RATES = """, br AS (SELECT variable, classe, count(*) AS n, sum(churn) AS churners, round_even(100 * CAST(sum(churn) AS DOUBLE) / count(*), 2) AS taux FROM bins GROUP BY 1, 2)"""


@query("c16_decile_contrast", sql(BASE + f", l AS ({long_sql(NUM)})" + edges_sql(NUM) + BIN_RATES + RHO_Y,
    """SELECT variable, count(*) AS n_classes, min(taux) AS taux_min, max(taux) AS taux_max, round_even(max(taux) - min(taux), 1) AS amplitude_pts,
  round_even(any_value(rho), 3) AS rho FROM br JOIN rho USING (variable) GROUP BY 1""", "taux_min taux_max amplitude_pts rho"))
def c16(spark, sf):
    return rounded(describe.decile_contrast(base(spark, sf), NUM))


CHI = BASE + f", lv AS ({_LEVELS}" + """), lc AS (SELECT variable, coalesce(niveau, 'Manquant') AS niveau, CAST(count(*) AS DOUBLE) AS n, CAST(sum(churn) AS DOUBLE) AS pos FROM lv GROUP BY 1, 2
), lt AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS t, sum(pos) OVER (PARTITION BY variable) AS tp FROM lc
), chi AS (SELECT variable, max(t) AS n, sum((pos - n * tp / t) ** 2 / (n * tp / t) + (n - pos - n * (t - tp) / t) ** 2 / (n * (t - tp) / t)) AS chi2, count(*) - 1 AS ddl FROM lt GROUP BY 1)"""


@query("c17_categorical_contrast", sql(CHI + ", lr AS (SELECT *, round_even(100 * pos / n, 2) AS taux FROM lc)",
    """SELECT variable, count(*) AS n_modalites, arg_min(niveau, taux) FILTER (WHERE n >= 100) AS modalite_min, min(taux) FILTER (WHERE n >= 100) AS taux_min,
  arg_max(niveau, taux) FILTER (WHERE n >= 100) AS modalite_max, max(taux) FILTER (WHERE n >= 100) AS taux_max,
  round_even(max(taux) FILTER (WHERE n >= 100) - min(taux) FILTER (WHERE n >= 100), 1) AS ecart_pts, round_even(sqrt(any_value(chi2) / any_value(chi.n)), 3) AS cramers_v
  FROM lr JOIN chi USING (variable) GROUP BY 1""".replace("n >= 100", "lr.n >= 100"), "taux_min taux_max ecart_pts cramers_v"))
def c17(spark, sf):
    return rounded(describe.categorical_contrast(base(spark, sf), CAT, min_n=100))


@query("c18_chi2_cramers_v", sql(CHI, "SELECT variable, CAST(n AS BIGINT) AS n, chi2, ddl, sqrt(chi2 / n) AS cramers_v FROM chi", "chi2 cramers_v"))
def c18(spark, sf):
    return rounded(describe.chi2_from_counts(describe.level_counts(base(spark, sf), CAT)))


@query("c19_medians_by_target", sql(BASE + f", l AS ({long_sql(NUM)})", """SELECT variable, median(value) FILTER (WHERE churn = 0) AS mediane_0, median(value) FILTER (WHERE churn = 1) AS mediane_1,
  100 * (median(value) FILTER (WHERE churn = 1) - median(value) FILTER (WHERE churn = 0)) / nullif(abs(median(value) FILTER (WHERE churn = 0)), 0) AS ecart_pct FROM l GROUP BY 1""", "mediane_0 mediane_1 ecart_pct"))
def c19(spark, sf):
    return rounded(describe.medians_by_target(base(spark, sf), NUM))


@query("c20_cross_tab", sql(BASE, """SELECT coalesce(hnd_webcap, 'All') AS hnd_webcap, count(*) AS n, 100 * avg((churn = 0)::INT) AS pct_0, 100 * avg(churn) AS pct_1
  FROM cust WHERE hnd_webcap IS NOT NULL GROUP BY ROLLUP (hnd_webcap)""", "pct_0 pct_1"))
def c20(spark, sf):
    return rounded(describe.cross_tab(base(spark, sf), "hnd_webcap"))


_HIST = ["eqpdays", "months", "rev_Mean", "ovrrev_Mean"]


@query("c21_histograms", sql(BASE + f", l AS (SELECT * FROM ({long_sql(_HIST)}) WHERE value IS NOT NULL)" + """
, sh AS (SELECT variable, abs(skewness(value)) > 1.5 AND min(value) >= 0 AND max(value) > 0 AS lg, min(value) AS mn, max(value) AS mx, min(value) FILTER (WHERE value > 0) AS mp,
    100 * avg((value = 0)::INT) AS pct_zero FROM l GROUP BY 1
), sc AS (SELECT variable, lg, pct_zero, CASE WHEN lg THEN log10(mp) ELSE mn END AS lo, CASE WHEN lg THEN log10(mx) ELSE mx END AS hi FROM sh
), rows_ AS (SELECT l.variable, lg, pct_zero, lo, (hi - lo) / 40 AS step, CASE WHEN lg THEN log10(value) ELSE value END AS x FROM l JOIN sc USING (variable) WHERE NOT lg OR value > 0
), bn AS (SELECT *, CAST(least(floor((x - lo) / step), 39) AS INTEGER) AS classe FROM rows_)""",
    """SELECT variable, CASE WHEN lg THEN 'log10' ELSE 'lineaire' END AS echelle, pct_zero, classe, lo + classe * step AS debut, lo + (classe + 1) * step AS fin, count(*) AS n FROM bn GROUP BY ALL""",
    "pct_zero debut fin"))
def c21(spark, sf):
    return rounded(describe.histograms(base(spark, sf), _HIST, skew_log=1.5))


@query("c22_box_statistics", sql(BASE + f", l AS ({long_sql(_HIST)})" + """, q AS (SELECT churn, variable, quantile_cont(value, 0.25) AS q1, median(value) AS mediane, quantile_cont(value, 0.75) AS q3 FROM l WHERE value IS NOT NULL GROUP BY 1, 2)""",
    """SELECT churn, variable, q1, mediane, q3, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS moustache_bas, max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS moustache_haut
  FROM l JOIN q USING (churn, variable) GROUP BY ALL""", "q1 mediane q3 moustache_bas moustache_haut"))
def c22(spark, sf):
    return rounded(describe.box_statistics(base(spark, sf), _HIST, ["churn"]))


@query("c23_zoom_bins", sql(BASE + ", z AS (SELECT churn, CASE WHEN eqpdays BETWEEN 100 AND 200 THEN CAST(floor(eqpdays / 5) * 5 AS BIGINT) END AS b FROM cust)"
    ", t AS (" + rates_sql("b", "z", "b IS NOT NULL") + ")", "SELECT *, row_number() OVER (ORDER BY CAST(groupe AS INTEGER)) AS ordre FROM t", "taux ic_bas ic_haut part"))
def c23(spark, sf):
    df = base(spark, sf).withColumn("b", describe.step_bins("eqpdays", 100, 200, 5))
    return rounded(describe.churn_rate_table(df.filter(F.col("b").isNotNull()), F.col("b")))


@query("c23_capped_tenure", sql(BASE + ", t AS (" + rates_sql("least(months, 60)", "cust") + ")",
    "SELECT *, row_number() OVER (ORDER BY CAST(groupe AS INTEGER)) AS ordre FROM t", "taux ic_bas ic_haut part"))
def c23b(spark, sf):
    df = base(spark, sf)
    return rounded(describe.churn_rate_table(df, describe.capped("months", 60)))


@query("c25_tenure_peaks", sql(BASE, """SELECT CASE WHEN months IN (71, 72) THEN '71-72' WHEN months IN (59, 60) THEN '59-60' ELSE 'autres' END AS fenetre, count(*) AS n, 100 * avg(churn) AS taux
  FROM cust WHERE months IN (71, 72, 59, 60) OR months BETWEEN 61 AND 70 GROUP BY 1""", "taux"))
def c25(spark, sf):
    return rounded(describe.tenure_peaks(base(spark, sf), {"71-72": (71, 72), "59-60": (59, 60)},
                                         (61, 70)))


# --- Tests ----------------------------------------------------------------------------------

MW = """, mw AS (SELECT variable, CAST(count(*) AS DOUBLE) AS n, CAST(sum(churn) AS DOUBLE) AS n1, sum(r) FILTER (WHERE churn = 1) AS r1 FROM rt GROUP BY 1
), ti AS (SELECT variable, sum(t * t * t - t) AS ties FROM (SELECT variable, CAST(count(*) AS DOUBLE) AS t FROM rt GROUP BY variable, value) GROUP BY 1
), mu AS (SELECT variable, n, n1, n - n1 AS n0, r1 - n1 * (n1 + 1) / 2 AS u, ties FROM mw JOIN ti USING (variable)
), mz AS (SELECT *, greatest((abs(u - n1 * n0 / 2) - 0.5) / sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))), 0) AS z FROM mu
), mwt AS (SELECT variable, u AS statistique, least(1.0, """ + erfc_sql("z / sqrt(2.0::DOUBLE)") + """) AS p_value, 2 * u / (n1 * n0) - 1 AS effet, CAST(n AS BIGINT) AS n FROM mz)"""


@query("d01_mann_whitney", sql(BASE + f", l AS ({long_sql(NUM)})" + RHO_Y + MW, "SELECT * FROM mwt", "statistique:3 p_value effet"))
def d01(spark, sf):
    return rounded(ht.mann_whitney(base(spark, sf), NUM), statistique=3)


MERGED = CHI + """, rm AS (SELECT variable, CASE WHEN n < 30 AND count(*) OVER (PARTITION BY variable) > 2 THEN 'Rare' ELSE niveau END AS niveau, n, pos FROM lc
), rs AS (SELECT variable, niveau, sum(n) AS n, sum(pos) AS pos FROM rm GROUP BY 1, 2 HAVING NOT (niveau = 'Rare' AND sum(n) < 30)
), rt_ AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS t, sum(pos) OVER (PARTITION BY variable) AS tp FROM rs
), rchi AS (SELECT variable, max(t) AS n, sum((pos - n * tp / t) ** 2 / (n * tp / t) + (n - pos - n * (t - tp) / t) ** 2 / (n * (t - tp) / t)) AS chi2, count(*) - 1 AS ddl,
    100 * CAST(count(*) FILTER (WHERE n * tp / t < 5) + count(*) FILTER (WHERE n * (t - tp) / t < 5) AS DOUBLE) / (2 * count(*)) AS pct FROM rt_ GROUP BY 1)"""


def chi2_p_sql(x: str, dof: str) -> str:
    """Upper tail of the chi-square law by its finite sum over whole degrees of freedom."""
    half = f"({x}) / 2"
    even = f"coalesce(list_sum(list_transform(range(0, CAST({dof} // 2 AS BIGINT)), lambda i: exp(i * ln({half}) - {half} - lgamma(CAST(i + 1 AS DOUBLE))))), 0)"
    odd = f"coalesce(list_sum(list_transform(range(1, CAST({dof} // 2 AS BIGINT) + 1), lambda i: exp((i - 0.5) * ln({half}) - {half} - lgamma(i + 0.5::DOUBLE)))), 0)"
    one = erfc_sql(f"sqrt({half})")
    return f"(CASE WHEN {x} <= 0 THEN 1 WHEN {dof} % 2 = 1 THEN least(1, {odd} + {one}) ELSE least(1, {even}) END)"


@query("d02_chi2_cramers_v", sql(MERGED, "SELECT variable, 'χ²' AS test, chi2 AS statistique, " + chi2_p_sql("chi2", "ddl") + " AS p_value, CASE WHEN ddl > 0 THEN sqrt(chi2 / n) END AS effet, CAST(n AS BIGINT) AS n, ddl, "
    "pct AS pct_cellules_attendu_lt5 FROM rchi", "statistique p_value effet pct_cellules_attendu_lt5"))
def d02(spark, sf):
    return rounded(ht.chi2_test(base(spark, sf), CAT))


@query("d02_rare_levels", BASE + """ SELECT variable, niveau, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos FROM (
  SELECT 'income' AS variable, CASE WHEN count(*) < 150 THEN 'Rare' ELSE coalesce(CAST(income AS VARCHAR), 'Manquant') END AS niveau, count(*) AS n, sum(churn) AS pos FROM cust GROUP BY income)
  GROUP BY 1, 2 HAVING NOT (niveau = 'Rare' AND sum(n) < 150)""")
def d02b(spark, sf):
    return ht.merge_rare_levels(describe.level_counts(base(spark, sf), ["income"]), 150)


PROFILE = """, big AS (SELECT * FROM br WHERE n >= 50
), pr AS (SELECT variable, taux, row_number() OVER (PARTITION BY variable ORDER BY classe) AS rx, rank() OVER (PARTITION BY variable ORDER BY taux) + (count(*) OVER (PARTITION BY variable, taux) - 1) / 2 AS ry FROM big
), prof AS (SELECT variable, CASE WHEN count(*) < 2 THEN 0 ELSE max(taux) - min(taux) END AS ecart_classes_pts,
    CASE WHEN count(*) < 2 THEN 'sans objet' WHEN count(*) < 3 OR abs(corr(rx, ry)) >= 0.8 THEN 'monotone' ELSE 'non monotone' END AS forme_courbe FROM pr GROUP BY 1)"""


@query("d03_class_profile", sql(BASE + f", l AS ({long_sql(NUM)})" + edges_sql(NUM) + BIN_RATES + PROFILE, "SELECT * FROM prof", "ecart_classes_pts"))
def d03(spark, sf):
    return rounded(ht.class_profile(describe.binned_rates(base(spark, sf), NUM), True, 50))


MI = "sum(CASE WHEN pos > 0 THEN pos / t * ln(pos * t / (n * tp)) ELSE 0 END + CASE WHEN n > pos THEN (n - pos) / t * ln((n - pos) * t / (n * (t - tp))) ELSE 0 END)"


@query("d04_mutual_information", sql(CHI, f"SELECT variable, {MI} AS info_mutuelle FROM lt GROUP BY 1", "info_mutuelle:9"))
def d04(spark, sf):
    return rounded(ht.mutual_information(describe.level_counts(base(spark, sf), CAT)), 9)


NUM_MI = """, fewv AS (SELECT variable, count(DISTINCT value) <= 30 AS few FROM l GROUP BY 1
), mc AS (SELECT variable, CAST(classe AS DOUBLE) AS c, CAST(n AS DOUBLE) AS n, CAST(churners AS DOUBLE) AS pos FROM br JOIN fewv USING (variable) WHERE NOT few
  UNION ALL SELECT variable, value, CAST(count(*) AS DOUBLE), CAST(sum(churn) AS DOUBLE) FROM l JOIN fewv USING (variable) WHERE few GROUP BY 1, 2
), mt AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS t, sum(pos) OVER (PARTITION BY variable) AS tp FROM mc
), nmi AS (SELECT variable, """ + MI + " AS info_mutuelle FROM mt GROUP BY 1)"
_NUMD = [*NUM, "actvsubs"]


@query("d05_binned_information", sql(BASE + f", l AS ({long_sql(_NUMD)})" + edges_sql(_NUMD) + BIN_RATES + NUM_MI, "SELECT * FROM nmi", "info_mutuelle:9"))
def d05(spark, sf):
    return rounded(ht.numeric_information(base(spark, sf), _NUMD), 9)


UNI = (MERGED + f", l AS ({long_sql(NUM)})" + edges_sql(NUM) + BIN_RATES + RHO_Y + MW + PROFILE + NUM_MI.replace(", mt AS (SELECT *, sum", ", nmt AS (SELECT *, sum").replace("FROM mt GROUP", "FROM nmt GROUP") + f"""
, cmi AS (SELECT variable, {MI} AS info_mutuelle FROM lt GROUP BY 1
), cbig AS (SELECT variable, CASE WHEN count(*) < 2 THEN 0 ELSE max(taux) - min(taux) END AS e FROM (SELECT variable, round_even(100 * pos / n, 2) AS taux FROM lc WHERE n >= 50) GROUP BY 1
), un0 AS (SELECT variable, 'numérique' AS type, statistique, p_value, effet, n, coalesce(ecart_classes_pts, 0) AS ecart_classes_pts, coalesce(forme_courbe, 'sans objet') AS forme_courbe, info_mutuelle FROM mwt LEFT JOIN prof USING (variable) JOIN nmi USING (variable)
  UNION ALL SELECT variable, 'catégorielle', chi2, """ + chi2_p_sql("chi2", "ddl") + """, CASE WHEN ddl > 0 THEN sqrt(chi2 / n) END, CAST(n AS BIGINT), coalesce(e, 0), 'sans objet', info_mutuelle FROM rchi LEFT JOIN cbig USING (variable) JOIN cmi USING (variable)
), un1 AS (SELECT *, row_number() OVER (ORDER BY p_value, variable) AS i, count(*) OVER () AS m FROM un0
), uni AS (SELECT * EXCLUDE (i, m), least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS p_ajustee_holm FROM un1)""")


@query("d08_univariate_table", sql(UNI, """SELECT *, abs(effet) AS effet_abs, CASE WHEN abs(effet) < 0.1 THEN 'négligeable' WHEN abs(effet) < 0.3 THEN 'faible' WHEN abs(effet) < 0.5 THEN 'moyen' ELSE 'fort' END AS interpretation,
  p_ajustee_holm <= 0.05 AS significatif_holm, abs(effet) < 0.1 AND ecart_classes_pts > 10 AS relation_non_monotone, row_number() OVER (ORDER BY info_mutuelle DESC, variable) AS rang FROM uni""",
    "statistique:3 p_value effet ecart_classes_pts info_mutuelle:9 p_ajustee_holm effet_abs"))
def d08(spark, sf):
    t = ht.univariate_table(base(spark, sf), NUM, CAT, min_n=50)
    return rounded(t.drop("test", "mesure_effet"), statistique=3, info_mutuelle=9)


@query("d06_holm", sql(BASE + f", l AS ({long_sql(NUM)})" + RHO_Y + MW + ", ho AS (SELECT *, row_number() OVER (ORDER BY p_value, variable) AS i, count(*) OVER () AS m FROM mwt)",
    "SELECT variable, p_value, least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS p_holm FROM ho", "p_value p_holm"))
def d06(spark, sf):
    return rounded(ht.holm(ht.mann_whitney(base(spark, sf), NUM).select("variable", "p_value")))


@query("d07_interpret_effect", BASE + f", l AS ({long_sql(NUM)})" + RHO_Y + MW + " SELECT variable, CASE WHEN abs(effet) < 0.1 THEN 'négligeable' WHEN abs(effet) < 0.3 THEN 'faible' WHEN abs(effet) < 0.5 THEN 'moyen' ELSE 'fort' END AS taille FROM mwt")
def d07(spark, sf):
    return ht.mann_whitney(base(spark, sf), NUM).select("variable", ht.effect_label("effet")
                                                        .alias("taille"))


@query("d09_p_value_vs_sample_size", sql(BASE + f""", h AS (SELECT churn, eqpdays, row_number() OVER (ORDER BY {mixed_hash_sql('customer_id', 42)}, customer_id) AS rn FROM cust
), s AS (SELECT unnest([200, 500, 1000]) AS taille), x AS (SELECT taille, churn, eqpdays AS value FROM h, s WHERE rn <= taille
), r AS (SELECT *, rank() OVER (PARTITION BY taille ORDER BY value) + (count(*) OVER (PARTITION BY taille, value) - 1) / 2 AS r FROM x
), g AS (SELECT taille, CAST(count(*) AS DOUBLE) AS n, CAST(sum(churn) AS DOUBLE) AS n1, sum(r) FILTER (WHERE churn = 1) AS r1 FROM r GROUP BY 1
), gt AS (SELECT taille, sum(t * t * t - t) AS ties FROM (SELECT taille, CAST(count(*) AS DOUBLE) AS t FROM r GROUP BY taille, value) GROUP BY 1
), gu AS (SELECT taille, n, n1, n - n1 AS n0, r1 - n1 * (n1 + 1) / 2 AS u, ties FROM g JOIN gt USING (taille)
), gz AS (SELECT *, greatest((abs(u - n1 * n0 / 2) - 0.5) / sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))), 0) AS z FROM gu)""",
    "SELECT CAST(taille AS INTEGER) AS taille, least(1.0, " + erfc_sql("z / sqrt(2.0::DOUBLE)") + ") AS p_value, 2 * u / (n1 * n0) - 1 AS rank_biserial FROM gz", "p_value rank_biserial"))
def d09(spark, sf):
    return rounded(ht.p_value_vs_sample_size(base(spark, sf), "eqpdays", [200, 500, 1000]))


@query("d10_redundant_pairs", sql(BASE + spearman_sql(_SP), "SELECT var_1, var_2, round_even(rho, 3) AS rho FROM sm WHERE abs(rho) > 0.5", "rho"))
def d10(spark, sf):
    return rounded(ht.redundant_pairs(base(spark, sf), _SP, 0.5))


@query("d11_variable_clusters")
def d11(spark, sf):
    return ht.clusters_table(base(spark, sf), ["rev_Mean", "avg6rev", "mou_Mean", "avg6mou",
                                               "totrev", "totcalls", "months"], 0.9)


@query("d12_choose_representatives", sql(BASE + f", l AS ({long_sql(NUM)})" + edges_sql(NUM) + BIN_RATES + NUM_MI + """, grp(variable, groupe) AS (VALUES ('rev_Mean', 1), ('mou_Mean', 1), ('change_mou', 2), ('months', 3), ('eqpdays', 3)
), gi AS (SELECT *, count(*) OVER (PARTITION BY groupe) AS k, first_value(variable) OVER (PARTITION BY groupe ORDER BY CASE variable WHEN 'mou_Mean' THEN 1 WHEN 'rev_Mean' THEN 2 ELSE 99 END, info_mutuelle DESC, variable) AS representante FROM grp JOIN nmi USING (variable))""",
    "SELECT variable, groupe, representante, variable = representante AS garder, info_mutuelle FROM gi WHERE k > 1", "info_mutuelle:9"))
def d12(spark, sf):
    groups = spark.createDataFrame([("rev_Mean", 1), ("mou_Mean", 1), ("change_mou", 2),
                                    ("months", 3), ("eqpdays", 3)], "variable string, groupe int")
    return rounded(ht.choose_representatives(groups, ht.numeric_information(base(spark, sf), NUM)), 9)


_LIN = ["rev_Mean", "change_mou", "eqpdays", "months", "ovrrev_Mean"]


def prepared_sql(columns: list[str]) -> str:
    fill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM cust)) AS {c}" for c in columns)
    log = ", ".join(f"CASE WHEN abs((SELECT skewness({c}) FROM pf)) > 2 THEN CASE WHEN (SELECT min({c}) FROM pf) < 0 THEN sign({c}) * ln(1 + abs({c})) ELSE ln(1 + {c}) END ELSE {c} END AS {c}" for c in columns)
    z = ", ".join(f"({c} - (SELECT avg({c}) FROM pl)) / (SELECT stddev_pop({c}) FROM pl) AS {c}" for c in columns)
    return f", pf AS (SELECT customer_id, {fill} FROM cust), pl AS (SELECT customer_id, {log} FROM pf), pz AS (SELECT customer_id, {z} FROM pl)"


@query("d13_prepare_for_linear", sql(BASE + prepared_sql(_LIN), "SELECT * FROM pz", " ".join(_LIN)))
def d13(spark, sf):
    return rounded(ht.prepare_for_linear(base(spark, sf), _LIN, keep=["customer_id"]))


_VIF = ["months", "eqpdays", "totrev", "totcalls", "totmrc_Mean", "ovrrev_Mean"]


def inverse_sql(columns: list[str]) -> str:
    """CTE ``inv`` (i, j, v): the inverse correlation matrix of ``pz``, by one sweep per column."""
    text = ", w0 AS (" + " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, corr({a}, {b}) AS v FROM pz"
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i != j)
    text += " UNION ALL " + " UNION ALL ".join(f"SELECT {i}, {i}, 1.0::DOUBLE" for i in range(len(columns))) + ")"
    for k in range(len(columns)):
        text += (f", w{k + 1} AS (SELECT m.i, m.j, CASE WHEN m.i = {k} AND m.j = {k} THEN -1 / p.v WHEN m.i = {k} OR m.j = {k} THEN m.v / p.v"
                 f" ELSE m.v - a.v * b.v / p.v END AS v FROM w{k} m JOIN w{k} a ON a.i = m.i AND a.j = {k} JOIN w{k} b ON b.i = {k} AND b.j = m.j JOIN w{k} p ON p.i = {k} AND p.j = {k})")
    return text + f", inv AS (SELECT i, j, -v AS v FROM w{len(columns)})"


_NAMES = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_VIF)) + ") AS names(i, variable)"


@query("d14_vif_table", sql(BASE + prepared_sql(_VIF) + inverse_sql(_VIF), f"SELECT variable, v AS vif FROM inv JOIN {_NAMES} USING (i) WHERE inv.i = inv.j", "vif"))
def d14(spark, sf):
    return rounded(ht.vif_table(ht.prepare_for_linear(base(spark, sf), _VIF), _VIF))


def dropping_sql(steps: int, threshold: float) -> str:
    """CTEs ``k0 ...``: the column with the largest inflation of each step, if beyond the threshold;
    leaving one out turns the inverse into that of the others."""
    text = ", s0 AS (SELECT * FROM inv)"
    for t in range(steps):
        text += (f", k{t} AS (SELECT i AS k, v FROM s{t} WHERE i = j AND v > {threshold!r}::DOUBLE QUALIFY row_number() OVER (ORDER BY v DESC, i) = 1)"
                 f", s{t + 1} AS (SELECT m.i, m.j, m.v - a.v * b.v / k{t}.v AS v FROM k{t}, s{t} m JOIN s{t} a ON a.i = m.i JOIN s{t} b ON b.j = m.j WHERE a.j = k AND b.i = k AND m.i <> k AND m.j <> k)")
    return text


@query("d15_iterative_vif", sql(BASE + prepared_sql(_VIF) + inverse_sql(_VIF) + dropping_sql(len(_VIF) - 1, 5.0), "SELECT variable, round(vif, 2) AS vif, CAST(etape AS INTEGER) AS etape FROM ("
    + " UNION ALL ".join(f"SELECT k AS i, v AS vif, {t + 1} AS etape FROM k{t}" for t in range(len(_VIF) - 1)) + f") JOIN {_NAMES} USING (i)", "vif:2"))
def d15(spark, sf):
    kept, history = ht.iterative_vif(ht.prepare_for_linear(base(spark, sf), _VIF), _VIF, 5.0)
    return history


@query("d16_effect_comparison", sql(BASE + f", l0 AS ({long_sql(NUM, 'churn, partition')}), l AS (SELECT * FROM l0 WHERE partition = 'train_oof')" + RHO_Y + MW
    + ", a AS (SELECT variable, effet AS effet_a FROM mwt)"
    + (", l2 AS (SELECT * FROM l0 WHERE partition = 'test')" + RHO_Y + MW).replace(", rt AS", ", rt2 AS").replace("FROM l WHERE", "FROM l2 WHERE").replace(", rho AS", ", rho2 AS").replace("FROM rt GROUP", "FROM rt2 GROUP").replace("mw AS", "mw2 AS").replace("ti AS", "ti2 AS").replace("mu AS", "mu2 AS").replace("mz AS", "mz2 AS").replace("mwt AS", "mwt2 AS").replace("FROM mw JOIN ti USING", "FROM mw2 JOIN ti2 USING").replace("FROM mu\n", "FROM mu2\n").replace("FROM mz)", "FROM mz2)"),
    "SELECT variable, effet_a, effet AS effet_b, abs(effet_a - effet) AS ecart FROM a JOIN mwt2 USING (variable)", "effet_a effet_b ecart"))
def d16(spark, sf):
    df = base(spark, sf)
    both = ht.mann_whitney(df, NUM, by=["partition"])
    a = both.filter(F.col("partition") == "train_oof")
    b = both.filter(F.col("partition") == "test")
    return rounded(ht.effect_comparison(a, b))


@query("a07_export_tables")
def a07(spark, sf):
    df = base(spark, sf)
    uni = ht.univariate_table(df, NUM, CAT, min_n=50)
    groups = ht.clusters_table(df, NUM, 0.5)
    reps = ht.choose_representatives(groups, uni)
    _, removed = ht.iterative_vif(ht.prepare_for_linear(df, NUM), NUM, 5.0)
    return ht.export_tables(uni, reps, removed, 10)["top"]
