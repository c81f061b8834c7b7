"""Cleaning, validation, audit and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base_sql import BASE, hash_sql
from catalog.registry import query, rounded, sql
from loyaltide import fixed_values as fv
from loyaltide.operators import quality, splits
from loyaltide.sources.customer_base import load_customer_base as base

NEG = ["acctbal", *fv.NEGATIVE_COLUMNS]
COLS = ["rev_Mean", "mou_Mean", "avg3rev", "avg6rev", "avg3mou", "avg6mou", "change_rev",
        "change_mou", "hnd_webcap", "prizm_social_one", "income", "lor"]
LEVELS = {"new_cell": ["U", "Y", "N"], "marital": ["U", "S", "M", "A"],
          "hnd_webcap": ["UNKW", "WCMB"], "area": ["AFRICA", "AMERICA", "ASIA", "EUROPE",
                                                   "MIDDLE EAST"]}


def erfc_sql(x: str) -> str:
    coefs = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
             0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = f"(1 / (1 + 0.5 * ({x})))"
    poly = f"({coefs[-1]}::DOUBLE)"
    for a in reversed(coefs[:-1]):
        poly = f"({poly} * {t} + ({a}))"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


@query("b01_negatives_to_null", BASE + " SELECT customer_id, " + ", ".join(
    f"CASE WHEN {c} >= 0 THEN {c} END AS {c}, CASE WHEN {c} < 0 THEN 1 ELSE 0 END AS {c}_was_negative"
    for c in NEG) + " FROM cust")
def b01(spark, sf):
    once = quality.negatives_to_null(base(spark, sf), NEG)
    return quality.negatives_to_null(once, NEG).select("customer_id", *[
        x for c in NEG for x in (c, f"{c}_was_negative")])


@query("b02_explicit_unknown", BASE + """ SELECT customer_id, CASE new_cell WHEN 'U' THEN 'Unknown' ELSE new_cell END AS new_cell,
  CASE marital WHEN 'U' THEN 'Unknown' ELSE marital END AS marital, CASE hnd_webcap WHEN 'UNKW' THEN 'Unknown' ELSE hnd_webcap END AS hnd_webcap,
  prizm_social_one, crclscod FROM cust""")
def b02(spark, sf):
    return quality.explicit_unknown(base(spark, sf)).select(
        "customer_id", "new_cell", "marital", "hnd_webcap", "prizm_social_one", "crclscod")


@query("b03_unknown_levels", BASE + """ SELECT 'marital' AS variable, marital AS niveau, count(*) AS n FROM cust WHERE marital NOT IN ('U','S','M','A') GROUP BY 2
  UNION ALL SELECT 'hnd_webcap', hnd_webcap, count(*) FROM cust WHERE hnd_webcap NOT IN ('UNKW','WCMB') GROUP BY 2""")
def b03(spark, sf):
    return quality.unknown_levels(base(spark, sf), LEVELS)


@query("b04_clean", BASE + """ SELECT customer_id, CASE WHEN acctbal >= 0 THEN acctbal END AS acctbal, CASE WHEN acctbal < 0 THEN 1 ELSE 0 END AS acctbal_was_negative,
  CASE new_cell WHEN 'U' THEN 'Unknown' ELSE new_cell END AS new_cell, rev_Mean_was_negative
  FROM (SELECT *, CASE WHEN rev_Mean < 0 THEN 1 ELSE 0 END AS rev_Mean_was_negative FROM cust)""")
def b04(spark, sf):
    out = quality.clean(base(spark, sf), {"area": LEVELS["area"]}, NEG)
    return out.select("customer_id", "acctbal", "acctbal_was_negative", "new_cell",
                      "rev_Mean_was_negative")


def _checks():
    return (quality.bound_checks({"acctbal": (0, 5000), "months": (0, 60)})
            + quality.level_checks({"marital": LEVELS["marital"]})
            + [quality.Check("actvsubs", "actvsubs_le_adjqty",
                             F.col("actvsubs") <= F.col("adjqty") - 3, "actvsubs")])


def _failure_sql(column: str, check: str, bad: str) -> str:
    return (f"SELECT '{column}' AS \"column\", '{check}' AS \"check\", CAST({column} AS VARCHAR) AS v FROM cust WHERE {bad}")


@query("b05_schema_failures", BASE + ", hits AS (" + " UNION ALL ".join([
    _failure_sql("acctbal", "greater_than_or_equal_to(0)", "acctbal < 0"),
    _failure_sql("acctbal", "in_range(0, 5000)", "acctbal NOT BETWEEN 0 AND 5000"),
    _failure_sql("months", "in_range(0, 60)", "months NOT BETWEEN 0 AND 60"),
    _failure_sql("marital", "isin", "marital NOT IN ('U','S','M','A')"),
    _failure_sql("actvsubs", "actvsubs_le_adjqty", "actvsubs > adjqty - 3")]) + """
), ex AS (SELECT "column", "check", list(v ORDER BY v)[1:5] AS e FROM (SELECT DISTINCT "column", "check", v FROM hits) GROUP BY 1, 2)
SELECT "column", "check", count(*) AS n_cas, array_to_string(any_value(e), ', ') AS exemples FROM hits JOIN ex USING ("column", "check") GROUP BY 1, 2""")
def b05(spark, sf):
    return quality.schema_failures(base(spark, sf), _checks())


_RULES = {
    "actvsubs_le_uniqsubs": ("stricte", "actvsubs > uniqsubs + 0.01"),
    "models_le_phones": ("stricte", "models > phones + 0.01"),
    "comp_vce_le_plcd_vce": ("stricte", "comp_vce_Mean > plcd_vce_Mean + 0.01"),
    "comp_dat_le_plcd_dat": ("stricte", "comp_dat_Mean > plcd_dat_Mean + 0.01"),
    "complete_le_attempt": ("stricte", "complete_Mean > attempt_Mean + 0.01"),
    "attempt_eq_plcd": ("stricte", "abs(attempt_Mean - plcd_vce_Mean - plcd_dat_Mean) > 0.01"),
    "drop_blk_eq_sum": ("stricte", "abs(drop_blk_Mean - drop_vce_Mean - drop_dat_Mean - blck_vce_Mean - blck_dat_Mean) > 0.01"),
    "adjmou_le_totmou": ("stricte", "adjmou > totmou + 0.01"),
    "adjqty_le_totcalls": ("stricte", "adjqty > totcalls + 0.01"),
    "usage_block_all_or_none": ("stricte", "(rev_Mean IS NULL)::INT + (mou_Mean IS NULL)::INT + (totmrc_Mean IS NULL)::INT + (ovrrev_Mean IS NULL)::INT + (vceovr_Mean IS NULL)::INT + (datovr_Mean IS NULL)::INT NOT IN (0, 6)"),
    "adjrev_le_totrev": ("informative", "adjrev > totrev + 0.01"),
    "ovrrev_eq_vce_dat": ("informative", "abs(ovrrev_Mean - vceovr_Mean - datovr_Mean) > 0.01"),
    "eqpdays_le_tenure": ("informative", "eqpdays > months * 31"),
    "actvsubs_ge_1": ("informative", "actvsubs < 1"),
}


@query("b06_coherence_report", sql(BASE, " UNION ALL ".join(
    f"SELECT '{r}' AS regle, '{k}' AS type, count(*) FILTER (WHERE {bad}) AS violations, "
    f"100 * count(*) FILTER (WHERE {bad}) / count(*) AS pct FROM cust" for r, (k, bad) in _RULES.items()), "pct"))
def b06(spark, sf):
    return rounded(quality.coherence_report(base(spark, sf)))


_YEAR = ["rev_Mean", "mou_Mean", "avg3rev", "avg6rev", "avg3mou", "avg6mou", "change_rev",
         "change_mou"]


@query("b07_missing_patterns", sql(BASE, " UNION ALL ".join(
    [f"SELECT 'rev_Mean' AS groupe, 8 AS n_colonnes, count(*) FILTER (WHERE rev_Mean IS NULL) AS n_manquants, "
     f"100 * count(*) FILTER (WHERE rev_Mean IS NULL) / count(*) AS pct, '{', '.join(_YEAR)}' AS colonnes FROM cust"]
    + [f"SELECT '{c}', 1, count(*) FILTER (WHERE {c} IS NULL), 100 * count(*) FILTER (WHERE {c} IS NULL) / count(*), '{c}' FROM cust"
       for c in COLS[8:]]), "pct"))
def b07(spark, sf):
    return rounded(quality.missing_patterns(base(spark, sf), COLS))


_NC = ["rev_Mean", "hnd_webcap", "prizm_social_one", "income", "lor"]


@query("b08_nullity_correlation", sql(BASE, " UNION ALL ".join(
    f"SELECT '{a}' AS var_1, '{b}' AS var_2, corr(({a} IS NULL)::INT, ({b} IS NULL)::INT) AS rho FROM cust"
    for i, a in enumerate(_NC) for b in _NC[i + 1:]), "rho"))
def b08(spark, sf):
    return rounded(quality.nullity_correlation(base(spark, sf), _NC))


@query("b09_source_missing_view", BASE + """ SELECT 'acctbal' AS variable, CAST(0 AS BIGINT) AS n FROM (SELECT 1)
  UNION ALL SELECT 'rev_Mean', count(*) FILTER (WHERE rev_Mean IS NULL) FROM cust""")
def b09(spark, sf):
    view = quality.source_missing_view(quality.negatives_to_null(base(spark, sf), NEG),
                                       ["acctbal", "rev_Mean"])
    return view.agg(F.count_if(F.col("acctbal").isNull()).alias("acctbal"),
                    F.count_if(F.col("rev_Mean").isNull()).alias("rev_Mean")).unpivot(
        [], ["acctbal", "rev_Mean"], "variable", "n")


@query("b10_missing_vs_target", sql(BASE + ", mv AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} IS NULL AS miss, churn FROM cust" for c in _NC) + """
), mc AS (SELECT variable, CAST(count(*) AS DOUBLE) AS n, CAST(sum(churn) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE miss) AS DOUBLE) AS k,
    CAST(sum(churn) FILTER (WHERE miss) AS DOUBLE) AS kp FROM mv GROUP BY 1
), mt AS (SELECT variable, 100 * k / n AS pct_manquant, 100 * kp / k AS churn_si_manquant, 100 * (pos - kp) / (n - k) AS churn_si_present,
    n * (kp * (n - k - pos + kp) - (k - kp) * (pos - kp)) ** 2 / (k * (n - k) * pos * (n - pos)) AS chi2, n FROM mc
), mp AS (SELECT *, """ + erfc_sql("sqrt(chi2 / 2)") + """ AS p_value FROM mt
), ms AS (SELECT *, row_number() OVER (ORDER BY p_value, variable) AS i, count(*) OVER () AS m FROM mp
), mh AS (SELECT *, least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS p_holm FROM ms)""",
    """SELECT variable, pct_manquant, churn_si_manquant, churn_si_present, churn_si_manquant - churn_si_present AS ecart_pts, chi2, sqrt(chi2 / n) AS cramers_v,
  p_value, p_holm, p_holm <= 0.05 AS significatif FROM mh""",
    "pct_manquant churn_si_manquant churn_si_present ecart_pts chi2 cramers_v p_value p_holm"))
def b10(spark, sf):
    return rounded(quality.missing_vs_target(base(spark, sf), _NC))


@query("b11_missing_indicators", BASE + " SELECT customer_id, (rev_Mean IS NULL)::INT AS manquant_rev, (income IS NULL)::INT AS manquant_income FROM cust")
def b11(spark, sf):
    return quality.missing_indicators(base(spark, sf), {"manquant_rev": "rev_Mean",
                                                        "manquant_income": "income"},
                                      ["customer_id"])


_DUP = ["months", "crclscod", "area", "marital"]


@query("b12_duplicates_summary", BASE + f""" SELECT CAST(count(*) - count(DISTINCT customer_id) AS BIGINT) AS doublons_id,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_DUP)} FROM cust)) AS BIGINT) AS doublons_lignes_hors_id FROM cust""")
def b12(spark, sf):
    return quality.duplicates_summary(base(spark, sf).select("customer_id", *_DUP))


_OUT = ["rev_Mean", "totmrc_Mean", "mou_Mean", "change_mou", "custcare_Mean", "eqpdays", "months"]


def long_sql(columns: list[str], keep: str = "churn", source: str = "cust") -> str:
    return " UNION ALL ".join(
        f"SELECT {keep + ', ' if keep else ''}'{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns)


@query("b13_outlier_summary", sql(BASE + f", l AS ({long_sql(_OUT)}), q AS (" + """
  SELECT variable, min(value) AS min, quantile_cont(value, 0.25) AS q25, median(value) AS mediane, quantile_cont(value, 0.75) AS q75,
    quantile_cont(value, 0.999) AS q999, max(value) AS max, skewness(value) AS asymetrie FROM l WHERE value IS NOT NULL GROUP BY 1)""",
    """SELECT q.*, max / nullif(q999, 0) AS max_sur_q999, (SELECT count(*) FROM l WHERE l.variable = q.variable AND value > q999) AS n_sup_q999,
  (SELECT 100 * avg((value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25))::INT) FROM l WHERE l.variable = q.variable AND value IS NOT NULL) AS pct_hors_tukey FROM q""",
    "min q25 mediane q75 q999 max asymetrie max_sur_q999 pct_hors_tukey"))
def b13(spark, sf):
    return rounded(quality.outlier_summary(base(spark, sf), _OUT))


@query("b14_split_train_test", BASE + " SELECT customer_id, partition AS part FROM cust")
def b14(spark, sf):
    return splits.split_train_test(base(spark, sf).select("customer_id", "churn"), name="part") \
        .select("customer_id", "part")


@query("b15_split_summary", sql(BASE, """SELECT partition, count(*) AS n, avg(churn) AS taux, count(*) / (SELECT count(*) FROM cust) AS part,
  CAST(0 AS BIGINT) AS ids_communs FROM cust GROUP BY 1""", "taux part"))
def b15(spark, sf):
    return rounded(splits.split_summary(base(spark, sf)))


@query("b16_tenure_of_missing", BASE + " SELECT months, count(*) AS n FROM cust WHERE avg6mou IS NULL GROUP BY 1")
def b16(spark, sf):
    return quality.tenure_of_missing(base(spark, sf))


@query("f01_make_folds", BASE + f""" SELECT customer_id, CAST(row_number() OVER (PARTITION BY churn ORDER BY {hash_sql('customer_id', 7)}, customer_id) % 4 AS INTEGER) AS pli FROM cust""")
def f01(spark, sf):
    return splits.make_folds(base(spark, sf).select("customer_id", "churn"), 4, seed=7,
                             name="pli").select("customer_id", "pli")


@query("a02_base_profile", sql(BASE, """SELECT churn, count(*) AS n, 100 * count(*) / (SELECT count(*) FROM cust) AS pct,
  (SELECT count(*) = count(DISTINCT customer_id) FROM cust) AS id_unique FROM cust GROUP BY 1""", "pct"))
def a02(spark, sf):
    from loyaltide.sources import tables
    return rounded(tables.base_profile(base(spark, sf)))
