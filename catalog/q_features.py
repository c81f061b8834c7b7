"""Feature and preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base_sql import BASE
from catalog.q_describe import BIN_RATES, NUM, NUM_MI, PROFILE, edges_sql
from catalog.q_quality import long_sql
from catalog.registry import query, rounded, sql
from loyaltide.functions.expressions import log1p_nonneg, safe_divide, signed_log1p
from loyaltide.operators import features, preprocessing as pp, quality
from loyaltide.sources.customer_base import load_customer_base as base

WINDOW = (69, 70)


def group_query(spark, sf, group, columns):
    df = quality.negatives_to_null(base(spark, sf), ["acctbal", "rev_Mean", "totmrc_Mean",
                                                     "avg6rev", "eqpdays"])
    return rounded(features.build_features(df, [group], contract_months=WINDOW)
                   .select("customer_id", *columns))


@query("e01_safe_divide", sql(BASE, "SELECT customer_id, rev_Mean / nullif(avg3mou, 0) AS q FROM cust", "q"))
def e01(spark, sf):
    return rounded(base(spark, sf).select("customer_id", safe_divide("rev_Mean", "avg3mou")
                                          .alias("q")))


@query("e02_source_missing", BASE + " SELECT customer_id, (income IS NULL)::INT AS m_income, 0 AS m_acctbal FROM cust")
def e02(spark, sf):
    df = quality.negatives_to_null(base(spark, sf), ["acctbal"])
    return df.select("customer_id", features.source_missing(df, "income").alias("m_income"),
                     features.source_missing(df, "acctbal").alias("m_acctbal"))


@query("e03_cycle_engagement", sql(BASE, "SELECT customer_id, (months IN (69, 70))::INT AS in_contract_end, (eqpdays >= 300)::INT AS handset_old, eqpdays / (months * 30) AS eqpdays_per_tenure_day FROM cust", "eqpdays_per_tenure_day"))
def e03(spark, sf):
    return group_query(spark, sf, "cycle_engagement", ["in_contract_end", "handset_old",
                                                       "eqpdays_per_tenure_day"])


@query("e04_tendance_usage", sql(BASE, "SELECT customer_id, avg3mou / nullif(avg6mou, 0) AS ratio_mou_3m_6m, avg3rev / nullif(avg6rev, 0) AS ratio_rev_3m_6m FROM cust", "ratio_mou_3m_6m ratio_rev_3m_6m"))
def e04(spark, sf):
    return group_query(spark, sf, "tendance_usage", ["ratio_mou_3m_6m", "ratio_rev_3m_6m"])


@query("e05_qualite_reseau", sql(BASE, "SELECT customer_id, drop_blk_Mean / nullif(attempt_Mean, 0) AS drop_blk_rate, complete_Mean / nullif(attempt_Mean, 0) AS complete_rate FROM cust", "drop_blk_rate complete_rate"))
def e05(spark, sf):
    return group_query(spark, sf, "qualite_reseau", ["drop_blk_rate", "complete_rate"])


@query("e06_service_client", sql(BASE, "SELECT customer_id, (custcare_Mean > 0)::INT AS has_custcare, custcare_Mean / (mou_Mean + 1) AS custcare_per_mou FROM cust", "custcare_per_mou"))
def e06(spark, sf):
    return group_query(spark, sf, "service_client", ["has_custcare", "custcare_per_mou"])


@query("e07_forfait", sql(BASE, "SELECT customer_id, ovrrev_Mean / nullif(rev_Mean, 0) AS overage_share_rev, totmrc_Mean / nullif(rev_Mean, 0) AS recurring_share_rev FROM cust", "overage_share_rev recurring_share_rev"))
def e07(spark, sf):
    return group_query(spark, sf, "forfait", ["overage_share_rev", "recurring_share_rev"])


@query("e08_compte_terminal", sql(BASE, "SELECT customer_id, actvsubs / uniqsubs AS active_lines_share, phones / months AS phones_per_month FROM cust", "active_lines_share phones_per_month"))
def e08(spark, sf):
    return group_query(spark, sf, "compte_terminal", ["active_lines_share", "phones_per_month"])


@query("e09_indicateurs_manquants", BASE + """ SELECT customer_id, (lor IS NULL)::INT AS manquant_lor, (income IS NULL)::INT AS manquant_income, (hnd_webcap IS NULL)::INT AS manquant_hnd_webcap,
  (prizm_social_one IS NULL)::INT AS manquant_prizm_social_one, (avg6mou IS NULL)::INT AS manquant_avg6mou_bloc, (hnd_price IS NULL)::INT AS manquant_hnd_price, (area IS NULL)::INT AS manquant_area,
  0 AS "rev_Mean_was_negative", 0 AS eqpdays_was_negative FROM cust""")
def e09(spark, sf):
    return group_query(spark, sf, "indicateurs_manquants", [
        "manquant_lor", "manquant_income", "manquant_hnd_webcap", "manquant_prizm_social_one",
        "manquant_avg6mou_bloc", "manquant_hnd_price", "manquant_area", "rev_Mean_was_negative",
        "eqpdays_was_negative"])


@query("e10_deja_parti", BASE + " SELECT customer_id, (rev_Mean IS NULL)::INT AS sans_usage, (change_mou IS NULL)::INT AS change_manquant FROM cust")
def e10(spark, sf):
    return group_query(spark, sf, "deja_parti", ["sans_usage", "change_manquant"])


@query("e11_build_features", sql(BASE, """SELECT customer_id, churn, months, eqpdays / (months * 30) AS eqpdays_per_tenure_day, avg3mou / nullif(avg6mou, 0) AS ratio_mou_3m_6m,
  actvsubs / uniqsubs AS active_lines_share, (change_mou IS NULL)::INT AS change_manquant FROM cust""", "eqpdays_per_tenure_day ratio_mou_3m_6m active_lines_share"))
def e11(spark, sf):
    df = quality.negatives_to_null(base(spark, sf))
    out = features.build_features(df, None, ["area"], WINDOW)
    return rounded(out.select("customer_id", "churn", "months", "eqpdays_per_tenure_day",
                              "ratio_mou_3m_6m", "active_lines_share", "change_manquant"))


@query("e12_logs", sql(BASE, "SELECT customer_id, ln(1 + greatest(acctbal, 0)) AS l, sign(change_mou) * ln(1 + abs(change_mou)) AS s FROM cust", "l s"))
def e12(spark, sf):
    return rounded(base(spark, sf).select("customer_id", log1p_nonneg("acctbal").alias("l"),
                                          signed_log1p("change_mou").alias("s")))


@query("e13_winsorizer", sql(BASE, """SELECT customer_id, least(greatest(change_mou, lo1), hi1) AS change_mou, least(greatest(eqpdays, lo2), hi2) AS eqpdays
  FROM cust, (SELECT quantile_cont(change_mou, 0.01) lo1, quantile_cont(change_mou, 0.99) hi1, quantile_cont(CAST(eqpdays AS DOUBLE), 0.01) lo2, quantile_cont(CAST(eqpdays AS DOUBLE), 0.99) hi2 FROM cust WHERE partition = 'train_oof')""".replace("least(greatest(change_mou, lo1), hi1)", "CASE WHEN change_mou IS NOT NULL THEN least(greatest(change_mou, lo1), hi1) END"), "change_mou eqpdays"))
def e13(spark, sf):
    df = base(spark, sf)
    cols = ["change_mou", "eqpdays"]
    bounds = pp.fit_winsorizer(df.filter(F.col("partition") == "train_oof"), cols)
    return rounded(pp.winsorize(df, bounds, cols).select("customer_id", *cols))


@query("e14_median_impute", sql(BASE, """SELECT customer_id, coalesce(rev_Mean, m1) AS rev_Mean, coalesce(income, m2) AS income, (rev_Mean IS NULL)::INT AS rev_Mean_manquant, (income IS NULL)::INT AS income_manquant
  FROM cust, (SELECT median(rev_Mean) m1, CAST(median(income) AS DOUBLE) m2 FROM cust WHERE partition = 'train_oof')""", "rev_Mean income"))
def e14(spark, sf):
    df = base(spark, sf)
    cols = ["rev_Mean", "income"]
    med = pp.fit_medians(df.filter(F.col("partition") == "train_oof"), cols)
    return rounded(pp.impute_median(df, med, cols, True).select(
        "customer_id", *cols, "rev_Mean_manquant", "income_manquant"))


@query("e15_mode_impute", BASE + """ SELECT customer_id, coalesce(hnd_webcap, m) AS hnd_webcap FROM cust, (SELECT hnd_webcap AS m FROM cust WHERE hnd_webcap IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def e15(spark, sf):
    df = base(spark, sf)
    return pp.impute_mode(df, pp.fit_modes(df, ["hnd_webcap"]), ["hnd_webcap"]).select(
        "customer_id", "hnd_webcap")


@query("e16_standardize", sql(BASE, "SELECT customer_id, (rev_Mean - m1) / s1 AS rev_Mean, (eqpdays - m2) / s2 AS eqpdays FROM cust, (SELECT avg(rev_Mean) m1, stddev_pop(rev_Mean) s1, avg(eqpdays) m2, stddev_pop(eqpdays) s2 FROM cust)", "rev_Mean eqpdays"))
def e16(spark, sf):
    df = base(spark, sf)
    cols = ["rev_Mean", "eqpdays"]
    return rounded(pp.standardize(df, pp.fit_scaler(df, cols), cols).select("customer_id", *cols))


@query("e17_one_hot", BASE + """ SELECT customer_id, """ + ", ".join(f"(coalesce(hnd_webcap, 'Manquant') = '{v}')::INT AS \"hnd_webcap_{v}\"" for v in ("Manquant", "UNKW", "WCMB"))
    + ", (coalesce(hnd_webcap, 'Manquant') = 'WC')::INT AS hnd_webcap_WC FROM cust")
def e17(spark, sf):
    df = base(spark, sf).select("customer_id", "hnd_webcap")
    return pp.one_hot(df, pp.fit_levels(df, ["hnd_webcap"]), ["hnd_webcap"])


@query("e17_one_hot_infrequent", BASE + """ SELECT customer_id, (coalesce(hnd_webcap, 'Manquant') = 'WCMB')::INT AS "hnd_webcap_WCMB", (coalesce(hnd_webcap, 'Manquant') <> 'WCMB')::INT AS hnd_webcap_infrequent FROM cust""")
def e17b(spark, sf):
    df = base(spark, sf).select("customer_id", "hnd_webcap")
    return pp.one_hot(df, pp.fit_levels(df, ["hnd_webcap"], 0.3), ["hnd_webcap"], True)


@query("e18_ordinal_codes", BASE + """ SELECT customer_id, CASE prizm_social_one WHEN 'C' THEN 0 WHEN 'R' THEN 1 WHEN 'S' THEN 2 WHEN 'T' THEN 3 WHEN 'U' THEN 4 END AS code,
  CASE WHEN area = 'ASIA' THEN -1 WHEN area = 'AFRICA' THEN 0 WHEN area = 'AMERICA' THEN 1 WHEN area = 'EUROPE' THEN 2 ELSE 3 END AS zone FROM cust""")
def e18(spark, sf):
    df = base(spark, sf).select("customer_id", "prizm_social_one", "area")
    # "ASIA" is unseen in the fit rows, hence unknown.
    columns = ["prizm_social_one", "area"]
    levels = pp.fit_levels(df.filter(F.col("area") != "ASIA"), columns)
    out = pp.ordinal_codes(df, levels, columns)
    return out.select("customer_id", F.col("prizm_social_one").alias("code"),
                      F.col("area").alias("zone"))


@query("e19_category_text", BASE + " SELECT customer_id, coalesce(hnd_webcap, 'Manquant') AS hnd_webcap, coalesce(prizm_social_one, 'Manquant') AS prizm_social_one FROM cust")
def e19(spark, sf):
    return pp.category_text(base(spark, sf), ["hnd_webcap", "prizm_social_one"]).select(
        "customer_id", "hnd_webcap", "prizm_social_one")


@query("e20_spline_basis")
def e20(spark, sf):
    df = base(spark, sf).select("customer_id", "eqpdays")
    return pp.spline_basis(df, pp.fit_knots(df, ["eqpdays"]), "eqpdays")


@query("e22_binary_columns", BASE + """, f AS (SELECT customer_id, churn, months, (income IS NULL)::INT AS sans_revenu FROM cust)
  SELECT bool_and(churn IN (0, 1)) AS churn, bool_and(months IN (0, 1)) AS months, bool_and(sans_revenu IN (0, 1)) AS sans_revenu FROM f""")
def e22(spark, sf):
    df = base(spark, sf).select("churn", "months", F.col("income").isNull().cast("int")
                                .alias("sans_revenu"))
    return pp.binary_flags(df, pp.numeric_columns(df))


@query("e23_drop_columns", BASE + " SELECT customer_id, months FROM cust")
def e23(spark, sf):
    return pp.drop_columns(base(spark, sf).select("customer_id", "months", "area"),
                           ["area", "absent"])


@query("e25_leak_neutralizer", sql(BASE, """SELECT customer_id, coalesce(rev_Mean, m1) AS rev_Mean, coalesce(change_mou, m2) AS change_mou FROM cust,
  (SELECT median(rev_Mean) m1, median(change_mou) m2 FROM cust WHERE partition = 'train_oof')""", "rev_Mean change_mou"))
def e25(spark, sf):
    df = base(spark, sf).select("customer_id", "partition", "rev_Mean", "change_mou")
    cols = pp.subset(df, ["rev_Mean", "change_mou", "roam_Mean"])
    med = pp.fit_medians(df.filter(F.col("partition") == "train_oof"), cols)
    return rounded(pp.neutralize_leaks(df, med).select("customer_id", *cols))


@query("e26_active_customer", BASE + " SELECT customer_id, rev_Mean IS NOT NULL AND change_mou IS NOT NULL AS actif FROM cust")
def e26(spark, sf):
    df = quality.negatives_to_null(base(spark, sf))
    return df.select("customer_id", features.active_customer(df).alias("actif"))


@query("c26_numeric_profile", sql(BASE + f", l AS ({long_sql(NUM)})" + edges_sql(NUM) + BIN_RATES + PROFILE + NUM_MI, "SELECT nmi.variable, info_mutuelle, prof.* EXCLUDE (variable) FROM nmi LEFT JOIN prof USING (variable)", "ecart_classes_pts info_mutuelle:6"))
def c26n(spark, sf):
    return rounded(features.feature_profile(base(spark, sf), NUM, min_n=50))


@query("c26_feature_profile", sql(BASE, """SELECT v AS variable, 100 * avg(churn) FILTER (WHERE x = 1) AS taux_si_1, 100 * avg(churn) FILTER (WHERE x = 0) AS taux_si_0, 100 * avg(x) AS part_de_1 FROM (
  SELECT 'handset_old' AS v, (eqpdays >= 300)::INT AS x, churn FROM cust UNION ALL SELECT 'in_contract_end', (months IN (69, 70))::INT, churn FROM cust UNION ALL SELECT 'sans_usage', (rev_Mean IS NULL)::INT, churn FROM cust) GROUP BY 1""",
    "taux_si_1 taux_si_0 part_de_1"))
def c26(spark, sf):
    df = features.build_features(base(spark, sf), ["cycle_engagement", "deja_parti"],
                                 contract_months=WINDOW)
    return rounded(features.indicator_profile(df, ["handset_old", "in_contract_end", "sans_usage"]))
