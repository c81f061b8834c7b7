"""Explanation queries over the contribution and factor tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base_sql import EXPLAINED, STORE
from catalog.q_describe import edges_sql
from catalog.registry import query, rounded, sql
from loyaltide.operators import describe, explain, features
from loyaltide.plans import score_table
from loyaltide.plans.score_table import load_store

WINDOW = (69, 70)


def feature_rows(spark, sf):
    df = features.build_features(load_store(spark, sf).scores,
                                 ["cycle_engagement", "tendance_usage", "service_client"],
                                 contract_months=WINDOW)
    return df.select("customer_id", "churn", "partition", *score_table.EXPLAINED)


def feature_contributions(spark, sf):
    rows = feature_rows(spark, sf)
    coefs = explain.class_gap_coefficients(rows.filter(F.col("partition") == "train_oof"),
                                           score_table.EXPLAINED)
    return explain.linear_contributions(rows, coefs, score_table.EXPLAINED)


@query("h02_linear_contributions", sql(STORE, "SELECT customer_id, feature, contribution FROM feature_contrib", "contribution"))
def h02(spark, sf):
    return rounded(feature_contributions(spark, sf))


@query("h03_source_variable", STORE + """ SELECT DISTINCT feature, CASE feature WHEN 'in_contract_end' THEN 'months' WHEN 'ratio_mou_3m_6m' THEN 'avg3mou'
  WHEN 'has_custcare' THEN 'custcare_Mean' ELSE feature END AS variable FROM feature_contrib""")
def h03(spark, sf):
    return feature_contributions(spark, sf).select(
        "feature", explain.source_variable(F.col("feature")).alias("variable")).distinct()


@query("h04_grouped", sql(STORE, "SELECT * FROM contrib", "contribution"))
def h04(spark, sf):
    return rounded(explain.grouped(feature_contributions(spark, sf)))


@query("h05_global_importance", sql(STORE, """SELECT variable, shap_abs_moyen, round_even(100 * shap_abs_moyen / sum(shap_abs_moyen) OVER (), 1) AS part_pct
  FROM (SELECT variable, avg(abs(contribution)) AS shap_abs_moyen FROM contrib GROUP BY 1)""", "shap_abs_moyen part_pct"))
def h05(spark, sf):
    return rounded(explain.global_importance(load_store(spark, sf).contributions).drop("libelle"))


@query("h06_reason_codes", sql(STORE, """SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, variable) AS rang, variable,
  'augmente le risque' AS effet, contribution FROM contrib WHERE contribution > 0 QUALIFY rang <= 3""", "contribution"))
def h06(spark, sf):
    return rounded(explain.reason_codes(load_store(spark, sf).contributions, 3, "increase")
                   .drop("libelle"))


@query("h07_family", STORE + " SELECT DISTINCT variable, in_contract_end = 1 AS fenetre, famille FROM fam JOIN feats USING (customer_id)")
def h07(spark, sf):
    store = load_store(spark, sf)
    window = store.scores.select("customer_id", F.col("months").isin(*WINDOW).alias("fenetre"))
    rows = store.contributions.join(window, "customer_id").select("variable", "fenetre").distinct()
    return rows.withColumn("famille", explain.family(F.col("variable"), F.col("fenetre")))


@query("h08_explain_clients", sql(STORE, """SELECT customer_id, variable, contribution, famille, actionnable, rang, rang_raison, rang_contexte FROM ranked_f
  WHERE rang <= 8 OR rang_raison <= 3 OR rang_contexte <= 2""", "contribution"))
def h08(spark, sf):
    store = load_store(spark, sf)
    window = store.scores.select("customer_id", F.col("months").isin(*WINDOW).alias("in_window"))
    return rounded(explain.factor_table(store.contributions, window).select(
        "customer_id", "variable", "contribution", "famille", "actionnable", "rang", "rang_raison",
        "rang_contexte"))


@query("h09_suggest_action", STORE + " SELECT customer_id, action FROM scores")
def h09(spark, sf):
    return load_store(spark, sf).scores.select("customer_id", explain.suggest_action(
        F.col("niveau"), F.col("famille_dominante")).alias("action"))


def _fr(x: str, d: int = 0) -> str:
    return f"replace(replace(format('{{:,.{d}f}}', CAST({x} AS DOUBLE)), ',', ' '), '.', ',')"


PHRASES = f"""CASE variable
  WHEN 'months' THEN CASE WHEN in_contract_end = 1 THEN 'Fin d''engagement : ' || months || ' mois d''ancienneté' ELSE 'Ancienneté : ' || months || ' mois' END
  WHEN 'eqpdays' THEN CASE WHEN eqpdays >= 300 THEN 'Terminal ancien : ' ELSE 'Terminal récent : ' END || {_fr('eqpdays / 30.4')} || ' mois'
  WHEN 'change_mou' THEN coalesce('Usage en ' || CASE WHEN change_mou < 0 THEN 'baisse' ELSE 'hausse' END || ' de ' || {_fr('abs(change_mou)')} || ' minutes par mois', 'Évolution de l''usage non mesurée')
  WHEN 'avg3mou' THEN coalesce('Usage en ' || CASE WHEN 100 * (ratio_mou_3m_6m - 1) < 0 THEN 'baisse' ELSE 'hausse' END || ' de ' || {_fr('abs(100 * (ratio_mou_3m_6m - 1))')} || ' % (3 derniers mois contre 6 mois)', 'Tendance d''usage récente non mesurée')
  WHEN 'totmrc_Mean' THEN 'Forfait : ' || {_fr('totmrc_Mean')} || ' $ par mois'
  WHEN 'rev_Mean' THEN coalesce('Facture : ' || {_fr('rev_Mean')} || ' $ par mois', 'Facture inconnu')
  WHEN 'ovrrev_Mean' THEN 'Dépassements : ' || {_fr('ovrrev_Mean')} || ' $ par mois'
  WHEN 'drop_vce_Mean' THEN 'Appels coupés : ' || {_fr('drop_vce_Mean', 1)} || ' par mois'
  WHEN 'custcare_Mean' THEN 'Appels au service client : ' || {_fr('custcare_Mean', 1)} || ' par mois'
  WHEN 'hnd_price' THEN coalesce('Terminal à ' || {_fr('hnd_price')} || ' $', 'Prix du terminal inconnu')
  WHEN 'actvsubs' THEN actvsubs || ' ligne(s) active(s) sur ' || uniqsubs
  WHEN 'uniqsubs' THEN CASE WHEN uniqsubs <= 1 THEN uniqsubs || ' ligne ouverte sur le compte' ELSE uniqsubs || ' lignes ouvertes sur le compte' END
  WHEN 'income' THEN coalesce('Tranche de revenu : ' || income, 'Tranche de revenu : non renseigné')
  WHEN 'lor' THEN coalesce('Durée de résidence : ' || lor || CASE WHEN lor <= 1 THEN ' an' ELSE ' ans' END, 'Durée de résidence inconnue') END"""

OUTLIERS = """, ol AS (SELECT feature AS variable, count(DISTINCT value) AS levels, min(value) AS lo, quantile_cont(value, 0.999) AS high, quantile_cont(value, 0.001) AS q FROM long WHERE partition = 'train_oof' AND value IS NOT NULL GROUP BY 1
), ot AS (SELECT variable, high, CASE WHEN lo < 0 OR variable = 'ratio_mou_3m_6m' THEN q END AS low FROM ol WHERE levels > 2)"""


@query("h10_describe_phrases", STORE + f" SELECT customer_id, variable, {PHRASES} AS phrase FROM contrib JOIN feats USING (customer_id)")
def h10(spark, sf):
    store = load_store(spark, sf)
    return explain.with_sentences(store.contributions.select("customer_id", "variable"),
                                  feature_rows(spark, sf), list(score_table.EXPLAINED)) \
        .select("customer_id", "variable", "phrase")


@query("h11_outlier_thresholds", sql(STORE + OUTLIERS, "SELECT * FROM ot", "high low"))
def h11(spark, sf):
    rows = feature_rows(spark, sf).filter(F.col("partition") == "train_oof")
    return rounded(explain.outlier_thresholds(rows, score_table.EXPLAINED))


@query("h12_is_atypical", STORE + OUTLIERS + """ SELECT customer_id, c.variable, coalesce(value > high OR coalesce(value < low, false), false) AS atypique FROM contrib c
  LEFT JOIN long l USING (customer_id) LEFT JOIN ot ON ot.variable = l.feature WHERE l.feature = CASE c.variable WHEN 'avg3mou' THEN 'ratio_mou_3m_6m' ELSE c.variable END""")
def h12(spark, sf):
    store = load_store(spark, sf)
    return explain.with_sentences(store.contributions.select("customer_id", "variable"),
                                  feature_rows(spark, sf), list(score_table.EXPLAINED),
                                  store.outliers).select("customer_id", "variable", "atypique")


@query("h13_waterfall", sql(STORE + """, wr AS (SELECT customer_id, least(row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, variable), 6) AS rang, variable, contribution FROM contrib
), ws AS (SELECT customer_id, rang, CASE WHEN rang <= 5 THEN max(variable) END AS variable, count(*) AS n_variables, sum(contribution) AS contribution FROM wr GROUP BY 1, 2)""",
    """SELECT ws.*, valeur_base, valeur_base + sum(contribution) OVER (PARTITION BY customer_id) AS log_odds, 1 / (1 + exp(-(valeur_base + sum(contribution) OVER (PARTITION BY customer_id)))) AS proba
  FROM ws JOIN scores USING (customer_id) WHERE niveau = 'High'""", "contribution valeur_base log_odds proba"))
def h13(spark, sf):
    store = load_store(spark, sf)
    high = store.scores.filter(F.col("niveau") == "High")
    return rounded(explain.waterfall(store.contributions, store.scores.select(
        "customer_id", "valeur_base"), high, 5))


@query("h15_contribution_by_bin", sql(STORE + ", l AS (SELECT customer_id, 'eqpdays' AS variable, CAST(eqpdays AS DOUBLE) AS value FROM scores)" + edges_sql(["eqpdays"]),
    """SELECT CAST(classe AS INTEGER) AS classe, count(*) AS n, avg(contribution) AS contribution_moyenne, 100 * sum(abs(contribution)) / sum(sum(abs(contribution))) OVER () AS part_abs_pct
  FROM bins JOIN contrib USING (customer_id, variable) GROUP BY 1""", "contribution_moyenne part_abs_pct"))
def h15(spark, sf):
    store = load_store(spark, sf)
    bins = describe.quantile_bins(store.scores, ["eqpdays"], 10, ["customer_id"]).select(
        "customer_id", "classe")
    return rounded(explain.mean_contribution_by_bin(store.contributions, bins, "eqpdays"))


@query("h16_rank_confrontation", STORE + """, im AS (SELECT variable, rank() OVER (ORDER BY avg(abs(contribution)) DESC) AS rang_contribution FROM contrib GROUP BY 1
), mx AS (SELECT variable, max(abs(contribution)) AS m FROM contrib GROUP BY 1), mr AS (SELECT variable, rank() OVER (ORDER BY m DESC) AS rang_extreme FROM mx)
SELECT * FROM im JOIN mr USING (variable)""")
def h16(spark, sf):
    c = load_store(spark, sf).contributions
    extreme = c.groupBy("variable").agg(F.max(F.abs("contribution")).alias("m"))
    return explain.rank_confrontation(
        ("contribution", explain.global_importance(c), "shap_abs_moyen"), ("extreme", extreme, "m"))


@query("h17_quantile_exemplars", sql(STORE + """, qt AS (SELECT unnest([0.975::DOUBLE, 0.5, 0.025]) AS q, unnest((SELECT quantile_cont(proba_calibree, [0.975, 0.5, 0.025]) FROM scores)) AS t
), pk AS (SELECT q, customer_id, proba_calibree FROM scores, qt QUALIFY row_number() OVER (PARTITION BY q ORDER BY abs(proba_calibree - t), customer_id) = 1)""",
    "SELECT q, customer_id, proba_calibree, (SELECT 100 * avg((s.proba_calibree < pk.proba_calibree)::INT) FROM scores s) AS pct_inferieur FROM pk", "q proba_calibree pct_inferieur"))
def h17(spark, sf):
    return rounded(explain.quantile_exemplars(load_store(spark, sf).scores))


@query("h18_high_reasons", sql(STORE, """SELECT variable, count(*) AS n, 100 * count(*) / (SELECT count(*) FROM scores WHERE niveau = 'High') AS pct
  FROM ranked_f JOIN scores USING (customer_id) WHERE niveau = 'High' AND rang_raison <= 3 GROUP BY 1""", "pct"))
def h18(spark, sf):
    store = load_store(spark, sf)
    return rounded(explain.high_reasons(store.scores, store.factors).drop("libelle"))


@query("h18_high_context", sql(STORE, """SELECT variable, count(*) AS n, 100 * count(*) / sum(count(*)) OVER () AS pct
  FROM ranked_f JOIN scores USING (customer_id) WHERE niveau = 'High' AND rang_contexte = 1 GROUP BY 1""", "pct"))
def h18b(spark, sf):
    store = load_store(spark, sf)
    return rounded(explain.high_context(store.scores, store.factors))
