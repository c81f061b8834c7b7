"""Portfolio, campaign and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base_sql import STORE
from catalog.registry import query, rounded, sql
from loyaltide import fixed_values as fv
from loyaltide.operators import customers, dashboards, portfolio
from loyaltide.plans import score_table
from loyaltide.plans.score_table import load_store

WINDOW = (69, 70)
FILTERS = {"area": ["ASIA", "EUROPE"], "risk_level": ["High", "Medium", "Low"]}
WHERE = "area IN ('ASIA', 'EUROPE') AND niveau IN ('High', 'Medium', 'Low')"


def scores(spark, sf):
    return load_store(spark, sf).scores


W = "poids_portefeuille"
SUMS = f"""count(*) AS n_rows, coalesce(sum({W}), 0) AS n_portfolio_equiv, coalesce(sum({W} * proba_reelle), 0) AS churners_attendus,
  coalesce(sum({W} * 0.02::DOUBLE), 0) AS churners_hasard, coalesce(sum({W} * churn), 0) AS churners_observes,
  coalesce(sum({W} * revenu_en_jeu), 0) AS revenu_en_jeu, coalesce(sum({W} * coalesce(rev_Mean, 0)), 0) AS facture_mensuelle"""
SUM_COLS = ("n_portfolio_equiv churners_attendus churners_hasard churners_observes "
            "revenu_en_jeu:2 facture_mensuelle:1")
DIG = {"revenu_en_jeu": 2, "facture_mensuelle": 1}


@query("j01_is_inactive", STORE + " SELECT inactif, count(*) AS n FROM scores GROUP BY 1")
def j01(spark, sf):
    return scores(spark, sf).groupBy(portfolio.is_inactive().alias("inactif")).agg(
        F.count(F.lit(1)).alias("n"))


@query("j05_revenue_at_risk", sql(
    STORE, "SELECT customer_id, proba_reelle * coalesce(rev_Mean, 0) AS revenu FROM scores", "revenu:3"))
def j05(spark, sf):
    return rounded(scores(spark, sf).select("customer_id", portfolio.revenue_at_risk()
                                            .alias("revenu")), revenu=3)


@query("j06_portfolio_weights", sql(STORE, """SELECT customer_id, CASE WHEN churn = 1 THEN u ELSE d END * 100000 / (pos * u + (n - pos) * d) AS poids
  FROM scores, (SELECT *, 0.02::DOUBLE / (CAST(pos AS DOUBLE) / n) AS u, (1 - 0.02::DOUBLE) / (1 - CAST(pos AS DOUBLE) / n) AS d
    FROM (SELECT sum(churn) AS pos, count(*) AS n FROM scores))""", "poids"))
def j06(spark, sf):
    return rounded(portfolio.with_portfolio_weights(scores(spark, sf), name="poids")
                   .select("customer_id", "poids"))


def curve_sql(caps: list[float], source: str = "scores", extra: str = "") -> str:
    grid = ", ".join(f"({c}::DOUBLE)" for c in caps)
    return f""", tot AS (SELECT sum({W}) AS w, sum({W} * proba_reelle) AS e, sum({W} * revenu_en_jeu) AS r FROM {source}
), act AS (
  SELECT *, (sum({W}) OVER (ORDER BY proba_calibree DESC, customer_id ROWS UNBOUNDED PRECEDING) - {W}) / (SELECT w FROM tot) AS before
  FROM {source} WHERE NOT inactif
), caps AS (SELECT * FROM (VALUES {grid}) t(capacite)
), curve AS (
  SELECT capacite, count(customer_id) AS n_rows, coalesce(sum({W}), 0) AS n_portfolio_equiv, coalesce(sum({W} * proba_reelle), 0) AS churners_attendus,
    coalesce(sum({W} * 0.02::DOUBLE), 0) AS churners_hasard, coalesce(sum({W} * churn), 0) AS churners_observes,
    coalesce(sum({W} * revenu_en_jeu), 0) AS revenu_en_jeu, coalesce(sum({W} * coalesce(rev_Mean, 0)), 0) AS facture_mensuelle,
    sum({W} * proba_reelle) / nullif(sum({W} * 0.02::DOUBLE), 0) AS facteur_vs_hasard,
    sum({W} * proba_reelle) / (SELECT e FROM tot) AS part_churners_attendus,
    sum({W} * revenu_en_jeu) / (SELECT r FROM tot) AS part_revenu_en_jeu
  FROM caps LEFT JOIN act ON before < capacite - 1e-12 GROUP BY capacite
)"""


CURVE_COLS = ("capacite " + SUM_COLS
              + " facteur_vs_hasard part_churners_attendus part_revenu_en_jeu")


@query("j07_campaign_curve", sql(STORE + curve_sql([0.01, 0.05, 0.1, 0.2, 0.5, 1.0]),
                                 "SELECT * FROM curve", CURVE_COLS))
def j07(spark, sf):
    return rounded(portfolio.campaign_curve(scores(spark, sf), [0.01, 0.05, 0.1, 0.2, 0.5, 1.0]),
                   **DIG)


TABLE = curve_sql([0.05, 0.1, 0.2]) + f""", lines AS (
  SELECT 'Inactifs (vérification / reconquête)' AS groupe, NULL::DOUBLE AS capacite, {SUMS} FROM scores WHERE inactif
  UNION ALL SELECT 'Portefeuille entier', NULL, {SUMS} FROM scores
), ctable AS (
  SELECT 'Top ' || CAST(round(100 * capacite) AS INTEGER) || ' % (actifs)' AS groupe, * FROM curve
  UNION ALL BY NAME SELECT l.*, churners_attendus / churners_hasard AS facteur_vs_hasard, churners_attendus / e AS part_churners_attendus, revenu_en_jeu / r AS part_revenu_en_jeu
  FROM lines l, tot
)"""


@query("j08_campaign_table", sql(STORE + TABLE, "SELECT * FROM ctable", CURVE_COLS))
def j08(spark, sf):
    return rounded(portfolio.campaign_table(scores(spark, sf)), **DIG)


GROUP = """, g AS (SELECT niveau, """ + SUMS + """, avg(churn) AS churn_observe_base FROM scores GROUP BY niveau
), lv AS (SELECT unnest(['High', 'Medium', 'Low', 'Inactif']) AS niveau
), gs AS (SELECT lv.niveau, coalesce(n_portfolio_equiv / sum(n_portfolio_equiv) OVER (), 0) AS part_portefeuille,
    coalesce(n_rows / sum(n_rows) OVER (), 0) AS part_lignes, churners_attendus / nullif(n_portfolio_equiv, 0) AS proba_reelle_moyenne,
    churn_observe_base, coalesce(n_rows, 0) AS n_rows, coalesce(n_portfolio_equiv, 0) AS n_portfolio_equiv,
    coalesce(churners_attendus, 0) AS churners_attendus, coalesce(revenu_en_jeu, 0) AS revenu_en_jeu, coalesce(facture_mensuelle, 0) AS facture_mensuelle,
    coalesce(churners_attendus / sum(churners_attendus) OVER (), 0) AS part_churners_attendus,
    coalesce(revenu_en_jeu / sum(revenu_en_jeu) OVER (), 0) AS part_revenu_en_jeu
  FROM lv LEFT JOIN g USING (niveau))"""
_GCOLS = ("part_portefeuille part_lignes proba_reelle_moyenne churn_observe_base n_portfolio_equiv "
          "churners_attendus revenu_en_jeu:2 facture_mensuelle:1 part_churners_attendus "
          "part_revenu_en_jeu")


@query("j09_tier_summary", sql(STORE + GROUP, "SELECT * FROM gs", _GCOLS))
def j09(spark, sf):
    return rounded(portfolio.tier_summary(scores(spark, sf)), **DIG)


@query("j09_group_summary_segment", sql(
    STORE + GROUP.replace("lv LEFT JOIN g USING", "g lv JOIN (SELECT niveau FROM g) z USING")
    .replace("GROUP BY niveau", "GROUP BY ALL").replace("SELECT niveau, count", "SELECT segment AS niveau, count"),
    "SELECT niveau AS segment, * EXCLUDE (niveau) FROM gs", _GCOLS))
def j09b(spark, sf):
    return rounded(portfolio.group_summary(scores(spark, sf), "segment"), **DIG)


@query("j10_tier_by_partition", sql(STORE, """SELECT niveau,
  avg(churn) FILTER (WHERE partition = 'train_oof') AS train_oof_taux, nullif(count(*) FILTER (WHERE partition = 'train_oof'), 0) / (SELECT count(*) FROM scores WHERE partition = 'train_oof') AS train_oof_part,
  avg(churn) FILTER (WHERE partition = 'test') AS test_taux, nullif(count(*) FILTER (WHERE partition = 'test'), 0) / (SELECT count(*) FROM scores WHERE partition = 'test') AS test_part
  FROM scores GROUP BY niveau""", "train_oof_taux train_oof_part test_taux test_part"))
def j10(spark, sf):
    return rounded(portfolio.tier_by_partition(scores(spark, sf)))


@query("j12_display_bands", STORE + """ SELECT tenure_band, handset_age_band, usage_band, count(*) AS n FROM scores GROUP BY ALL""")
def j12(spark, sf):
    df = scores(spark, sf).drop("tenure_band", "handset_age_band", "usage_band")
    return score_table.with_display_bands(df).groupBy(
        "tenure_band", "handset_age_band", "usage_band").agg(F.count(F.lit(1)).alias("n"))


@query("j13_filtered_rows", STORE + f" SELECT customer_id FROM scores WHERE {WHERE}")
def j13(spark, sf):
    return dashboards.apply_filters(scores(spark, sf), FILTERS).select("customer_id")


@query("j14_dimension_values", STORE + """ SELECT value, n_rows, CAST(row_number() OVER (ORDER BY n_rows DESC, value) AS INTEGER) AS position
  FROM (SELECT area AS value, count(*) AS n_rows FROM scores GROUP BY 1)""")
def j14(spark, sf):
    return dashboards.dimension_values(scores(spark, sf), "area")


def group_rows_sql(keys: str, where: str = "true") -> str:
    return f""", gr AS (SELECT {keys}, count(*) AS n_rows, sum({W}) AS n_portfolio_equiv, sum({W} * proba_reelle) AS expected_churners,
    sum({W} * revenu_en_jeu) AS revenue_at_risk, sum({W} * coalesce(rev_Mean, 0)) AS monthly_bill,
    sum({W}) / sum(sum({W})) OVER () AS share_of_portfolio, CAST(sum(churn) AS DOUBLE) / count(*) AS observed_churn_rate_in_base,
    sum({W} * proba_reelle) / sum({W}) AS expected_churn_rate,
    coalesce(sum({W}) FILTER (WHERE niveau = 'High'), 0) / sum({W}) AS share_high,
    sum({W} * proba_reelle) / sum(sum({W} * proba_reelle)) OVER () AS share_of_expected_churners,
    sum({W} * revenu_en_jeu) / sum(sum({W} * revenu_en_jeu)) OVER () AS share_of_revenue_at_risk
  FROM scores WHERE {where} GROUP BY {keys})"""


GR_COLS = ("n_portfolio_equiv expected_churners revenue_at_risk:2 monthly_bill:1 share_of_portfolio "
           "observed_churn_rate_in_base expected_churn_rate share_high share_of_expected_churners "
           "share_of_revenue_at_risk")
GR_DIG = {"revenue_at_risk": 2, "monthly_bill": 1, "revenue_at_risk_monthly": 2}


@query("j15_group_rows", sql(STORE + group_rows_sql("niveau, area"), "SELECT * FROM gr", GR_COLS))
def j15(spark, sf):
    return rounded(dashboards.group_rows(scores(spark, sf), ["niveau", "area"]), **GR_DIG)


@query("j16_kpis", sql(STORE, f"""SELECT count(*) AS n_rows, sum({W}) AS n_portfolio_equiv, sum({W} * proba_reelle) AS expected_churners,
  avg(churn) AS observed_churn_rate_in_base, sum({W} * revenu_en_jeu) AS revenue_at_risk_monthly, sum({W} * coalesce(rev_Mean, 0)) AS monthly_bill,
  count(*) FILTER (WHERE inactif) AS inactive_n_rows, sum({W}) / 100000 AS share_of_portfolio, sum({W} * proba_reelle) / sum({W}) AS expected_churn_rate,
  sum({W} * revenu_en_jeu) / sum({W} * coalesce(rev_Mean, 0)) AS revenue_at_risk_share_of_bill FROM scores WHERE {WHERE}""",
    "n_portfolio_equiv expected_churners observed_churn_rate_in_base revenue_at_risk_monthly:2 monthly_bill:1 share_of_portfolio expected_churn_rate revenue_at_risk_share_of_bill"))
def j16(spark, sf):
    return rounded(dashboards.kpis(scores(spark, sf), FILTERS), **GR_DIG)


@query("j16_kpis_by_level", sql(
    STORE + group_rows_sql("niveau", "area IN ('ASIA', 'EUROPE')"),
    "SELECT niveau, coalesce(n_rows, 0) AS n_rows, coalesce(n_portfolio_equiv, 0) AS n_portfolio_equiv, "
    "gr.* EXCLUDE (niveau, n_rows, n_portfolio_equiv) "
    "FROM (SELECT unnest(['High', 'Medium', 'Low', 'Inactif']) AS niveau) LEFT JOIN gr USING (niveau)", GR_COLS))
def j16b(spark, sf):
    sub = dashboards.apply_filters(scores(spark, sf), {"area": ["ASIA", "EUROPE"]})
    return rounded(dashboards.by_risk_level(sub), **GR_DIG)


@query("j16_official_campaign", sql(
    STORE + f", sub AS (SELECT * FROM scores WHERE {WHERE})" + curve_sql([0.1], "sub"),
    "SELECT 100 * capacite AS capacity_pct, n_rows AS targeted_n_rows, n_portfolio_equiv AS targeted_n_portfolio_equiv, "
    "churners_attendus AS expected_churners, 1000 * churners_attendus / n_portfolio_equiv AS churners_per_1000_contacted, "
    "20.0::DOUBLE AS random_churners_per_1000_contacted, facteur_vs_hasard AS lift_vs_random, revenu_en_jeu AS revenue_at_risk_monthly FROM curve",
    "capacity_pct targeted_n_portfolio_equiv expected_churners churners_per_1000_contacted random_churners_per_1000_contacted lift_vs_random revenue_at_risk_monthly:2"))
def j16c(spark, sf):
    return rounded(dashboards.official_campaign(scores(spark, sf), FILTERS), **GR_DIG)


@query("j17_filter_options", STORE + " " + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {c} AS value, count(*) AS n_rows FROM scores GROUP BY 2"
    for d, c in fv.DIMENSIONS.items()))
def j17(spark, sf):
    return dashboards.filter_options(scores(spark, sf))


_HIST = STORE + f""", h AS (SELECT least(CAST(floor(100 * proba_reelle / 0.5::DOUBLE) AS INTEGER), 30) AS bin, count(*) AS n_rows, sum({W}) AS n_portfolio_equiv,
""" + ", ".join(f"coalesce(sum({W}) FILTER (WHERE niveau = '{t}'), 0) AS \"n_{t}\"" for t in fv.TIERS) + f"""
  FROM scores WHERE {WHERE} GROUP BY 1)"""


@query("j18_risk_histogram", sql(
    _HIST, "SELECT CAST(i AS INTEGER) AS bin, i * 0.5::DOUBLE AS p_real_min_pct, CASE WHEN i < 30 THEN (i + 1) * 0.5::DOUBLE END AS p_real_max_pct, "
    "coalesce(n_rows, 0) AS n_rows, coalesce(n_portfolio_equiv, 0) AS n_portfolio_equiv, "
    + ", ".join(f'coalesce("n_{t}", 0) AS "n_{t}"' for t in fv.TIERS)
    + " FROM range(0, 31) g(i) LEFT JOIN h ON bin = i",
    "p_real_min_pct p_real_max_pct n_portfolio_equiv n_High n_Medium n_Low n_Inactif"))
def j18(spark, sf):
    return rounded(dashboards.risk_histogram(scores(spark, sf), FILTERS))


@query("j19_real_thresholds", sql(STORE, """SELECT high AS high_p_calibrated, medium AS medium_p_calibrated,
  100 * high * (0.02::DOUBLE / s) / (high * (0.02::DOUBLE / s) + (1 - high) * ((1 - 0.02::DOUBLE) / (1 - s))) AS high_p_real_pct,
  100 * medium * (0.02::DOUBLE / s) / (medium * (0.02::DOUBLE / s) + (1 - medium) * ((1 - 0.02::DOUBLE) / (1 - s))) AS medium_p_real_pct FROM thr, rate""",
    "high_p_calibrated medium_p_calibrated high_p_real_pct medium_p_real_pct"))
def j19(spark, sf):
    store = load_store(spark, sf)
    return rounded(dashboards.real_thresholds(store.thresholds, score_table.train_rate(store.scores)))


@query("j20_segments", sql(STORE + group_rows_sql("tenure_band", WHERE),
                           "SELECT tenure_band AS value, * EXCLUDE (tenure_band) FROM gr", GR_COLS))
def j20(spark, sf):
    return rounded(dashboards.segments(scores(spark, sf), "tenure_band", FILTERS), **GR_DIG)


@query("j21_weighted_quantiles", sql(STORE + f""", pv AS (SELECT 100 * proba_reelle AS p, sum({W}) AS w FROM scores GROUP BY 1
), pc AS (SELECT p, sum(w) OVER (ORDER BY p) / sum(w) OVER () AS share FROM pv)""",
    "SELECT " + ", ".join(f"min(p) FILTER (WHERE share >= {q}::DOUBLE) AS p{round(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) + " FROM pc",
    "p10 p25 p50 p75 p90 p99"))
def j21(spark, sf):
    return rounded(dashboards.risk_quantiles(scores(spark, sf)))


@query("j22_heatmap", sql(STORE + group_rows_sql("tenure_band, handset_age_band"),
    """SELECT tenure_band AS x, handset_age_band AS y, n_rows, n_portfolio_equiv, CASE WHEN n_rows >= 30 THEN observed_churn_rate_in_base END AS observed_churn_rate_in_base,
  CASE WHEN n_rows >= 30 THEN expected_churn_rate END AS expected_churn_rate, revenue_at_risk, n_rows < 30 AS low_sample FROM gr""",
    "n_portfolio_equiv observed_churn_rate_in_base expected_churn_rate revenue_at_risk:2"))
def j22(spark, sf):
    return rounded(dashboards.heatmap(scores(spark, sf), "tenure_band", "handset_age_band"), **GR_DIG)


DRIVERS = STORE + f""", dsub AS (SELECT customer_id, months IN (69, 70) AS win FROM scores WHERE {WHERE}
), dn AS (SELECT count(*) AS n FROM dsub
), dv AS (SELECT CASE WHEN variable = 'months' AND NOT win THEN 'months_outside_window' ELSE variable END AS variable, contribution AS c
  FROM contrib JOIN dsub USING (customer_id)
), dg AS (SELECT variable, sum(abs(c)) AS a, sum(c) AS s, count(*) FILTER (WHERE c > 0) AS up FROM dv GROUP BY 1
), dt AS (SELECT variable, CASE WHEN variable = 'months' THEN 'engagement'
      WHEN variable IN ('eqpdays', 'hnd_price') THEN 'terminal' WHEN variable IN ('change_mou', 'avg3mou') THEN 'usage'
      WHEN variable IN ('totmrc_Mean', 'rev_Mean', 'ovrrev_Mean') THEN 'forfait'
      WHEN variable = 'drop_vce_Mean' THEN 'reseau' WHEN variable = 'custcare_Mean' THEN 'service_client'
      WHEN variable IN ('actvsubs', 'uniqsubs') THEN 'lignes' ELSE 'contexte' END AS family,
    a / n AS mean_abs_shap, s / n AS mean_shap, CAST(up AS DOUBLE) / n AS share_rows_increasing, 100 * a / sum(a) OVER () AS share_pct FROM dg, dn)"""


@query("j23_drivers", sql(DRIVERS, """SELECT *, family <> 'contexte' AS actionable, variable IN ('income') AS sensitive,
  row_number() OVER (PARTITION BY family <> 'contexte' ORDER BY mean_abs_shap DESC, variable) AS rang FROM dt""",
    "mean_abs_shap mean_shap share_rows_increasing share_pct"))
def j23(spark, sf):
    store = load_store(spark, sf)
    return rounded(dashboards.drivers(store.scores, store.contributions, FILTERS, WINDOW)
                   .drop("label", "family_label"))


@query("j23_driver_families", sql(DRIVERS, "SELECT family, family <> 'contexte' AS actionable, sum(share_pct) AS share_pct FROM dt GROUP BY 1, 2", "share_pct"))
def j23b(spark, sf):
    store = load_store(spark, sf)
    return rounded(dashboards.family_shares(dashboards.drivers(
        store.scores, store.contributions, FILTERS, WINDOW)).drop("family_label"))


@query("j24_segment_profiles", sql(STORE + group_rows_sql("segment", WHERE) + f""", am AS (
  SELECT segment, action, count(*) AS n FROM scores WHERE {WHERE} AND niveau IN ('High', 'Medium') GROUP BY 1, 2
), ab AS (SELECT segment, action AS main_action FROM am QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, action) = 1)""",
    "SELECT gr.*, main_action, CAST(substr(segment, 9) AS INTEGER) AS segment_id FROM gr LEFT JOIN ab USING (segment)", GR_COLS))
def j24(spark, sf):
    return rounded(dashboards.segment_profiles(scores(spark, sf), FILTERS), **GR_DIG)


_TRAITS = [c for c, _, _ in fv.PROFILE_TRAITS]


@query("j24_segment_traits", sql(STORE + ", tl AS (" + " UNION ALL ".join(
    f"SELECT segment, '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM scores" for c in _TRAITS) + """
), ov AS (SELECT variable, median(v) AS overall_median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, stddev_samp(v) AS sd FROM tl GROUP BY 1
), sm AS (SELECT segment, variable, median(v) AS segment_median FROM tl WHERE v IS NOT NULL GROUP BY 1, 2
), tg AS (SELECT segment, variable, segment_median, overall_median, (segment_median - overall_median) / CASE WHEN iqr <> 0 THEN iqr ELSE sd END AS gap_iqr FROM sm JOIN ov USING (variable)
), tr AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY abs(gap_iqr) DESC, variable) AS rang FROM tg)""",
    "SELECT segment, rang, variable, segment_median, overall_median, gap_iqr, CASE WHEN gap_iqr > 0 THEN 'higher' ELSE 'lower' END AS direction FROM tr WHERE rang <= 3",
    "segment_median overall_median gap_iqr"))
def j24b(spark, sf):
    return rounded(dashboards.segment_traits(scores(spark, sf)).drop("label", "unit"))


SIM = STORE + curve_sql([0.075] + [i / 100 for i in range(1, 51)]) + """, sim AS (
  SELECT CASE WHEN capacite = 0.075 THEN 'result' ELSE 'curve' END AS kind, round(100 * capacite, 6) AS capacity_pct, n_rows AS targeted_n_rows, n_portfolio_equiv AS targeted_n_portfolio_equiv,
    churners_attendus AS expected_churners, churners_hasard AS random_churners, facteur_vs_hasard AS lift_vs_random,
    1000 * churners_attendus / nullif(n_portfolio_equiv, 0) AS churners_per_1000_contacted, part_churners_attendus AS share_of_expected_churners,
    revenu_en_jeu AS revenue_at_risk_monthly, part_revenu_en_jeu AS share_of_revenue_at_risk, churners_observes AS observed_churners_check,
    churners_attendus * 0.2::DOUBLE AS avoided_departures_hypothesis, revenu_en_jeu * 0.2::DOUBLE AS preserved_revenue_monthly_hypothesis,
    revenu_en_jeu * 0.2::DOUBLE * 6 AS preserved_revenue_horizon_hypothesis, 500 * n_portfolio_equiv AS campaign_cost,
    revenu_en_jeu * 0.2::DOUBLE * 6 - 500 * n_portfolio_equiv AS net_balance FROM curve)"""
_SIM_COLS = ("capacity_pct targeted_n_portfolio_equiv expected_churners random_churners lift_vs_random churners_per_1000_contacted share_of_expected_churners "
             "revenue_at_risk_monthly:2 share_of_revenue_at_risk observed_churners_check avoided_departures_hypothesis preserved_revenue_monthly_hypothesis:2 "
             "preserved_revenue_horizon_hypothesis:1 campaign_cost:2 net_balance:1")
_SIM_DIG = {"revenue_at_risk_monthly": 2, "preserved_revenue_monthly_hypothesis": 2,
            "preserved_revenue_horizon_hypothesis": 1, "campaign_cost": 2, "net_balance": 1}


@query("j25_simulate_campaign", sql(SIM, "SELECT * FROM sim", _SIM_COLS))
def j25(spark, sf):
    return rounded(portfolio.simulate_campaign(scores(spark, sf), 7.5, 0.2, 500.0, 6), **_SIM_DIG)


@query("j25_inactive_customers", sql(STORE, """SELECT count(*) AS n_rows, coalesce(sum(poids_portefeuille), 0) AS n_portfolio_equiv, coalesce(sum(poids_portefeuille * proba_reelle), 0) AS expected_churners,
  coalesce(sum(poids_portefeuille * revenu_en_jeu), 0) AS revenue_at_risk_monthly, 'Vérifier la ligne / reconquête' AS action FROM scores WHERE inactif""",
    "n_portfolio_equiv expected_churners revenue_at_risk_monthly:2"))
def j25i(spark, sf):
    return rounded(portfolio.inactive_summary(scores(spark, sf)), revenue_at_risk_monthly=2)


@query("j26_best_capacity", sql(SIM, "SELECT arg_max(capacity_pct, net_balance) AS capacity_pct, max(net_balance) AS net_balance FROM sim WHERE kind = 'curve'", "capacity_pct net_balance:1"))
def j26(spark, sf):
    return rounded(portfolio.best_capacity(portfolio.simulate_campaign(
        scores(spark, sf), 7.5, 0.2, 500.0, 6)), **_SIM_DIG)


@query("j27_concentration", sql(STORE + group_rows_sql("handset_age_band"),
    "SELECT arg_max(handset_age_band, share_of_expected_churners / share_of_portfolio) AS value, max(share_of_expected_churners / share_of_portfolio) AS ratio FROM gr WHERE share_of_portfolio >= 0.02", "ratio"))
def j27(spark, sf):
    return rounded(dashboards.concentration(dashboards.segments(scores(spark, sf), "handset_age_band")))


@query("j28_success_grid", sql(STORE + curve_sql([0.05, 0.1, 0.2]), "SELECT capacite, " + ", ".join(
    f"churners_attendus * {r}::DOUBLE AS departs_evites_{round(100 * r)}, revenu_en_jeu * {r}::DOUBLE AS revenu_preserve_{round(100 * r)}" for r in (0.1, 0.2, 0.3)) + " FROM curve",
    "capacite " + " ".join(f"departs_evites_{k} revenu_preserve_{k}:2" for k in (10, 20, 30))))
def j28(spark, sf):
    return rounded(portfolio.success_grid(portfolio.campaign_curve(scores(spark, sf), fv.CAPACITIES)),
                   revenu_preserve_10=2, revenu_preserve_20=2, revenu_preserve_30=2)


@query("j29_campaign_sensitivity", sql(STORE + """, rr AS (SELECT unnest([0.01::DOUBLE, 0.02, 0.03]) AS taux_reel
), pr AS (SELECT taux_reel, customer_id, churn, inactif, rev_Mean, proba_calibree AS pc0, least(greatest(proba_calibree, 1e-9), 1 - 1e-9) AS pc,
    pc * (taux_reel / 0.4) / (pc * (taux_reel / 0.4) + (1 - pc) * ((1 - taux_reel) / (1 - 0.4))) AS p,
    CASE WHEN churn = 1 THEN taux_reel / 0.4 ELSE (1 - taux_reel) / (1 - 0.4) END AS w0 FROM scores, rr
), pw AS (SELECT *, p * coalesce(rev_Mean, 0) AS rv, w0 * 100000 / sum(w0) OVER (PARTITION BY taux_reel) AS w FROM pr
), po AS (SELECT *, (sum(w) OVER (PARTITION BY taux_reel ORDER BY pc0 DESC, customer_id ROWS UNBOUNDED PRECEDING) - w) / 100000 AS before FROM pw WHERE NOT inactif
), tt AS (SELECT taux_reel, sum(w * p) AS e, sum(w * rv) AS r FROM pw GROUP BY 1
), res AS (SELECT taux_reel, 'Top 10 % (actifs)' AS groupe, count(*) AS n_rows, sum(w) AS n, sum(w * p) AS ca, sum(w * rv) AS rv FROM po WHERE before < 0.1 - 1e-12 GROUP BY 1
  UNION ALL SELECT taux_reel, 'Inactifs (vérification / reconquête)', count(*), sum(w), sum(w * p), sum(w * rv) FROM pw WHERE inactif GROUP BY 1
  UNION ALL SELECT taux_reel, 'Portefeuille entier', count(*), sum(w), sum(w * p), sum(w * rv) FROM pw GROUP BY 1)""",
    """SELECT taux_reel, groupe, n_rows, n AS n_portfolio_equiv, ca AS churners_attendus, n * taux_reel AS churners_hasard, ca / (n * taux_reel) AS facteur_vs_hasard,
  rv AS revenu_en_jeu, ca / e AS part_churners_attendus, rv / r AS part_revenu_en_jeu FROM res JOIN tt USING (taux_reel)""",
    "taux_reel n_portfolio_equiv churners_attendus churners_hasard facteur_vs_hasard revenu_en_jeu:2 part_churners_attendus part_revenu_en_jeu"))
def j29(spark, sf):
    return rounded(portfolio.campaign_sensitivity(scores(spark, sf), 0.4, capacities=[0.1])
                   .drop("capacite", "churners_observes", "facture_mensuelle"), **DIG)


_SUMMARY = """customer_id, partition, niveau AS risk_level, proba_reelle AS p_real, proba_calibree AS p_calibrated, segment, action,
  revenu_en_jeu AS revenue_at_risk_monthly, rev_Mean AS monthly_bill, months AS tenure_months, eqpdays AS handset_age_days, area, inactif AS inactive"""
_SUM_D = "p_real p_calibrated revenue_at_risk_monthly monthly_bill"
_SUM_DIG: dict[str, int] = {}


@query("j30_list_customers", sql(STORE, f"SELECT {_SUMMARY} FROM scores WHERE {WHERE} AND contains(id_text, '1') ORDER BY rev_Mean DESC NULLS LAST, customer_id LIMIT 25 OFFSET 25", _SUM_D))
def j30(spark, sf):
    return rounded(customers.list_customers(scores(spark, sf), FILTERS, "monthly_bill", "desc", 2,
                                            25, "1").drop("top_reason"), **_SUM_DIG)


@query("j30_deep_page", sql(STORE, f"SELECT {_SUMMARY} FROM scores ORDER BY eqpdays NULLS LAST, customer_id LIMIT 40 OFFSET 400", _SUM_D))
def j30d(spark, sf):
    return rounded(customers.page_by_position(scores(spark, sf), None, "handset_age_days", "asc",
                                              11, 40).drop("top_reason"))


@query("j30_list_totals", STORE + f" SELECT count(*) AS total_n_rows, greatest(1, CAST(ceil(count(*) / 25) AS BIGINT)) AS total_pages FROM scores WHERE {WHERE} AND contains(id_text, '1')")
def j30b(spark, sf):
    return customers.list_totals(scores(spark, sf), FILTERS, 25, "1")


@query("j30_numbered_selection", STORE + f" SELECT customer_id, row_number() OVER (ORDER BY rev_Mean DESC NULLS LAST, customer_id) AS position FROM scores WHERE {WHERE}")
def j30c(spark, sf):
    return customers.numbered_selection(scores(spark, sf), FILTERS, "monthly_bill").select(
        "customer_id", "position")


@query("j31_get_customer", sql(STORE, """SELECT customer_id, partition, proba_calibree AS p_raw, proba_calibree AS p_calibrated, proba_reelle AS p_real, niveau AS risk_level,
  inactif AS inactive, segment_id, segment, tenure_band, handset_age_band, usage_band, action, famille_dominante AS dominant_family, rev_Mean AS monthly_bill,
  revenu_en_jeu AS revenue_at_risk_monthly, churn AS historical_churn_label FROM scores WHERE customer_id = 7""",
    "p_raw p_calibrated p_real monthly_bill revenue_at_risk_monthly"))
def j31(spark, sf):
    return rounded(customers.get_customer(scores(spark, sf), 7), **_SUM_DIG)


@query("j31_customer_factors", sql(STORE, """SELECT r.customer_id, kind, rang, variable, famille AS family, actionnable AS actionable, contribution,
  CASE WHEN contribution > 0 THEN 'augmente le risque' ELSE 'réduit le risque' END AS effect FROM ranked_f r JOIN (
    SELECT 'raison' AS kind, unnest([1, 2, 3]) AS rang UNION ALL SELECT 'contexte', unnest([1, 2])) k
  ON (kind = 'raison' AND rang_raison = k.rang) OR (kind = 'contexte' AND rang_contexte = k.rang) WHERE r.customer_id = 7""".replace("kind, rang,", "kind, k.rang AS rang,"), "contribution"))
def j31b(spark, sf):
    store = load_store(spark, sf)
    return rounded(customers.customer_factors(
        store.scores, store.contributions, F.col("months").isin(*WINDOW), 7).drop("label", "text"))


_MED = ["months", "eqpdays", "mou_Mean", "change_mou", "totmrc_Mean", "rev_Mean", "ovrrev_Mean",
        "custcare_Mean", "drop_vce_Mean", "hnd_price", "uniqsubs"]


@query("j32_tier_medians", sql(STORE, "SELECT niveau, " + ", ".join(f"CAST(median({c}) AS DOUBLE) AS {c}" for c in _MED)
    + ", 100 * avg(CASE WHEN months IN (69, 70) THEN 1.0 ELSE 0 END) AS pct_fenetre FROM scores GROUP BY niveau",
    " ".join(f"{c}" for c in _MED) + " pct_fenetre"))
def j32(spark, sf):
    return rounded(dashboards.tier_medians(scores(spark, sf), _MED, WINDOW))


@query("j33_action_mix", sql(STORE, "SELECT action, niveau, count(*) AS n, 100 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY niveau) AS pct_colonne FROM scores GROUP BY 1, 2", "pct_colonne"))
def j33(spark, sf):
    return rounded(dashboards.action_mix(scores(spark, sf)))


@query("j34_segment_tier_shares", sql(STORE, "SELECT segment, " + ", ".join(
    f"coalesce(sum({W}) FILTER (WHERE niveau = '{t}'), 0) / sum({W}) AS \"{t}\"" for t in fv.TIERS) + " FROM scores GROUP BY 1", "High Medium Low Inactif"))
def j34(spark, sf):
    return rounded(dashboards.segment_tier_shares(scores(spark, sf)))


_PROFILE = [f for f in fv.PROFILE_FIELDS if f[0] not in fv.SENSITIVE_VARIABLES]


def _literal(text):
    return "'" + text.replace("'", "''") + "'"


@query("j31_customer_profile", STORE + " " + " UNION ALL ".join(
    f"SELECT customer_id, '{c}' AS variable, {_literal(label)} AS label, CAST({c} AS VARCHAR) AS value, {_literal(unit)} AS unit FROM scores WHERE customer_id = 7"
    for c, label, unit in _PROFILE))
def j31p(spark, sf):
    return customers.customer_profile(scores(spark, sf), 7)


@query("j35_list_at_risk", sql(STORE, f"SELECT {_SUMMARY} FROM scores WHERE niveau <> 'Inactif' ORDER BY proba_reelle DESC, customer_id LIMIT 20", _SUM_D))
def j35(spark, sf):
    return rounded(customers.list_at_risk(scores(spark, sf), limit=20).drop("top_reason"), **_SUM_DIG)


@query("j37_executive_facts", sql(STORE + group_rows_sql("niveau") + group_rows_sql("segment").replace(", gr AS", ", gs AS"),
    """SELECT share_of_portfolio AS high_share, expected_churn_rate AS high_rate, s.* FROM gr, (SELECT arg_max(segment, expected_churn_rate) AS riskiest_segment,
  max(expected_churn_rate) AS riskiest_rate, arg_max(segment, share_of_revenue_at_risk) AS revenue_segment, max(share_of_revenue_at_risk) AS revenue_share FROM gs) s WHERE niveau = 'High'""",
    "high_share high_rate riskiest_rate revenue_share"))
def j37(spark, sf):
    return rounded(dashboards.executive_facts(scores(spark, sf)))


@query("a06_export_customers", STORE + f""" SELECT customer_id AS identifiant, niveau, segment, area AS region, months AS anciennete_mois, action AS action_suggeree, partition,
  replace(CAST(round(100 * proba_reelle, 2) AS VARCHAR), '.', ',') AS risque_mensuel_pct_taux_suppose_2pct FROM scores WHERE {WHERE}""")
def a06(spark, sf):
    return customers.export_customers(scores(spark, sf), FILTERS).select(
        "identifiant", "niveau", "segment", "region", "anciennete_mois", "action_suggeree",
        "partition", "risque_mensuel_pct_taux_suppose_2pct")
