"""Score quality queries (metrics, calibration, prior)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base_sql import STORE, bands_sql, tiers_sql
from catalog.registry import query, rounded, sql
from loyaltide.functions.expressions import adjust_prior, population_weight
from loyaltide.operators import bootstrap, features, metrics, portfolio
from loyaltide.plans.score_table import load_store

S = 0.4  # sample rate assumed by the weighted metrics below


def scores(spark, sf):
    return load_store(spark, sf).scores


def auc_sql(source: str, score: str, by: str = "") -> str:
    """CTEs ``sc`` (per score) and ``auc`` of a source; ``by`` is one column or empty."""
    b, pb = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f""", sc AS (
  SELECT {b}{score} AS s_, sum(churn) AS pos, sum(1 - churn) AS neg FROM {source} GROUP BY ALL
), cum AS (
  SELECT *, sum(neg) OVER ({pb}ORDER BY s_) - neg AS below, sum(pos) OVER ({pb}) AS pos_all, sum(neg) OVER ({pb}) AS neg_all,
    sum(pos) OVER ({pb}ORDER BY s_ DESC) AS pos_cum, sum(neg) OVER ({pb}ORDER BY s_ DESC) AS neg_cum FROM sc
), auc AS (
  SELECT {b}CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / nullif(max(pos_all) * max(neg_all), 0) AS roc_auc,
    sum(CAST(pos AS DOUBLE) / pos_all * pos_cum / (pos_cum + neg_cum)) AS pr_auc
  FROM cum {'GROUP BY ' + by if by else ''}
)"""


AUC = STORE + auc_sql("scores", "proba_calibree")


@query("g01_roc_auc", sql(AUC, "SELECT roc_auc FROM auc", "roc_auc"))
def g01(spark, sf):
    return rounded(metrics.roc_auc(scores(spark, sf), "proba_calibree"))


@query("g02_pr_auc", sql(AUC, "SELECT pr_auc FROM auc", "pr_auc"))
def g02(spark, sf):
    return rounded(metrics.pr_auc(scores(spark, sf), "proba_calibree"))


@query("g03_brier", sql(STORE, "SELECT avg((proba_calibree - churn) ** 2) AS brier FROM scores",
                        "brier"))
def g03(spark, sf):
    return rounded(metrics.brier(scores(spark, sf), "proba_calibree"))


RANKED = STORE + """, r AS (
  SELECT partition, churn, proba_calibree AS p, row_number() OVER (ORDER BY proba_calibree DESC, customer_id) AS rn,
    count(*) OVER () AS n, sum(churn) OVER () AS pos FROM scores
)"""


def _top_sql(ks=(5, 10, 20), group: str = "") -> str:
    cells = []
    for k in ks:
        hits = f"CAST(sum(churn) FILTER (WHERE rn <= ceil({k / 100}::DOUBLE * n)) AS DOUBLE)"
        size = f"ceil({k / 100}::DOUBLE * max(n))"
        cells += [f"{hits} / {size} / (max(pos) / max(n)) AS lift_{k}",
                  f"{hits} / {size} AS precision_{k}", f"{hits} / max(pos) AS recall_{k}"]
    return ", ".join(cells)


_TOPCOLS = " ".join(f"{m}_{k}" for k in (5, 10, 20) for m in ("lift", "precision", "recall"))


@query("g04_top_share", sql(RANKED, f"SELECT {_top_sql()} FROM r", _TOPCOLS))
def g04(spark, sf):
    return rounded(metrics.top_share_metrics(scores(spark, sf), "proba_calibree"))


@query("g05_compute_metrics", sql(
    AUC + RANKED[len(STORE):],
    f"SELECT * FROM (SELECT roc_auc, pr_auc FROM auc), "
    f"(SELECT avg((p - churn) ** 2) AS brier, {_top_sql()} FROM r)",
    "roc_auc pr_auc brier " + _TOPCOLS))
def g05(spark, sf):
    return rounded(metrics.compute_metrics(scores(spark, sf), "proba_calibree"))


@query("g06_gain_curve", sql(STORE + """, r AS (
  SELECT row_number() OVER w AS rn, sum(churn) OVER (ORDER BY proba_calibree DESC, customer_id ROWS UNBOUNDED PRECEDING) AS c,
    count(*) OVER () AS n, sum(churn) OVER () AS pos FROM scores
  WINDOW w AS (ORDER BY proba_calibree DESC, customer_id)
), grid AS (
  SELECT CAST(i AS DOUBLE) AS part_ciblee, greatest(1, CAST(round_even(CAST(i AS DOUBLE) / 100 * (SELECT max(n) FROM r), 0) AS BIGINT)) AS k
  FROM range(1, 101) t(i)
)""", """SELECT part_ciblee, 100 * CAST(c AS DOUBLE) / pos AS gain, (CAST(c AS DOUBLE) / k) / (CAST(pos AS DOUBLE) / n) AS lift
  FROM grid JOIN r ON rn = k""", "part_ciblee gain lift"))
def g06(spark, sf):
    return rounded(metrics.gain_curve(scores(spark, sf), "proba_calibree"))


@query("g07_confusion_top_k", RANKED + """ SELECT churn,
  count(*) FILTER (WHERE rn <= ceil(0.1::DOUBLE * n)) AS cible, count(*) FILTER (WHERE rn > ceil(0.1::DOUBLE * n)) AS non_cible
  FROM r GROUP BY churn""")
def g07(spark, sf):
    return metrics.confusion_at_top_k(scores(spark, sf), "proba_calibree")


@query("g08_subset_auc_per_fold", sql(
    STORE + ", act AS (SELECT * FROM scores WHERE rev_Mean IS NOT NULL AND change_mou IS NOT NULL)"
    + auc_sql("act", "proba_calibree", "fold"), "SELECT fold, roc_auc FROM auc", "roc_auc"))
def g08(spark, sf):
    df = scores(spark, sf)
    return rounded(metrics.subset_auc_per_fold(df, "proba_calibree", features.active_customer(df)))


@query("g09_bootstrap_auc_ci")
def g09(spark, sf):
    return bootstrap.bootstrap_auc_ci(scores(spark, sf), "proba_calibree")


@query("g10_bootstrap_auc_difference")
def g10(spark, sf):
    df = scores(spark, sf).withColumn("score_b", -F.col("eqpdays").cast("double"))
    return bootstrap.bootstrap_auc_difference(df, "proba_calibree", "score_b")


REL = STORE + """, edges AS (
  SELECT list_distinct(list(q)) AS e FROM (SELECT unnest(quantile_cont(proba_calibree, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) AS q FROM scores)
), b AS (
  SELECT churn, proba_calibree AS p, greatest(len(list_filter(e, lambda x: x < proba_calibree)), 1) AS classe FROM scores, edges
), rel AS (
  SELECT CAST(classe AS INTEGER) AS classe, count(*) AS n, avg(p) AS p_moyenne, avg(churn) AS taux_observe FROM b GROUP BY classe
)"""


@query("g11_reliability_table", sql(REL, "SELECT * FROM rel", "p_moyenne taux_observe"))
def g11(spark, sf):
    return rounded(metrics.reliability_table(scores(spark, sf), "proba_calibree"))


@query("g11_expected_calibration_error", sql(
    REL, "SELECT sum(n * abs(p_moyenne - taux_observe)) / sum(n) AS ece FROM rel", "ece"))
def g11b(spark, sf):
    return rounded(metrics.expected_calibration_error(
        metrics.reliability_table(scores(spark, sf), "proba_calibree")))


@query("g12_adjust_prior", sql(STORE, f"""SELECT customer_id, r AS taux_reel,
  proba_calibree * (r / {S}) / (proba_calibree * (r / {S}) + (1 - proba_calibree) * ((1 - r) / (1 - {S}))) AS p
  FROM scores, (SELECT unnest([0.01::DOUBLE, 0.02, 0.03]) AS r)""", "p"))
def g12(spark, sf):
    df = scores(spark, sf).select("customer_id", "proba_calibree", F.explode(
        F.array(F.lit(0.01), F.lit(0.02), F.lit(0.03))).alias("taux_reel"))
    return df.select("customer_id", "taux_reel", F.round(
        adjust_prior("proba_calibree", F.col("taux_reel"), S), 6).alias("p"))


@query("g13_population_weights", sql(STORE, f"""SELECT churn, count(*) AS n,
  max(CASE WHEN churn = 1 THEN 0.02::DOUBLE / {S} ELSE (1 - 0.02::DOUBLE) / (1 - {S}) END) AS poids,
  sum(CASE WHEN churn = 1 THEN 0.02::DOUBLE / {S} ELSE (1 - 0.02::DOUBLE) / (1 - {S}) END) AS total
  FROM scores GROUP BY churn""", "poids total"))
def g13(spark, sf):
    w = population_weight("churn", 0.02, S)
    return rounded(scores(spark, sf).groupBy("churn").agg(
        F.count(F.lit(1)).alias("n"), F.max(w).alias("poids"), F.sum(w).alias("total")))


def weighted_sql(rate: str = "0.02::DOUBLE") -> str:
    return STORE + f""", wr AS (
  SELECT customer_id, churn, proba_calibree AS p, CASE WHEN churn = 1 THEN {rate} / {S} ELSE (1 - {rate}) / (1 - {S}) END AS w,
    sum(churn) OVER o * ({rate} / {S}) + sum(1 - churn) OVER o * ((1 - {rate}) / (1 - {S})) AS w_cum,
    sum(churn) OVER () * ({rate} / {S}) + sum(1 - churn) OVER () * ((1 - {rate}) / (1 - {S})) AS w_all
  FROM scores WINDOW o AS (ORDER BY proba_calibree DESC, customer_id ROWS UNBOUNDED PRECEDING)
), wm AS (SELECT *, w_cum <= 0.1::DOUBLE * w_all AS top FROM wr)"""


@query("g14_production_precision_at_k", sql(
    weighted_sql(), "SELECT sum(w * churn) / sum(w) AS precision FROM wm WHERE top", "precision"))
def g14(spark, sf):
    return rounded(metrics.production_precision_at_k(scores(spark, sf), "proba_calibree", 0.02, S))


@query("g15_top_k_mask_weighted", sql(weighted_sql(), "SELECT customer_id, w, top FROM wm", "w"))
def g15(spark, sf):
    return rounded(metrics.top_weighted_mask(scores(spark, sf), "proba_calibree", 0.02, S)
                   .select("customer_id", "w", "top"))


@query("g16_weighted_mean", sql(
    weighted_sql(), "SELECT sum(w * rev_Mean) / sum(w) AS moyenne FROM wm JOIN scores USING "
    "(customer_id) WHERE NOT inactif", "moyenne:4"))
def g16(spark, sf):
    return rounded(metrics.weighted_mean(scores(spark, sf), F.col("rev_Mean"), 0.02, S,
                                         ~F.col("inactif")), moyenne=4)


@query("g17_prior_sensitivity", sql(STORE + f""", rr AS (SELECT unnest([0.01::DOUBLE, 0.02, 0.03]) AS taux_reel), wr AS (
  SELECT taux_reel, customer_id, churn, CASE WHEN churn = 1 THEN taux_reel / {S} ELSE (1 - taux_reel) / (1 - {S}) END AS w,
    sum(churn) OVER o * (taux_reel / {S}) + sum(1 - churn) OVER o * ((1 - taux_reel) / (1 - {S})) AS w_cum,
    sum(churn) OVER g * (taux_reel / {S}) + sum(1 - churn) OVER g * ((1 - taux_reel) / (1 - {S})) AS w_all,
    proba_calibree * (taux_reel / {S}) / (proba_calibree * (taux_reel / {S}) + (1 - proba_calibree) * ((1 - taux_reel) / (1 - {S}))) AS p
  FROM scores, rr WINDOW o AS (PARTITION BY taux_reel ORDER BY proba_calibree DESC, customer_id ROWS UNBOUNDED PRECEDING),
    g AS (PARTITION BY taux_reel)
), pv AS (SELECT taux_reel, p, sum(w) AS w FROM wr GROUP BY 1, 2
), pc AS (SELECT *, sum(w) OVER (PARTITION BY taux_reel ORDER BY p) / sum(w) OVER (PARTITION BY taux_reel) AS share FROM pv
), q AS (SELECT taux_reel, min(p) FILTER (WHERE share >= 0.1) AS p10, min(p) FILTER (WHERE share >= 0.5) AS p50, min(p) FILTER (WHERE share >= 0.9) AS p90 FROM pc GROUP BY 1
), t AS (SELECT taux_reel, sum(w * p) / sum(w) AS p_moyenne,
    sum(w * churn) FILTER (WHERE w_cum <= 0.1::DOUBLE * w_all) / sum(w) FILTER (WHERE w_cum <= 0.1::DOUBLE * w_all) AS precision_top,
    sum(w * p) FILTER (WHERE w_cum <= 0.1::DOUBLE * w_all) / sum(w) FILTER (WHERE w_cum <= 0.1::DOUBLE * w_all) AS precision_annoncee
  FROM wr GROUP BY 1)""",
    "SELECT t.*, precision_top / taux_reel AS lift_top, p10, p50, p90 FROM t JOIN q USING (taux_reel)",
    "taux_reel p_moyenne precision_top precision_annoncee lift_top p10 p50 p90"))
def g17(spark, sf):
    return rounded(metrics.prior_sensitivity(scores(spark, sf), "proba_calibree", S))


@query("g18_test_report", sql(
    STORE + auc_sql("scores", "proba_calibree", "partition")
    + ", act AS (SELECT partition AS pt, churn, proba_calibree AS p FROM scores WHERE NOT inactif)"
      ", asc_ AS (SELECT pt, p, sum(churn) pos, sum(1 - churn) neg FROM act GROUP BY ALL)"
      ", acum AS (SELECT *, sum(neg) OVER (PARTITION BY pt ORDER BY p) - neg AS below FROM asc_)"
      ", aauc AS (SELECT pt, CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / (sum(pos) * sum(neg)) AS auc_actifs FROM acum GROUP BY pt)"
      ", br AS (SELECT partition, count(*) AS n, avg((proba_calibree - churn) ** 2) AS brier FROM scores GROUP BY 1)",
    "SELECT partition, n, roc_auc, pr_auc, brier, auc_actifs FROM auc JOIN br USING (partition) JOIN aauc ON pt = partition",
    "roc_auc pr_auc brier auc_actifs"))
def g18(spark, sf):
    df = scores(spark, sf)
    by = ["partition"]
    report = (metrics.roc_auc(df, "proba_calibree", by=by)
              .join(metrics.pr_auc(df, "proba_calibree", by=by), by)
              .join(metrics.brier(df, "proba_calibree", by=by), by)
              .join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
              .join(metrics.roc_auc(df.filter(~F.col("inactif")), "proba_calibree", by=by)
                    .withColumnRenamed("roc_auc", "auc_actifs"), by))
    return rounded(report)


@query("g18_test_report_gaps", sql(
    STORE + auc_sql("scores", "proba_calibree", "partition")
    + ", rk AS (SELECT partition AS pt, churn, proba_calibree, row_number() OVER (PARTITION BY partition ORDER BY proba_calibree DESC, customer_id) AS rn, count(*) OVER (PARTITION BY partition) AS n, sum(churn) OVER (PARTITION BY partition) AS pos FROM scores)"
      ", tk AS (SELECT pt, max(n) AS n, avg((proba_calibree - churn) ** 2) AS brier, "
    + ", ".join(f"avg(churn) FILTER (WHERE rn <= ceil({k / 100!r}::DOUBLE * n)) / (max(pos) / CAST(max(n) AS DOUBLE)) AS lift_{k}" for k in (5, 10, 20))
    + " FROM rk GROUP BY 1), al AS (SELECT * FROM auc JOIN tk ON pt = partition)",
    "SELECT partition, n, roc_auc, pr_auc, brier, lift_5, lift_10, lift_20, roc_auc - (SELECT roc_auc FROM al WHERE partition = 'train_oof') AS ecart_auc, brier - (SELECT brier FROM al WHERE partition = 'train_oof') AS ecart_brier FROM al",
    "roc_auc pr_auc brier lift_5 lift_10 lift_20 ecart_auc ecart_brier"))
def g18g(spark, sf):
    df = scores(spark, sf).withColumn("actif", ~F.col("inactif"))
    return rounded(metrics.test_report(df, "proba_calibree", "actif").select(
        "partition", "n", "roc_auc", "pr_auc", "brier", "lift_5", "lift_10", "lift_20", "ecart_auc",
        "ecart_brier"))


@query("g18_test_interval")
def g18i(spark, sf):
    """AUC of the test part with its bootstrap interval."""
    df = scores(spark, sf).filter(F.col("partition") == "test")
    return bootstrap.bootstrap_auc_ci(df, "proba_calibree")


# --- Lift bands and tiers -------------------------------------------------------------------

@query("j02_band_lift", sql(
    STORE + bands_sql("scores", "proba_calibree", 0.05, None, "1.0", "b_"),
    "SELECT * FROM b_bands", "debut_pct fin_pct taux lift lift_cumule score_min"))
def j02(spark, sf):
    return rounded(portfolio.band_lift(scores(spark, sf), "proba_calibree"))


@query("j02_band_lift_weighted", sql(
    STORE + bands_sql("scores", "proba_calibree", 0.05, "0.02", str(S), "b_"),
    "SELECT * FROM b_bands", "debut_pct fin_pct taux lift lift_cumule score_min"))
def j02w(spark, sf):
    return rounded(portfolio.band_lift(scores(spark, sf), "proba_calibree", real_rate=0.02,
                                       sample_rate=S))


_TIERED = (STORE + bands_sql("scores", "proba_calibree", 0.05, "0.02", str(S), "b_")
           + tiers_sql(0.05, 0.10, "b_"))


@query("j03_choose_tiers", sql(_TIERED, "SELECT bande, n, lift, score_min, niveau FROM b_tiers",
                               "lift score_min"))
def j03(spark, sf):
    bands = portfolio.band_lift(scores(spark, sf), "proba_calibree", real_rate=0.02, sample_rate=S)
    return rounded(portfolio.choose_tiers(bands).select("bande", "n", "lift", "score_min",
                                                        "niveau"))


@query("j03_tier_thresholds", sql(_TIERED, "SELECT high, medium, medium_end FROM b_thr",
                                  "high medium medium_end"))
def j03t(spark, sf):
    bands = portfolio.band_lift(scores(spark, sf), "proba_calibree", real_rate=0.02, sample_rate=S)
    return rounded(portfolio.tier_thresholds(portfolio.choose_tiers(bands))
                   .select("high", "medium", "medium_end"))


@query("j04_assign_tiers", _TIERED + """ SELECT customer_id, CASE WHEN inactif THEN 'Inactif'
  WHEN proba_calibree >= high THEN 'High' WHEN proba_calibree >= medium THEN 'Medium' ELSE 'Low' END AS niveau
  FROM scores, b_thr""")
def j04(spark, sf):
    df = scores(spark, sf).drop("niveau")
    bands = portfolio.band_lift(df, "proba_calibree", real_rate=0.02, sample_rate=S)
    limits = portfolio.tier_thresholds(portfolio.choose_tiers(bands))
    return portfolio.assign_tiers(df, limits).select("customer_id", "niveau")


@query("j11_partition_controls", sql(
    STORE + auc_sql("scores", "proba_calibree", "partition") + """, r AS (
  SELECT partition AS pt, churn, row_number() OVER (PARTITION BY partition ORDER BY proba_calibree DESC, customer_id) AS rn,
    count(*) OVER (PARTITION BY partition) AS n, sum(churn) OVER (PARTITION BY partition) AS pos FROM scores
), l AS (SELECT pt, max(n) AS clients, CAST(sum(churn) FILTER (WHERE rn <= ceil(0.1::DOUBLE * n)) AS DOUBLE) / ceil(0.1::DOUBLE * max(n)) / (max(pos) / max(n)) AS lift_10
  FROM r GROUP BY pt)""",
    "SELECT partition, clients, roc_auc, lift_10 FROM auc JOIN l ON pt = partition",
    "roc_auc lift_10"))
def j11(spark, sf):
    df = scores(spark, sf)
    out = (metrics.compute_metrics(df, "proba_calibree", (0.10,), by=["partition"])
           .select("partition", "roc_auc", "lift_10")
           .join(df.groupBy("partition").agg(F.count(F.lit(1)).alias("clients")), "partition"))
    return rounded(out)
