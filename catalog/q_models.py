"""Model queries: rule scores (with SQL) and Spark ML jobs (property-checked in the tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base_sql import BASE, SCORED, STORE, mixed_hash_sql
from catalog.q_metrics import auc_sql
from catalog.q_segments import seg_auc_sql
from catalog.registry import query, rounded, sql
from loyaltide.functions.expressions import SHUFFLE_ROUNDS, shuffle_rounds, shuffled_position
from loyaltide.operators import describe, features, hypothesis_tests as ht, isotonic, metrics, models
from loyaltide.operators.explain import global_importance, grouped, rank_confrontation
from loyaltide.operators.ranking import row_numbers
from loyaltide.operators.segments_by_rule import segment_rate_scores
from loyaltide.operators.tree_contributions import (ensemble_paths, expected_value,
                                                    tree_contributions)
from loyaltide.plans.model_scores import explanation
from loyaltide.plans.score_table import load_store
from loyaltide.sources.customer_base import load_customer_base as base
from loyaltide.staging import stage

COLUMNS = ("months", "eqpdays", "rev_Mean", "mou_Mean", "avg3mou", "avg6mou", "avg3rev", "avg6rev",
           "change_mou", "totmrc_Mean", "ovrrev_Mean", "custcare_Mean", "hnd_price", "actvsubs",
           "uniqsubs", "phones", "hnd_webcap", "area")
FOLDS = range(5)              # the frozen folds of the customer table


def spec(kind: str, **params) -> models.ModelSpec:
    return models.ModelSpec(kind, COLUMNS, params=params, contract_months=(69, 70))


def rows(spark, sf):
    df = base(spark, sf)
    return df.select("customer_id", "churn", "fold", "partition", *COLUMNS)


@query("f02_segment_rate_scores", sql(SCORED, "SELECT customer_id, proba_calibree, taux_appris FROM scored", "proba_calibree:9 taux_appris:9"))
def f02(spark, sf):
    df = load_store(spark, sf).scores.drop("proba_calibree", "taux_appris")
    return rounded(segment_rate_scores(df, learn_from=F.col("partition") == "train_oof").select(
        "customer_id", "proba_calibree", "taux_appris"), 9)


@query("f03_dummy_scores", SCORED + f""", t AS (SELECT fold, sum(churn) AS p, count(*) AS n FROM cust GROUP BY 1
), pr AS (SELECT fold, CAST(sum(p) OVER () - p AS DOUBLE) / (sum(n) OVER () - n) AS prior FROM t)
  SELECT customer_id, churn, cust.fold, CASE WHEN {mixed_hash_sql('customer_id', 42)} / 4294967296.0::DOUBLE < prior THEN 1.0::DOUBLE ELSE 0 END AS score FROM cust JOIN pr USING (fold)""")
def f03(spark, sf):
    return models.dummy_scores(base(spark, sf))


def _fold_rates(label: str, p: str) -> str:
    text = auc_sql(f"{p}sr", "score", "fold")
    for name in ("auc", "cum", "sc"):
        text = text.replace(f", {name} AS (", f", {p}{name}x AS (").replace(f"FROM {name}", f"FROM {p}{name}x")
    return seg_auc_sql(label, p) + text


_LABELS = {"regles": "segment_regles", "segment": "segment", "zone": "area"}
ABL = (STORE + ", cust2 AS (SELECT c.*, s.segment, s.segment_regles FROM cust c JOIN scores s USING (customer_id))"
       + "".join(_fold_rates(c, f"{n}_") for n, c in _LABELS.items())
       + ", abl AS (" + " UNION ALL ".join(f"SELECT '{n}' AS configuration, 'taux' AS modele, fold, roc_auc AS auc FROM {n}_aucx" for n in _LABELS) + ")")


def ablation_table(spark, sf):
    """AUC per fold of the segment-rate score under three labelings."""
    extra = load_store(spark, sf).scores.select("customer_id", "segment", "segment_regles")
    df = base(spark, sf).join(extra, "customer_id")
    out = None
    for name, label in _LABELS.items():
        scored = segment_rate_scores(df.select("customer_id", "churn", "fold", label), label,
                                     score="_s")
        part = metrics.roc_auc(scored, "_s", by=["fold"]).select(
            F.lit(name).alias("configuration"), F.lit("taux").alias("modele"), "fold",
            F.col("roc_auc").alias("auc"))
        out = part if out is None else out.unionByName(part)
    return out


@query("f10_cross_validate_rules", sql(ABL, "SELECT fold, auc FROM abl WHERE configuration = 'regles'", "auc"))
def f10(spark, sf):
    return rounded(ablation_table(spark, sf).filter(F.col("configuration") == "regles")
                   .select("fold", "auc"))


@query("f11_ablation", sql(ABL, "SELECT * FROM abl", "auc"))
def f11(spark, sf):
    return rounded(ablation_table(spark, sf))


_SUMMARY = ABL + """, sm AS (SELECT a.modele, a.configuration, avg(a.auc) AS auc_moyenne, stddev_samp(a.auc) AS auc_ecart_type, avg(a.auc - r.auc) AS gain_moyen,
  stddev_samp(a.auc - r.auc) AS gain_ecart_type, count(*) FILTER (WHERE a.auc > r.auc) AS folds_en_hausse FROM abl a JOIN abl r ON r.configuration = 'zone' AND r.fold = a.fold GROUP BY 1, 2)"""
_SUM_COLS = "auc_moyenne auc_ecart_type gain_moyen gain_ecart_type"


@query("f12_summarize_ablation", sql(_SUMMARY, "SELECT * FROM sm", _SUM_COLS))
def f12(spark, sf):
    return rounded(models.summarize_ablation(ablation_table(spark, sf), "zone"))


@query("f13_summarize_folds", sql(ABL, "SELECT 'auc' AS metrique, avg(auc) AS moyenne, stddev_samp(auc) AS ecart_type FROM abl WHERE configuration = 'regles'", "moyenne ecart_type"))
def f13(spark, sf):
    table = ablation_table(spark, sf).filter(F.col("configuration") == "regles")
    return rounded(models.summarize_folds(table.select("fold", "auc")))


@query("f15_selection_rules", sql(_SUMMARY, "SELECT configuration, auc_moyenne, folds_en_hausse = 5 AND gain_moyen >= 0.01 AS retenu FROM sm", "auc_moyenne"))
def f15(spark, sf):
    summary = models.summarize_ablation(ablation_table(spark, sf), "zone")
    return rounded(models.final_choice(summary).select("configuration", "auc_moyenne", "retenu"))


@query("f15_one_sd_rule", sql(_SUMMARY + ", bb AS (SELECT arg_max(auc_moyenne, auc_moyenne) AS a, arg_max(auc_ecart_type, auc_moyenne) AS s FROM sm)",
    "SELECT configuration, auc_moyenne FROM sm, bb WHERE auc_moyenne >= a - s ORDER BY auc_ecart_type, auc_moyenne DESC LIMIT 1", "auc_moyenne"))
def f15b(spark, sf):
    summary = models.summarize_ablation(ablation_table(spark, sf), "zone")
    return rounded(models.one_sd_rule(summary, tie="auc_ecart_type").select("configuration",
                                                                            "auc_moyenne"))


@query("f18_calibration_choice", sql(STORE + """, br AS (SELECT 'sigmoid' AS methode, fold, avg((proba_calibree - churn) ** 2) AS brier FROM scores GROUP BY 2
  UNION ALL SELECT 'isotonic', fold, avg((taux_appris - churn) ** 2) FROM scores GROUP BY 2
), bs AS (SELECT methode, avg(brier) AS m, stddev_samp(brier) AS s FROM br GROUP BY 1
), bt AS (SELECT arg_min(methode, m) AS meilleure, min(m) AS m, arg_min(s, m) AS s, min(m) FILTER (WHERE methode = 'sigmoid') AS p FROM bs)""",
    "SELECT CASE WHEN p <= m + s THEN 'sigmoid' ELSE meilleure END AS choix, meilleure FROM bt"))
def f18(spark, sf):
    df = load_store(spark, sf).scores
    table = (metrics.brier(df, "proba_calibree", by=["fold"]).withColumn("methode", F.lit("sigmoid"))
             .unionByName(metrics.brier(df, "taux_appris", by=["fold"])
                          .withColumn("methode", F.lit("isotonic"))))
    return models.calibration_choice(table)


LEAKY = ABL + """, lk AS (SELECT fold, churn, avg(churn) OVER (PARTITION BY segment_regles) AS score FROM cust2)""" + \
    auc_sql("lk", "score", "fold").replace(", auc AS", ", lauc AS").replace(", cum AS", ", lcum AS").replace("FROM cum", "FROM lcum").replace(", sc AS", ", lsc AS").replace("FROM sc", "FROM lsc")


@query("f22_leaky_encoding", sql(LEAKY, "SELECT fold, l.roc_auc AS auc_fuite, a.auc AS auc_hors_fold, l.roc_auc - a.auc AS ecart FROM lauc l JOIN abl a USING (fold) WHERE configuration = 'regles'", "auc_fuite auc_hors_fold ecart"))
def f22(spark, sf):
    extra = load_store(spark, sf).scores.select("customer_id", "segment_regles")
    df = base(spark, sf).select("customer_id", "churn", "fold").join(extra, "customer_id")
    rates = df.groupBy("segment_regles").agg(F.avg("churn").alias("_s"))
    leaky = metrics.roc_auc(df.join(F.broadcast(rates), "segment_regles"), "_s", by=["fold"])
    clean = ablation_table(spark, sf).filter(F.col("configuration") == "regles")
    out = leaky.select("fold", F.col("roc_auc").alias("auc_fuite")).join(
        clean.select("fold", F.col("auc").alias("auc_hors_fold")), "fold")
    return rounded(out.withColumn("ecart", F.col("auc_fuite") - F.col("auc_hors_fold")))


@query("f23_fold_comparison", sql(ABL, "SELECT a.configuration, a.fold, a.auc - r.auc AS gain, a.auc > r.auc AS gagne FROM abl a JOIN abl r ON r.configuration = 'regles' AND r.fold = a.fold", "gain"))
def f23(spark, sf):
    table = ablation_table(spark, sf)
    ref = table.filter(F.col("configuration") == "regles").select("fold", F.col("auc").alias("r"))
    gain = F.col("auc") - F.col("r")
    return rounded(table.join(ref, "fold").select("configuration", "fold", gain.alias("gain"),
                                                  (gain > 0).alias("gagne")))


def _cv(kind, **params):
    def run(spark, sf):
        return models.cross_validate(rows(spark, sf), spec(kind, **params), FOLDS).per_fold
    return run


query("f04_logreg_simple")(_cv("logreg_simple"))
query("f05_logreg_improved")(_cv("logreg"))
query("f06_decision_tree")(_cv("decision_tree"))
query("f07_random_forest")(_cv("random_forest"))
query("f08_boosting")(_cv("boosting"))


@query("f14_parameter_search")
def f14(spark, sf):
    return models.parameter_search(rows(spark, sf), spec("decision_tree"),
                                   {"max_depth": list(range(3, 13)),
                                    "min_leaf": [20, 50, 100, 200, 500]}, folds=FOLDS)


def oof(spark, sf):
    return models.cross_validate(rows(spark, sf), spec("logreg_simple"), FOLDS,
                                 train_auc=False).scores


@query("f11_model_ablation")
def f11m(spark, sf):
    return models.group_ablation(rows(spark, sf), spec("logreg_simple"), FOLDS)


@query("f18_fitted_calibrators")
def f18m(spark, sf):
    """Brier score of both fitted calibrators by fold, and which one the rule keeps."""
    table = stage(models.calibrator_scores(oof(spark, sf)), "calibrators")
    return table.crossJoin(F.broadcast(models.calibration_choice(table)))      # one row


@query("f16_sigmoid_calibration")
def f16(spark, sf):
    scores = oof(spark, sf)
    return models.fit_calibrator(scores, "sigmoid").apply(scores, "score")


@query("f17_isotonic_calibration")
def f17(spark, sf):
    scores = oof(spark, sf)
    return models.fit_calibrator(scores, "isotonic").apply(scores, "score")


# The largest, over all starts up to a score, of the smallest mean from there to any end beyond it.
@query("f17_isotonic_fit", sql(BASE + """, d AS (SELECT CAST(months AS DOUBLE) * 1000 + eqpdays // 30 AS x, count(*) AS w, CAST(sum(churn) AS DOUBLE) AS s FROM cust WHERE months IS NOT NULL AND eqpdays IS NOT NULL GROUP BY 1
), e AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs FROM d
), m AS (SELECT a.i AS a, b.i, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS low FROM e a JOIN e b ON b.i >= a.i
), g AS (SELECT i, max(low) AS v FROM m GROUP BY 1)""", "SELECT customer_id, v AS valeur FROM cust JOIN e ON x = CAST(months AS DOUBLE) * 1000 + eqpdays // 30 JOIN g USING (i)", "valeur:9"))
def f17_fit(spark, sf):
    x = F.col("months").cast("double") * 1000 + F.floor(F.col("eqpdays") / 30)
    df = base(spark, sf).select("customer_id", "churn", x.alias("x")).filter("x IS NOT NULL")
    fitted = isotonic.IsotonicMap(isotonic.isotonic_blocks(df, "x", "churn"))
    return rounded(fitted.apply(df, "x", "valeur").select("customer_id", "valeur"), 9)


@query("f19_out_of_fold_scores")
def f19(spark, sf):
    return models.out_of_fold_scores(rows(spark, sf), spec("decision_tree"), folds=FOLDS)


@query("f20_final_scores")
def f20(spark, sf):
    df = rows(spark, sf)
    model = models.fit_calibrated(df.filter(F.col("partition") == "train_oof"),
                                  spec("logreg_simple"))
    return models.final_scores(model, df.filter(F.col("partition") == "test"))


@query("f21_leak_test")
def f21(spark, sf):
    df = rows(spark, sf)
    return models.leak_test(df.withColumn("actif", features.active_customer(df)),
                            spec("decision_tree"), "actif", FOLDS)


@query("h01_tree_contributions")
def h01(spark, sf):
    df = rows(spark, sf)
    fitted = models.fit_model(df, spec("boosting"))
    paths = ensemble_paths(fitted.model)
    out = tree_contributions(fitted.vectors(df), paths, fitted.inputs)
    return grouped(out).withColumn("valeur_base", F.lit(expected_value(paths)))


def _shuffle_sql(seed: int) -> str:
    text = ", r0 AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS p, count(*) OVER () AS n FROM cust)"
    text += ", s0 AS (SELECT customer_id, p, n, p AS x FROM r0)"
    for i, (u, key) in enumerate(shuffle_rounds(seed)):
        text += (f", t{i} AS (SELECT *, ((CAST(floor({u!r}::DOUBLE * n) AS BIGINT) - x) % n + n) % n AS y FROM s{i})"
                 f", s{i + 1} AS (SELECT customer_id, p, n, CASE WHEN {mixed_hash_sql('greatest(x, y)', key)} % 2 = 1 THEN y ELSE x END AS x FROM t{i})")
    return text


@query("h14_shuffled_positions", BASE + _shuffle_sql(42) + f" SELECT customer_id, p + 1 AS position, x + 1 AS donneur FROM s{SHUFFLE_ROUNDS}")
def h14_positions(spark, sf):
    placed = row_numbers(base(spark, sf).select("customer_id"), ["customer_id"], name="position")
    at = shuffled_position(F.col("position") - 1, F.col("position_n"), 42) + 1
    return placed.select("customer_id", "position", at.alias("donneur"))


@query("h16_model_ranks")
def h16m(spark, sf):
    """Ranks of the original columns by mean contribution of a fitted model, by the loss of AUC when
    they are shuffled, and by information about the target."""
    df = rows(spark, sf)
    fitted = models.fit_model(df, spec("logreg"))
    ready = fitted.prepare.features(df)
    lines, _ = explanation(fitted, ready, ready)
    shuffled = models.permutation_importance(df, lambda d: fitted.score(d, "score"), COLUMNS)
    text = [c for c in COLUMNS if c in ("hnd_webcap", "area")]
    known = ht.numeric_information(df, [c for c in COLUMNS if c not in text]).unionByName(
        ht.mutual_information(describe.level_counts(df, text)))
    return rank_confrontation(
        ("contribution", global_importance(lines), "shap_abs_moyen"),
        ("permutation", shuffled, "baisse_auc"), ("information", known, "info_mutuelle"))


@query("h14_permutation_importance")
def h14(spark, sf):
    df = rows(spark, sf)
    fitted = models.fit_model(df, spec("decision_tree"))
    return models.permutation_importance(df, lambda d: fitted.score(d, "score"), COLUMNS)
