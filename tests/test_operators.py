"""Exact values and identities on small frames."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import adjust_prior, hash_uniform, safe_divide
from loyaltide.operators import (bootstrap, customers, dashboards, describe, explain, features,
                                 hypothesis_tests as ht, metrics, portfolio, preprocessing as pp,
                                 quality, segmentation, splits, text_audit as ta)
from loyaltide.operators.ranking import exact_quantiles, row_numbers, running_totals
from loyaltide.sources import tables


def one(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def ranking(spark):
    y = [1, 1, 0, 1, 0, 0, 0, 0, 0, 0]
    s = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, s))],
                                 "customer_id bigint, churn int, score double").cache()


@pytest.fixture(scope="module")
def skewed(spark):
    """20 000 rows, a third of them under one value."""
    return spark.range(20000).select(
        F.col("id").alias("customer_id"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(hash_uniform("id", 3)).alias("score"),
        (hash_uniform("id", 9) < 0.4).cast("int").alias("churn")).cache()


# --- Order statistics ----------------------------------------------------------------------

def test_running_totals_match_a_plain_window_with_heavy_ties(skewed):
    got = running_totals(skewed, [("score", "desc"), "customer_id"],
                         {"pos": F.col("churn").cast("bigint")}).toPandas()
    want = skewed.toPandas().sort_values(["score", "customer_id"], ascending=[False, True])
    got = got.set_index("customer_id").loc[want["customer_id"]]
    assert (got["pos_cum"].to_numpy() == want["churn"].cumsum().to_numpy()).all()
    assert (got["pos_all"] == want["churn"].sum()).all()


def test_running_totals_restart_within_groups_and_keep_null_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")],
                               "id bigint, g string")
    rows = {r["id"]: (r["rn"], r["rn_n"]) for r in row_numbers(df, ["id"], ["g"]).collect()}
    assert rows == {1: (1, 2), 2: (2, 2), 3: (1, 2), 4: (2, 2), 5: (1, 1)}


def test_no_single_partition_exchange_over_rows(skewed):
    plan = running_totals(skewed, [("score", "desc"), "customer_id"], {"n": F.lit(1)}) \
        ._jdf.queryExecution().toString()
    rows_part = plan.split("Optimized Logical Plan")[1]
    assert "SinglePartition" not in rows_part.split("_s_n")[0]


def test_exact_quantiles_interpolate(skewed):
    probs = [0.0, 0.01, 0.25, 0.5, 0.731, 1.0]
    row = exact_quantiles(skewed, ["score"], probs).first()
    want = np.quantile(skewed.toPandas()["score"], probs)
    assert np.allclose([row[f"q{i}"] for i in range(6)], want, atol=1e-12)


# --- Metrics -------------------------------------------------------------------------------

def test_ranking_metrics(ranking):
    row = metrics.compute_metrics(ranking, "score", (0.2,)).first()
    assert row["roc_auc"] == pytest.approx(20 / 21)
    assert row["precision_20"] == 1.0 and row["recall_20"] == pytest.approx(2 / 3)
    assert row["lift_20"] == pytest.approx(1 / 0.3)
    assert row["pr_auc"] == pytest.approx((1 + 1 + 3 / 4) / 3)


def test_ties_count_half(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.5), (3, 0, 0.1)],
                               "customer_id bigint, churn int, score double")
    assert one(metrics.roc_auc(df, "score")) == pytest.approx(0.75)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.2)],
                               "customer_id bigint, churn int, score double")
    assert one(metrics.roc_auc(df, "score")) is None


def test_auc_against_brute_force(skewed):
    rows = skewed.limit(600).cache()
    p = rows.toPandas()
    a, b = p[p.churn == 1].score.to_numpy(), p[p.churn == 0].score.to_numpy()
    want = ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))
    assert one(metrics.roc_auc(rows, "score")) == pytest.approx(want)


def test_bootstrap_brackets_the_auc_and_is_reproducible(skewed):
    rows = skewed.limit(800).withColumn("score", F.col("score") + 0.3 * F.col("churn")).cache()
    a = bootstrap.bootstrap_auc_ci(rows, "score", n_boot=60).first()
    b = bootstrap.bootstrap_auc_ci(rows.repartition(5), "score", n_boot=60).first()
    assert a["ic_bas"] < a["auc"] < a["ic_haut"] and a["n_tirages"] == 60
    assert a["erreur_type"] == pytest.approx(b["erreur_type"])
    same = bootstrap.bootstrap_auc_difference(rows.withColumn("other", F.col("score")), "score",
                                            "other", n_boot=20).first()
    assert same["difference"] == 0 and same["ic_bas"] == 0 and same["part_positive"] == 0


def test_bootstrap_replicates_against_brute_force(skewed):
    """A third of the rows share one score and spread over several ranges."""
    rows = skewed.limit(3000).repartition(3).cache()
    got = {r["replicate"]: r["roc_auc"]
           for r in bootstrap.bootstrap_auc(rows, ["score"], n_boot=5).collect()}
    p = rows.select("score", "churn", F.xxhash64("customer_id", F.lit(42)).alias("h")).toPandas()
    z = p.h.to_numpy().astype(np.uint64)[:, None] + (
        np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    law = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    w = np.searchsorted(law, u, side="right")
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06
    s, y = p.score.to_numpy(), p.churn.to_numpy()
    for b in range(5):
        a, c, wa, wc = s[y == 1], s[y == 0], w[y == 1, b], w[y == 0, b]
        wins = ((a[:, None] > c) + 0.5 * (a[:, None] == c)) * wa[:, None] * wc
        assert got[b + 1] == pytest.approx(wins.sum() / (wa.sum() * wc.sum()))


# --- Prior and weights ---------------------------------------------------------------------

def test_prior_fixed_points(spark):
    row = spark.range(1).select(adjust_prior(F.lit(0.5), 0.02, 0.5).alias("a"),
                                adjust_prior(F.lit(0.3), 0.4, 0.4).alias("b")).first()
    assert row["a"] == pytest.approx(0.02) and row["b"] == pytest.approx(0.3)
    with pytest.raises(ValueError):
        adjust_prior(F.lit(0.5), 1.2, 0.5)


def test_production_precision_of_a_perfect_ranking(spark):
    df = spark.range(1000).select(F.col("id").alias("customer_id"),
                                  (F.col("id") < 500).cast("int").alias("churn"),
                                  (1 - F.col("id") / 1000).alias("score"))
    got = one(metrics.production_precision_at_k(df, "score", 0.02, 0.5, 0.10))
    assert got == pytest.approx(0.2, abs=0.005)


@pytest.fixture(scope="module")
def book(spark):
    p = hash_uniform("id", 5)
    df = spark.range(5000).select(
        F.col("id").alias("customer_id"), p.alias("proba_calibree"),
        (hash_uniform("id", 6) < p).cast("int").alias("churn"),
        (40 + 30 * hash_uniform("id", 7)).alias("rev_Mean"),
        F.when(F.col("id") % 33 == 0, 0.0).otherwise(100.0).alias("mou_Mean"))
    df = df.withColumns({"proba_reelle": adjust_prior("proba_calibree", 0.02, 0.5),
                         "inactif": portfolio.is_inactive()})
    df = df.withColumn("revenu_en_jeu", portfolio.revenue_at_risk())
    return portfolio.with_portfolio_weights(df).cache()


def test_weights_sum_to_the_portfolio_and_to_the_assumed_rate(book):
    row = book.agg(F.sum(fv.PORTFOLIO_WEIGHT), F.sum(F.col(fv.PORTFOLIO_WEIGHT) * F.col("churn"))) \
        .first()
    assert row[0] == pytest.approx(100000) and row[1] == pytest.approx(2000)


def test_bands_cover_everyone_and_tiers_follow_capacity(book):
    bands = portfolio.band_lift(book, "proba_calibree", real_rate=0.02)
    rows = portfolio.choose_tiers(bands).orderBy("bande").collect()
    assert len(rows) == 20 and sum(r["n"] for r in rows) == 5000
    assert [r["niveau"] for r in rows[:2]] == ["High", "High"]
    assert rows[-1]["lift_cumule"] == pytest.approx(1.0)
    levels = [r["niveau"] for r in rows]
    assert levels == sorted(levels, key=["High", "Medium", "Low"].index)
    with pytest.raises(ValueError):
        portfolio.choose_tiers(bands, capacity=0.12)


def test_campaign_against_brute_force(book):
    p = book.toPandas()
    w = p[fv.PORTFOLIO_WEIGHT]
    act = p[~p.inactif].sort_values(["proba_calibree", "customer_id"], ascending=[False, True])
    wa = act[fv.PORTFOLIO_WEIGHT]
    before = (wa.cumsum() - wa) / w.sum()
    for r in portfolio.campaign_curve(book, [0.05, 0.10, 0.999]).collect():
        top = before < r["capacite"]
        assert r["n_rows"] == int(top.sum())
        assert r["churners_attendus"] == pytest.approx((wa * act.proba_reelle)[top].sum())


def test_campaign_table_and_empty_tier(book):
    table = {r["groupe"]: r for r in portfolio.campaign_table(book).collect()}
    assert len(table) == 5
    assert table[fv.WHOLE_ROW]["part_churners_attendus"] == pytest.approx(1)
    rows = portfolio.tier_summary(book.withColumn("niveau", F.lit("Low"))).collect()
    assert {r["niveau"]: r["n_rows"] for r in rows} == {"High": 0, "Medium": 0, "Low": 5000,
                                                        "Inactif": 0}


def test_campaign_bounds_and_no_invented_cost(book):
    for bad in ({"capacity_pct": 0, "success_rate": 0.1}, {"capacity_pct": 5, "success_rate": 2},
                {"capacity_pct": 5, "success_rate": 0.1, "offer_cost": -1},
                {"capacity_pct": 5, "success_rate": 0.1, "horizon_months": 0}):
        with pytest.raises(ValueError):
            portfolio.simulate_campaign(book, **bad)
    row = portfolio.simulate_campaign(book, 10, 0.2).filter("kind = 'result'").first()
    assert row["campaign_cost"] is None and row["net_balance"] is None
    rows = portfolio.simulate_campaign(book, 10, 0.2, 3.0, 2).filter("kind = 'curve'").collect()
    assert len(rows) == 50
    for r in rows:
        assert r["net_balance"] == pytest.approx(
            r["preserved_revenue_horizon_hypothesis"] - r["campaign_cost"])


def test_bad_dimension_and_sort(book):
    with pytest.raises(ValueError):
        dashboards.segments(book, "inconnu")
    with pytest.raises(ValueError):
        dashboards.heatmap(book, "area", "area")
    with pytest.raises(ValueError):
        customers.select_customers(book, sort="x")
    with pytest.raises(ValueError):
        customers.list_customers(book, page=0)
    with pytest.raises(LookupError):
        customers.get_customer(book, -1)


# --- Cleaning and splits -------------------------------------------------------------------

def test_negatives_flag_and_idempotence(spark):
    df = spark.createDataFrame([(-1.0, 1.0, 1.0, -3.0), (5.0, -2.0, 1.0, None)],
                               "rev_Mean double, totmrc_Mean double, avg6rev double, eqpdays double")
    once = quality.negatives_to_null(df)
    rows = quality.negatives_to_null(once).collect()
    assert [r["rev_Mean"] for r in rows] == [None, 5.0]
    assert [r["rev_Mean_was_negative"] for r in rows] == [1, 0]
    assert [r["totmrc_Mean_was_negative"] for r in rows] == [0, 1]
    assert [r["eqpdays_was_negative"] for r in rows] == [1, 0]


def test_unknown_is_column_specific_and_levels_are_checked(spark):
    df = spark.createDataFrame([("U", "U", "ASIA"), ("Y", "S", None)],
                               "new_cell string, prizm_social_one string, area string")
    out = quality.explicit_unknown(df).collect()
    assert out[0]["new_cell"] == "Unknown" and out[0]["prizm_social_one"] == "U"
    with pytest.raises(ValueError, match="area"):
        quality.cast_categories(df, {"area": ["EUROPE"]})


def test_schema_failures_empty_when_clean(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert quality.schema_failures(df, quality.bound_checks({"x": (0, 5)})).count() == 0


def test_split_is_stratified_disjoint_and_locked(spark, skewed, tmp_path):
    parts = splits.split_train_test(skewed)
    again = splits.split_train_test(skewed.repartition(7))
    assert parts.exceptAll(again).count() == 0
    rows = {r["partition"]: r for r in splits.split_summary(parts).collect()}
    assert rows["test"]["part"] == pytest.approx(0.2, abs=1e-3)
    assert rows["test"]["taux"] == pytest.approx(rows["train_oof"]["taux"], abs=1e-3)
    assert rows["test"]["ids_communs"] == 0
    tables.save_splits(parts, str(tmp_path / "s"))
    with pytest.raises(PermissionError):
        tables.load_test(spark, str(tmp_path / "s"))
    assert tables.load_train(spark, str(tmp_path / "s")).count() == rows["train_oof"]["n"]


def test_missing_store_lists_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="scores"):
        tables.read_store(spark, str(tmp_path / "none"))


# --- Features and preprocessing ------------------------------------------------------------

def test_safe_divide_never_infinite(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1e300, 1e-300), (6.0, 3.0)],
                               "a double, b double")
    assert [r[0] for r in df.select(safe_divide("a", "b")).collect()] == [None, None, None, 2.0]


def test_unknown_feature_group(spark):
    with pytest.raises(ValueError):
        features.build_features(spark.range(1), ["rien"])
    assert features.build_features(spark.range(1), []).columns == ["id"]


def test_winsorizer_keeps_rare_indicators(spark):
    df = spark.range(1000).select((F.col("id") < 5).cast("double").alias("rare"),
                                  F.col("id").cast("double").alias("x"))
    out = pp.winsorize(df, pp.fit_winsorizer(df, ["rare", "x"]), ["rare", "x"])
    row = out.agg(F.sum("rare"), F.max("x"), F.min("x")).first()
    assert row[0] == 5 and row[1] < 999 and row[2] > 0


def test_medians_come_from_fit_rows_only(spark):
    fit = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    new = spark.createDataFrame([(None,), (100.0,)], "x double")
    rows = pp.impute_median(new, pp.fit_medians(fit, ["x"]), ["x"], True).collect()
    assert [r["x"] for r in rows] == [2.0, 100.0] and [r["x_manquant"] for r in rows] == [0, 0]


def test_spline_basis_sums_to_one_and_is_constant_outside(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    knots = pp.fit_knots(df, ["x"])
    probe = spark.createDataFrame([(-50.0,), (0.0,), (33.3,), (100.0,), (400.0,)], "x double")
    rows = [[r[f"x_sp{i}"] for i in range(7)]
            for r in pp.spline_basis(probe, knots, "x").collect()]
    for r in rows:
        assert sum(r) == pytest.approx(1.0)
    assert rows[0] == pytest.approx(rows[1]) and rows[3] == pytest.approx(rows[4])


def test_one_hot_unknown_level_is_all_zero(spark):
    fit = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    out = pp.one_hot(spark.createDataFrame([("z",), ("a",)], "c string"),
                     pp.fit_levels(fit, ["c"]), ["c"]).collect()
    assert sum(out[0]) == 0 and out[1]["c_a"] == 1


# --- Tests and description -----------------------------------------------------------------

def test_mann_whitney_known_values(spark):
    x1, x0 = [3.0, 4.0, 5.0, 7.0, 9.0], [1.0, 2.0, 3.0, 4.0, 6.0, 8.0]
    df = spark.createDataFrame([(v, 1) for v in x1] + [(v, 0) for v in x0], "x double, churn int")
    row = ht.mann_whitney(df, ["x"]).first()
    u = sum((a > b) + 0.5 * (a == b) for a in x1 for b in x0)
    assert row["statistique"] == pytest.approx(u)
    assert row["effet"] == pytest.approx(2 * u / 30 - 1)
    ties = 2 * (2 ** 3 - 2)
    sd = math.sqrt(30 / 12 * (12 - ties / (11 * 10)))
    want = math.erfc((abs(u - 15) - 0.5) / sd / math.sqrt(2))
    assert row["p_value"] == pytest.approx(want, abs=1e-6)


def test_fisher_replaces_chi2_on_sparse_tables(spark):
    rows = [("oui", 1)] * 3 + [("oui", 0)] * 1 + [("non", 1)] * 2 + [("non", 0)] * 14
    row = ht.chi2_test(spark.createDataFrame(rows, "c string, churn int"), ["c"]).first()
    n, k, r = 20, 5, 4
    law = [math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k) for x in range(5)]
    want = sum(p for p in law if p <= law[3] + 1e-9)
    assert row["test"] == "Fisher exact" and row["p_value"] == pytest.approx(want, rel=1e-6)


def test_non_monotone_peak_is_found(spark):
    df = spark.range(4000).select(
        F.col("id").alias("customer_id"), (F.col("id") % 20).cast("double").alias("x"),
        ((F.col("id") % 20).isin(9, 10) & (F.col("id") % 7 > 0)).cast("int").alias("churn"))
    t = ht.univariate_table(df.withColumn("c", F.lit("k")).withColumn(
        "c", F.when(F.col("customer_id") % 2 == 0, "a").otherwise("b")), ["x"], ["c"]).filter(
            "variable = 'x'").first()
    assert t["forme_courbe"] == "non monotone" and t["relation_non_monotone"]


def test_holm_steps(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "variable string, p_value double")
    got = {r["variable"]: r["p_holm"] for r in quality.holm(df).collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_vif_drops_the_combined_column(spark):
    df = spark.range(2000).select(hash_uniform("id", 1).alias("x1"), hash_uniform("id", 2).alias("x2"),
                                  hash_uniform("id", 3).alias("e"))
    df = df.withColumn("x3", F.col("x1") + F.col("x2") + 0.01 * F.col("e"))
    kept, history = ht.iterative_vif(df, ["x1", "x2", "x3"])
    assert len(kept) == 2 and history.count() == 1


def test_variable_clusters_average_link():
    pairs = [("a", "b", 0.97), ("a", "c", 0.2), ("b", "c", -0.1)]
    groups = ht.variable_clusters(pairs, ["a", "b", "c"])
    assert groups["a"] == groups["b"] != groups["c"]


def test_missing_group_is_last_and_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(1, 11)] + [(None, 1)],
                               "x double, churn int")
    rows = describe.churn_rate_table(df, F.col("x") > 5).orderBy("ordre").collect()
    assert rows[-1]["groupe"] == "Manquant"
    bins = describe.quantile_bins(df, ["x"], 2).orderBy("value").collect()
    assert [b["classe"] for b in bins] == [1] * 5 + [2] * 5


def test_spearman_with_ties(spark):
    x, y = [1.0, 2.0, 2.0, 4.0], [1.0, 3.0, 2.0, 9.0]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(x, y))],
                               "customer_id bigint, x double, y double")
    rho = describe.spearman_matrix(df, ["x", "y"], digits=None).first()["rho"]
    assert rho == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1, 3, 2, 4])[0, 1])


# --- Explanation, segments, texts ----------------------------------------------------------

def test_tenure_is_actionable_only_in_the_window(spark):
    rows = spark.createDataFrame([("months", True), ("months", False), ("crclscod", True),
                                  ("eqpdays", False)], "v string, w boolean")
    got = [r[0] for r in rows.select(explain.family(F.col("v"), F.col("w"))).collect()]
    assert got == ["engagement", "contexte", "contexte", "terminal"]


def test_reasons_only_raise_the_risk(spark):
    c = spark.createDataFrame([(1, "eqpdays", 0.4), (1, "months", 0.9), (1, "change_mou", -0.7),
                               (1, "crclscod", -0.2)],
                              "customer_id bigint, variable string, contribution double")
    w = spark.createDataFrame([(1, False)], "customer_id bigint, in_window boolean")
    rows = {r["variable"]: r for r in explain.factor_table(c, w).collect()}
    assert rows["eqpdays"]["rang_raison"] == 1 and rows["change_mou"]["rang_raison"] is None
    assert rows["months"]["rang_contexte"] == 1 and rows["crclscod"]["rang_contexte"] == 2
    assert rows["months"]["rang"] == 1


def test_cluster_names(spark):
    rows = [(0, 14.0, 45.0, 300.0, 0.0), (1, 30.0, 40.0, 200.0, -5.0), (2, 12.0, 20.0, 90.0, 0.0),
            (3, 13.0, 70.0, 1200.0, -180.0), (4, 13.5, 65.0, 1100.0, 160.0)]
    df = spark.createDataFrame(rows, "segment_id int, months double, totmrc_Mean double, "
                               "mou_Mean double, change_mou double")
    names = {r[0]: r[1] for r in segmentation.name_clusters(df).collect()}
    assert names == {0: fv.NAME_MODERATE_RECENT, 1: fv.NAME_TENURED_OLD_DEVICE,
                     2: fv.NAME_SECONDARY_LINES, 3: fv.NAME_HEAVY_DECLINING,
                     4: fv.NAME_HEAVY_GROWING}
    with pytest.raises(ValueError):
        segmentation.name_clusters(df.filter("segment_id < 4"))


def test_identical_labelings_agree(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 2)], "a int, b int")
    assert one(segmentation.adjusted_rand(df, "a", "b")) == pytest.approx(1.0)


def test_numbers_in_text(spark):
    text = "Environ 116 162 $ (2,5 %), D79 et 3G exclus, 1 000 contacts, top 10."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [(r["valeur"], r["decimales"]) for r in ta.extract_numbers(df, ["id"]).orderBy("pos")
           .collect()]
    assert got == [(116162.0, 0), (2.5, 1), (1000.0, 0), (10.0, 0)]


def test_number_tolerance(spark):
    df = spark.createDataFrame([(1, "116 000 et 7,4 puis 9 999 et 0,3")], "id int, text string")
    allowed = spark.createDataFrame([(1, 116162.0), (1, 7.42), (1, 0.26)], "id int, autorise double")
    got = ta.unsupported_numbers(ta.extract_numbers(df, ["id"]), allowed, ["id"]).collect()
    assert [r["texte"] for r in got] == ["9 999"]


def test_sensitive_terms_ignore_accents(spark):
    df = spark.createDataFrame([(1, "Votre SITUATION FAMILIALE et vos enfants")],
                               "id int, text string")
    got = {r["terme"] for r in ta.sensitive_hits(df, ["id"]).collect()}
    assert got == {"situation familiale", "enfant"}


def test_sms_is_cut_at_a_sentence_end(spark):
    text = "a" * 150 + ". " + "b" * 100 + "! " + "c" * 100
    row = spark.createDataFrame([(text,), ("court.",), ("d" * 400,)], "s string").select(
        ta.shorten_sms(F.col("s"))).collect()
    assert row[0][0].endswith("!") and len(row[0][0]) == 253
    assert row[1][0] == "court." and len(row[2][0]) == 300 and row[2][0].endswith("…")


def test_routing_rules(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"], True, True), ([], [], True, True),
                                (["c"], ["a"], False, True), ([], ["a"], True, False)],
                               "appels array<string>, attendus array<string>, fidele boolean, evalue boolean")
    row = ta.evaluation_summary(df).first()
    assert row["n"] == 3 and row["routage"] == pytest.approx(2 / 3)


# --- Exact tails, plain numbers, titles, accents, sparse coding ---------------------------------

def test_chi_square_tail_is_exact(spark):
    from loyaltide.operators.hypothesis_tests import _chi2_upper
    rows = [(80.0, 4, 1.7418263e-16), (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05),
            (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (0.0, 5, 1.0),
            (24.99579013972863, 15, 0.05), (900.0, 301, 2.8e-61)]
    got = spark.createDataFrame(rows, "x double, k bigint, p double").select(
        "p", _chi2_upper(F.col("x"), F.col("k")).alias("q")).collect()
    for r in got[:-1]:
        assert r.q == pytest.approx(r.p, rel=2e-6)
    assert 0 < got[-1].q < 1e-50


def test_export_numbers_are_plain(spark):
    from loyaltide.operators.customers import _decimal_comma
    rows = [(0.0004, "0,0004"), (12345678.9, "12345678,9"), (12.0, "12,0"), (0.5, "0,5"), (None, None)]
    got = spark.createDataFrame(rows, "x double, t string").select(
        "t", _decimal_comma(F.col("x"), 4).alias("s")).collect()
    assert all(r.s == r.t for r in got)


def test_region_titles(spark):
    from loyaltide.functions.french import title_case
    rows = [("DC/MARYLAND/VIRGINIA AREA", "Dc/Maryland/Virginia Area"), ("", ""), (None, None),
            ("new york-city o'hara", "New York-City O'Hara")]
    got = spark.createDataFrame(rows, "a string, t string").select(
        "t", title_case(F.col("a")).alias("s")).collect()
    assert all(r.s == r.t for r in got)


def test_accents_of_all_latin_letters(spark):
    from loyaltide.operators.text_audit import normalised
    rows = [("ČESKÝ český", "cesky cesky"), ("e\u0301te\u0301", "ete"), ("Ñandú ß œ", "nandu ß œ")]
    got = spark.createDataFrame(rows, "a string, t string").select(
        "t", normalised(F.col("a")).alias("s")).collect()
    assert all(r.s == r.t for r in got)


def test_one_hot_vector_equals_the_columns(spark):
    df = spark.createDataFrame([(i, "abcd"[i % 4], "xy"[i % 2] if i % 5 else None)
                                for i in range(60)], "customer_id bigint, c string, d string")
    levels = pp.fit_levels(df, ["c", "d"])
    wide = pp.one_hot(df, levels, ["c", "d"]).orderBy("customer_id").toPandas().drop(
        columns="customer_id").to_numpy()
    slim = pp.one_hot_vector(df, levels, ["c", "d"], "customer_id").orderBy("customer_id").collect()
    assert {r["size"] for r in slim} == {wide.shape[1]}
    assert all(list(r["positions"]) == list(row.nonzero()[0]) for r, row in
               zip(slim, wide, strict=True))
