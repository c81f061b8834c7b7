"""Model jobs on the smallest test set: leak guards, order, additivity."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import q_models, q_segments
from catalog.q_models import COLUMNS, FOLDS, rows, spec
from catalog.registry import QUERIES
from loyaltide.operators import metrics, models
from loyaltide.operators.tree_contributions import (contributions, ensemble_paths, expected_value,
                                                    leaf_arrays, tree_contributions)
from loyaltide.plans import model_scores


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return rows(spark, sf_dir).cache()


def test_unknown_kind():
    with pytest.raises(ValueError):
        models.ModelSpec("neural", ("months",))


@pytest.mark.parametrize("kind", ["logreg_simple", "logreg", "decision_tree"])
def test_every_row_is_scored_once_out_of_fold(data, kind):
    params = {"min_leaf": 5} if kind == "decision_tree" else {}
    result = models.cross_validate(data, spec(kind, **params), FOLDS)
    scored = result.scores.groupBy("customer_id").count()
    assert scored.count() == data.count() and scored.filter("count > 1").count() == 0
    for r in result.per_fold.collect():
        assert 0 <= r["roc_auc"] <= 1 and r["auc_train"] >= 0.4
    assert result.scores.filter(~F.col("score").between(0, 1)).count() == 0


def test_calibration_keeps_the_order(data):
    oof = models.cross_validate(data, spec("logreg_simple"), FOLDS, train_auc=False).scores
    out = models.fit_calibrator(oof, "sigmoid").apply(oof, "score")
    if out.stat.corr("score", "proba_calibree") > 0:
        a = metrics.roc_auc(out, "score").first()[0]
        b = metrics.roc_auc(out, "proba_calibree").first()[0]
        assert a == pytest.approx(b, abs=1e-9)
    iso = models.fit_calibrator(oof, "isotonic").apply(oof, "score")
    assert iso.filter(~F.col("proba_calibree").between(0, 1)).count() == 0


def test_tree_contributions_add_up_to_the_log_odds(data):
    fitted = models.fit_model(data, spec("boosting", n_trees=4, min_leaf=5, max_depth=3))
    paths = ensemble_paths(fitted.model)
    base = expected_value(paths)
    parts = tree_contributions(fitted.vectors(data), paths, fitted.inputs)
    total = parts.groupBy("customer_id").agg(F.sum("contribution").alias("c"))
    p = fitted.score(data, "p").join(total, "customer_id")
    gap = p.select(F.abs(F.log(F.col("p") / (1 - F.col("p"))) - (F.col("c") + base)).alias("g"))
    assert gap.agg(F.max("g")).first()[0] < 1e-6


def test_contributions_are_shapley_values():
    """Against the definition: every coalition of features, absent ones by their training shares."""
    r = np.random.default_rng(2)
    paths = []
    for _ in range(6):
        held = [(int(f), *sorted(r.normal(size=2)), float(r.uniform(0.1, 0.9)))
                for f in r.permutation(4)[:r.integers(1, 5)]]
        paths.append((float(r.normal()), held))
    x = r.normal(size=(7, 4))

    def game(row, known):
        total = 0.0
        for value, held in paths:
            for f, low, high, share in held:
                value *= float(low < row[f] <= high) if f in known else share
            total += value
        return total

    want = np.zeros_like(x)
    for i, row in enumerate(x):
        for f in range(4):
            others = [g for g in range(4) if g != f]
            for size in range(4):
                for known in itertools.combinations(others, size):
                    weight = 1 / (4 * math.comb(3, size))
                    want[i, f] += weight * (game(row, {*known, f}) - game(row, set(known)))
    assert np.allclose(contributions(x, leaf_arrays(paths)), want)


@pytest.mark.parametrize("kind", ["logreg", "boosting"])
def test_scores_of_the_job_are_explained_by_their_own_model(data, kind):
    params = {"n_trees": 4, "min_leaf": 5, "max_depth": 3} if kind == "boosting" else {}
    found = model_scores.model_scores(data, spec(kind, **params))
    assert model_scores.additivity_gap(found).agg(F.max("ecart")).first()[0] < 1e-6
    assert found.scores.count() == data.count()
    named = {r.variable for r in found.contributions.select("variable").distinct().collect()}
    assert named <= set(COLUMNS)
    with pytest.raises(ValueError):
        model_scores.explanation(models.fit_model(data, spec("decision_tree", min_leaf=5)), data, data)


def test_final_scores_carry_fold_minus_one(data):
    model = models.fit_calibrated(data.filter("partition = 'train_oof'"),
                                  spec("decision_tree", min_leaf=5), k=2)
    out = models.final_scores(model, data.filter("partition = 'test'"))
    assert out.filter("fold <> -1").count() == 0
    assert out.filter(F.col("proba_reelle") > F.col("proba_calibree") + 1e-12).count() == 0


def test_queries_ask_for_the_whole_job(spark, monkeypatch):
    """Calls of the registered queries, without running them: nothing below the defaults."""
    calls = {}

    def note(module, name):
        monkeypatch.setattr(module, name, lambda *a, **b: calls.setdefault(name, []).append((a, b)))

    class Rows:
        def filter(self, *_):
            return self

        cache = filter

    monkeypatch.setattr(q_models, "rows", lambda *_: Rows())
    monkeypatch.setattr(q_segments, "vectors", lambda *_: Rows())
    for name in ("out_of_fold_scores", "fit_calibrated", "final_scores", "fit_model",
                 "permutation_importance", "parameter_search", "cross_validate"):
        note(models, name)
    note(q_segments.seg, "evaluate_k")
    for run in (q_models.f14, q_models.f19, q_models.f20, q_models.h14, q_segments.i03):
        run(None, None)
    for run in (QUERIES["f07_random_forest"], QUERIES["f08_boosting"], q_models.h01):
        with pytest.raises(AttributeError):        # they read the result, which is None here
            run(None, None)
    specs = [x for c in calls.values() for a, _ in c for x in a if isinstance(x, models.ModelSpec)]
    assert len(specs) == 7 and not any(x.params for x in specs)
    assert tuple(calls["permutation_importance"][0][0][2]) == COLUMNS
    assert list(calls["evaluate_k"][0][0][1]) == [3, 4, 5, 6, 7, 8]
    assert len(calls["evaluate_k"][0][0]) == 2 and len(calls["parameter_search"][0][0]) == 3
    for name in ("permutation_importance", "out_of_fold_scores", "fit_calibrated", "evaluate_k",
                 "parameter_search"):
        assert not {"k", "k_inner", "repeats", "n_trials", "seeds", "n_init"} & set(
            calls[name][0][1])
    assert len(calls["fit_calibrated"][0][0]) == 2 and len(calls["out_of_fold_scores"][0][0]) == 2
