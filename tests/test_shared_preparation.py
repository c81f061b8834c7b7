"""What training sets teach together equals what each teaches alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalog.q_models import rows, spec
from loyaltide.operators import models, preprocessing as pp, shared_preparation as sp
from loyaltide.operators.describe import unpivot_levels

PROBS = (0.0, 0.25, 0.5, 0.75, 1.0, 0.01, 0.99)
NUMERIC = ("months", "rev_Mean", "change_mou", "hnd_price", "custcare_Mean")


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return rows(spark, sf_dir).cache()


def direct(df, wanted, cells):
    """The statistics of one training set by Spark's own aggregates over its rows."""
    train = df.filter(~F.col("fold").isin(list(cells))) if cells else df
    out = {}
    for c in wanted.numeric:
        x = F.col(c).cast("double")
        q = train.agg(*[F.percentile(x, F.lit(p)) for p in PROBS]).first()
        value = x
        if wanted.clip and q[5] < q[6]:
            value = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(q[5])), F.lit(q[6])))
        if wanted.fill:
            value = F.coalesce(value, F.lit(q[2]))
        out[c] = (tuple(q), tuple(train.agg(F.avg(value), F.stddev_pop(value)).first()),
                  train.agg(F.count(c)).first()[0])
    return train.count(), out


@pytest.mark.parametrize("wanted", [
    sp.Wanted(NUMERIC, ("area",), PROBS, 2, clip=(5, 6), share=0.05),
    sp.Wanted(NUMERIC, ("area",), PROBS, 2, fill=True, count=4)])
def test_statistics_equal_those_of_each_training_set(data, wanted):
    plans = {0: (0,), 1: (1, 3), 7: ()}
    got = sp.learn(data, "fold", plans, wanted)
    for p, cells in plans.items():
        n, columns = direct(data, wanted, cells)
        assert got[p].n == n
        for c, (quantiles, scale, recorded) in columns.items():
            assert got[p].quantiles[c] == pytest.approx(quantiles, rel=1e-12)
            assert got[p].scale[c] == pytest.approx(scale, rel=1e-9, abs=1e-12)
            assert got[p].recorded[c] == recorded
        train = data.filter(~F.col("fold").isin(list(cells))) if cells else data
        table = pp.fit_levels(train, ["area"], wanted.share, wanted.count).collect()
        want = {(r.niveau, r.code): r.frequent for r in table}
        found = {(r.niveau, r.code): r.slot for r in got[p].levels.collect()}
        assert {k: s is not None for k, s in found.items()} == want
        slots = sorted(s for s in found.values() if s is not None)
        assert slots == list(range(got[p].slots["area"]))


def test_many_levels_reach_no_driver(spark):
    df = spark.range(100_000).select(F.col("id").alias("v"), F.col("id").cast("string").alias("name"),
                                     (F.col("id") % 2).cast("int").alias("fold"))
    got = sp.learn(df, "fold", {0: (0,), 1: ()}, sp.Wanted(("v",), ("name",), (0.5,), 0, count=1))
    assert got[0].slots == {"name": 50_000} and got[1].slots == {"name": 100_000}
    coded = pp.one_hot_sparse(df, got[0].levels, "name", 50_001, True)
    seen = coded.filter("v in (0, 1, 3)").collect()
    assert {r.v: r.name_vecteur.indices.tolist()[0] == 50_000 for r in seen} == {
        0: True, 1: False, 3: False}
    assert unpivot_levels(df, ["name"]).count() == 100_000


@pytest.mark.parametrize("kind", ["logreg_simple", "logreg", "decision_tree"])
def test_folds_prepared_together_give_the_vectors_of_each(data, kind):
    together = models.prepared_folds(data, spec(kind), models._cells(data), {0: (0,), 1: (1,)})
    for k in (0, 1):
        alone = models.fit_model(data.filter(F.col("fold") != k), spec(kind, **(
            {"min_leaf": 5} if kind == "decision_tree" else {})))
        of = together[k].prepare[k]
        assert of.names == alone.inputs
        a = {r.customer_id: r.features.toArray() for r in of.vectors(together[k].rows).collect()}
        b = {r.customer_id: r.features.toArray() for r in alone.vectors(data).collect()}
        assert a.keys() == b.keys()
        assert all(a[i] == pytest.approx(b[i], rel=1e-9, abs=1e-9) for i in a)


def test_no_preparation_inside_the_trial_loop(data, monkeypatch):
    """Statistics are learned once for all folds, and vectors once per fold, whatever the trials."""
    calls = {"learn": 0, "fit": 0}
    learn, fit = sp.learn, models.Prepared.fit

    def counted_learn(*args):
        calls["learn"] += 1
        return learn(*args)

    def counted_fit(self, plan, specs):
        calls["fit"] += 1
        assert len(specs) == 3
        return fit(self, plan, specs)

    monkeypatch.setattr(sp, "learn", counted_learn)
    monkeypatch.setattr(models.Prepared, "fit", counted_fit)
    table = models.parameter_search(data, spec("decision_tree"), {
        "max_depth": [2, 3, 4], "min_leaf": [5, 10]}, n_trials=3, folds=(0, 1)).collect()
    assert calls == {"learn": 1, "fit": 2} and len(table) == 3
    assert sorted(r.essai for r in table) == [0, 1, 2]
    monkeypatch.undo()
    for r in table:
        params = dict(eval(r.parametres))                  # noqa: S307 - written by the search
        alone = models.cross_validate(data, spec("decision_tree", **params), (0, 1)).per_fold.collect()
        assert r.auc_moyenne == pytest.approx(sum(x.roc_auc for x in alone) / 2, abs=1e-9)
        assert r.ecart_train == pytest.approx(
            sum(x.auc_train - x.roc_auc for x in alone) / 2, abs=1e-9)
