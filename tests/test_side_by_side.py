"""Small fits run side by side, and configurations share a preparation."""

from __future__ import annotations

import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalog.q_models import rows, spec
from loyaltide.operators import models, shared_preparation as sp
from loyaltide.plans import model_scores


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return rows(spark, sf_dir).cache()


def meeting(monkeypatch, parties: int) -> None:
    """Fits that wait for each other: alone, they fail."""
    fit, met = models.Prepared.fit, threading.Barrier(parties)

    def waiting(self, plan, specs):
        met.wait(60)
        return fit(self, plan, specs)

    monkeypatch.setattr(models.Prepared, "fit", waiting)


def test_calls_keep_their_order_and_large_ones_wait(spark):
    met = threading.Barrier(3)
    assert models.side_by_side([lambda i=i: (met.wait(60), i)[1] for i in range(3)], 10) == [0, 1, 2]
    seen = []
    models.side_by_side([lambda i=i: seen.append((i, threading.active_count())) for i in range(3)],
                        models.AT_ONCE_ROWS)
    assert [i for i, _ in seen] == [0, 1, 2] and len({n for _, n in seen}) == 1


def test_configurations_share_a_preparation(data, monkeypatch):
    learned = []
    learn = sp.learn
    monkeypatch.setattr(sp, "learn", lambda *a: learned.append(1) or learn(*a))
    meeting(monkeypatch, 2)
    one = spec("logreg_simple")
    configs = {"tous": one, "deux": replace(one, groups=one.groups[:2])}
    got = {(r.configuration, r.fold): r.auc for r in models.ablation(data, configs, (0, 1)).collect()}
    assert len(learned) == 1 and len(got) == 4
    monkeypatch.undo()
    alone = models.cross_validate(data, configs["deux"], (0, 1), train_auc=False).per_fold.collect()
    assert all(got["deux", r.fold] == pytest.approx(r.roc_auc, abs=1e-9) for r in alone)


def test_fits_of_the_score_table_run_side_by_side(data, monkeypatch):
    meeting(monkeypatch, 2)                                # five folds and all training rows
    few = spec("boosting", n_trees=2, max_depth=2, min_leaf=5)
    scored = model_scores.model_scores(data, few)
    monkeypatch.undo()
    assert scored.scores.count() == data.count()
    assert model_scores.additivity_gap(scored).filter("ecart > 1e-9").count() == 0
    one = models.prepared_folds(data.filter("partition = 'train_oof'"), few, F.col("fold"),
                                {0: (0,)})[0]
    fitted, = one.fit(0, [few])
    alone = {r.customer_id: r.p for r in fitted.score(one.rows.filter("fold = 0"), "p", True).collect()}
    got = {r.customer_id: r.proba_brute for r in scored.scores.filter("fold = 0").collect()}
    assert got == pytest.approx(alone, abs=1e-12)
