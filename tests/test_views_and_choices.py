"""Public lines, numbers of questions, calibrator scores and assigned segments on small frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.operators import metrics, models, segmentation as seg, text_audit as ta


def test_public_lines_leave_out_sensitive_ones_and_close_up(spark):
    hidden = sorted(fv.SENSITIVE_VARIABLES)[0]
    rows = [(1, "months", 0.5, 1, None), (1, hidden, 0.4, 2, None), (1, "eqpdays", 0.3, 3, None),
            (1, "rev_Mean", 0.2, 4, None), (1, hidden, -0.4, None, 1), (1, "lor", -0.12345, None, 2)]
    df = spark.createDataFrame(rows, "customer_id bigint, variable string, contribution double, "
                                     "rang_raison int, rang_contexte int")
    got = sorted(tuple(r) for r in ta.public_lines(df).collect())
    assert got == [(1, "contexte", 1, "lor", -0.123, "baisse"),
                   (1, "raison", 1, "months", 0.5, "hausse"),
                   (1, "raison", 2, "eqpdays", 0.3, "hausse")]


def test_numbers_of_the_question_may_be_cited(spark):
    df = spark.createDataFrame([(1, "seuil de 0,25 et 40 clients", "Avec 25 % et 40 clients, 77 euros"),
                                (2, None, "Avec 25 % et 40 clients")],
                               "id bigint, question string, text string")
    allowed = ta.allowed_in_texts(df, ["id"], ["question"])
    bad = ta.unsupported_numbers(ta.extract_numbers(df, ["id"]), allowed, ["id"]).collect()
    assert sorted((r.id, r.valeur) for r in bad) == [(1, 77.0), (2, 25.0), (2, 40.0)]


def test_calibrators_are_scored_on_folds_they_did_not_see(spark):
    rows = [(i, int((i * 7919) % 100 < 20 + 60 * (i % 10) / 10), i % 3, (i % 10) / 20 + 0.2)
            for i in range(600)]
    oof = spark.createDataFrame(rows, "customer_id bigint, churn int, fold int, score double")
    got = models.calibrator_scores(oof).collect()
    assert sorted((r.methode, r.fold) for r in got) == [
        (m, k) for m in ("isotonic", "sigmoid") for k in range(3)]
    raw = metrics.brier(oof, "score").first()[0]
    assert all(0 < r.brier < raw for r in got)
    choice = models.calibration_choice(models.calibrator_scores(oof)).first()
    assert choice.choix in ("sigmoid", "isotonic")


def test_report_gaps_are_against_the_validated_part(spark):
    rows = [(i, i % 2, "train_oof" if i % 3 else "test", (i % 2) * 0.3 + (i * 37 % 50) / 100, i % 5 > 0)
            for i in range(300)]
    df = spark.createDataFrame(rows, "customer_id bigint, churn int, partition string, p double, "
                                     "actif boolean")
    got = {r.partition: r for r in metrics.test_report(df, "p", "actif").collect()}
    assert got["train_oof"].ecart_auc == 0
    assert got["train_oof"].ecart_brier == pytest.approx(0, abs=1e-12)
    assert got["test"].ecart_auc == pytest.approx(got["test"].roc_auc - got["train_oof"].roc_auc)
    assert got["test"].n == 100 and 0 < got["test"].auc_actifs <= 1


def test_assigned_segments_are_the_nearest_centres(spark):
    from pyspark.ml.functions import array_to_vector
    rows = [(i, [float(i % 4) * 10 + (i % 3) / 10, float(i % 2)]) for i in range(80)]
    vectors = spark.createDataFrame(rows, "customer_id bigint, x array<double>").select(
        "customer_id", "x", array_to_vector("x").alias("vector"))
    fitted = seg.fit_kmeans(vectors, 4, n_init=4)
    names = spark.createDataFrame([(i, f"S{i}") for i in range(4)], "segment_id int, segment string")
    got = seg.assign_segments(vectors, fitted, names).collect()
    assert len(got) == 80 and fitted.cost == pytest.approx(sum(
        min(sum((a - b) ** 2 for a, b in zip(r.x, c, strict=True)) for c in fitted.centres)
        for r in got))
    assert {r.segment for r in got} == {"S0", "S1", "S2", "S3"}
    own = {tuple(sorted({r.segment_id for r in got if r.customer_id % 4 == k})) for k in range(4)}
    assert len(own) == 4 and all(len(s) == 1 for s in own)
    assert vectors.select(F.max("customer_id")).first()[0] == 79
