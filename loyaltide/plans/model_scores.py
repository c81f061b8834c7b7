"""Scores of the batch job by calibrated models that never saw the rows they score.

Training rows: for each fold a model is learned on the other folds.  Other rows: a model of all
training rows.  The explanation of a row belongs to the very model that scored
it: ``valeur_base`` of that model plus the row's contributions is the log-odds of its raw score.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.operators import models, segmentation
from loyaltide.operators.models import FOLD, ID, TARGET
from loyaltide.operators.tree_contributions import (ensemble_paths, expected_value,
                                                    tree_contributions)
from loyaltide.staging import stage


@dataclass(frozen=True)
class Scored:
    """``scores``: raw, calibrated and corrected probability per row, with ``valeur_base`` and the
    rate its model learned from; ``contributions``: ``customer_id, variable, contribution``."""

    scores: DataFrame
    contributions: DataFrame


def source_of_input(name: str, columns: Sequence[str]) -> str:
    """Original column of a model input (``months_sp3``, ``area_X``, ``avg3mou_manquant``, ...)."""
    derived = fv.DERIVED_TO_SOURCE
    for known in sorted({*columns, *derived}, key=len, reverse=True):
        if name == known or name.startswith(known + "_"):
            return derived.get(known, known)
    return name


def linear_explanation(fitted: models.FittedModel, learned_from: DataFrame, rows: DataFrame
                       ) -> tuple[DataFrame, float]:
    """Contributions of a fitted logistic model: coefficient times distance from the training mean,
    summed over the inputs of each original column; and the log-odds at the mean.

    Both inputs are feature rows.  No shuffle: each row is turned into its few lines in place.
    """
    mean = fitted.vectors(learned_from, True).select(
        Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    weights = fitted.model.coefficients.toArray()
    base = float(fitted.model.intercept + weights @ mean)
    by_source: dict[str, list[Column]] = {}
    coded = {i for first, size in fitted.blocks for i in range(first, first + size)}
    for i, name in enumerate(fitted.inputs):
        if i not in coded:
            by_source.setdefault(source_of_input(name, fitted.spec.columns), []).append(
                (F.col("_x")[i] - float(mean[i])) * float(weights[i]))
    for first, size in fitted.blocks:                      # one slot of many is 1
        own = weights[first:first + size]
        dot = F.aggregate(F.zip_with(F.slice("_x", first + 1, size), F.lit(own.tolist()),
                                     lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        by_source.setdefault(source_of_input(fitted.inputs[first], fitted.spec.columns), []).append(
            dot - float(own @ mean[first:first + size]))
    lines = [F.struct(F.lit(v).alias("variable"), sum(parts, F.lit(0.0)).alias("contribution"))
             for v, parts in sorted(by_source.items())]
    out = fitted.vectors(rows, True).select(ID, vector_to_array("features").alias("_x"))
    return out.select(ID, F.inline(F.array(*lines))), base


def tree_explanation(fitted: models.FittedModel, rows: DataFrame) -> tuple[DataFrame, float]:
    """Path-dependent contributions of a boosted model, summed over the inputs of each original
    column; and its mean log-odds under the training shares."""
    paths = ensemble_paths(fitted.model)
    sources = [source_of_input(name, fitted.spec.columns) for name in fitted.inputs]
    # Summed by column inside each row: no shuffle.
    columns = sorted(set(sources))
    lines = tree_contributions(fitted.vectors(rows, True), paths, fitted.inputs, by=[
        columns.index(v) for v in sources], group_names=columns)
    return lines.withColumnRenamed("feature", "variable"), expected_value(paths)


def explanation(fitted: models.FittedModel, learned_from: DataFrame, rows: DataFrame
                ) -> tuple[DataFrame, float]:
    """``customer_id, variable, contribution`` and the base, by the kind of the model."""
    if fitted.spec.kind.startswith("logreg"):
        return linear_explanation(fitted, learned_from, rows)
    if fitted.spec.kind == "boosting":
        return tree_explanation(fitted, rows)
    raise ValueError(f"{fitted.spec.kind} has no additive explanation of its log-odds")


def model_scores(base: DataFrame, spec: models.ModelSpec, method: str = "sigmoid",
                 real_rate: float = fv.REAL_RATE) -> Scored:
    """Out-of-fold scores of the training rows, scores of the full-train model for the others.

    One fit per frozen fold and one on all training rows, prepared together.  The calibrator of a
    fold is learned on the out-of-fold scores of the other folds, that of the other rows on all of
    them.
    """
    train = base.filter(F.col("partition") == fv.TRAIN_OOF)
    rest = base.filter(F.col("partition") != fv.TRAIN_OOF)
    totals = {r[FOLD]: (r["n"], r["pos"]) for r in train.groupBy(FOLD).agg(
        F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("pos")).collect()}       # five rows
    whole = max(totals) + 1
    left_out = {k: (k,) for k in sorted(totals)} | {whole: ()}
    prepared = models.prepared_folds(train, spec, F.col(FOLD), left_out)
    n = sum(n for n, _ in totals.values())

    def score(k: int) -> tuple[DataFrame, DataFrame]:
        """Raw scores and contributions of the rows the model without fold ``k`` never saw."""
        of, cells = prepared[k], left_out[k]
        fitted, = of.fit(k, [spec])
        asked = (of.rows.filter(F.col(FOLD) == k) if cells
                 else stage(of.prepare[k].features(rest), "model-rest"))
        lines, at_mean = explanation(fitted, of.train_rows(k), asked)
        rows = fitted.score(asked, "proba_brute", True).withColumns({
            FOLD: F.lit(k if cells else -1), "valeur_base": F.lit(at_mean)}).drop("_cell")
        return stage(rows, "model-raw"), stage(lines, "model-contributions")

    found = models.side_by_side([lambda k=k: score(k) for k in left_out], n)
    raw, parts = {}, None
    for (k, cells), (rows, lines) in zip(left_out.items(), found, strict=True):
        raw[k if cells else None] = rows
        parts = lines if parts is None else parts.unionByName(lines)

    def calibrator(k: int | None) -> models.Calibrator:
        """Learned on the out-of-fold scores of the other folds."""
        others = [x for j, x in raw.items() if j is not None and j != k]
        oof = others[0]
        for x in others[1:]:
            oof = oof.unionByName(x)
        return models.fit_calibrator(oof, method, "proba_brute")

    calibrators = models.side_by_side([lambda k=k: calibrator(k) for k in raw], n)
    scores = None
    for (k, rows), fitted in zip(raw.items(), calibrators, strict=True):
        counted = [t for j, t in totals.items() if j != k]
        rate = sum(pos for _, pos in counted) / sum(n for n, _ in counted)
        part = fitted.apply(rows, "proba_brute").withColumns({
            "proba_reelle": models.adjust_prior("proba_calibree", real_rate, rate),
            "taux_appris": F.lit(rate)}).drop(TARGET)
        scores = part if scores is None else scores.unionByName(part)
    return Scored(stage(scores, "model-scores"), parts)


def behaviour_segments(base: DataFrame, k: int = fv.N_CLUSTERS, n_init: int = 10) -> DataFrame:
    """``customer_id, segment_id``: k-means on the training rows, all rows assigned."""
    train = base.filter(F.col("partition") == fv.TRAIN_OOF)
    prepared = segmentation.fit_preparation(train)
    vectors = stage(segmentation.prepare(base, prepared, ("customer_id", "partition")), "segments")
    rows = segmentation.with_vector(vectors)
    model = segmentation.fit_kmeans(rows.filter(F.col("partition") == fv.TRAIN_OOF), k, n_init)
    return model.transform(rows).select("customer_id", "segment_id")


def additivity_gap(scored: Scored) -> DataFrame:
    """Per row: distance of the raw score from what its base and contributions add up to."""
    total = scored.contributions.groupBy(ID).agg(F.sum("contribution").alias("_sum"))
    odds = F.exp(-(F.col("valeur_base") + F.col("_sum")))
    return scored.scores.join(total, ID).select(
        ID, F.abs(F.col("proba_brute") - 1 / (1 + odds)).alias("ecart"))
