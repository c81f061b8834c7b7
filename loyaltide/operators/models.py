"""Churn models as Spark ML jobs: leak-free preparation, fold loops, calibration, scores.

Preparation is learned on the fit rows only, for all folds together (``shared_preparation``); a few
numbers per column and fold are held by the driver, level tables and rows never leave the cluster.
Loops run over folds and candidates, each step being one distributed fit.  A small fit is hundreds of
jobs that leave most cores idle, so small fits run side by side.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import adjust_prior, hash_uniform, mixed_hash, shuffled_position
from loyaltide.operators import metrics, preprocessing as pp, shared_preparation
from loyaltide.operators.features import build_features
from loyaltide.operators.isotonic import IsotonicMap, isotonic_blocks
from loyaltide.operators.ranking import row_numbers
from loyaltide.staging import stage

ID, TARGET, FOLD = "customer_id", "churn", "fold"

# Default parameters of the candidates.
DEFAULTS: dict[str, dict] = {
    "logreg_simple": {"C": 1.0, "l1_ratio": 0.0},
    "logreg": {"C": 0.01, "l1_ratio": 0.0},
    "decision_tree": {"max_depth": 5, "min_leaf": 100},
    "random_forest": {"n_trees": 300, "min_leaf": 50, "max_depth": 10},
    "boosting": {"n_trees": 100, "max_depth": 5, "step": 0.1, "subsample": 0.54, "min_leaf": 113},
}


@dataclass(frozen=True)
class ModelSpec:
    """What to fit: a model kind, its parameters, the features and how leaks are treated."""

    kind: str
    columns: tuple[str, ...]
    groups: tuple[str, ...] = ("cycle_engagement", "tendance_usage", "forfait", "compte_terminal")
    params: Mapping = field(default_factory=dict)
    drop: tuple[str, ...] = ()
    contract_months: tuple[int, ...] = fv.CONTRACT_MONTHS
    neutralize: bool = False
    seed: int = 42

    def __post_init__(self) -> None:
        if self.kind not in DEFAULTS:
            raise ValueError(f"unknown model {self.kind}; known: {sorted(DEFAULTS)}")

    def param(self, name: str):
        return {**DEFAULTS[self.kind], **self.params}[name]


@dataclass
class FittedModel:
    """Preparation steps and a fitted Spark ML model.

    ``inputs`` names each position of the model's input vector; ``blocks`` are the runs of positions
    ``(first, size)`` that code one category column.
    """

    spec: ModelSpec
    prepare: Prepare
    model: Model

    @property
    def inputs(self) -> list[str]:
        return self.prepare.names

    @property
    def blocks(self) -> list[tuple[int, int]]:
        return self.prepare.blocks

    def vectors(self, df: DataFrame, ready: bool = False) -> DataFrame:
        """Rows with the model's input vector; id, target and fold are kept when present.
        ``ready``: the rows hold the built features already."""
        return self.prepare.vectors(df if ready else self.prepare.features(df))

    def score(self, df: DataFrame, name: str = "proba_brute", ready: bool = False) -> DataFrame:
        """Bookkeeping columns and ``<name>``: probability of leaving."""
        scored = self.model.transform(self.vectors(df, ready))
        keep = [c for c in (*_BOOKKEEPING, _VARIANT, _CELL) if c in scored.columns]
        return scored.select(*keep, vector_to_array("probability")[1].alias(name))


_BOOKKEEPING = (ID, TARGET, FOLD, "partition")
_VARIANT = "variante"
_CELL = "_cell"
_KNOTS = (0.0, 0.25, 0.5, 0.75, 1.0)
_CLIP = (0.01, 0.99)
_MEDIAN = _KNOTS.index(0.5)
AT_ONCE = 8                    # fits side by side
AT_ONCE_ROWS = 1_000_000       # as long as their training rows together are that few
TASK_ROWS = 20_000             # of a fit that sums over all rows, at least


def side_by_side(calls: Sequence[Callable[[], object]], rows: int) -> list:
    """What each call returns, in their order.  Calls that fit models on about ``rows`` rows each run
    in threads of their own, as long as the rows they hold together are few; else one by one."""
    width = min(AT_ONCE, len(calls), AT_ONCE_ROWS // max(rows, 1))
    if width < 2:
        return [call() for call in calls]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPool(width) as pool:
        return pool.map(lambda call: call(), [inherit(call) for call in calls], 1)


@dataclass
class Prepare:
    """A learned preparation: feature rows to input vectors, without looking at data again."""

    features: Callable[[DataFrame], DataFrame]
    steps: list[Callable[[DataFrame], DataFrame]]
    assembled: list[str]
    names: list[str]
    blocks: list[tuple[int, int]]

    def vectors(self, rows: DataFrame) -> DataFrame:
        out = rows
        for step in self.steps:
            out = step(out)
        keep = [c for c in (*_BOOKKEEPING, _VARIANT, _CELL) if c in out.columns]
        return VectorAssembler(inputCols=self.assembled, outputCol="features").transform(out).select(
            *keep, "features")


def _features(spec: ModelSpec, leak_medians: Mapping[str, object] | None = None
              ) -> Callable[[DataFrame], DataFrame]:
    """From the columns of a customer table to feature columns, row by row."""
    def build(df: DataFrame) -> DataFrame:
        keep = dict.fromkeys((*_BOOKKEEPING, _VARIANT, _CELL, *spec.columns))
        out = df.select(*[c for c in keep if c in df.columns])
        if leak_medians is not None:
            out = pp.neutralize_leaks(out, leak_medians, pp.subset(out, fv.LEAK_COLUMNS))
        out = pp.drop_columns(build_features(out, spec.groups, contract_months=spec.contract_months),
                              spec.drop)
        return pp.log_columns(out) if spec.kind == "logreg" else out
    return build


def _wanted(spec: ModelSpec, numeric: Sequence[str], categories: Sequence[str]
            ) -> shared_preparation.Wanted:
    improved = spec.kind == "logreg"
    return shared_preparation.Wanted(
        numeric, categories, (*_KNOTS, *_CLIP), _MEDIAN,
        clip=(len(_KNOTS), len(_KNOTS) + 1) if improved else None,
        fill=spec.kind == "logreg_simple", share=0.01 if improved else None,
        count=30 if spec.kind == "logreg_simple" else None)


def _prepare(spec: ModelSpec, numeric: Sequence[str], categories: Sequence[str],
             learned: shared_preparation.Learned, features: Callable[[DataFrame], DataFrame]
             ) -> Prepare:
    """The preparation of ``spec`` with what one training set taught."""
    steps: list[Callable[[DataFrame], DataFrame]] = []
    improved = spec.kind == "logreg"
    trees = spec.kind in ("decision_tree", "random_forest", "boosting")
    binary = [c for c in numeric if improved and learned.only_01[c]]
    splines = [c for c in fv.SPLINE_COLUMNS if improved and c in numeric and c not in binary]
    plain = [c for c in numeric if c not in binary and c not in splines]
    gaps = {f"{c}_gap": learned.recorded[c] < learned.n for c in numeric}
    medians = {f"{c}_med": learned.quantiles[c][_MEDIAN] if c in learned.quantiles else 0.0
               for c in numeric}

    if improved:
        bounds = {f"{c}_{side}": learned.quantiles[c][len(_KNOTS) + i]
                  if c in learned.quantiles else None
                  for c in plain for i, side in enumerate(("low", "high"))}
        steps.append(lambda d: pp.winsorize(d, bounds, plain))
    if not trees:
        scale = {f"{c}_{part}": learned.scale[c][i] if c in learned.scale else None
                 for c in plain for i, part in enumerate(("mean", "sd"))}
    if improved:            # scale first, so that the indicators stay 0/1
        steps.append(lambda d: pp.standardize(d, scale, plain))
        for c in plain:
            mean, sd = learned.scale.get(c, (0.0, 1.0))
            medians[f"{c}_med"] = (medians[f"{c}_med"] - mean) / (sd if sd > 0 else 1.0)
    indicator = improved or trees
    steps.append(lambda d: pp.impute_median(d, medians | gaps, plain, indicator))
    inputs = list(plain)
    if indicator:
        inputs += [f"{c}_manquant" for c in plain if gaps[f"{c}_gap"]]
    if spec.kind == "logreg_simple":
        steps.append(lambda d: pp.standardize(d, scale, plain))
    if binary:
        modes = {f"{c}_mode": int(2 * learned.total[c] > learned.recorded[c]) for c in binary}
        steps.append(lambda d: pp.impute_mode(d, modes, binary))
        inputs += binary
    if splines:
        knots = {f"{c}_k{i}": learned.quantiles[c][i] for c in splines for i in range(len(_KNOTS))}
        steps.append(lambda d: pp.impute_median(d, medians | gaps, splines))
        for c in splines:
            steps.append(lambda d, c=c: pp.spline_basis(d, knots, c))
            inputs += [f"{c}_sp{i}" for i in range(len(_KNOTS) + 2)]
    if trees:
        if categories:
            steps.append(lambda d: pp.ordinal_codes(d, learned.levels, categories).withColumns(
                {c: F.coalesce(F.col(c), F.lit(-2)) for c in categories}))
        inputs += categories
        return Prepare(features, steps, inputs, list(inputs), [])
    names, blocks, assembled = list(inputs), [], list(inputs)
    for c in categories:
        size = learned.slots[c] + (not improved)            # a slot for all other levels
        if size:
            steps.append(lambda d, c=c, size=size: pp.one_hot_sparse(
                d, learned.levels, c, size, not improved))
            blocks.append((len(names), size))
            names += [f"{c}_{i}" for i in range(size)]
            assembled.append(f"{c}_vecteur")
    return Prepare(features, steps, assembled, names, blocks)


class Prepared:
    """Feature rows of a customer table, written once, and the preparation of each of its training
    sets; fits and scores of any number of models read those rows."""

    def __init__(self, df: DataFrame, spec: ModelSpec, cell: Column,
                 left_out: Mapping[int, Collection[int]], leak_medians: Mapping | None = None):
        self.spec, self.left_out = spec, dict(left_out)
        self.df, self.leak_medians = df, leak_medians
        features = _features(spec, leak_medians)
        self.rows = stage(features(df.withColumn(_CELL, cell.cast("int"))), "feature-rows")
        skip = (*_BOOKKEEPING, _CELL, _VARIANT)
        numeric = [c for c in pp.numeric_columns(self.rows) if c not in skip]
        categories = [c for c in pp.category_columns(self.rows) if c not in skip]
        self.learned = shared_preparation.learn(self.rows, _CELL, self.left_out,
                                                _wanted(spec, numeric, categories))
        self.numeric, self.categories = numeric, categories
        self.prepare = {p: _prepare(spec, numeric, categories, taught, features)
                        for p, taught in self.learned.items()}

    def prepare_for(self, plan: int, spec: ModelSpec) -> Prepare:
        """The preparation of a spec that has some of the prepared feature groups.  What is learned
        about a column does not depend on the others."""
        if spec.groups == self.spec.groups:
            return self.prepare[plan]
        features = _features(spec, self.leak_medians)
        has = set(features(self.df).columns)                  # a plan, no job
        return _prepare(spec, [c for c in self.numeric if c in has],
                        [c for c in self.categories if c in has], self.learned[plan], features)

    def train_rows(self, plan: int) -> DataFrame:
        out = list(self.left_out[plan])
        return self.rows.filter(~F.col(_CELL).isin(out)) if out else self.rows

    def fit(self, plan: int, specs: Sequence[ModelSpec]) -> list[FittedModel]:
        """Models of one training set: its vectors are made once and kept for all fits.  The specs
        may differ from each other in the parameters of the model only, and from the prepared one in
        having fewer feature groups."""
        prepare, n = self.prepare_for(plan, specs[0]), self.learned[plan].n
        rows = prepare.vectors(self.train_rows(plan)).select(
            "features", F.col(TARGET).cast("double").alias(TARGET))
        if specs[0].kind.startswith("logreg"):       # trees draw their samples by partition
            rows = rows.coalesce(max(1, n // TASK_ROWS))
        rows.persist()
        try:
            return [FittedModel(s, prepare, _estimator(s, n).fit(rows)) for s in specs]
        finally:
            rows.unpersist()


def _cells(df: DataFrame) -> Column:
    """The frozen folds as cells; rows without a fold are a cell that is never left out."""
    return F.coalesce(F.col(FOLD), F.lit(-1)) if FOLD in df.columns else F.lit(0)


def _leak_medians(df: DataFrame, spec: ModelSpec) -> dict[str, object]:
    """Medians of the columns that reveal a departure, and whether they have nulls."""
    leaks = [c for c in pp.subset(df, fv.LEAK_COLUMNS) if c in spec.columns]
    return pp.fit_medians(df, leaks).first().asDict()       # one row


def prepared_folds(df: DataFrame, spec: ModelSpec, cell: Column,
                    left_out: Mapping[int, Collection[int]]) -> dict[int, Prepared]:
    """The preparation that serves each training set.  One for all of them, unless the features
    themselves are learned from the training rows."""
    if not spec.neutralize:
        return dict.fromkeys(left_out, Prepared(df, spec, cell, left_out))
    out = {}
    for p, cells in left_out.items():
        seen = df.filter(~cell.isin(list(cells))) if cells else df
        out[p] = Prepared(df, spec, cell, {p: cells}, _leak_medians(seen, spec))
    return out


def _estimator(spec: ModelSpec, n_rows: int):
    common = {"featuresCol": "features", "labelCol": TARGET}
    if spec.kind.startswith("logreg"):
        return LogisticRegression(
            regParam=1.0 / (spec.param("C") * max(n_rows, 1)),
            elasticNetParam=spec.param("l1_ratio"), standardization=False, maxIter=200, **common)
    common |= {"seed": spec.seed, "maxDepth": spec.param("max_depth"),
               "minInstancesPerNode": spec.param("min_leaf")}
    if spec.kind == "decision_tree":
        return DecisionTreeClassifier(**common)
    if spec.kind == "random_forest":
        return RandomForestClassifier(numTrees=spec.param("n_trees"), featureSubsetStrategy="sqrt",
                                      **common)
    return GBTClassifier(maxIter=spec.param("n_trees"), stepSize=spec.param("step"),
                         subsamplingRate=spec.param("subsample"), **common)


def fit_model(train: DataFrame, spec: ModelSpec) -> FittedModel:
    """Learn preparation and model on ``train``."""
    return prepared_folds(train, spec, F.lit(0), {0: ()})[0].fit(0, [spec])[0]


def dummy_scores(df: DataFrame, seed: int = 42, target: str = TARGET, fold: str = FOLD,
                 id_col: str = ID) -> DataFrame:
    """Random class drawn with the prior of the other folds: the floor of every comparison."""
    totals = df.groupBy(fold).agg(F.sum(target).alias("_p"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy()                       # one row per fold
    prior = totals.select(F.col(fold).alias("_f"), (
        (F.sum("_p").over(whole) - F.col("_p")) / (F.sum("_n").over(whole) - F.col("_n")))
        .alias("_prior"))
    return (df.join(F.broadcast(prior), F.col(fold) == F.col("_f"))
            .select(id_col, target, fold, (hash_uniform(id_col, seed) < F.col("_prior"))
                    .cast("double").alias("score")))


# --- Cross-validation ----------------------------------------------------------------------

@dataclass
class CVResult:
    """Out-of-fold score of every row, and metrics per fold (train AUC included)."""

    scores: DataFrame
    per_fold: DataFrame


def _fold_scores(df: DataFrame, specs: Sequence[ModelSpec], folds: Sequence[int],
                 train_too: bool) -> DataFrame:
    """Scores of every model left without a fold, for the rows of the fold (and all others):
    bookkeeping, ``_model`` (the fold) and one column ``s<i>`` per spec.

    The preparations of all folds are learned together; per fold one pass scores all its models.
    """
    prepared = prepared_folds(df, specs[0], _cells(df), {k: (k,) for k in folds})
    return _scores_of(prepared, specs, folds, train_too)


def _rows_of(prepared: Mapping[int, Prepared]) -> int:
    """Rows of the largest training set."""
    return max((of.learned[plan].n for plan, of in prepared.items()), default=0)


def _scores_of(prepared: Mapping[int, Prepared], specs: Sequence[ModelSpec], folds: Sequence[int],
               train_too: bool, beside: int = 1) -> DataFrame:
    """:func:`_fold_scores` of specs with some of the prepared feature groups; ``beside`` such calls
    may run at a time."""
    out = None
    fits = side_by_side([lambda k=k: prepared[k].fit(k, specs) for k in folds],
                        beside * _rows_of(prepared))
    for k, models in zip(folds, fits, strict=True):
        rows = prepared[k].rows if train_too else prepared[k].rows.filter(F.col(_CELL) == k)
        scored = models[0].vectors(rows, True)
        for i, fitted in enumerate(models):
            fitted.model.setProbabilityCol(f"_p{i}").setPredictionCol(f"_c{i}")
            fitted.model.setRawPredictionCol(f"_r{i}")
            scored = fitted.model.transform(scored).withColumn(
                f"s{i}", vector_to_array(f"_p{i}")[1]).drop(f"_p{i}", f"_c{i}", f"_r{i}")
        part = scored.drop("features", _CELL).withColumn("_model", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return stage(out, "fold-scores")                   # read by every metric


def cross_validate(df: DataFrame, spec: ModelSpec, folds: Sequence[int] = range(5),
                   train_auc: bool = True) -> CVResult:
    """Fit on the other folds, score the fold, for each fold of a frozen fold column."""
    rows = _fold_scores(df, [spec], folds, train_auc).withColumnRenamed("s0", "score")
    scores = rows.filter(F.col(FOLD) == F.col("_model")).drop("_model")
    per_fold = metrics.compute_metrics(scores, "score", by=[FOLD])
    if train_auc:
        seen = rows.filter(~F.col(FOLD).eqNullSafe(F.col("_model"))).drop(FOLD) \
            .withColumnRenamed("_model", FOLD)
        per_fold = per_fold.join(metrics.roc_auc(seen, "score", by=[FOLD]).withColumnRenamed(
            "roc_auc", "auc_train"), FOLD)
    return CVResult(scores, per_fold)


def ablation(df: DataFrame, configs: Mapping[str, ModelSpec], folds: Sequence[int] = range(5)
             ) -> DataFrame:
    """AUC per fold of each configuration: ``configuration, modele, fold, auc``, from one ranking of
    the scores of all of them.

    Configurations that differ in their feature groups and the parameters of the model only share a
    preparation, learned on all their groups.
    """
    alike: list[list[str]] = []
    for name, spec in configs.items():
        like = next((names for names in alike if replace(
            configs[names[0]], groups=spec.groups, params=spec.params) == spec), None)
        if like is None:
            alike.append(like := [])
        like.append(name)
    scores = {}
    for names in alike:
        groups = tuple(dict.fromkeys(g for name in names for g in configs[name].groups))
        whole = replace(configs[names[0]], groups=groups)
        prepared = prepared_folds(df, whole, _cells(df), {k: (k,) for k in folds})
        rows = side_by_side([lambda name=name, prepared=prepared: _scores_of(
            prepared, [configs[name]], folds, False, AT_ONCE) for name in names],
            _rows_of(prepared))
        scores |= dict(zip(names, rows, strict=True))
    out = None
    for name, spec in configs.items():
        rows = scores[name].select(
            F.lit(name).alias("configuration"), F.lit(spec.kind).alias("modele"), FOLD, TARGET,
            F.col("s0").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return metrics.roc_auc(out, "score", by=["configuration", "modele", FOLD]).withColumnRenamed(
        "roc_auc", "auc")


def summarize_ablation(table: DataFrame, reference: str) -> DataFrame:
    """Mean and deviation of the AUC, and the gain over the reference fold by fold."""
    ref = table.filter(F.col("configuration") == reference).select(
        "modele", "fold", F.col("auc").alias("_ref"))
    rows = table.join(ref, ["modele", "fold"]).withColumn("_gain", F.col("auc") - F.col("_ref"))
    return rows.groupBy("modele", "configuration").agg(
        F.avg("auc").alias("auc_moyenne"), F.stddev_samp("auc").alias("auc_ecart_type"),
        F.avg("_gain").alias("gain_moyen"), F.stddev_samp("_gain").alias("gain_ecart_type"),
        F.count_if(F.col("_gain") > 0).alias("folds_en_hausse"))


def summarize_folds(per_fold: DataFrame, fold: str = FOLD) -> DataFrame:
    """Mean and deviation of each metric over the folds, long."""
    names = [c for c in per_fold.columns if c != fold]
    long = per_fold.unpivot([], [F.col(c).cast("double").alias(c) for c in names], "metrique", "v")
    return long.groupBy("metrique").agg(F.avg("v").alias("moyenne"),
                                        F.stddev_samp("v").alias("ecart_type"))


def one_sd_rule(trials: DataFrame, auc: str = "auc_moyenne", sd: str = "auc_ecart_type",
                tie: str = "ecart_train") -> DataFrame:
    """Among trials within one deviation of the best AUC, the one with the smallest train gap."""
    best = F.max_by(F.struct(F.col(auc).alias("a"), F.col(sd).alias("s")), F.col(auc)).over(
        Window.partitionBy())                          # one row per trial
    rows = trials.withColumn("_best", best).filter(
        F.col(auc) >= F.col("_best.a") - F.col("_best.s"))
    order = Window.orderBy(tie, F.desc(auc))
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "_best")


def final_choice(summary: DataFrame, min_gain: float = 0.010, n_folds: int = 5) -> DataFrame:
    """Whether each candidate wins every fold by enough on average to replace the reference."""
    return summary.withColumn("retenu", (F.col("folds_en_hausse") == n_folds)
                              & (F.col("gain_moyen") >= min_gain))


def calibration_choice(table: DataFrame, preferred: str = "sigmoid") -> DataFrame:
    """Lowest mean Brier score; the preferred method stays when within one deviation of it.

    ``table`` is ``methode, fold, brier``.
    """
    s = table.groupBy("methode").agg(F.avg("brier").alias("m"), F.stddev_samp("brier").alias("s"))
    best = s.agg(F.min_by("methode", "m").alias("meilleure"), F.min("m").alias("_m"),
                 F.min_by("s", "m").alias("_s"),
                 F.min(F.when(F.col("methode") == preferred, F.col("m"))).alias("_p"))
    return best.select(F.when(F.col("_p") <= F.col("_m") + F.coalesce("_s", F.lit(0.0)), preferred)
                       .otherwise(F.col("meilleure")).alias("choix"), "meilleure")


def group_ablation(df: DataFrame, spec: ModelSpec, folds: Sequence[int] = range(5)) -> DataFrame:
    """AUC per fold with all feature groups, without each one, and with none."""
    configs = {"tous": spec} | {f"sans_{g}": replace(spec, groups=tuple(
        x for x in spec.groups if x != g)) for g in spec.groups} | {"aucun": replace(spec, groups=())}
    return ablation(df, configs, folds)


def calibrator_scores(oof: DataFrame, score: str = "score",
                      methods: Sequence[str] = ("sigmoid", "isotonic")) -> DataFrame:
    """Brier score of each calibrator on each fold, learned on the out-of-fold scores of the other
    folds: ``methode, fold, brier``."""
    sizes = {r[FOLD]: r["n"] for r in oof.groupBy(FOLD).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(FOLD).collect()}                                        # one line per fold
    asked = [(method, k) for method in methods for k in sizes]
    fits = side_by_side([lambda method=method, k=k: fit_calibrator(
        oof.filter(F.col(FOLD) != k), method, score) for method, k in asked], sum(sizes.values()))
    out = None
    for (method, k), fitted in zip(asked, fits, strict=True):
        part = fitted.apply(oof.filter(F.col(FOLD) == k), score, "_p").select(
            F.lit(method).alias("methode"), FOLD, TARGET, "_p")
        out = part if out is None else out.unionByName(part)
    return metrics.brier(out, "_p", TARGET, by=["methode", FOLD])


def parameter_search(df: DataFrame, spec: ModelSpec, space: Mapping[str, Sequence],
                     n_trials: int = 10, folds: Sequence[int] = range(5), seed: int = 42
                     ) -> DataFrame:
    """Seeded random draws from a grid, each evaluated on the frozen folds: one line per trial.

    Trials share the preparation and the vectors of each fold, one scoring pass per fold and one
    ranking for the AUC of all trials, folds and sides.
    """
    grid = [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]
    random.Random(seed).shuffle(grid)
    trials = grid[:n_trials]
    rows = _fold_scores(df, [replace(spec, params={**spec.params, **t}) for t in trials], folds, True)
    long = rows.select(TARGET, F.col("_model").alias(FOLD),
                       F.col(FOLD).eqNullSafe(F.col("_model")).alias("_test"),
                       F.inline(F.array(*[F.struct(F.lit(i).alias("essai"),
                                                   F.col(f"s{i}").alias("score"))
                                          for i in range(len(trials))])))
    aucs = metrics.roc_auc(long, "score", by=["essai", FOLD, "_test"])
    sides = aucs.groupBy("essai", FOLD).agg(
        F.max(F.when(F.col("_test"), F.col("roc_auc"))).alias("_auc"),
        F.max(F.when(~F.col("_test"), F.col("roc_auc"))).alias("_train"))
    named = F.create_map(*[x for i, t in enumerate(trials)
                           for x in (F.lit(i), F.lit(str(sorted(t.items()))))])
    return sides.groupBy("essai").agg(
        F.avg("_auc").alias("auc_moyenne"), F.stddev_samp("_auc").alias("auc_ecart_type"),
        F.avg(F.col("_train") - F.col("_auc")).alias("ecart_train")).select(
            "essai", named[F.col("essai")].alias("parametres"), "auc_moyenne", "auc_ecart_type",
            "ecart_train")


# --- Calibration and final scores ----------------------------------------------------------

@dataclass
class Calibrator:
    """Monotone map from a raw score to a calibrated probability."""

    method: str
    model: Model | IsotonicMap

    def apply(self, df: DataFrame, score: str = "proba_brute", name: str = "proba_calibree"
              ) -> DataFrame:
        if self.method == "isotonic":
            return self.model.apply(df, score, name)
        rows = VectorAssembler(inputCols=["_logit"], outputCol="_v").transform(_with_logit(df, score))
        out = self.model.transform(rows)
        return out.select(*df.columns, vector_to_array("_p")[1].alias(name))


def _with_logit(df: DataFrame, score: str) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(1e-9)), F.lit(1 - 1e-9))
    return df.withColumn("_logit", F.log(p / (1 - p)))


def fit_calibrator(oof: DataFrame, method: str = "sigmoid", score: str = "score",
                   target: str = TARGET) -> Calibrator:
    """Learn the map on out-of-fold scores: logistic on the log-odds, or isotonic regression."""
    if method not in ("sigmoid", "isotonic"):
        raise ValueError("method must be sigmoid or isotonic")
    if method == "isotonic":
        return Calibrator(method, IsotonicMap(isotonic_blocks(oof, score, target)))
    rows = VectorAssembler(inputCols=["_logit"], outputCol="_v").transform(
        _with_logit(oof, score).withColumn("_y", F.col(target).cast("double")))
    model = LogisticRegression(regParam=0.0, featuresCol="_v", labelCol="_y", probabilityCol="_p",
                               rawPredictionCol="_raw", predictionCol="_class").fit(rows)
    return Calibrator(method, model)


@dataclass
class CalibratedModel:
    """One base model refitted on all rows, one calibrator learned on its out-of-fold scores."""

    fitted: FittedModel
    calibrator: Calibrator
    sample_rate: float
    real_rate: float = fv.REAL_RATE

    def score(self, df: DataFrame, partition: str, ready: bool = False) -> DataFrame:
        """Raw, calibrated and corrected probability of each row."""
        raw = self.fitted.score(df, "proba_brute", ready).drop("partition", _CELL)
        scored = self.calibrator.apply(raw)
        return scored.withColumns({
            "partition": F.lit(partition),
            "proba_reelle": adjust_prior("proba_calibree", self.real_rate, self.sample_rate)})


def inner_folds(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Replace the fold column by a fresh stratified one for the inner loop."""
    keyed = df.drop(FOLD).withColumn("_h", mixed_hash(ID, seed))
    ranked = row_numbers(keyed, ["_h", ID], by=[TARGET])
    return ranked.withColumn(FOLD, F.pmod("rn", F.lit(k)).cast("int")).drop("rn", "rn_n", "_h")


def _calibrated(prepared: Mapping[int, Prepared], whole: int, inner: Mapping[int, int],
                spec: ModelSpec, inner_cells: Callable[[int], Collection[int]], method: str,
                rate: float, real_rate: float) -> CalibratedModel:
    """The model of training set ``whole``; its calibrator learns on the scores of the models
    without an inner fold (``inner``: inner fold to training set) for the rows of that fold."""
    oof = None
    fits = side_by_side([lambda plan=plan: prepared[plan].fit(plan, [spec])
                         for plan in (*inner.values(), whole)], _rows_of(prepared))
    for (j, plan), (fitted,) in zip(inner.items(), fits[:-1], strict=True):
        of = prepared[plan]
        part = fitted.score(of.rows.filter(F.col(_CELL).isin(list(inner_cells(j)))), "score", True)
        oof = part if oof is None else oof.unionByName(part)
    calibrator = fit_calibrator(stage(oof, "inner-scores"), method)
    return CalibratedModel(fits[-1][0], calibrator, rate, real_rate)


def fit_calibrated(train: DataFrame, spec: ModelSpec, method: str = "sigmoid", k: int = 5,
                   real_rate: float = fv.REAL_RATE) -> CalibratedModel:
    """Model of all rows, calibrated on scores out of ``k`` inner folds; all share a preparation."""
    rows = inner_folds(train, k)
    left_out = {j: (j,) for j in range(k)} | {k: ()}
    prepared = prepared_folds(rows, spec, F.col(FOLD), left_out)
    rate = float(train.agg(F.avg(TARGET)).first()[0])
    return _calibrated(prepared, k, {j: j for j in range(k)}, spec, lambda j: (j,), method, rate,
                       real_rate)


def out_of_fold_scores(df: DataFrame, spec: ModelSpec, method: str = "sigmoid",
                       folds: Sequence[int] = range(5), k_inner: int = 5,
                       real_rate: float = fv.REAL_RATE) -> DataFrame:
    """Every row scored by a calibrated model that never saw it; the prior correction uses the
    rate of the rows each model learned from.

    Inner folds are drawn once for all rows, so a row's cell is its pair of folds, and the
    ``folds x (k_inner + 1)`` training sets share one preparation.
    """
    inner = inner_folds(df, k_inner).select(ID, F.col(FOLD).alias("_inner"))
    rows = df.join(inner, ID)
    cell = _cells(df) * k_inner + F.col("_inner")
    values = [r[0] for r in df.select(_cells(df)).distinct().collect()]      # one line per fold

    def outer(k: int) -> list[int]:
        return [k * k_inner + j for j in range(k_inner)]

    left_out, numbers = {}, {}
    for k in folds:
        for j in (*range(k_inner), None):
            numbers[k, j] = len(left_out)
            left_out[len(left_out)] = (*outer(k), *([f * k_inner + j for f in values]
                                                    if j is not None else ()))
    prepared = prepared_folds(rows, spec, cell, left_out)
    counts = {r["c"]: r for r in df.groupBy(_cells(df).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("pos")).collect()}
    out = None
    for k in folds:
        seen = [r for c, r in counts.items() if c != k]
        rate = sum(r["pos"] for r in seen) / sum(r["n"] for r in seen)
        model = _calibrated(
            prepared, numbers[k, None], {j: numbers[k, j] for j in range(k_inner)}, spec,
            lambda j, k=k: [f * k_inner + j for f in values if f != k], method, rate, real_rate)
        of = prepared[numbers[k, None]]
        part = model.score(of.rows.filter(F.col(_CELL).isin(outer(k))), fv.TRAIN_OOF, True)
        out = part if out is None else out.unionByName(part)
    return out


def final_scores(model: CalibratedModel, df: DataFrame, partition: str = fv.TEST) -> DataFrame:
    """Scores of the delivered model for rows it has not seen (fold -1)."""
    return model.score(df.drop(FOLD), partition).withColumn(FOLD, F.lit(-1))


def leak_test(df: DataFrame, spec: ModelSpec, active: str, folds: Sequence[int] = range(5)
              ) -> DataFrame:
    """AUC on all and on active rows, with and without the traces of absence, per fold."""
    out = None
    flags = df.select(ID, F.col(active).alias("_active"))
    for name, neutralize in (("complet", False), ("neutralise", True)):
        variant = replace(spec, neutralize=neutralize)
        scores = cross_validate(df, variant, folds, train_auc=False).scores.join(flags, ID)
        everyone = metrics.roc_auc(scores, "score", by=[FOLD]).withColumnRenamed("roc_auc", "auc")
        active_rows = metrics.roc_auc(scores.filter("_active"), "score", by=[FOLD]) \
            .withColumnRenamed("roc_auc", "auc_actifs")
        rows = everyone.join(active_rows, FOLD).withColumn("variante", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], DataFrame],
                           columns: Sequence[str], repeats: int = 5, seed: int = 42,
                           score_column: str = "score") -> DataFrame:
    """Drop of the AUC when one column is shuffled: ``variable, baisse_auc, ecart_type``.

    Rows are numbered once.  A repeat is a keyed shuffle of the numbers and one join: each row meets
    the row whose values it borrows, and is written once per column with that column borrowed.
    """
    placed = stage(row_numbers(df, [ID], name="_pos"), "positions")
    donors = placed.select(F.col("_pos").alias("_from"), *[F.col(c).alias(f"_d_{c}") for c in columns])
    variants = None
    for r in range(repeats):
        at = shuffled_position(F.col("_pos") - 1, F.col("_pos_n"), seed + r) + 1
        both = placed.withColumn("_from", at).join(donors, "_from")

        def line(name: str, borrowed: str | None = None) -> Column:
            return F.struct(F.lit(name).alias(_VARIANT), *[
                F.col(f"_d_{c}" if c == borrowed else c).alias(c) for c in df.columns])

        lines = [line(f"{r}:{c}", c) for c in columns] + ([line("base")] if r == 0 else [])
        part = both.select(F.inline(F.array(*lines)))
        variants = part if variants is None else variants.unionByName(part)
    aucs = metrics.roc_auc(score(variants), score_column, by=[_VARIANT])   # one job for all
    base = aucs.filter(F.col(_VARIANT) == "base").select(F.col("roc_auc").alias("_base"))
    drops = aucs.filter(F.col(_VARIANT) != "base").crossJoin(F.broadcast(base))   # one row
    return drops.groupBy(F.substring_index(_VARIANT, ":", -1).alias("variable")).agg(
        F.avg(F.col("_base") - F.col("roc_auc")).alias("baisse_auc"),
        F.stddev_samp(F.col("_base") - F.col("roc_auc")).alias("ecart_type"))
