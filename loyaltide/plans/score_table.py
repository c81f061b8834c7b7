"""The batch job: customer table -> out-of-fold scores -> tiers -> reasons -> score table.

A scorer supplies scores, their contributions and segments; the default one fits models.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import adjust_prior, right_closed_bands
from loyaltide.operators import explain, portfolio
from loyaltide.operators.centroids import nearest_centroid, standardised
from loyaltide.operators.features import build_features
from loyaltide.operators.models import ModelSpec
from loyaltide.operators.segmentation import cluster_profiles, name_clusters
from loyaltide.operators.segments_by_rule import (business_segments, rule_segment,
                                                  segment_rate_scores)
from loyaltide.plans.model_scores import behaviour_segments, model_scores
from loyaltide.sources.customer_base import load_customer_base
from loyaltide.staging import stage


@dataclass(frozen=True)
class Tuning:
    """Class edges fitted to the customer table at hand (the defaults of the operators are the
    telecom ones)."""

    tenure: tuple = ((0, 64, 69, float("inf")), ("< 64 mois", "64-68 mois", ">= 69 mois"))
    usage: tuple = ((0, 10, 20, float("inf")), ("Usage < 10", "Usage 10-19", "Usage >= 20"))
    device: tuple = ((0, 90, 270, float("inf")), ("Achat < 90 j", "Achat 90-269 j",
                                                   "Achat >= 270 j"))
    tenure_bands: tuple = ((55, 62, 66, 69), ("0-55 mois", "56-62 mois", "63-66 mois",
                                               "67-69 mois", "70 mois et plus"))
    usage_bands: tuple = ((10, 20, 30), ("1-10", "11-20", "21-30", "plus de 30"))
    contract_months: tuple = (69, 70)
    band: float = fv.LIFT_BAND
    capacity: float = fv.CAPACITY


EXPLAINED = ("months", "in_contract_end", "eqpdays", "change_mou", "avg3mou", "ratio_mou_3m_6m",
             "totmrc_Mean", "rev_Mean", "ovrrev_Mean", "drop_vce_Mean", "custcare_Mean",
             "has_custcare", "hnd_price", "actvsubs", "uniqsubs", "income", "lor")
MODEL_COLUMNS = ("months", "eqpdays", "rev_Mean", "mou_Mean", "avg3mou", "avg6mou", "avg3rev", "avg6rev",
                 "change_mou", "totmrc_Mean", "ovrrev_Mean", "custcare_Mean", "hnd_price",
                 "actvsubs", "uniqsubs", "phones", "hnd_webcap", "area")
SEGMENT_AXES = ("months", "eqpdays", "totmrc_Mean")


@dataclass(frozen=True)
class ScoreStore:
    """The written tables every portfolio query reads."""

    scores: DataFrame
    contributions: DataFrame
    factors: DataFrame
    bands: DataFrame
    thresholds: DataFrame
    outliers: DataFrame


def scored_customers(base: DataFrame, tuning: Tuning = Tuning()) -> DataFrame:
    """Out-of-fold rates for train rows, full-train rates for test rows, corrected to the real
    rate with the rate of the rows each score was learned from."""
    segmented = rule_segment(business_segments(base, tuning.tenure, tuning.usage, tuning.device))
    train = F.col("partition") == fv.TRAIN_OOF
    df = segmented.withColumn("fold", F.when(train, F.col("fold")).otherwise(-1))
    df = segment_rate_scores(df, learn_from=train)
    df = df.withColumns({
        "proba_brute": F.col("proba_calibree"),
        "proba_reelle": adjust_prior("proba_calibree", fv.REAL_RATE, F.col("taux_appris")),
        "inactif": portfolio.is_inactive()})
    return df.withColumn("revenu_en_jeu", portfolio.revenue_at_risk())


def train_rate(base: DataFrame) -> float:
    """Target rate of the training rows (one number)."""
    row = base.filter(F.col("partition") == fv.TRAIN_OOF).agg(F.avg("churn")).first()
    return float(row[0])


def usage_band(c: str, cuts: Sequence[float] = fv.USAGE_CUTS,
               labels: Sequence[str] = tuple(fv.USAGE_BANDS[1:])):
    """Usage class; nothing used or nothing measured has its own class."""
    return F.when(F.coalesce(F.col(c), F.lit(0)) > 0, right_closed_bands(c, cuts, labels)) \
        .otherwise(fv.USAGE_BANDS[0])


def handset_band(c: str, cuts: Sequence[float] = fv.HANDSET_CUTS,
                 labels: Sequence[str] = tuple(fv.HANDSET_AGE_BANDS[:-1])):
    return F.coalesce(right_closed_bands(c, cuts, labels), F.lit(fv.HANDSET_AGE_BANDS[-1]))


def with_display_bands(df: DataFrame, tuning: Tuning = Tuning()) -> DataFrame:
    """Display classes, region default and id text added when the store is loaded."""
    return df.withColumns({
        "area": F.coalesce("area", F.lit(fv.UNKNOWN_AREA)),
        "tenure_band": right_closed_bands("months", *tuning.tenure_bands),
        "handset_age_band": handset_band("eqpdays"),
        "usage_band": usage_band("mou_Mean", *tuning.usage_bands),
        "id_text": F.col("customer_id").cast("string")})


def assign_behaviour_segments(df: DataFrame, axes: Sequence[str] = SEGMENT_AXES) -> DataFrame:
    """Nearest of five centroids, the mean profiles of the five credit classes."""
    z = standardised(df, axes)
    centres = z.groupBy("crclscod").agg(*[F.avg(f"z_{c}").alias(f"z_{c}") for c in axes])
    centres = centres.withColumn("segment_id", F.row_number().over(
        Window.orderBy("crclscod")) - 1)              # five rows
    out = nearest_centroid(z, [f"z_{c}" for c in axes], centres)
    return out.drop(*[f"z_{c}" for c in axes]).withColumn(
        "segment", F.concat(F.lit("Segment "), F.col("segment_id").cast("string")))


@dataclass(frozen=True)
class ScoreInput:
    """What a scorer hands to the job.

    ``customers``: the base columns with ``proba_brute``, ``proba_calibree``, ``proba_reelle``,
    ``taux_appris``, ``valeur_base``, ``segment_id``, ``segment``; training folds kept, others -1.
    ``contributions``: ``customer_id, variable, contribution``; ``columns``: variables with values.
    """

    customers: DataFrame
    contributions: DataFrame
    columns: tuple[str, ...]


Scorer = Callable[[DataFrame, Tuning], ScoreInput]
CATEGORIES = ("hnd_webcap", "area")


def rate_scorer(base: DataFrame, tuning: Tuning) -> ScoreInput:
    """Closed-form stand-in that SQL can repeat: segment rates, class-gap contributions, mean
    profiles of the credit classes.  Its contributions describe the classes, not its score."""
    scored = stage(scored_customers(base, tuning), "scored")
    features = explained_features(scored, tuning, EXPLAINED)
    coefficients = explain.class_gap_coefficients(
        features.filter(F.col("partition") == fv.TRAIN_OOF), EXPLAINED)
    parts = explain.grouped(explain.linear_contributions(features, coefficients, EXPLAINED))
    rate = train_rate(scored)
    customers = assign_behaviour_segments(scored).withColumn(
        "valeur_base", F.lit(math.log(rate / (1 - rate))))
    return ScoreInput(customers, parts, EXPLAINED)


def model_scorer(base: DataFrame, tuning: Tuning, kind: str = "logreg",
                 columns: Sequence[str] = MODEL_COLUMNS) -> ScoreInput:
    """Calibrated logistic models per outer fold, their own contributions, k-means segments.

    Segment names need five clusters that the naming rules tell apart; otherwise they are numbered.
    """
    spec = ModelSpec(kind, tuple(c for c in columns if c in base.columns),
                     contract_months=tuning.contract_months)
    found = model_scores(base, spec)
    segments = behaviour_segments(base)
    profiles = cluster_profiles(base.join(segments, "customer_id"))
    try:
        names = name_clusters(profiles)
    except ValueError:
        names = profiles.select("segment_id", F.concat(
            F.lit("Segment "), F.col("segment_id").cast("string")).alias("segment"))
    scores = found.scores.select("customer_id", "fold", "proba_brute", "proba_calibree",
                                 "proba_reelle", "taux_appris", "valeur_base")
    customers = (base.drop("fold").join(scores, "customer_id").join(segments, "customer_id")
                 .join(names, "segment_id").withColumn("inactif", portfolio.is_inactive()))
    customers = customers.withColumn("revenu_en_jeu", portfolio.revenue_at_risk())
    return ScoreInput(customers, found.contributions, spec.columns)


def explained_features(scored: DataFrame, tuning: Tuning, columns: Sequence[str]) -> DataFrame:
    features = build_features(scored, ["cycle_engagement", "tendance_usage", "service_client"],
                              contract_months=tuning.contract_months)
    extra = [c for c in ("in_contract_end",) if c not in columns]
    return stage(features.select("customer_id", "churn", "partition", *columns, *extra), "features")


def build_store(base: DataFrame, tuning: Tuning = Tuning(), scorer: Scorer = model_scorer
                ) -> ScoreStore:
    """Run the whole job; each table is written once and read by the queries."""
    given = scorer(base, tuning)
    scored = stage(given.customers, "customers")
    rate = train_rate(scored)
    train = F.col("partition") == fv.TRAIN_OOF

    # Thresholds: active training rows only.
    bands = portfolio.band_lift(scored.filter(train & ~F.col("inactif")), "proba_calibree",
                                band=tuning.band, real_rate=fv.REAL_RATE, sample_rate=rate)
    tiers = stage(portfolio.choose_tiers(bands, tuning.capacity, band=tuning.band), "tiers")
    thresholds = stage(portfolio.tier_thresholds(tiers, tuning.capacity, tuning.band),
                       "thresholds")

    # Explanations: contributions of every row, ranked factors with sentences.
    features = explained_features(scored, tuning, given.columns)
    contributions = stage(given.contributions, "contributions", "customer_id")
    measured = [c for c in given.columns if c not in CATEGORIES]
    outliers = stage(explain.outlier_thresholds(features.filter(train), measured), "outliers")
    in_window = features.select("customer_id",
                                (F.col("in_contract_end") == 1).alias("in_window"))
    factors = explain.factor_table(contributions, in_window)
    factors = stage(explain.with_sentences(factors, features, list(given.columns), outliers),
                    "factors", "customer_id")
    reasons = explain.reasons_wide(factors)

    # Assembly.
    df = portfolio.assign_tiers(scored, thresholds).join(reasons, "customer_id", "left")
    df = df.withColumn("action", explain.suggest_action(F.col("niveau"),
                                                        F.col("famille_dominante")))
    df = portfolio.with_portfolio_weights(df, fv.REAL_RATE, rate)
    scores = stage(with_display_bands(df, tuning), "scores", "customer_id")
    return ScoreStore(scores, contributions, factors, tiers, thresholds, outliers)


_stores: dict[tuple, ScoreStore] = {}


def load_store(spark: SparkSession, sf_dir: str, tuning: Tuning = Tuning(),
               scorer: Scorer = rate_scorer) -> ScoreStore:
    """The store of one source folder, built once per session (scores that SQL can repeat)."""
    key = (spark.sparkContext.applicationId, sf_dir, tuning, scorer)
    if key not in _stores:
        _stores[key] = build_store(load_customer_base(spark, sf_dir), tuning, scorer)
    return _stores[key]
