"""Fixed-rule segments and the out-of-fold segment rate used as a reference score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import all_present, left_closed_bins

AXES = ("anciennete", "usage", "terminal")


def business_segments(df: DataFrame, tenure=(fv.TENURE_EDGES, fv.TENURE_LABELS),
                      usage=(fv.USAGE_EDGES, fv.USAGE_LABELS),
                      device=(fv.DEVICE_EDGES, fv.DEVICE_LABELS)) -> DataFrame:
    """Tenure x usage x device classes with fixed left-closed edges."""
    return df.withColumns({
        "anciennete": left_closed_bins("months", *tenure),
        "usage": left_closed_bins("mou_Mean", *usage),
        "terminal": left_closed_bins("eqpdays", *device)})


def rule_segment(df: DataFrame, axes: Sequence[str] = AXES,
                 name: str = "segment_regles") -> DataFrame:
    """One text label per row; rows with a missing axis share one label."""
    return df.withColumn(name, F.when(all_present(axes), F.concat_ws(" | ", *axes))
                         .otherwise(F.lit(fv.UNSEGMENTED)))


def segment_rate_scores(df: DataFrame, segment: str = "segment_regles", target: str = "churn",
                        fold: str = "fold", learn_from=None, score: str = "proba_calibree"
                        ) -> DataFrame:
    """Score = target rate of the row's segment in the *other* folds.

    All folds come from one aggregate: totals minus the fold's own counts.  The table joined back
    has one row per (segment, fold).  A segment absent from the other folds takes their global
    rate, as does an unknown one.  Rows outside ``learn_from`` (a Column; default all rows) are
    scored but never learned from.  Adds ``score`` and ``taux_appris`` (rate of the learning rows).
    """
    learn = F.lit(True) if learn_from is None else learn_from
    counts = df.groupBy(F.col(segment).alias("_segment"), F.col(fold).alias("_fold")).agg(
        F.count_if(learn).alias("n"),
        F.coalesce(F.sum(F.when(learn, F.col(target))), F.lit(0)).alias("pos"))
    by_segment, by_fold, whole = (Window.partitionBy("_segment"), Window.partitionBy("_fold"),
                                  Window.partitionBy())

    def others(c: str, part: Window) -> F.Column:
        return F.sum(c).over(part) - F.col(c)

    rates = counts.select(
        "_segment", "_fold",
        (F.sum("pos").over(whole) - F.sum("pos").over(by_fold)).alias("g_pos"),
        (F.sum("n").over(whole) - F.sum("n").over(by_fold)).alias("g_n"),
        others("pos", by_segment).alias("s_pos"), others("n", by_segment).alias("s_n"))
    rates = rates.select(
        "_segment", "_fold", F.try_divide("g_pos", "g_n").alias("taux_appris"),
        F.coalesce(F.try_divide("s_pos", "s_n"), F.try_divide("g_pos", "g_n")).alias(score))
    return (df.join(rates, (F.col(segment) == F.col("_segment"))
                    & (F.col(fold) == F.col("_fold"))).drop("_segment", "_fold"))
