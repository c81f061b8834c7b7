"""Quality of a churn score.

Ranking metrics start from one row per distinct score (map-side combine) and a running total over
those rows; row-level ranks are used only where the result is row-level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import adjust_prior, population_weight
from loyaltide.operators.describe import quantile_bins
from loyaltide.operators.ranking import running_totals

ID = "customer_id"
K_VALUES = (0.05, 0.10, 0.20)


def _by_score(df: DataFrame, score: str, target: str, by: Sequence[str]) -> DataFrame:
    """Running positives and negatives over distinct scores, highest first."""
    counts = df.groupBy(*by, score).agg(
        F.sum(target).alias("pos"), F.sum(1 - F.col(target)).alias("neg"))
    return running_totals(counts, [(score, "desc")],
                          {"pos": F.col("pos"), "neg": F.col("neg")}, by)


def _auc() -> Column:
    """Area from rows holding a score's counts and the running counts of higher scores."""
    below = F.col("neg_all") - F.col("neg_cum")
    return F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)),
                        F.max(F.col("pos_all") * F.col("neg_all")).cast("double"))


def roc_auc(df: DataFrame, score: str, target: str = "churn", by: Sequence[str] = ()) -> DataFrame:
    """Rank AUC with ties counted half; null with one class only."""
    return _by_score(df, score, target, by).groupBy(*by).agg(_auc().alias("roc_auc"))


def pr_auc(df: DataFrame, score: str, target: str = "churn", by: Sequence[str] = ()) -> DataFrame:
    """Average precision: sum of recall steps times precision."""
    table = _by_score(df, score, target, by)
    step = F.col("pos") / F.col("pos_all") * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    return table.groupBy(*by).agg(F.sum(step).alias("pr_auc"))


def brier(df: DataFrame, score: str, target: str = "churn", by: Sequence[str] = ()) -> DataFrame:
    gap = F.col(score) - F.col(target)
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def ranked_rows(df: DataFrame, score: str, target: str = "churn", by: Sequence[str] = (),
                id_col: str = ID) -> DataFrame:
    """Row positions by decreasing score (ties by id) with running positives."""
    return running_totals(df.select(id_col, *by, target, score), [(score, "desc"), id_col],
                          {"n": F.lit(1).cast("bigint"), "pos": F.col(target).cast("bigint")}, by)


def top_share_metrics(df: DataFrame, score: str, ks: Sequence[float] = K_VALUES,
                      target: str = "churn", by: Sequence[str] = (), id_col: str = ID) -> DataFrame:
    """Precision, recall and lift among the ``ceil(k n)`` best-scored rows, one column per k."""
    ranked = ranked_rows(df, score, target, by, id_col)
    return ranked.groupBy(*by).agg(*_top_aggs(ks, target))


def _top_aggs(ks: Sequence[float], target: str) -> list[Column]:
    out = []
    for k in ks:
        tag = f"{round(100 * k)}"
        size = F.ceil(F.lit(float(k)) * F.col("n_all"))
        hits = F.sum(F.when(F.col("n_cum") <= size, F.col(target))).cast("double")
        precision = hits / F.max(size)
        out += [(precision / F.try_divide(F.max("pos_all"), F.max("n_all"))).alias(f"lift_{tag}"),
                precision.alias(f"precision_{tag}"),
                F.try_divide(hits, F.max("pos_all")).alias(f"recall_{tag}")]
    return out


def compute_metrics(df: DataFrame, score: str, ks: Sequence[float] = K_VALUES,
                    target: str = "churn", by: Sequence[str] = (), id_col: str = ID) -> DataFrame:
    """All metrics in one row per group, from a single ranking of the rows.

    Rows of one score sit next to each other in the ranking, so the per-score running counts of
    the two areas are group aggregates of the ranked rows.
    """
    ranked = ranked_rows(df, score, target, by, id_col)
    gap = F.col(score) - F.col(target)
    scalars = ranked.groupBy(*by).agg(F.avg(gap * gap).alias("brier"), *_top_aggs(ks, target))
    per_score = ranked.groupBy(*by, score).agg(
        F.sum(target).alias("pos"), F.sum(1 - F.col(target)).alias("neg"),
        F.max("pos_cum").alias("pos_cum"), F.max(F.col("n_cum")).alias("n_cum"),
        F.max("pos_all").alias("pos_all"), F.max("n_all").alias("n_all"))
    per_score = per_score.withColumns({"neg_cum": F.col("n_cum") - F.col("pos_cum"),
                                       "neg_all": F.col("n_all") - F.col("pos_all")})
    step = F.col("pos") / F.col("pos_all") * F.col("pos_cum") / F.col("n_cum")
    areas = per_score.groupBy(*by).agg(_auc().alias("roc_auc"), F.sum(step).alias("pr_auc"))
    return areas.join(scalars, list(by)) if by else areas.crossJoin(scalars)  # one row each


def test_report(df: DataFrame, score: str, active: str, by: str = "partition",
                learned: str = "train_oof", target: str = "churn", id_col: str = ID) -> DataFrame:
    """All metrics per part, the AUC of its active rows, and how far its AUC and Brier score lie from
    those of the part the models were validated on."""
    whole = compute_metrics(df, score, target=target, by=[by], id_col=id_col)
    alive = roc_auc(df.filter(F.col(active)), score, target, [by]).withColumnRenamed(
        "roc_auc", "auc_actifs")
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    table = whole.join(sizes, by).join(alive, by, "left")
    reference = table.filter(F.col(by) == learned).select(
        F.col("roc_auc").alias("_auc"), F.col("brier").alias("_brier"))
    return (table.crossJoin(F.broadcast(reference))        # one row
            .withColumns({"ecart_auc": F.col("roc_auc") - F.col("_auc"),
                          "ecart_brier": F.col("brier") - F.col("_brier")}).drop("_auc", "_brier"))


def gain_curve(df: DataFrame, score: str, points: int = 100, target: str = "churn",
               id_col: str = ID) -> DataFrame:
    """Share of positives reached and lift when targeting 1..100 % of the rows."""
    ranked = ranked_rows(df, score, target, (), id_col)
    size = df.agg(F.count(F.lit(1)).alias("n"))
    step = 99.0 / (points - 1) if points > 1 else 0.0
    grid = size.select("n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.withColumn("part_ciblee", 1 + F.col("i") * F.lit(step))
    grid = grid.select("part_ciblee", F.greatest(F.lit(1), F.bround(
        F.col("part_ciblee") / 100 * F.col("n")).cast("bigint")).alias("k"))
    hit = ranked.join(F.broadcast(grid), F.col("n_cum") == F.col("k"))   # ``points`` rows
    return hit.select("part_ciblee", (100 * F.col("pos_cum") / F.col("pos_all")).alias("gain"),
                      ((F.col("pos_cum") / F.col("k")) / (F.col("pos_all") / F.col("n_all")))
                      .alias("lift"))


def confusion_at_top_k(df: DataFrame, score: str, k: float = 0.10, target: str = "churn",
                       id_col: str = ID) -> DataFrame:
    """Counts of the 2 x 2 table when the best-scored share ``k`` is targeted."""
    ranked = ranked_rows(df, score, target, (), id_col)
    hit = F.col("n_cum") <= F.ceil(F.lit(float(k)) * F.col("n_all"))
    return ranked.groupBy(target).agg(F.count_if(hit).alias("cible"),
                                      F.count_if(~hit).alias("non_cible"))


def subset_auc_per_fold(df: DataFrame, score: str, mask: Column, target: str = "churn",
                        fold: str = "fold") -> DataFrame:
    return roc_auc(df.filter(mask), score, target, [fold])


# --- Calibration and prior -----------------------------------------------------------------

def reliability_table(df: DataFrame, score: str, n_bins: int = 10, target: str = "churn",
                      id_col: str = ID) -> DataFrame:
    """Per quantile bin of the score: n, mean score, observed rate."""
    binned = quantile_bins(df.select(id_col, target, score), [score], n_bins, [id_col, target])
    return binned.groupBy("classe").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("p_moyenne"),
        F.avg(target).alias("taux_observe"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    """Weighted mean absolute gap of a reliability table."""
    gap = F.abs(F.col("p_moyenne") - F.col("taux_observe"))
    return table.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def weighted_ranking(df: DataFrame, score: str, real_rate: float, sample_rate: float,
                     target: str = "churn", id_col: str = ID) -> DataFrame:
    """Rows by decreasing score with ``w``, the running weight ``w_cum`` and its total ``w_all``.

    Two class weights only: the running weight follows from two integer counts.
    """
    ranked = running_totals(
        df.select(id_col, target, score), [(score, "desc"), id_col],
        {"pos": F.col(target).cast("bigint"), "neg": (1 - F.col(target)).cast("bigint")})
    up, down = real_rate / sample_rate, (1 - real_rate) / (1 - sample_rate)
    return ranked.select(
        id_col, target, score, population_weight(target, real_rate, sample_rate).alias("w"),
        (F.col("pos_cum") * up + F.col("neg_cum") * down).alias("w_cum"),
        (F.col("pos_all") * up + F.col("neg_all") * down).alias("w_all"))


def top_weighted_mask(df: DataFrame, score: str, real_rate: float, sample_rate: float,
                      k: float = 0.10, target: str = "churn", id_col: str = ID) -> DataFrame:
    """``id, w, top``: rows whose running weight (inclusive) stays within share ``k``."""
    ranked = weighted_ranking(df, score, real_rate, sample_rate, target, id_col)
    return ranked.select(id_col, target, score, "w",
                         (F.col("w_cum") <= F.lit(float(k)) * F.col("w_all")).alias("top"))


def production_precision_at_k(df: DataFrame, score: str, real_rate: float, sample_rate: float,
                              k: float = 0.10, target: str = "churn", id_col: str = ID
                              ) -> DataFrame:
    """Precision of the best-scored share ``k`` of the re-weighted population."""
    mask = top_weighted_mask(df, score, real_rate, sample_rate, k, target, id_col)
    top = mask.filter("top")
    return top.agg((F.sum(F.col("w") * F.col(target)) / F.sum("w")).alias("precision"))


def weighted_mean(df: DataFrame, value: Column, real_rate: float, sample_rate: float,
                  mask: Column | None = None, target: str = "churn") -> DataFrame:
    rows = df if mask is None else df.filter(mask)
    w = population_weight(target, real_rate, sample_rate)
    return rows.agg((F.sum(w * value) / F.sum(w)).alias("moyenne"))


def weighted_quantiles(df: DataFrame, value: str, weight: str, probs: Sequence[float],
                       by: Sequence[str] = ()) -> DataFrame:
    """First value whose cumulative weight share reaches each probability."""
    per_value = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    ranked = running_totals(per_value, [value], {"w": F.col("_w")}, by)
    share = F.col("w_cum") / F.col("w_all")
    return ranked.groupBy(*by).agg(*[
        F.min(F.when(share >= F.lit(float(p)), F.col(value))).alias(f"p{round(100 * p)}")
        for p in probs])


def prior_sensitivity(df: DataFrame, score: str, sample_rate: float,
                      rates: Sequence[float] = fv.SENSITIVITY_RATES, k: float = 0.10,
                      target: str = "churn", id_col: str = ID) -> DataFrame:
    """Per assumed real rate: weighted mean of the corrected score, announced and observed
    precision of the top share, lift, and weighted quantiles of the corrected score.

    The running class counts do not depend on the rate: one ranking serves all rates.
    """
    ranked = running_totals(
        df.select(id_col, target, score), [(score, "desc"), id_col],
        {"pos": F.col(target).cast("bigint"), "neg": (1 - F.col(target)).cast("bigint")})
    rate = F.col("taux_reel")
    up, down = rate / sample_rate, (1 - rate) / (1 - sample_rate)
    rows = ranked.withColumn("taux_reel", F.explode(F.array(*[F.lit(r) for r in rates])))
    rows = rows.withColumns({
        "p": adjust_prior(score, rate, sample_rate),
        "w": F.when(F.col(target) == 1, up).otherwise(down),
        "top": F.col("pos_cum") * up + F.col("neg_cum") * down
               <= F.lit(float(k)) * (F.col("pos_all") * up + F.col("neg_all") * down)})
    tw = F.when(F.col("top"), F.col("w"))
    table = rows.groupBy("taux_reel").agg(
        (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p_moyenne"),
        (F.sum(tw * F.col(target)) / F.sum(tw)).alias("precision_top"),
        (F.sum(tw * F.col("p")) / F.sum(tw)).alias("precision_annoncee"))
    quantiles = weighted_quantiles(rows, "p", "w", (0.1, 0.5, 0.9), ["taux_reel"])
    return (table.withColumn("lift_top", F.col("precision_top") / rate)
            .join(quantiles, "taux_reel"))
