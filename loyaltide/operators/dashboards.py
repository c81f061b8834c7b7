"""Filtered portfolio questions over the score table.

A filter is a mapping ``dimension -> values``: OR inside a dimension, AND between dimensions, an
empty list means no filter.  It becomes one predicate, pushed down to the table scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import adjust_prior
from loyaltide.functions.french import label_of
from loyaltide.operators.explain import family
from loyaltide.operators.metrics import weighted_quantiles
from loyaltide.operators.portfolio import campaign_curve
from loyaltide.operators.ranking import exact_quantiles

Filters = Mapping[str, Sequence[str]]


def dimension_column(dimension: str) -> str:
    if dimension not in fv.DIMENSIONS:
        raise ValueError(f"unknown dimension: {dimension}")
    return fv.DIMENSIONS[dimension]


def filter_predicate(filters: Filters | None) -> Column:
    terms = [F.col(dimension_column(d)).isin(*values) for d, values in (filters or {}).items()
             if values]
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def apply_filters(scores: DataFrame, filters: Filters | None) -> DataFrame:
    return scores.filter(filter_predicate(filters)) if filters else scores


def dimension_values(scores: DataFrame, dimension: str,
                     fixed_order: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Levels of a dimension with their rows and display position (fixed order, else by count)."""
    column = dimension_column(dimension)
    counts = scores.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    order = {"risk_level": fv.TIERS, **(fixed_order or {})}.get(dimension)
    position = (F.array_position(F.array(*[F.lit(v) for v in order]), F.col("value")) if order
                else F.row_number().over(Window.orderBy(F.desc("n_rows"), "value")))
    return counts.withColumn("position", position.cast("int"))


def filter_options(scores: DataFrame) -> DataFrame:
    """Rows per level of every dimension: ``dimension, value, n_rows``, one pass."""
    long = scores.unpivot([], [F.col(c).alias(d) for d, c in fv.DIMENSIONS.items()],
                          "dimension", "value")
    return (long.filter(F.col("value").isNotNull()).groupBy("dimension", "value")
            .agg(F.count(F.lit(1)).alias("n_rows")))


def group_rows(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted sums and rates per group of one or two columns, with shares of the whole subset.

    Shares come from a window over the grouped rows, not from a second pass.
    """
    w = F.col(fv.PORTFOLIO_WEIGHT)
    table = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(w).alias("n_portfolio_equiv"),
        F.sum(w * F.col("proba_reelle")).alias("expected_churners"),
        F.sum(w * F.col("revenu_en_jeu")).alias("revenue_at_risk"),
        F.sum(w * F.coalesce(F.col("rev_Mean"), F.lit(0.0))).alias("monthly_bill"),
        F.sum(F.when(F.col("niveau") == fv.HIGH, w).otherwise(0.0)).alias("_high"),
        F.sum("churn").alias("_churn"))
    whole = Window.partitionBy()
    equiv = F.col("n_portfolio_equiv")
    return table.select(
        *keys, "n_rows", "n_portfolio_equiv", "expected_churners", "revenue_at_risk",
        "monthly_bill", (equiv / F.sum(equiv).over(whole)).alias("share_of_portfolio"),
        (F.col("_churn") / F.col("n_rows")).alias("observed_churn_rate_in_base"),
        F.try_divide("expected_churners", "n_portfolio_equiv").alias("expected_churn_rate"),
        F.try_divide("_high", "n_portfolio_equiv").alias("share_high"),
        F.try_divide("expected_churners", F.sum("expected_churners").over(whole))
        .alias("share_of_expected_churners"),
        F.try_divide("revenue_at_risk", F.sum("revenue_at_risk").over(whole))
        .alias("share_of_revenue_at_risk"))


def segments(scores: DataFrame, dimension: str, filters: Filters | None = None) -> DataFrame:
    """One line per level of a dimension; a level can be fed back as a filter (drill-down)."""
    column = dimension_column(dimension)
    subset = apply_filters(scores, filters).filter(F.col(column).isNotNull())
    return group_rows(subset, [column]).withColumnRenamed(column, "value")


def heatmap(scores: DataFrame, x: str, y: str, filters: Filters | None = None,
            min_rows: int = fv.MIN_ROWS_FOR_RATE) -> DataFrame:
    """Crossing of two dimensions; rates of small cells are hidden."""
    cx, cy = dimension_column(x), dimension_column(y)
    if x == y:
        raise ValueError("the two dimensions must differ")
    subset = apply_filters(scores, filters).filter(F.col(cx).isNotNull() & F.col(cy).isNotNull())
    cells = group_rows(subset, [cx, cy])
    small = F.col("n_rows") < min_rows
    return cells.select(
        F.col(cx).alias("x"), F.col(cy).alias("y"), "n_rows", "n_portfolio_equiv",
        F.when(~small, F.col("observed_churn_rate_in_base")).alias("observed_churn_rate_in_base"),
        F.when(~small, F.col("expected_churn_rate")).alias("expected_churn_rate"),
        "revenue_at_risk", small.alias("low_sample"))


def by_risk_level(scores: DataFrame) -> DataFrame:
    """Group rows of the four levels; absent levels get zero head-counts."""
    levels = scores.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in fv.TIERS])).alias("niveau"))
    table = group_rows(scores, ["niveau"]).join(F.broadcast(levels), "niveau", "right")
    return table.withColumns({
        "n_rows": F.coalesce("n_rows", F.lit(0)),
        "n_portfolio_equiv": F.coalesce("n_portfolio_equiv", F.lit(0.0))})


def kpis(scores: DataFrame, filters: Filters | None = None,
         portfolio_size: float = fv.PORTFOLIO_SIZE) -> DataFrame:
    """Totals of the filtered scope, one row; null rates on an empty scope."""
    w = F.col(fv.PORTFOLIO_WEIGHT)
    t = apply_filters(scores, filters).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(w), F.lit(0.0)).alias("n_portfolio_equiv"),
        F.coalesce(F.sum(w * F.col("proba_reelle")), F.lit(0.0)).alias("expected_churners"),
        F.avg("churn").alias("observed_churn_rate_in_base"),
        F.coalesce(F.sum(w * F.col("revenu_en_jeu")), F.lit(0.0)).alias("revenue_at_risk_monthly"),
        F.coalesce(F.sum(w * F.coalesce(F.col("rev_Mean"), F.lit(0.0))), F.lit(0.0))
        .alias("monthly_bill"),
        F.count_if("inactif").alias("inactive_n_rows"))
    return t.withColumns({
        "share_of_portfolio": F.col("n_portfolio_equiv") / portfolio_size,
        "expected_churn_rate": F.try_divide("expected_churners", "n_portfolio_equiv"),
        "revenue_at_risk_share_of_bill": F.try_divide("revenue_at_risk_monthly", "monthly_bill")})


def official_campaign(scores: DataFrame, filters: Filters | None = None,
                      capacity: float = fv.CAPACITY, real_rate: float = fv.REAL_RATE) -> DataFrame:
    """The campaign at the official capacity within the filtered scope; no row without actives."""
    curve = campaign_curve(apply_filters(scores, filters), [capacity], real_rate)
    return curve.filter(F.col("n_rows") > 0).select(
        (100 * F.col("capacite")).alias("capacity_pct"),
        F.col("n_rows").alias("targeted_n_rows"),
        F.col("n_portfolio_equiv").alias("targeted_n_portfolio_equiv"),
        F.col("churners_attendus").alias("expected_churners"),
        (1000 * F.col("churners_attendus") / F.col("n_portfolio_equiv"))
        .alias("churners_per_1000_contacted"),
        F.lit(1000 * real_rate).alias("random_churners_per_1000_contacted"),
        F.col("facteur_vs_hasard").alias("lift_vs_random"),
        F.col("revenu_en_jeu").alias("revenue_at_risk_monthly"))


def risk_histogram(scores: DataFrame, filters: Filters | None = None,
                   step: float = fv.HISTOGRAM_STEP_PCT, top: float = fv.HISTOGRAM_MAX_PCT
                   ) -> DataFrame:
    """Distribution of the corrected probability (%): equal bins, the last one open, empty bins
    kept, weights split by level."""
    last = int(round(top / step))
    w = F.col(fv.PORTFOLIO_WEIGHT)
    index = F.least(F.floor(100 * F.col("proba_reelle") / step), F.lit(last)).cast("int")
    counts = apply_filters(scores, filters).groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(w).alias("n_portfolio_equiv"),
        *[F.sum(F.when(F.col("niveau") == t, w).otherwise(0.0)).alias(f"n_{t}") for t in fv.TIERS])
    grid = scores.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    filled = F.broadcast(grid).join(counts, "bin", "left")
    return filled.select(
        "bin", (F.col("bin") * F.lit(step)).alias("p_real_min_pct"),
        F.when(F.col("bin") < last, (F.col("bin") + 1) * F.lit(step)).alias("p_real_max_pct"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in
          ("n_rows", "n_portfolio_equiv", *[f"n_{t}" for t in fv.TIERS])])


def risk_quantiles(scores: DataFrame, filters: Filters | None = None,
                   probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Weighted quantiles of the corrected probability, in percent."""
    rows = apply_filters(scores, filters).select(
        (100 * F.col("proba_reelle")).alias("pct"), fv.PORTFOLIO_WEIGHT)
    return weighted_quantiles(rows, "pct", fv.PORTFOLIO_WEIGHT, probs)


def real_thresholds(thresholds: DataFrame, sample_rate: float, real_rate: float = fv.REAL_RATE
                    ) -> DataFrame:
    """Tier thresholds expressed as corrected monthly probabilities (%)."""
    return thresholds.select(
        F.col("high").alias("high_p_calibrated"), F.col("medium").alias("medium_p_calibrated"),
        (100 * adjust_prior("high", real_rate, sample_rate)).alias("high_p_real_pct"),
        (100 * adjust_prior("medium", real_rate, sample_rate)).alias("medium_p_real_pct"))


def drivers(scores: DataFrame, contributions: DataFrame, filters: Filters | None = None,
            contract_months: Sequence[int] = fv.CONTRACT_MONTHS, id_col: str = "customer_id"
            ) -> DataFrame:
    """Mean absolute contribution per variable over the filtered rows.

    Tenure counts twice: inside the contract window (actionable) and outside (context), both over
    all filtered rows.  ``rang`` orders the variables within actionable and context lists.
    """
    subset = apply_filters(scores, filters).select(
        id_col, F.coalesce(F.col("months").isin(*contract_months), F.lit(False)).alias("_window"))
    size = subset.agg(F.count(F.lit(1)).alias("_n"))
    rows = contributions.join(subset, id_col)
    tenure = F.col("variable") == "months"
    name = F.when(tenure & ~F.col("_window"), "months_outside_window").otherwise(F.col("variable"))
    c = F.col("contribution")
    sums = rows.groupBy(name.alias("variable")).agg(
        F.sum(F.abs(c)).alias("_abs"), F.sum(c).alias("_sum"), F.count_if(c > 0).alias("_up"))
    whole = Window.partitionBy()                       # one row per variable
    inside = F.col("variable") == "months"
    table = sums.crossJoin(F.broadcast(size)).select(  # one row
        "variable", family(F.col("variable"), inside).alias("family"),
        (F.col("_abs") / F.col("_n")).alias("mean_abs_shap"),
        (F.col("_sum") / F.col("_n")).alias("mean_shap"),
        (F.col("_up") / F.col("_n")).alias("share_rows_increasing"),
        F.try_divide(100 * F.col("_abs"), F.sum("_abs").over(whole)).alias("share_pct"))
    # Names of the two tenure lines.
    label = (F.when(F.col("variable") == "months", "Fin d'engagement (11-12 mois)")
             .when(F.col("variable") == "months_outside_window",
                   "Ancienneté (hors fin d'engagement)").otherwise(label_of(F.col("variable"))))
    actionable = F.col("family") != fv.CONTEXT
    order = Window.partitionBy("actionable").orderBy(F.desc("mean_abs_shap"), "variable")
    labels = F.create_map(*[F.lit(x) for kv in fv.FAMILY_LABELS.items() for x in kv])
    return (table.withColumns({"label": label, "actionable": actionable,
                               "family_label": F.element_at(labels, F.col("family")),
                               "sensitive": F.col("variable").isin(*sorted(fv.SENSITIVE_VARIABLES))})
            .withColumn("rang", F.row_number().over(order)))


def family_shares(driver_table: DataFrame) -> DataFrame:
    return driver_table.groupBy("family", "family_label", "actionable").agg(
        F.sum("share_pct").alias("share_pct"))


def segment_traits(scores: DataFrame, filters: Filters | None = None, n_traits: int = 3,
                   traits: Sequence[tuple[str, str, str]] = tuple(fv.PROFILE_TRAITS)) -> DataFrame:
    """Distinctive traits of each behaviour segment: largest gaps between the segment median
    (filtered rows) and the overall median, in interquartile ranges."""
    columns = [c for c, _, _ in traits]
    overall = exact_quantiles(scores, columns, [0.25, 0.5, 0.75])
    sd = scores.agg(*[F.stddev_samp(c).alias(c) for c in columns]).unpivot(
        [], columns, "variable", "_sd")
    spread = overall.join(sd, "variable").select(
        "variable", F.col("q1").alias("overall_median"),
        F.when(F.col("q2") != F.col("q0"), F.col("q2") - F.col("q0")).otherwise(F.col("_sd"))
        .alias("_spread"))
    medians = exact_quantiles(apply_filters(scores, filters), columns, [0.5], ["segment"])
    gap = F.try_divide(F.col("segment_median") - F.col("overall_median"), F.col("_spread"))
    table = (medians.select("segment", "variable", F.col("q0").alias("segment_median"))
             .join(F.broadcast(spread), "variable").withColumn("gap_iqr", gap))
    order = Window.partitionBy("segment").orderBy(F.abs("gap_iqr").desc_nulls_last(), "variable")
    label = F.create_map(*[F.lit(x) for c, text, _ in traits for x in (c, text)])
    unit = F.create_map(*[F.lit(x) for c, _, u in traits for x in (c, u)])
    return (table.withColumn("rang", F.row_number().over(order)).filter(F.col("rang") <= n_traits)
            .select("segment", "rang", "variable",
                    F.element_at(label, F.col("variable")).alias("label"),
                    F.element_at(unit, F.col("variable")).alias("unit"),
                    "segment_median", "overall_median", "gap_iqr",
                    F.when(F.col("gap_iqr") > 0, "higher").otherwise("lower").alias("direction")))


def segment_profiles(scores: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Size, risk, money and most frequent action (High and Medium rows) of each segment."""
    subset = apply_filters(scores, filters)
    actions = (subset.filter(F.col("niveau").isin(fv.HIGH, fv.MEDIUM))
               .groupBy("segment", "action").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("segment").agg(F.min_by("action", F.struct(-F.col("n"), "action"))
                                       .alias("main_action")))
    ids = subset.groupBy("segment").agg(F.min("segment_id").alias("segment_id"))
    return (group_rows(subset, ["segment"]).join(actions, "segment", "left").join(ids, "segment"))


def concentration(segment_rows: DataFrame, min_share: float = 0.02) -> DataFrame:
    """The level whose share of expected churners most exceeds its share of the portfolio."""
    ratio = F.col("share_of_expected_churners") / F.col("share_of_portfolio")
    return (segment_rows.filter(F.col("share_of_portfolio") >= min_share)
            .agg(F.max_by("value", F.struct(ratio, "value")).alias("value"),
                 F.max(ratio).alias("ratio")))


def tier_medians(scores: DataFrame, columns: Sequence[str],
                 contract_months: Sequence[int] = fv.CONTRACT_MONTHS) -> DataFrame:
    """Medians per level and share of rows inside the contract window."""
    q = exact_quantiles(scores, columns, [0.5], ["niveau"])
    wide = q.groupBy("niveau").agg(*[
        F.max(F.when(F.col("variable") == c, F.col("q0"))).alias(c) for c in columns])
    inside = F.coalesce(F.col("months").isin(*contract_months), F.lit(False)).cast("double")
    return wide.join(scores.groupBy("niveau").agg((100 * F.avg(inside)).alias("pct_fenetre")),
                     "niveau")


def action_mix(scores: DataFrame) -> DataFrame:
    """Counts of each action per level and their share of the level."""
    cells = scores.groupBy("action", "niveau").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("pct_colonne", 100 * F.col("n") / F.sum("n").over(
        Window.partitionBy("niveau")))


def segment_tier_shares(scores: DataFrame) -> DataFrame:
    """Weighted share of each level within each segment (rows sum to 1)."""
    w = F.sum(fv.PORTFOLIO_WEIGHT)
    wide = scores.groupBy("segment").pivot("niveau", fv.TIERS).agg(w)
    total = sum((F.coalesce(F.col(t), F.lit(0.0)) for t in fv.TIERS), F.lit(0.0))
    return wide.select("segment", *[(F.coalesce(F.col(t), F.lit(0.0)) / total).alias(t)
                                    for t in fv.TIERS])


def executive_facts(scores: DataFrame) -> DataFrame:
    """High share and risk, riskiest segment, segment carrying most revenue at risk: one row."""
    high = group_rows(scores, ["niveau"]).filter(F.col("niveau") == fv.HIGH).select(
        F.col("share_of_portfolio").alias("high_share"),
        F.col("expected_churn_rate").alias("high_rate"))
    seg = segments(scores, "cluster").agg(
        F.max_by("value", F.struct("expected_churn_rate", "value")).alias("riskiest_segment"),
        F.max("expected_churn_rate").alias("riskiest_rate"),
        F.max_by("value", F.struct("share_of_revenue_at_risk", "value")).alias("revenue_segment"),
        F.max("share_of_revenue_at_risk").alias("revenue_share"))
    return high.crossJoin(seg)                         # one row each
