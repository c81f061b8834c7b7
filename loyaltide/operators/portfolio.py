"""Portfolio weights, risk tiers and campaign tables.

Every aggregate carries two head-counts: ``n_rows`` (rows of the base) and ``n_portfolio_equiv``
(rows weighted to an assumed real churn rate).  A filtered subset keeps the weights of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import population_weight
from loyaltide.operators.ranking import running_totals


def is_inactive(mou: str = "mou_Mean") -> Column:
    """No usage measured, or none at all."""
    return F.col(mou).isNull() | (F.col(mou) == 0)


def revenue_at_risk(p_real: str = "proba_reelle", bill: str = "rev_Mean") -> Column:
    return F.col(p_real) * F.coalesce(F.col(bill), F.lit(0.0))


def with_portfolio_weights(df: DataFrame, real_rate: float = fv.REAL_RATE,
                           sample_rate: Column | float | None = None,
                           portfolio_size: int = fv.PORTFOLIO_SIZE, target: str = "churn",
                           name: str = fv.PORTFOLIO_WEIGHT) -> DataFrame:
    """Add the portfolio equivalent of each row (the column sums to ``portfolio_size``).

    Only two weights exist, one per class, so they follow from the two class counts.
    """
    totals = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(target).alias("_pos"))
    rate = F.col("_pos") / F.col("_n") if sample_rate is None else sample_rate
    if not isinstance(rate, Column):
        rate = F.lit(float(rate))
    up, down = F.lit(real_rate) / rate, F.lit(1 - real_rate) / (1 - rate)
    mass = F.col("_pos") * up + (F.col("_n") - F.col("_pos")) * down
    return (df.crossJoin(F.broadcast(totals))  # exactly one row
            .withColumn(name, population_weight(target, real_rate, rate) * portfolio_size / mass)
            .drop("_n", "_pos"))


# --- Lift by score band and risk tiers -----------------------------------------------------

def band_rows(df: DataFrame, score: str, target: str = "churn", id_col: str = "customer_id",
              band: float = fv.LIFT_BAND, real_rate: float | None = None,
              sample_rate: float | None = None) -> DataFrame:
    """Each row with its band number (0 = highest scores), weighted to ``real_rate`` if given.

    The two class weights make the cumulative weight a function of two integer running counts.
    """
    ranked = running_totals(
        df.select(id_col, target, score), [(score, "desc"), id_col],
        {"pos": F.col(target).cast("bigint"), "neg": (1 - F.col(target)).cast("bigint")})
    if real_rate is None:
        up = down = F.lit(1.0)
    else:
        rate = (F.col("pos_all") / (F.col("pos_all") + F.col("neg_all")) if sample_rate is None
                else F.lit(float(sample_rate)))
        up, down = F.lit(real_rate) / rate, F.lit(1 - real_rate) / (1 - rate)
    weight = F.when(F.col(target) == 1, up).otherwise(down)
    n_bands = int(round(1 / band))
    start = ((F.col("pos_cum") * up + F.col("neg_cum") * down - weight)
             / (F.col("pos_all") * up + F.col("neg_all") * down))
    number = F.least(F.floor(start / band + 1e-9).cast("int"), F.lit(n_bands - 1))
    return ranked.select(id_col, target, score, weight.alias("w"), number.alias("bande"))


def band_lift(df: DataFrame, score: str, target: str = "churn", id_col: str = "customer_id",
              band: float = fv.LIFT_BAND, real_rate: float | None = None,
              sample_rate: float | None = None) -> DataFrame:
    """Churn rate, lift and cumulative lift per score band of the (weighted) portfolio."""
    rows = band_rows(df, score, target, id_col, band, real_rate, sample_rate)
    table = rows.groupBy("bande").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("poids"),
        F.sum(F.col("w") * F.col(target)).alias("churners"), F.min(score).alias("score_min"))
    whole = Window.partitionBy()                       # at most 1 / band rows from here on
    upto = Window.orderBy("bande").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.sum("churners").over(whole) / F.sum("poids").over(whole)
    return table.select(
        "bande", (100 * band * F.col("bande")).alias("debut_pct"),
        (100 * band * (F.col("bande") + 1)).alias("fin_pct"), "n",
        (F.col("churners") / F.col("poids")).alias("taux"),
        (F.col("churners") / F.col("poids") / base).alias("lift"),
        (F.sum("churners").over(upto) / F.sum("poids").over(upto) / base).alias("lift_cumule"),
        "score_min")


def choose_tiers(bands: DataFrame, capacity: float = fv.CAPACITY,
                 min_lift: float = fv.MEDIUM_MIN_LIFT, band: float = fv.LIFT_BAND) -> DataFrame:
    """Level of each band: the first ``capacity`` is High, the contiguous next bands whose lift
    stays above ``min_lift`` are Medium, the rest Low."""
    n_high = int(round(capacity / band))
    if abs(n_high * band - capacity) > 1e-8:
        raise ValueError(f"capacity {capacity} must be a multiple of the band {band}")
    upto = Window.orderBy("bande").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unbroken = F.min(F.when(F.col("bande") < n_high, 1)
                     .otherwise((F.col("lift") > min_lift).cast("int"))).over(upto)
    return bands.withColumn("niveau", F.when(F.col("bande") < n_high, fv.HIGH)
                            .when(unbroken == 1, fv.MEDIUM).otherwise(fv.LOW))


def tier_thresholds(tiers: DataFrame, capacity: float = fv.CAPACITY, band: float = fv.LIFT_BAND,
                    min_lift: float = fv.MEDIUM_MIN_LIFT,
                    real_rate: float = fv.REAL_RATE) -> DataFrame:
    """One row: lowest score of High, lowest score of High or Medium, and the parameters."""
    return tiers.agg(
        F.min(F.when(F.col("niveau") == fv.HIGH, F.col("score_min"))).alias("high"),
        F.min(F.when(F.col("niveau") != fv.LOW, F.col("score_min"))).alias("medium"),
        F.lit(capacity).alias("capacity"),
        (F.count_if(F.col("niveau") != fv.LOW) * band).alias("medium_end"),
        F.lit(min_lift).alias("min_lift"), F.lit(band).alias("band"),
        F.lit(real_rate).alias("real_rate"))


def assign_tiers(df: DataFrame, thresholds: DataFrame, score: str = "proba_calibree",
                 inactive: str = "inactif") -> DataFrame:
    """Add ``niveau``: inactive first, then by the two thresholds (a one-row table)."""
    limits = thresholds.select(F.col("high").alias("_h"), F.col("medium").alias("_m"))
    return (df.crossJoin(F.broadcast(limits))
            .withColumn("niveau", F.when(F.col(inactive), fv.INACTIVE)
                        .when(F.col(score) >= F.col("_h"), fv.HIGH)
                        .when(F.col(score) >= F.col("_m"), fv.MEDIUM).otherwise(fv.LOW))
            .drop("_h", "_m"))


# --- Campaign ------------------------------------------------------------------------------

def weighted_sums(real_rate: float = fv.REAL_RATE, where: Column | None = None,
                  w: str = fv.PORTFOLIO_WEIGHT) -> list[Column]:
    """The standard bundle of sums of a group of rows."""
    keep = F.lit(True) if where is None else where

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, c)), F.lit(0.0))

    weight = F.col(w)
    return [F.count_if(keep).alias("n_rows"), total(weight).alias("n_portfolio_equiv"),
            total(weight * F.col("proba_reelle")).alias("churners_attendus"),
            total(weight * F.lit(real_rate)).alias("churners_hasard"),
            total(weight * F.col("churn")).alias("churners_observes"),
            total(weight * F.col("revenu_en_jeu")).alias("revenu_en_jeu"),
            total(weight * F.coalesce(F.col("rev_Mean"), F.lit(0.0))).alias("facture_mensuelle")]


def campaign_curve(scores: DataFrame, capacities: Sequence[float], real_rate: float = fv.REAL_RATE,
                   id_col: str = "customer_id", by: Sequence[str] = ()) -> DataFrame:
    """Campaign results per capacity, for active customers by decreasing calibrated score.

    A row is targeted while the weight share *before* it is below the capacity; the share is over
    all rows of ``scores``, inactive ones included.  One ranking serves every capacity: each row is
    tagged with the first capacity that reaches it, summed per tag, then accumulated over the
    capacities (a handful of rows).  ``by`` repeats the curve within groups.
    """
    by = list(by)
    caps = sorted({float(c) for c in capacities})
    w = fv.PORTFOLIO_WEIGHT
    rows = scores.select(id_col, *by, "proba_calibree", "proba_reelle", "churn", "rev_Mean",
                         "revenu_en_jeu", "inactif", w)
    totals = rows.groupBy(*by).agg(
        F.sum(w).alias("_w"), F.sum(F.col(w) * F.col("proba_reelle")).alias("_expected"),
        F.sum(F.col(w) * F.col("revenu_en_jeu")).alias("_revenue"))
    ranked = running_totals(rows.filter(~F.col("inactif")).drop("inactif"),
                            [("proba_calibree", "desc"), id_col], {"w": F.col(w)}, by)
    ranked = (ranked.join(F.broadcast(totals), by) if by
              else ranked.crossJoin(F.broadcast(totals)))
    before = (F.col("w_cum") - F.col(w)) / F.col("_w")
    first = F.lit(None).cast("int")
    for i in reversed(range(len(caps))):
        # The margin keeps a share equal to the capacity out whatever the order of the sums.
        first = F.when(before < caps[i] - 1e-12, F.lit(i)).otherwise(first)
    pieces = (ranked.withColumn("_cap", first).filter(F.col("_cap").isNotNull())
              .groupBy(*by, "_cap").agg(*weighted_sums(real_rate)))
    # Skeleton of every capacity, so that a capacity adding no row still gets a line.
    grid = totals.withColumn("_cap", F.explode(F.array(*[F.lit(i) for i in range(len(caps))])))
    upto = (Window.partitionBy(*by).orderBy("_cap")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = ["n_rows", "n_portfolio_equiv", "churners_attendus", "churners_hasard",
            "churners_observes", "revenu_en_jeu", "facture_mensuelle"]
    full = grid.join(pieces, [*by, "_cap"], "left").select(
        *by, "_cap", "_expected", "_revenue",
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in sums])
    cap_value = F.element_at(F.array(*[F.lit(c) for c in caps]), F.col("_cap") + 1)
    return full.select(
        *by, cap_value.alias("capacite"), *sums,
        F.try_divide("churners_attendus", "churners_hasard").alias("facteur_vs_hasard"),
        F.try_divide("churners_attendus", "_expected").alias("part_churners_attendus"),
        F.try_divide("revenu_en_jeu", "_revenue").alias("part_revenu_en_jeu"))


_CAMPAIGN_COLUMNS = ["groupe", "capacite", "n_rows", "n_portfolio_equiv", "churners_attendus",
                     "churners_hasard", "facteur_vs_hasard", "churners_observes", "revenu_en_jeu",
                     "facture_mensuelle", "part_churners_attendus", "part_revenu_en_jeu"]


def campaign_table(scores: DataFrame, capacities: Sequence[float] = fv.CAPACITIES,
                   real_rate: float = fv.REAL_RATE, id_col: str = "customer_id",
                   by: Sequence[str] = ()) -> DataFrame:
    """The curve at a few capacities, then a line for the inactive and one for everybody."""
    by = list(by)
    curve = campaign_curve(scores, capacities, real_rate, id_col, by).withColumn(
        "groupe", F.format_string("Top %.0f %% (actifs)", 100 * F.col("capacite")))
    one = scores.groupBy(*by).agg(
        F.struct(*weighted_sums(real_rate)).alias("all"),
        F.struct(*weighted_sums(real_rate, F.col("inactif"))).alias("inactive"))
    lines = one.select(*by, "all", F.explode(F.array(
        F.struct(F.lit(fv.INACTIVE_ROW).alias("groupe"), F.col("inactive").alias("s")),
        F.struct(F.lit(fv.WHOLE_ROW).alias("groupe"), F.col("all").alias("s")))).alias("x"))
    extra = lines.select(
        *by, F.col("x.groupe").alias("groupe"), F.lit(None).cast("double").alias("capacite"),
        F.col("x.s.*"),
        F.try_divide("x.s.churners_attendus", "x.s.churners_hasard").alias("facteur_vs_hasard"),
        F.try_divide("x.s.churners_attendus", "all.churners_attendus")
        .alias("part_churners_attendus"),
        F.try_divide("x.s.revenu_en_jeu", "all.revenu_en_jeu").alias("part_revenu_en_jeu"))
    columns = [*by, *_CAMPAIGN_COLUMNS]
    return curve.select(*columns).unionByName(extra.select(*columns))


def group_summary(scores: DataFrame, by: str, order: Sequence[str] | None = None,
                  real_rate: float = fv.REAL_RATE) -> DataFrame:
    """Per group: shares, mean risk, observed churn, both head-counts and money.

    With ``order`` every listed group gets a line, empty ones included.
    """
    sums = scores.groupBy(by).agg(*weighted_sums(real_rate), F.avg("churn").alias("_churn"))
    whole = Window.partitionBy()
    shares = {
        "part_portefeuille": F.col("n_portfolio_equiv") / F.sum("n_portfolio_equiv").over(whole),
        "part_lignes": F.col("n_rows") / F.sum("n_rows").over(whole),
        "part_churners_attendus":
            F.col("churners_attendus") / F.sum("churners_attendus").over(whole),
        "part_revenu_en_jeu": F.col("revenu_en_jeu") / F.sum("revenu_en_jeu").over(whole)}
    table = sums.withColumns(shares)
    if order is None:
        table = table.filter(F.col(by).isNotNull())
    else:
        listed = scores.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(v) for v in order])).alias(by))
        table = table.join(F.broadcast(listed), by, "right")

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).alias(c)

    return table.select(
        by, zero("part_portefeuille"), zero("part_lignes"),
        F.try_divide("churners_attendus", "n_portfolio_equiv").alias("proba_reelle_moyenne"),
        F.col("_churn").alias("churn_observe_base"),
        *[zero(c) for c in ("n_rows", "n_portfolio_equiv", "churners_attendus", "revenu_en_jeu",
                            "facture_mensuelle", "part_churners_attendus", "part_revenu_en_jeu")])


def tier_summary(scores: DataFrame, real_rate: float = fv.REAL_RATE) -> DataFrame:
    return group_summary(scores, "niveau", fv.TIERS, real_rate)


def tier_by_partition(scores: DataFrame, partitions: Sequence[str] = (fv.TRAIN_OOF, fv.TEST)
                      ) -> DataFrame:
    """Churn rate and share of rows of each tier in each partition."""
    size = Window.partitionBy("partition")
    cells = (scores.groupBy("partition", "niveau")
             .agg(F.count(F.lit(1)).alias("n"), F.avg("churn").alias("taux"))
             .withColumn("part", F.col("n") / F.sum("n").over(size)))
    return cells.groupBy("niveau").pivot("partition", list(partitions)).agg(
        F.first("taux").alias("taux"), F.first("part").alias("part"))


def success_grid(curve: DataFrame, rates: Sequence[float] = (0.1, 0.2, 0.3)) -> DataFrame:
    """Avoided departures and preserved revenue per capacity for assumed success rates."""
    return curve.select("capacite", *[
        e for r in rates for e in (
            (F.col("churners_attendus") * r).alias(f"departs_evites_{round(100 * r)}"),
            (F.col("revenu_en_jeu") * r).alias(f"revenu_preserve_{round(100 * r)}"))])


def simulate_campaign(scores: DataFrame, capacity_pct: float, success_rate: float,
                      offer_cost: float | None = None, horizon_months: int = 1,
                      real_rate: float = fv.REAL_RATE, curve_pct: Sequence[int] = range(1, 51)
                      ) -> DataFrame:
    """What-if at one capacity and along the 1-50 % curve (``kind`` = result / curve).

    Cost and balance stay null without a cost: no amount is invented.
    """
    if not 0 < capacity_pct <= 100:
        raise ValueError("capacity_pct must be in ]0, 100]")
    if not 0 <= success_rate <= 1:
        raise ValueError("success_rate must be in [0, 1]")
    if offer_cost is not None and offer_cost < 0:
        raise ValueError("offer_cost must not be negative")
    if horizon_months < 1:
        raise ValueError("horizon_months must be at least 1")
    asked = capacity_pct / 100
    points = [p / 100 for p in curve_pct]
    curve = campaign_curve(scores, [asked, *points], real_rate)
    kinds = F.array_compact(F.array(
        F.when(F.col("capacite") == asked, F.lit("result")),
        F.when(F.col("capacite").isin(*points), F.lit("curve"))))
    cost = F.lit(None).cast("double") if offer_cost is None else (
        F.lit(float(offer_cost)) * F.col("n_portfolio_equiv"))
    preserved = F.col("revenu_en_jeu") * success_rate
    return curve.select(
        F.explode(kinds).alias("kind"), F.round(100 * F.col("capacite"), 6).alias("capacity_pct"),
        F.col("n_rows").alias("targeted_n_rows"),
        F.col("n_portfolio_equiv").alias("targeted_n_portfolio_equiv"),
        F.col("churners_attendus").alias("expected_churners"),
        F.col("churners_hasard").alias("random_churners"),
        F.col("facteur_vs_hasard").alias("lift_vs_random"),
        F.try_divide(1000 * F.col("churners_attendus"), F.col("n_portfolio_equiv"))
        .alias("churners_per_1000_contacted"),
        F.col("part_churners_attendus").alias("share_of_expected_churners"),
        F.col("revenu_en_jeu").alias("revenue_at_risk_monthly"),
        F.col("part_revenu_en_jeu").alias("share_of_revenue_at_risk"),
        F.col("churners_observes").alias("observed_churners_check"),
        (F.col("churners_attendus") * success_rate).alias("avoided_departures_hypothesis"),
        preserved.alias("preserved_revenue_monthly_hypothesis"),
        (preserved * horizon_months).alias("preserved_revenue_horizon_hypothesis"),
        cost.alias("campaign_cost"), (preserved * horizon_months - cost).alias("net_balance"))


def inactive_summary(scores: DataFrame) -> DataFrame:
    """What the what-if leaves out: one row with the size, the expected churners, the revenue and
    the action of the inactive customers (zeros if there are none)."""
    w = F.col("poids_portefeuille")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return scores.filter("inactif").agg(
        F.count(F.lit(1)).alias("n_rows"), total(w).alias("n_portfolio_equiv"),
        total(w * F.col("proba_reelle")).alias("expected_churners"),
        total(w * F.col("revenu_en_jeu")).alias("revenue_at_risk_monthly"),
        F.lit(fv.INACTIVE_ACTION).alias("action"))


def best_capacity(simulation: DataFrame) -> DataFrame:
    """Capacity of the curve with the highest net balance."""
    return simulation.filter(F.col("kind") == "curve").agg(
        F.max_by("capacity_pct", "net_balance").alias("capacity_pct"),
        F.max("net_balance").alias("net_balance"))


def campaign_sensitivity(scores: DataFrame, sample_rate: float | Column,
                         rates: Sequence[float] = fv.SENSITIVITY_RATES,
                         capacities: Sequence[float] = fv.CAPACITIES,
                         id_col: str = "customer_id") -> DataFrame:
    """The campaign table recomputed under each assumed real rate, in one job.

    Rows are exploded over the few assumed rates; weights, probabilities and money follow the rate,
    the ranking restarts within each rate.
    """
    from loyaltide.functions.expressions import adjust_prior
    s = sample_rate if isinstance(sample_rate, Column) else F.lit(float(sample_rate))
    rate = F.col("taux_reel")
    exploded = scores.withColumn("taux_reel", F.explode(F.array(*[F.lit(r) for r in rates])))
    raw = exploded.withColumn("proba_reelle", adjust_prior("proba_calibree", rate, s))
    raw = raw.withColumn("revenu_en_jeu", revenue_at_risk())
    weight = population_weight("churn", rate, s)
    mass = raw.groupBy("taux_reel").agg(F.sum(weight).alias("_mass"))
    weighted = (raw.join(F.broadcast(mass), "taux_reel")
                .withColumn(fv.PORTFOLIO_WEIGHT, weight * fv.PORTFOLIO_SIZE / F.col("_mass")))
    table = campaign_table(weighted, capacities, 1.0, id_col, ["taux_reel"])
    # churners_hasard was summed with rate 1; scale it by the assumed rate.
    return table.withColumns({
        "churners_hasard": F.col("churners_hasard") * rate,
        "facteur_vs_hasard": F.try_divide(F.col("churners_attendus"),
                                          F.col("churners_hasard") * rate)})
