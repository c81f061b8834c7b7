"""Contributions to a score, in log-odds, kept long: ``(id, variable, contribution)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.french import describe, label_of
from loyaltide.operators.ranking import exact_quantiles, unpivot_values

ID = "customer_id"


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def linear_contributions(df: DataFrame, coefficients: DataFrame, features: Sequence[str],
                         id_col: str = ID) -> DataFrame:
    """``coef * (x - mean)`` per row and feature; a missing value contributes nothing.

    ``coefficients`` has one row per feature: ``feature, coef, mean``.
    """
    long = unpivot_values(df, features, [id_col], drop_nulls=False)
    return (long.join(F.broadcast(coefficients), F.col("variable") == F.col("feature"))
            .select(id_col, "feature",
                    F.coalesce(F.col("coef") * (F.col("value") - F.col("mean")), F.lit(0.0))
                    .alias("contribution")))


def class_gap_coefficients(df: DataFrame, features: Sequence[str], target: str = "churn"
                           ) -> DataFrame:
    """Diagonal linear discriminant: gap between class means over the variance, per feature.

    A data-derived coefficient table for :func:`linear_contributions`, one aggregate for all.
    """
    long = unpivot_values(df, features, [target])
    return long.groupBy(F.col("variable").alias("feature")).agg(
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.coalesce(F.try_divide(
            F.avg(F.when(F.col(target) == 1, F.col("value")))
            - F.avg(F.when(F.col(target) == 0, F.col("value"))),
            F.var_pop("value")), F.lit(0.0)), 12).alias("coef"))


def source_variable(feature: Column) -> Column:
    """Original variable of a derived feature; the negative-value suffix is stripped."""
    return F.coalesce(_lookup(fv.DERIVED_TO_SOURCE, feature),
                      F.regexp_replace(feature, f"{fv.NEGATIVE_SUFFIX}$", ""))


def grouped(contributions: DataFrame, id_col: str = ID) -> DataFrame:
    """Contributions summed over the features of each original variable."""
    return (contributions.groupBy(id_col, source_variable(F.col("feature")).alias("variable"))
            .agg(F.sum("contribution").alias("contribution")))


def global_importance(contributions: DataFrame, variable: str = "variable") -> DataFrame:
    """Mean absolute contribution per variable, its share and label."""
    whole = Window.partitionBy()                      # one row per variable
    table = contributions.groupBy(variable).agg(F.avg(F.abs("contribution")).alias("shap_abs_moyen"))
    return table.select(variable, "shap_abs_moyen", label_of(F.col(variable)).alias("libelle"),
                        F.bround(100 * F.col("shap_abs_moyen")
                                 / F.sum("shap_abs_moyen").over(whole), 1).alias("part_pct"))


def family(variable: Column, in_window: Column | None = None) -> Column:
    """Actionable family, or the context; tenure is actionable only inside the contract window."""
    members = {v: name for name, variables in fv.FAMILIES.items() for v in variables}
    found = F.coalesce(_lookup(members, variable), F.lit(fv.CONTEXT))
    inside = F.lit(False) if in_window is None else F.coalesce(in_window, F.lit(False))
    return F.when((found == fv.ENGAGEMENT) & ~inside, fv.CONTEXT).otherwise(found)


def suggest_action(tier: Column, dominant_family: Column) -> Column:
    return (F.when(tier == fv.INACTIVE, fv.INACTIVE_ACTION)
            .when(~tier.isin(fv.HIGH, fv.MEDIUM), fv.NO_ACTION)
            .otherwise(F.coalesce(_lookup(fv.ACTIONS, dominant_family),
                                  F.lit(fv.DEFAULT_ACTION))))


def effect_words(contribution: Column) -> Column:
    return F.when(contribution > 0, fv.INCREASES).otherwise(fv.DECREASES)


def _by_strength(id_col: str) -> Window:
    return Window.partitionBy(id_col).orderBy(F.abs("contribution").desc(), "variable")


def reason_codes(contributions: DataFrame, top: int = 3, only: str | None = None,
                 id_col: str = ID) -> DataFrame:
    """The ``top`` variables of each row by absolute contribution, one sign only if asked."""
    if only not in (None, "increase", "decrease"):
        raise ValueError("only must be None, 'increase' or 'decrease'")
    rows = contributions
    if only:
        c = F.col("contribution")
        rows = rows.filter(c > 0 if only == "increase" else c < 0)
    return (rows.withColumn("rang", F.row_number().over(_by_strength(id_col)))
            .filter(F.col("rang") <= top)
            .select(id_col, "rang", "variable", label_of(F.col("variable")).alias("libelle"),
                    effect_words(F.col("contribution")).alias("effet"), "contribution"))


def outlier_thresholds(df: DataFrame, columns: Sequence[str], high: float = fv.OUTLIER_HIGH,
                       low: float = fv.OUTLIER_LOW) -> DataFrame:
    """``variable, high, low``: extreme quantiles of the non-binary columns.

    The low side only exists for columns that can be negative and for recent-change ratios.
    """
    ratios = ["ratio_mou_3m_6m", "ratio_rev_3m_6m"]
    long = unpivot_values(df, columns)
    shape = long.groupBy("variable").agg(F.countDistinct("value").alias("levels"),
                                         F.min("value").alias("lowest"))
    q = exact_quantiles(df, columns, [high, low])
    signed = (F.col("lowest") < 0) | F.col("variable").isin(*ratios)
    return (q.join(shape, "variable").filter(F.col("levels") > 2)
            .select("variable", F.col("q0").alias("high"),
                    F.when(signed, F.col("q1")).alias("low")))


def displayed_column(variable: Column) -> Column:
    """Column whose value the sentence shows (recent averages show their ratio)."""
    # The two variables described through a ratio.
    shown = {"avg3mou": "ratio_mou_3m_6m", "avg3rev": "ratio_rev_3m_6m"}
    return F.coalesce(_lookup(shown, variable), variable)


def with_sentences(rows: DataFrame, features: DataFrame, columns: Sequence[str],
                   thresholds: DataFrame | None = None, id_col: str = ID) -> DataFrame:
    """Add ``phrase`` (and ``atypique``) to rows of ``(id, variable, ...)``.

    The value columns are joined once on the id; thresholds are one row per variable.
    """
    types = dict(features.dtypes)
    values = features.select(id_col, *columns)
    out = rows.join(values, id_col)
    text = describe(F.col("variable"), columns, types)
    numeric = [c for c in columns if types[c] not in ("string", "boolean")]
    if thresholds is None:
        out = out.withColumn("atypique", F.lit(False))
    else:
        shown = F.lit(None).cast("double")
        for c in numeric:
            shown = F.when(displayed_column(F.col("variable")) == c,
                           F.col(c).cast("double")).otherwise(shown)
        limits = thresholds.select(F.col("variable").alias("_var"), F.col("high").alias("_high"),
                                   F.col("low").alias("_low"))
        out = out.withColumn("_shown", shown).join(
            F.broadcast(limits), displayed_column(F.col("variable")) == F.col("_var"), "left")
        out = out.withColumn("atypique", F.coalesce(
            (F.col("_shown") > F.col("_high")) | (F.col("_shown") < F.col("_low")), F.lit(False)))
    return out.select(*rows.columns, "atypique",
                      F.concat(text, F.when(F.col("atypique"), fv.ATYPICAL_NOTE).otherwise(""))
                      .alias("phrase"))


def factor_table(contributions: DataFrame, in_window: DataFrame, n_factors: int = 8,
                 id_col: str = ID) -> DataFrame:
    """Long table of ranked factors of every row, with the ranks used for reasons and context.

    ``in_window`` is ``(id, in_window)``.  Ranks: ``rang`` over all variables by strength,
    ``rang_raison`` over actionable raising ones, ``rang_contexte`` over context ones.  All three
    windows share one shuffle on the id; a group is as small as the list of variables.
    """
    rows = contributions.join(in_window, id_col).withColumn(
        "famille", family(F.col("variable"), F.col("in_window"))).drop("in_window")
    rows = rows.withColumn("actionnable", F.col("famille") != fv.CONTEXT)
    raising = F.col("actionnable") & (F.col("contribution") > 0)
    per_reason = Window.partitionBy(id_col).orderBy(
        raising.desc(), F.col("contribution").desc(), "variable")
    per_context = Window.partitionBy(id_col).orderBy(
        (~F.col("actionnable") & (F.col("contribution") != 0)).desc(),
        F.abs("contribution").desc(), "variable")
    ranked = rows.withColumns({
        "rang": F.row_number().over(_by_strength(id_col)),
        "rang_raison": F.when(raising, F.row_number().over(per_reason)),
        "rang_contexte": F.when(~F.col("actionnable") & (F.col("contribution") != 0),
                                F.row_number().over(per_context))})
    return (ranked.filter((F.col("rang") <= n_factors) | (F.col("rang_raison") <= 3)
                          | (F.col("rang_contexte") <= 2))
            .withColumns({"libelle": label_of(F.col("variable")),
                          "effet": effect_words(F.col("contribution"))}))


def reasons_wide(factors: DataFrame, n_reasons: int = 3, n_context: int = 2, id_col: str = ID
                 ) -> DataFrame:
    """One row per id: reasons, context, dominant factor and family (needs ``phrase``)."""
    picks = []
    for k in range(1, n_reasons + 1):
        here = F.col("rang_raison") == k
        picks += [F.max(F.when(here, F.col("phrase"))).alias(f"raison_{k}"),
                  F.max(F.when(here, F.col("variable"))).alias(f"raison_{k}_variable")]
    first = F.col("rang_raison") == 1
    picks += [F.max(F.when(first, F.col("libelle"))).alias("facteur_dominant"),
              F.max(F.when(first, F.col("famille"))).alias("famille_dominante")]
    for k in range(1, n_context + 1):
        here = F.col("rang_contexte") == k
        text = F.concat("phrase", F.lit(" ("), "effet", F.lit(")"))
        picks += [F.max(F.when(here, text)).alias(f"contexte_{k}"),
                  F.max(F.when(here, F.col("variable"))).alias(f"contexte_{k}_variable")]
    return factors.groupBy(id_col).agg(*picks)


def waterfall(contributions: DataFrame, base: DataFrame, ids: DataFrame, top: int = 12,
              id_col: str = ID) -> DataFrame:
    """Steps of the score of the chosen ids: strongest contributions, then the sum of the others.

    ``base`` is ``(id, valeur_base)``; ``ids`` any table of ids.  Filtering comes first; Spark picks
    the join by the size of the ids.
    """
    rows = contributions.join(ids.select(id_col), id_col, "left_semi")
    ranked = rows.withColumn("rang", F.row_number().over(_by_strength(id_col)))
    steps = ranked.select(
        id_col, F.least("rang", F.lit(top + 1)).alias("rang"),
        F.when(F.col("rang") <= top, F.col("variable")).alias("variable"), "contribution")
    total = Window.partitionBy(id_col)
    out = (steps.groupBy(id_col, "rang", "variable")
           .agg(F.sum("contribution").alias("contribution"), F.count(F.lit(1)).alias("n_variables"))
           .join(base, id_col))
    log_odds = F.col("valeur_base") + F.sum("contribution").over(total)
    return out.select(id_col, "rang", "variable", "n_variables", "contribution", "valeur_base",
                      log_odds.alias("log_odds"),
                      (1 / (1 + F.exp(-log_odds))).alias("proba"))


def mean_contribution_by_bin(contributions: DataFrame, bins: DataFrame, variable: str,
                             id_col: str = ID) -> DataFrame:
    """Mean contribution of one variable per bin of its value; ``bins`` is ``(id, classe)``."""
    rows = contributions.filter(F.col("variable") == variable).join(bins, id_col)
    whole = Window.partitionBy()                      # one row per bin
    table = rows.groupBy("classe").agg(F.count(F.lit(1)).alias("n"),
                                       F.avg("contribution").alias("contribution_moyenne"),
                                       F.sum(F.abs("contribution")).alias("_abs"))
    return table.select("classe", "n", "contribution_moyenne",
                        F.try_divide(100 * F.col("_abs"), F.sum("_abs").over(whole))
                        .alias("part_abs_pct"))


def rank_confrontation(*tables: tuple[str, DataFrame, str]) -> DataFrame:
    """Join several importance tables ``(name, table, value column)`` and rank each."""
    out = None
    for name, table, value in tables:
        part = table.select("variable", F.rank().over(Window.orderBy(F.desc(value)))
                            .alias(f"rang_{name}"))
        out = part if out is None else out.join(part, "variable")
    return out


def high_reasons(scores: DataFrame, factors: DataFrame, id_col: str = ID) -> DataFrame:
    """Share of High rows with each actionable variable among their three reasons."""
    high = scores.filter(F.col("niveau") == fv.HIGH).select(id_col)
    size = high.agg(F.count(F.lit(1)).alias("n_high"))
    return (factors.filter(F.col("rang_raison") <= 3).join(high, id_col, "left_semi")
            .groupBy("variable", "libelle").agg(F.count(F.lit(1)).alias("n"))
            .crossJoin(F.broadcast(size))            # one row
            .select("variable", "libelle", "n", (100 * F.col("n") / F.col("n_high")).alias("pct")))


def high_context(scores: DataFrame, factors: DataFrame, id_col: str = ID) -> DataFrame:
    """Main context variable of High rows."""
    high = scores.filter(F.col("niveau") == fv.HIGH).select(id_col)
    size = Window.partitionBy()                       # one row per variable
    return (factors.filter(F.col("rang_contexte") == 1).join(high, id_col, "left_semi")
            .groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pct", 100 * F.col("n") / F.sum("n").over(size)))


def quantile_exemplars(scores: DataFrame, probs: Sequence[float] = (0.975, 0.5, 0.025),
                       score: str = "proba_calibree", id_col: str = ID) -> DataFrame:
    """The row closest to each score quantile, with the percent of rows strictly below it."""
    marks = exact_quantiles(scores, [score], probs).select(
        *[f"q{i}" for i in range(len(probs))])
    near = scores.select(id_col, score).crossJoin(F.broadcast(marks))      # one row
    picks = near.agg(*[F.min_by(F.struct(id_col, score), F.struct(
        F.abs(F.col(score) - F.col(f"q{i}")), id_col)).alias(f"x{i}") for i in range(len(probs))])
    below = scores.select(F.col(score).alias("_s")).crossJoin(F.broadcast(picks)).agg(  # one row
        *[F.max(f"x{i}").alias(f"x{i}") for i in range(len(probs))],
        *[(100 * F.avg((F.col("_s") < F.col(f"x{i}.{score}")).cast("double"))).alias(f"b{i}")
          for i in range(len(probs))])
    return below.select(F.inline(F.array(*[F.struct(
        F.lit(float(p)).alias("q"), F.col(f"x{i}.{id_col}").alias(id_col),
        F.col(f"x{i}.{score}").alias(score), F.col(f"b{i}").alias("pct_inferieur"))
        for i, p in enumerate(probs)])))
