"""Derived customer features as plan-only column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import safe_divide


def flag(condition: Column) -> Column:
    """0/1 indicator; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def source_missing(df: DataFrame, column: str) -> Column:
    """1 when the value was already missing in the source (not nulled by the negative rule)."""
    missing = F.col(column).isNull()
    marker = f"{column}{fv.NEGATIVE_SUFFIX}"
    if marker in df.columns:
        missing = missing & (F.col(marker) == 0)
    return flag(missing)


def _cycle(df: DataFrame, months: Sequence[int]) -> list[Column]:
    return [flag(F.col("months").isin(*months)).alias("in_contract_end"),
            flag(F.col("eqpdays") >= fv.HANDSET_OLD_DAYS).alias("handset_old"),
            safe_divide("eqpdays", F.col("months") * fv.DAYS_PER_TENURE_MONTH)
            .alias("eqpdays_per_tenure_day")]


def _trend(df: DataFrame, months: Sequence[int]) -> list[Column]:
    return [safe_divide("avg3mou", "avg6mou").alias("ratio_mou_3m_6m"),
            safe_divide("avg3rev", "avg6rev").alias("ratio_rev_3m_6m")]


def _network(df: DataFrame, months: Sequence[int]) -> list[Column]:
    return [safe_divide("drop_blk_Mean", "attempt_Mean").alias("drop_blk_rate"),
            safe_divide("complete_Mean", "attempt_Mean").alias("complete_rate")]


def _care(df: DataFrame, months: Sequence[int]) -> list[Column]:
    return [flag(F.col("custcare_Mean") > 0).alias("has_custcare"),
            safe_divide("custcare_Mean", F.col("mou_Mean") + 1).alias("custcare_per_mou")]


def _plan(df: DataFrame, months: Sequence[int]) -> list[Column]:
    return [safe_divide("ovrrev_Mean", "rev_Mean").alias("overage_share_rev"),
            safe_divide("totmrc_Mean", "rev_Mean").alias("recurring_share_rev")]


def _account(df: DataFrame, months: Sequence[int]) -> list[Column]:
    return [safe_divide("actvsubs", "uniqsubs").alias("active_lines_share"),
            safe_divide("phones", "months").alias("phones_per_month")]


def _missing(df: DataFrame, months: Sequence[int]) -> list[Column]:
    found = [source_missing(df, c).alias(name) for name, c in fv.MISSING_PATTERNS.items()
             if c in df.columns]
    return found + [F.col(f).cast("int").alias(f) for f in fv.NEGATIVE_FLAGS if f in df.columns]


def _gone(df: DataFrame, months: Sequence[int]) -> list[Column]:
    return [source_missing(df, c).alias(name) for name, c in fv.ALREADY_GONE_PATTERNS.items()]


_BUILDERS = {"cycle_engagement": _cycle, "tendance_usage": _trend, "qualite_reseau": _network,
             "service_client": _care, "forfait": _plan, "compte_terminal": _account,
             "indicateurs_manquants": _missing, "deja_parti": _gone}


def build_features(df: DataFrame, groups: Sequence[str] | None = None,
                   drop_columns: Sequence[str] = (),
                   contract_months: Sequence[int] = fv.CONTRACT_MONTHS) -> DataFrame:
    """Original columns (minus ``drop_columns`` and the negative flags) plus the chosen groups."""
    chosen = list(_BUILDERS) if groups is None else list(groups)
    unknown = sorted(set(chosen) - set(_BUILDERS))
    if unknown:
        raise ValueError(f"unknown feature groups {unknown}; known: {sorted(_BUILDERS)}")
    hidden = {*drop_columns, *fv.NEGATIVE_FLAGS}
    base = [F.col(c) for c in df.columns if c not in hidden]
    added = [e for g in _BUILDERS if g in chosen for e in _BUILDERS[g](df, contract_months)]
    return df.select(*base, *added)


def active_customer(df: DataFrame) -> Column:
    """Usage measured in the source and usage change known (a nulled negative counts as measured)."""
    missing = F.col("rev_Mean").isNull()
    marker = f"rev_Mean{fv.NEGATIVE_SUFFIX}"
    if marker in df.columns:
        missing = missing & (F.col(marker) == 0)
    return ~missing & F.col("change_mou").isNotNull()


def indicator_profile(df: DataFrame, indicators: Sequence[str], target: str = "churn"
                      ) -> DataFrame:
    """Per 0/1 feature: target rate when 1 and when 0, share of 1, in percent."""
    long = df.unpivot([target], list(indicators), "variable", "x")
    rate = 100 * F.col(target)
    return long.groupBy("variable").agg(
        F.avg(F.when(F.col("x") == 1, rate)).alias("taux_si_1"),
        F.avg(F.when(F.col("x") == 0, rate)).alias("taux_si_0"),
        (100 * F.avg("x")).alias("part_de_1"))


def feature_profile(df: DataFrame, columns: Sequence[str], target: str = "churn",
                    min_n: int = 200) -> DataFrame:
    """Per numeric feature: class spread, shape and information about the target."""
    from loyaltide.operators.describe import binned_rates
    from loyaltide.operators.hypothesis_tests import class_profile, numeric_information
    profile = class_profile(binned_rates(df, columns, 10, target), True, min_n)
    return numeric_information(df, columns, target).join(profile, "variable", "left")
