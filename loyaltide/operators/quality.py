"""Cleaning by fixed rules, schema checks, coherence rules and the missing-value audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import erfc
from loyaltide.operators.ranking import exact_quantiles, unpivot_values

# Codes that mean "declared unknown", per column.
UNKNOWN_CODES = {
    "new_cell": "U", "dualband": "U", "marital": "U", "kid0_2": "U", "kid3_5": "U",
    "kid6_10": "U", "kid11_15": "U", "kid16_17": "U", "hnd_webcap": "UNKW",
}


# --- Cleaning ------------------------------------------------------------------------------

def negatives_to_null(df: DataFrame, columns: Sequence[str] = fv.NEGATIVE_COLUMNS) -> DataFrame:
    """Impossible negatives become null with a 0/1 flag; an existing flag is kept (idempotent)."""
    present = [c for c in columns if c in df.columns]
    changes: dict[str, Column] = {}
    for c in present:
        marker = f"{c}{fv.NEGATIVE_SUFFIX}"
        now = F.coalesce((F.col(c) < 0).cast("int"), F.lit(0))
        changes[marker] = F.greatest(F.col(marker), now) if marker in df.columns else now
    flagged = df.withColumns(changes)
    return flagged.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in present})


def explicit_unknown(df: DataFrame, codes: Mapping[str, str] = UNKNOWN_CODES) -> DataFrame:
    """The column's own unknown code becomes one common level; null stays null."""
    return df.withColumns({
        c: F.when(F.col(c) == code, fv.UNKNOWN_LEVEL).otherwise(F.col(c))
        for c, code in codes.items() if c in df.columns})


def unknown_levels(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Levels outside the fixed lists: ``variable, niveau, n`` (empty when all is well)."""
    columns = [c for c in levels if c in df.columns]
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in columns], "variable", "niveau")
    bad = F.lit(False)
    for c in columns:
        bad = bad | ((F.col("variable") == c) & ~F.col("niveau").isin(*levels[c]))
    return (long.filter(F.col("niveau").isNotNull() & bad).groupBy("variable", "niveau")
            .agg(F.count(F.lit(1)).alias("n")))


def cast_categories(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Check every level against its list; an unseen one is an error naming the column."""
    found = unknown_levels(df, levels).select("variable").distinct().limit(len(levels)).collect()
    if found:
        raise ValueError(f"unknown levels in {', '.join(sorted(r[0] for r in found))}")
    return df


def clean(df: DataFrame, levels: Mapping[str, Sequence[str]] | None = None,
          negative_columns: Sequence[str] = fv.NEGATIVE_COLUMNS) -> DataFrame:
    """Negatives, unknown codes, level check; no row is dropped, twice equals once."""
    out = explicit_unknown(negatives_to_null(df, negative_columns))
    return cast_categories(out, levels) if levels else out


# --- Schema and coherence ------------------------------------------------------------------

@dataclass(frozen=True)
class Check:
    """One validity rule; ``shown`` is the column whose values illustrate a failure."""

    column: str
    name: str
    valid: Column
    shown: str


def bound_checks(bounds: Mapping[str, tuple[float, float]]) -> list[Check]:
    out = []
    for c, (low, high) in bounds.items():
        out.append(Check(c, f"greater_than_or_equal_to({low})", F.col(c) >= low, c))
        out.append(Check(c, f"in_range({low}, {high})", F.col(c).between(low, high), c))
    return out


def level_checks(levels: Mapping[str, Sequence[str]]) -> list[Check]:
    return [Check(c, "isin", F.col(c).isin(*values), c) for c, values in levels.items()]


def schema_failures(df: DataFrame, checks: Sequence[Check], n_examples: int = 5) -> DataFrame:
    """One line per failed check: ``column, check, n_cas, exemples`` (a few distinct values).

    Each row is exploded only into the checks it fails, so a clean table yields no rows to shuffle;
    examples are the first distinct values, kept by a limited rank inside each check.
    """
    failing = F.array_compact(F.array(*[
        F.when(~F.coalesce(k.valid, F.lit(True)), F.struct(
            F.lit(k.column).alias("column"), F.lit(k.name).alias("check"),
            F.col(k.shown).cast("string").alias("value"))) for k in checks]))
    hits = df.select(F.explode(failing).alias("x")).select("x.*")
    per_value = hits.groupBy("column", "check", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column", "check").orderBy("value")
    examples = (per_value.withColumn("_rn", F.row_number().over(order))
                .filter(F.col("_rn") <= n_examples)
                .groupBy("column", "check")
                .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("exemples")))
    counts = per_value.groupBy("column", "check").agg(F.sum("n").alias("n_cas"))
    return counts.join(examples, ["column", "check"])


TOLERANCE = 0.01


def coherence_rules(columns: Sequence[str]) -> list[tuple[str, str, Column]]:
    """``(rule, type, holds)`` for the rules whose columns exist; nulls never violate."""
    c = F.col
    usage = [x for x in fv.USAGE_BLOCK if x in columns]
    missing = sum((c(x).isNull().cast("int") for x in usage), F.lit(0))

    def at_most(a: str, b: str) -> Column:
        return c(a) <= c(b) + TOLERANCE

    def equal(a: str, parts: Sequence[str]) -> Column:
        return F.abs(c(a) - sum((c(p) for p in parts), F.lit(0.0))) <= TOLERANCE

    # Names, columns and kinds of the rules.
    strict, informative = "stricte", "informative"
    rules = [
        ("actvsubs_le_uniqsubs", strict, ["actvsubs", "uniqsubs"], at_most("actvsubs", "uniqsubs")),
        ("models_le_phones", strict, ["models", "phones"], at_most("models", "phones")),
        ("comp_vce_le_plcd_vce", strict, ["comp_vce_Mean", "plcd_vce_Mean"],
         at_most("comp_vce_Mean", "plcd_vce_Mean")),
        ("comp_dat_le_plcd_dat", strict, ["comp_dat_Mean", "plcd_dat_Mean"],
         at_most("comp_dat_Mean", "plcd_dat_Mean")),
        ("complete_le_attempt", strict, ["complete_Mean", "attempt_Mean"],
         at_most("complete_Mean", "attempt_Mean")),
        ("attempt_eq_plcd", strict, ["attempt_Mean", "plcd_vce_Mean", "plcd_dat_Mean"],
         equal("attempt_Mean", ["plcd_vce_Mean", "plcd_dat_Mean"])),
        ("drop_blk_eq_sum", strict, ["drop_blk_Mean", "drop_vce_Mean", "drop_dat_Mean",
                                     "blck_vce_Mean", "blck_dat_Mean"],
         equal("drop_blk_Mean", ["drop_vce_Mean", "drop_dat_Mean", "blck_vce_Mean",
                                 "blck_dat_Mean"])),
        ("adjmou_le_totmou", strict, ["adjmou", "totmou"], at_most("adjmou", "totmou")),
        ("adjqty_le_totcalls", strict, ["adjqty", "totcalls"], at_most("adjqty", "totcalls")),
        ("usage_block_all_or_none", strict, usage, missing.isin(0, len(usage))),
        ("adjrev_le_totrev", informative, ["adjrev", "totrev"], at_most("adjrev", "totrev")),
        ("ovrrev_eq_vce_dat", informative, ["ovrrev_Mean", "vceovr_Mean", "datovr_Mean"],
         equal("ovrrev_Mean", ["vceovr_Mean", "datovr_Mean"])),
        ("eqpdays_le_tenure", informative, ["eqpdays", "months"],
         c("eqpdays") <= c("months") * 31),
        ("actvsubs_ge_1", informative, ["actvsubs"], c("actvsubs") >= 1),
    ]
    return [(name, kind, holds) for name, kind, needed, holds in rules
            if needed and set(needed) <= set(columns)]


def coherence_report(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Violations of every rule in one pass over the rows: ``regle, type, violations, pct``."""
    rules = [r for r in coherence_rules(df.columns) if r[0] not in skip]
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if(~F.coalesce(holds, F.lit(True))).alias(f"r{i}")
        for i, (_, _, holds) in enumerate(rules)])
    lines = F.array(*[F.struct(F.lit(name).alias("regle"), F.lit(kind).alias("type"),
                               F.col(f"r{i}").alias("violations"))
                      for i, (name, kind, _) in enumerate(rules)])
    return (counts.select("_n", F.inline(lines))
            .select("regle", "type", "violations",
                    F.try_divide(100 * F.col("violations"), F.col("_n")).alias("pct")))


# --- Missing values ------------------------------------------------------------------------

def missing_patterns(df: DataFrame, columns: Sequence[str], id_col: str = "customer_id"
                     ) -> DataFrame:
    """Columns that are always missing together: ``groupe, n_colonnes, n_manquants, pct, colonnes``.

    Each column's null mask is reduced to a fingerprint (count and two xor-ed hashes of the ids
    with a null): equal masks give equal fingerprints whatever the partitioning.
    """
    h1, h2 = F.xxhash64(id_col), F.xxhash64(id_col, F.lit("mask"))
    prints = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("variable"),
                 F.count_if(F.col(c).isNull()).alias("k"),
                 F.coalesce(F.bit_xor(F.when(F.col(c).isNull(), h1)), F.lit(0)).alias("a"),
                 F.coalesce(F.bit_xor(F.when(F.col(c).isNull(), h2)), F.lit(0)).alias("b"))
        .alias(f"p{i}") for i, c in enumerate(columns)])
    rows = prints.select("_n", F.inline(F.array(*[f"p{i}" for i in range(len(columns))])))
    rows = rows.filter(F.col("k") > 0)
    members = F.array_sort(F.collect_list(F.struct("pos", "variable")))   # one entry per column
    return (rows.groupBy("k", "a", "b").agg(members.alias("m"), F.max("_n").alias("_n"))
            .select(F.col("m")[0]["variable"].alias("groupe"), F.size("m").alias("n_colonnes"),
                    F.col("k").alias("n_manquants"), (100 * F.col("k") / F.col("_n")).alias("pct"),
                    F.array_join(F.col("m.variable"), ", ").alias("colonnes")))


def source_missing_view(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns with nulls made by the negative rule undone (filled with -1): what is left null
    was missing in the source."""
    out = {}
    for c in columns:
        marker = f"{c}{fv.NEGATIVE_SUFFIX}"
        if marker in df.columns:
            out[c] = F.when(F.col(marker) == 1, F.coalesce(F.col(c), F.lit(-1))).otherwise(F.col(c))
    return df.withColumns(out) if out else df


def nullity_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of the null indicators, upper triangle; null for an always-present column.

    Indicators are 0/1, so the three counts of each pair are enough.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    counts = df.agg(F.count(F.lit(1)).cast("double").alias("_n"),
                    *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns],
                    *[F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"n{i}")
                      for i, (a, b) in enumerate(pairs)])
    n = F.col("_n")

    def rho(a: str, b: str, i: int) -> Column:
        pa, pb, pab = F.col(f"n_{a}") / n, F.col(f"n_{b}") / n, F.col(f"n{i}") / n
        spread = F.sqrt(pa * (1 - pa) * pb * (1 - pb))
        return F.try_divide(pab - pa * pb, spread)

    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"), rho(a, b, i).alias("rho"))
        for i, (a, b) in enumerate(pairs)])))


def missing_indicators(df: DataFrame, patterns: Mapping[str, str], keep: Sequence[str] = ()
                       ) -> DataFrame:
    """One 0/1 column per pattern (name -> representative column)."""
    return df.select(*keep, *[F.col(c).isNull().cast("int").alias(n) for n, c in patterns.items()])


def holm(df: DataFrame, p: str = "p_value", name: str = "p_holm") -> DataFrame:
    """Add Holm-adjusted p-values; one row per test, so a plain window is enough."""
    order = Window.orderBy(F.col(p).asc(), *[F.col(c) for c in df.columns if c == "variable"])
    rank, m = F.row_number().over(order), F.count(F.lit(1)).over(Window.partitionBy())
    stepped = df.withColumn("_step", (m - rank + 1) * F.col(p))
    running = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn(name, F.least(running, F.lit(1.0))).drop("_step")


def chi2_1_p(chi2: Column) -> Column:
    """Upper tail of the chi-square law with one degree of freedom."""
    return erfc(F.sqrt(F.greatest(chi2, F.lit(0.0)) / 2))


def missing_vs_target(df: DataFrame, columns: Sequence[str], min_pct: float = 0.0,
                      target: str = "churn", alpha: float = 0.05) -> DataFrame:
    """Per pattern: rate when missing and when present, gap, chi-square, V, Holm p."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(target).alias("_pos"), *[
        F.struct(F.lit(c).alias("variable"), F.count_if(F.col(c).isNull()).alias("k"),
                 F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col(target))), F.lit(0)).alias("kpos"))
        .alias(f"p{i}") for i, c in enumerate(columns)])
    rows = counts.select("_n", "_pos", F.inline(F.array(*[f"p{i}" for i in range(len(columns))])))
    n, pos, k, kpos = (F.col(c).cast("double") for c in ("_n", "_pos", "k", "kpos"))
    rows = rows.filter((F.col("k") > 0) & (F.col("k") < F.col("_n"))
                       & (100 * F.col("k") / F.col("_n") >= min_pct))
    gap = kpos - k * pos / n
    chi2 = gap * gap * n * n * n / (k * (n - k) * pos * (n - pos))
    miss, present = 100 * kpos / k, 100 * (pos - kpos) / (n - k)
    table = rows.select("variable", (100 * k / n).alias("pct_manquant"),
                        miss.alias("churn_si_manquant"), present.alias("churn_si_present"),
                        (miss - present).alias("ecart_pts"), chi2.alias("chi2"),
                        F.sqrt(chi2 / n).alias("cramers_v"))
    table = holm(table.withColumn("p_value", chi2_1_p(F.col("chi2"))))
    return table.withColumn("significatif", F.col("p_holm") <= alpha)


def duplicates_summary(df: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Repeated ids, and repeated rows ignoring the id (two 64-bit hashes of the row)."""
    rest = [F.col(c) for c in df.columns if c != id_col]
    keyed = df.select(id_col, F.xxhash64(*rest).alias("_a"), F.xxhash64(F.lit(1), *rest).alias("_b"))
    ids = keyed.groupBy(id_col).agg(F.count(F.lit(1)).alias("k")).agg(
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("doublons_id"))
    rows = keyed.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("k")).agg(
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("doublons_lignes_hors_id"))
    return ids.crossJoin(rows)                         # one row each


def outlier_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Extreme quantiles, isolation of the maximum, share outside the Tukey fences, skewness."""
    from loyaltide.operators.describe import unbiased_skew
    q = exact_quantiles(df, columns, [0.0, 0.25, 0.5, 0.75, 0.999, 1.0])
    v = F.col("value")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    rows = unpivot_values(df, columns).join(F.broadcast(q.drop("n")), "variable")
    outside = (v < F.col("q1") - reach) | (v > F.col("q3") + reach)
    t = rows.groupBy("variable", *[f"q{i}" for i in range(6)]).agg(
        F.count_if(v > F.col("q4")).alias("n_sup_q999"),
        (100 * F.avg(outside.cast("double"))).alias("pct_hors_tukey"),
        F.skewness("value").alias("_skew"), F.count(F.lit(1)).alias("_n"))
    return t.select("variable", F.col("q0").alias("min"), F.col("q1").alias("q25"),
                    F.col("q2").alias("mediane"), F.col("q3").alias("q75"),
                    F.col("q4").alias("q999"), F.col("q5").alias("max"),
                    F.try_divide("q5", "q4").alias("max_sur_q999"), "n_sup_q999", "pct_hors_tukey",
                    unbiased_skew(F.col("_skew"), F.col("_n")).alias("asymetrie"))


def tenure_of_missing(df: DataFrame, column: str = "avg6mou", tenure: str = "months") -> DataFrame:
    """Rows with the column missing, counted by tenure."""
    return df.filter(F.col(column).isNull()).groupBy(tenure).agg(F.count(F.lit(1)).alias("n"))
