"""Variable x target tests and redundancy between variables.

Counts and rank sums are collected by Spark over all rows; p-values, clustering and matrix inversion
work on the results, whose size depends on the number of variables only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import (effect_label, log1p_nonneg,
                                             mixed_hash, normal_two_sided_p, signed_log1p)
from loyaltide.operators.describe import (binned_rates, chi2_from_counts, level_counts,
                                          spearman_matrix, top_correlated_pairs,
                                          unbiased_skew)
from loyaltide.operators.quality import chi2_1_p, holm
from loyaltide.operators.ranking import quantile_row, row_numbers, unpivot_values, value_ranks
from loyaltide.staging import stage


# --- Tests ---------------------------------------------------------------------------------

def mann_whitney(df: DataFrame, columns: Sequence[str], target: str = "churn",
                 by: Sequence[str] = ()) -> DataFrame:
    """U of the positives, two-sided normal p (tie and continuity corrected), rank-biserial effect.

    Rank sums need one row per distinct value; any number of variables runs as one job.
    """
    ranks = value_ranks(df, columns, by, {"pos": F.sum(target)}, [target])
    n = F.col("n").cast("double")
    s = ranks.groupBy(*by, "variable").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n1"),
        F.sum(F.col("pos") * F.col("avg_rank")).alias("r1"),
        F.sum(n * n * n - n).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    total = F.col("n").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1))))
    z = F.try_divide(F.abs(u - n1 * n0 / 2) - 0.5, sd)
    return s.select(*by, "variable", u.alias("statistique"),
                    F.least(F.lit(1.0), normal_two_sided_p(F.greatest(z, F.lit(0.0))))
                    .alias("p_value"),
                    (2 * F.try_divide(u, n1 * n0) - 1).alias("effet"), "n")


def _chi2_upper(chi2: Column, dof: Column) -> Column:
    """Upper chi-square tail by its finite sum, exact for any whole number of degrees of freedom.

    Even: ``exp(-h) * sum(h^j / j!)`` for ``j < dof / 2`` with ``h`` half of chi2; odd: the tail of one
    degree plus ``exp(-h) * sum(h^(j - 1/2) / gamma(j + 1/2))`` for ``j <= (dof - 1) / 2``.  Terms follow
    from one another, each taken relative to ``exp(-h)`` so that none overflows.
    """
    h = F.greatest(chi2, F.lit(0.0)) / 2
    odd = F.pmod(dof, F.lit(2)) == 1
    steps = F.floor(dof / 2).cast("int")
    # log of the j-th term, j from 0 (even) or 1 (odd): -h + a * log(h) - lgamma(a + 1)
    first = F.when(odd, F.log(2 * F.sqrt(h / math.pi))).otherwise(F.lit(0.0))
    start = F.struct((first - h).alias("log"), F.lit(0.0).alias("sum"))
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))

    def term(acc: Column, j: Column) -> Column:
        return F.struct((acc["log"] + F.log(h) - F.log(j + shift)).alias("log"),
                        (acc["sum"] + F.exp(acc["log"])).alias("sum"))

    tail = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start,
                                         term)["sum"]).otherwise(F.lit(0.0))
    whole = F.when(odd, tail + chi2_1_p(chi2)).otherwise(tail)
    return F.when(chi2 <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), whole))


def merge_rare_levels(counts: DataFrame, min_count: int = 30) -> DataFrame:
    """Levels under ``min_count`` of variables with more than two levels become one; that level is
    dropped when it stays too small.  Works on counts, not rows."""
    per_variable = Window.partitionBy("variable")
    many = F.count(F.lit(1)).over(per_variable) > 2
    level = F.when(F.col("_many") & (F.col("n") < min_count), fv.RARE).otherwise(F.col("niveau"))
    merged = (counts.withColumn("_many", many).withColumn("niveau", level)
              .groupBy("variable", "niveau").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"),
                                                 F.max("_many").alias("_many")))
    too_small = F.col("_many") & (F.col("niveau") == fv.RARE) & (F.col("n") < min_count)
    return merged.filter(~too_small).drop("_many")


def _fisher_two_sided(counts: DataFrame) -> DataFrame:
    """Fisher's exact p of 2 x 2 tables given as ``variable, a, b, c, d``.

    Terms of the hypergeometric law are exploded per table; only tables with an expected count under
    5 come here, so the smallest margin, hence the number of terms, is small for such variables.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")

    def log_factorial(x: Column) -> Column:
        # Stirling series above 16, exact sums below: error under 1e-10.
        series = (x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x)
                  - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))))
        small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(17)]),
                             F.least(x, F.lit(16.0)).cast("int") + 1)
        return F.when(x > 16, series).otherwise(small)

    r1, r2, k1 = a + b, c + d, a + c
    n = r1 + r2
    low = F.greatest(F.lit(0.0), k1 - r2)
    high = F.least(r1, k1)
    constant = (log_factorial(r1) + log_factorial(r2) + log_factorial(k1)
                + log_factorial(n - k1) - log_factorial(n))

    def log_p(x: Column) -> Column:
        return constant - (log_factorial(x) + log_factorial(r1 - x) + log_factorial(k1 - x)
                           + log_factorial(r2 - k1 + x))

    terms = counts.withColumn("_x", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    terms = terms.select("variable", log_p(F.col("_x").cast("double")).alias("lp"),
                         log_p(a).alias("lp0"))
    return terms.groupBy("variable").agg(F.least(F.lit(1.0), F.sum(F.when(
        F.col("lp") <= F.col("lp0") + 1e-7, F.exp("lp")).otherwise(0.0))).alias("p_fisher"))


def chi2_test(df: DataFrame, columns: Sequence[str], target: str = "churn", min_count: int = 30
              ) -> DataFrame:
    """Chi-square, V and p per categorical variable; Fisher's p for sparse 2 x 2 tables."""
    counts = merge_rare_levels(level_counts(df, columns, target), min_count)
    per_variable = Window.partitionBy("variable")
    total, pos = F.sum("n").over(per_variable), F.sum("pos").over(per_variable)
    cells = counts.withColumns({"_e1": F.col("n") * pos / total,
                                "_e0": F.col("n") * (total - pos) / total})
    sparse = cells.groupBy("variable").agg(
        (100 * (F.count_if(F.col("_e1") < 5) + F.count_if(F.col("_e0") < 5))
         / (2 * F.count(F.lit(1)))).alias("pct_cellules_attendu_lt5"))
    order = Window.partitionBy("variable").orderBy("niveau")
    square = (cells.withColumn("_i", F.row_number().over(order)).groupBy("variable").agg(
        F.count(F.lit(1)).alias("_levels"), F.min(F.least("_e1", "_e0")).alias("_min"),
        F.max(F.when(F.col("_i") == 1, F.col("pos"))).alias("a"),
        F.max(F.when(F.col("_i") == 1, F.col("n") - F.col("pos"))).alias("b"),
        F.max(F.when(F.col("_i") == 2, F.col("pos"))).alias("c"),
        F.max(F.when(F.col("_i") == 2, F.col("n") - F.col("pos"))).alias("d"))
        .filter((F.col("_levels") == 2) & (F.col("_min") < 5)))
    fisher = _fisher_two_sided(square.select("variable", "a", "b", "c", "d"))
    table = chi2_from_counts(counts).join(sparse, "variable").join(fisher, "variable", "left")
    exact = F.col("p_fisher").isNotNull()
    return table.select(
        "variable", F.when(exact, "Fisher exact").otherwise("χ²").alias("test"),
        F.col("chi2").alias("statistique"),
        F.coalesce("p_fisher", _chi2_upper(F.col("chi2"), F.col("ddl"))).alias("p_value"),
        F.col("cramers_v").alias("effet"), "n", "ddl", "pct_cellules_attendu_lt5")


# --- Non-monotone links --------------------------------------------------------------------

def class_profile(rates: DataFrame, numeric: bool, min_n: int = 200) -> DataFrame:
    """Spread of the class rates and shape of the curve: ``variable, ecart_classes_pts,
    forme_courbe``.  ``rates`` is ``variable, classe, n, taux``."""
    big = rates.filter(F.col("n") >= min_n)
    if not numeric:
        return big.groupBy("variable").agg(
            F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.max("taux") - F.min("taux"))
            .alias("ecart_classes_pts"), F.lit("sans objet").alias("forme_courbe"))
    per_variable = Window.partitionBy("variable")
    tie = F.count(F.lit(1)).over(Window.partitionBy("variable", "taux"))
    ranked = big.select(
        "variable", "taux", F.row_number().over(per_variable.orderBy("classe")).alias("rx"),
        (F.rank().over(per_variable.orderBy("taux")) + (tie - 1) / 2.0).alias("ry"))
    rho = F.corr("rx", "ry")
    k = F.count(F.lit(1))
    return ranked.groupBy("variable").agg(
        F.when(k < 2, 0.0).otherwise(F.max("taux") - F.min("taux")).alias("ecart_classes_pts"),
        F.when(k < 2, "sans objet").when((k < 3) | (F.abs(rho) >= 0.8), "monotone")
        .otherwise("non monotone").alias("forme_courbe"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """Mutual information (nats) with the 0/1 target from ``variable, <class>, n, pos`` counts."""
    per_variable = Window.partitionBy("variable")
    total = F.sum("n").over(per_variable).cast("double")
    pos = F.sum("pos").over(per_variable).cast("double")

    def part(k: Column, margin: Column) -> Column:
        return F.when(k > 0, k / F.col("_n") * F.log(k * F.col("_n") / (F.col("n") * margin))) \
            .otherwise(0.0)

    rows = counts.withColumns({"_n": total, "_pos": pos})
    return rows.groupBy("variable").agg(F.sum(
        part(F.col("pos"), F.col("_pos"))
        + part(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos"))).alias("info_mutuelle"))


def numeric_information(df: DataFrame, columns: Sequence[str], target: str = "churn", q: int = 10,
                        max_levels: int = 30, rates: DataFrame | None = None) -> DataFrame:
    """Information of numeric variables: over levels when few, else over quantile classes of the
    recorded values (``rates`` passes class counts already computed)."""
    levels = unpivot_values(df, columns, [target], drop_nulls=False).groupBy("variable", "value") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("pos"))
    per_value = levels.groupBy("variable").agg(F.count("value").alias("_levels"))
    few = per_value.filter(F.col("_levels") <= max_levels).select("variable")
    discrete = mutual_information(levels.join(F.broadcast(few), "variable", "left_semi"))
    binned = binned_rates(df, columns, q, target) if rates is None else rates
    continuous = mutual_information(binned.select(
        "variable", "classe", "n", F.col("churners").alias("pos")))
    return continuous.join(F.broadcast(few), "variable", "left_anti").unionByName(discrete)


def univariate_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                     target: str = "churn", alpha: float = 0.05, min_n: int = 200) -> DataFrame:
    """All tests in one table: effect, Holm, spread, shape, information, rank by information."""
    # Variables x classes: a small table read by the shape and by the information.
    rates = stage(binned_rates(df, numeric, 10, target), "class_rates")
    num = (mann_whitney(df, numeric, target)
           .join(class_profile(rates, True, min_n), "variable", "left")
           .join(numeric_information(df, numeric, target, rates=rates), "variable")
           .withColumns({"type": F.lit("numérique"), "test": F.lit("Mann-Whitney U"),
                         "mesure_effet": F.lit("rank-biserial")}))
    counts = level_counts(df, categorical, target)
    cat_rates = counts.select("variable", F.col("niveau").alias("classe"), "n",
                              F.bround(100 * F.col("pos") / F.col("n"), 2).alias("taux"))
    kinds = counts.groupBy("variable").agg(
        F.when(F.count(F.lit(1)) <= 2, "binaire").otherwise("catégorielle").alias("type"))
    cat = (chi2_test(df, categorical, target)
           .join(class_profile(cat_rates, False, min_n), "variable", "left")
           .join(mutual_information(counts), "variable").join(kinds, "variable")
           .withColumn("mesure_effet", F.lit("V de Cramér")))
    columns = ["variable", "type", "test", "mesure_effet", "statistique", "p_value", "effet", "n",
               "ecart_classes_pts", "forme_courbe", "info_mutuelle"]
    both = num.select(*columns).unionByName(cat.select(*columns)).withColumns({
        "ecart_classes_pts": F.coalesce("ecart_classes_pts", F.lit(0.0)),
        "forme_courbe": F.coalesce("forme_courbe", F.lit("sans objet"))})
    table = holm(both, "p_value", "p_ajustee_holm")
    size = F.abs("effet")
    return table.withColumns({
        "significatif_holm": F.col("p_ajustee_holm") <= alpha, "effet_abs": size,
        "interpretation": effect_label("effet"),
        "relation_non_monotone": (size < 0.1) & (F.col("ecart_classes_pts") > 10),
        "rang": F.row_number().over(Window.orderBy(F.desc("info_mutuelle"), "variable"))})


def p_value_vs_sample_size(df: DataFrame, column: str, sizes: Sequence[int],
                           target: str = "churn", id_col: str = "customer_id", seed: int = 42
                           ) -> DataFrame:
    """The same test on nested seeded samples of growing size: ``taille, p_value, effet``.

    A row belongs to every sample at least as large as its position in the seeded order.
    """
    keyed = df.select(id_col, target, column).withColumn("_h", mixed_hash(id_col, seed))
    ranked = row_numbers(keyed, ["_h", id_col])
    member = ranked.withColumn("taille", F.explode(F.array(*[F.lit(int(s)) for s in sizes]))) \
        .filter(F.col("rn") <= F.col("taille"))
    return mann_whitney(member, [column], target, ["taille"]).select(
        "taille", "p_value", F.col("effet").alias("rank_biserial"))


# --- Redundancy ----------------------------------------------------------------------------

def redundant_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    matrix = spearman_matrix(df, columns, digits=None)
    return top_correlated_pairs(matrix, threshold, strict=True).withColumn(
        "rho", F.bround("rho", 3))


def variable_clusters(pairs: Sequence[tuple[str, str, float]], columns: Sequence[str],
                      threshold: float = 0.9) -> dict[str, int]:
    """Average-link groups on ``1 - |rho|`` cut at ``1 - threshold`` (p x p result only)."""
    strength = {frozenset((a, b)): 1 - abs(r) for a, b, r in pairs}
    groups: list[list[str]] = [[c] for c in columns]
    while len(groups) > 1:
        best, where = None, None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                d = float(np.mean([strength.get(frozenset((a, b)), 1.0)
                                   for a in groups[i] for b in groups[j]]))
                if best is None or d < best:
                    best, where = d, (i, j)
        if best is None or best > 1 - threshold:
            break
        i, j = where
        groups[i] += groups.pop(j)
    return {c: g + 1 for g, members in enumerate(groups) for c in members}


def clusters_table(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """``variable, groupe``: correlations over all rows, linkage on the small matrix."""
    pairs = [tuple(r) for r in spearman_matrix(df, columns, digits=None).collect()]
    groups = variable_clusters(pairs, columns, threshold)
    return df.sparkSession.createDataFrame(list(groups.items()), "variable string, groupe int")


# Representatives preferred inside a redundant group.
PREFERRED_REPRESENTATIVES = ("mou_Mean", "rev_Mean", "custcare_Mean", "ovrrev_Mean",
                             "totrev", "totcalls", "phones", "recv_vce_Mean")


def choose_representatives(groups: DataFrame, importance: DataFrame,
                           preferred: Sequence[str] = PREFERRED_REPRESENTATIVES) -> DataFrame:
    """One kept variable per group of two or more: the first preferred one, else the most
    informative."""
    rows = groups.join(importance.select("variable", "info_mutuelle"), "variable", "left")
    position = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("variable"))
    order = Window.partitionBy("groupe").orderBy(
        (position == 0).cast("int"), position, F.coalesce("info_mutuelle", F.lit(0.0)).desc(),
        "variable")
    members = Window.partitionBy("groupe")
    return (rows.withColumns({"_k": F.count(F.lit(1)).over(members),
                              "representante": F.first("variable").over(order)})
            .filter(F.col("_k") > 1)
            .select("variable", "groupe", "representante",
                    (F.col("variable") == F.col("representante")).alias("garder"),
                    "info_mutuelle"))


def prepare_for_linear(df: DataFrame, columns: Sequence[str], skew_threshold: float = 2.0,
                       keep: Sequence[str] = ()) -> DataFrame:
    """Median fill, log of skewed columns (signed when negatives exist), z-score."""
    med = quantile_row(df, columns, [0.5], ["med"])
    filled = df.crossJoin(F.broadcast(med)).select(     # one row
        *keep, *[F.coalesce(F.col(c).cast("double"), F.col(f"{c}_med")).alias(c)
                 for c in columns])
    shape = filled.agg(*[e for c in columns for e in (
        unbiased_skew(F.skewness(c), F.count(c)).alias(f"{c}_skew"), F.min(c).alias(f"{c}_min"))])
    logged = filled.crossJoin(F.broadcast(shape)).select(
        *keep, *[F.when(F.abs(f"{c}_skew") > skew_threshold,
                        F.when(F.col(f"{c}_min") < 0, signed_log1p(c))
                        .otherwise(log1p_nonneg(c))).otherwise(F.col(c)).alias(c)
                 for c in columns])
    stats = logged.agg(*[e for c in columns for e in (
        F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])
    return logged.crossJoin(F.broadcast(stats)).select(
        *keep, *[F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")).alias(c)
                 for c in columns])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson matrix of complete columns: one aggregate over all rows, p x p numbers back."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = df.agg(*[F.corr(columns[i], columns[j]).alias(f"r{k}")
                   for k, (i, j) in enumerate(pairs)]).first()
    matrix = np.eye(len(columns))
    for k, (i, j) in enumerate(pairs):
        matrix[i, j] = matrix[j, i] = row[k] if row[k] is not None else 0.0
    return matrix


def vif_from_matrix(matrix: np.ndarray) -> np.ndarray:
    return np.diag(np.linalg.pinv(matrix))


def vif_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation of each (complete) column, largest first."""
    vif = vif_from_matrix(correlation_matrix(df, columns))
    rows = sorted(zip(columns, (float(v) for v in vif), strict=True), key=lambda r: -r[1])
    return df.sparkSession.createDataFrame(rows, "variable string, vif double")


def iterative_vif(df: DataFrame, columns: Sequence[str], threshold: float = 10.0
                  ) -> tuple[list[str], DataFrame]:
    """Drop the largest VIF until all are at most ``threshold``: kept columns and the history.

    One pass over the rows gives the matrix; the loop only takes sub-matrices.
    """
    matrix, kept, removed = correlation_matrix(df, columns), list(range(len(columns))), []
    while len(kept) > 1:
        vif = vif_from_matrix(matrix[np.ix_(kept, kept)])
        worst = int(np.argmax(vif))
        if vif[worst] <= threshold:
            break
        removed.append((columns[kept[worst]], round(float(vif[worst]), 2), len(removed) + 1))
        kept.pop(worst)
    history = df.sparkSession.createDataFrame(removed, "variable string, vif double, etape int")
    return [columns[i] for i in kept], history


def effect_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Effects of two tables side by side with their gap (``variable, effet``)."""
    return (a.select("variable", F.col("effet").alias("effet_a"))
            .join(b.select("variable", F.col("effet").alias("effet_b")), "variable")
            .withColumn("ecart", F.abs(F.col("effet_a") - F.col("effet_b"))))


def export_tables(univariate: DataFrame, representatives: DataFrame, vif_removed: DataFrame,
                  top_n: int = 15) -> dict[str, DataFrame]:
    """The three result tables: everything, the top with its drop mark, the drop list."""
    redundant = representatives.filter(~F.col("garder")).select("variable", "representante")
    vif = vif_removed.select("variable", "vif")
    drop = (redundant.withColumns({"raison": F.lit("redondance_spearman"),
                                   "vif": F.lit(None).cast("double")})
            .unionByName(vif.withColumns({"raison": F.lit("vif"),
                                          "representante": F.lit(None).cast("string")})))
    names = drop.groupBy("variable").agg(F.max("representante").alias("_rep"))
    removed_by_vif = vif.select(F.col("variable").alias("_vif"))
    shown = F.coalesce("_rep", "variable")
    top = (univariate.filter(F.col("rang") <= top_n).join(names, "variable", "left")
           .join(names.select(F.col("variable").alias("_d")), F.col("variable") == F.col("_d"),
                 "left")
           .withColumn("a_retirer_logreg", F.col("_d").isNotNull())
           .withColumn("_shown", shown)
           .join(removed_by_vif, F.col("_shown") == F.col("_vif"), "left")
           .withColumn("representante", F.when(F.col("_vif").isNotNull(), F.concat(
               "_shown", F.lit(" (retirée, VIF)"))).otherwise(F.col("_shown"))))
    columns = ["variable", "rang", "type", "test", "effet", "interpretation", "ecart_classes_pts",
               "forme_courbe", "info_mutuelle", "p_ajustee_holm", "a_retirer_logreg",
               "representante"]
    return {"univariate": univariate, "top": top.select(*columns),
            "drop": drop.select("variable", "raison", "representante", "vif")}
