"""Descriptive and exploratory tables.

Many variables are described in one job: columns are unpivoted to ``(variable, value, ...)`` and
aggregated by variable, never one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import MISSING, all_present, safe_divide, wilson_bound
from loyaltide.operators.ranking import (exact_quantiles, running_totals, unpivot_values,
                                          value_ranks)


def unbiased_skew(skew: Column, n: Column) -> Column:
    """Sample-corrected skewness from the population one; null under 3 values."""
    n = n.cast("double")
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(kurt: Column, n: Column) -> Column:
    """Sample-corrected excess kurtosis; null under 4 values."""
    n = n.cast("double")
    return F.when(n > 3, ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3)))


def describe_numeric(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Centre, spread, shape, zero and missing shares: one row per variable."""
    long = unpivot_values(df, columns, drop_nulls=False)
    v = F.col("value")
    table = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(v).alias("_n"), F.avg(v).alias("moyenne"),
        F.stddev_samp(v).alias("ecart_type"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("_skew"), F.kurtosis(v).alias("_kurt"),
        F.count_if(v == 0).alias("_zeros"))
    median = exact_quantiles(df, columns, [0.5]).select("variable", F.col("q0").alias("mediane"))
    table = table.join(median, "variable", "left")
    shown = {"moyenne": F.col("moyenne"), "mediane": F.col("mediane"),
             "ecart_type": F.col("ecart_type"), "min": F.col("min"), "max": F.col("max"),
             "asymetrie": unbiased_skew(F.col("_skew"), F.col("_n")),
             "aplatissement": unbiased_kurtosis(F.col("_kurt"), F.col("_n")),
             "pct_zero": 100 * F.col("_zeros") / F.col("_rows"),
             "pct_manquant": 100 * (F.col("_rows") - F.col("_n")) / F.col("_rows")}
    return table.select("variable", *[F.bround(c, digits).alias(k) for k, c in shown.items()])


def shape_flags(stats: DataFrame, skew: float = 2.0, zero: float = 50.0) -> DataFrame:
    return stats.select("variable", (F.abs("asymetrie") > skew).alias("tres_asymetrique"),
                        (F.col("pct_zero") > zero).alias("concentree_sur_zero"))


def block_summary(flags: DataFrame, blocks: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Per business block, and in total: variables, skewed ones, zero-heavy ones."""
    members = {v: b for b, names in (blocks or fv.VARIABLE_BLOCKS).items() for v in names}
    pairs = [F.lit(x) for item in members.items() for x in item]
    block = F.try_element_at(F.create_map(*pairs), F.col("variable"))
    rows = flags.withColumn("bloc", block).filter(F.col("bloc").isNotNull())
    return (rows.rollup("bloc").agg(F.count(F.lit(1)).alias("variables"),
                                    F.count_if("tres_asymetrique").alias("tres_asymetriques"),
                                    F.count_if("concentree_sur_zero").alias("concentrees_sur_zero"))
            .withColumn("bloc", F.coalesce("bloc", F.lit("Total"))))


def category_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each level; a missing value is a level."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("niveau")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.bround(
        100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def unpivot_levels(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
                   missing: str | None = MISSING) -> DataFrame:
    """Long form of categorical columns: ``keep..., variable, niveau``."""
    def text(c: str) -> Column:
        value = F.col(c).cast("string")
        return (value if missing is None else F.coalesce(value, F.lit(missing))).alias(c)
    return df.unpivot([F.col(c) for c in keep], [text(c) for c in columns], "variable", "niveau")


def level_dominance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per categorical column: number of levels, top level and its share, missing share."""
    counts = unpivot_levels(df, columns, missing=None).groupBy("variable", "niveau").agg(
        F.count(F.lit(1)).alias("n"))
    known = F.col("niveau").isNotNull()
    return counts.groupBy("variable").agg(
        F.count_if(known).alias("n_niveaux"),
        F.max_by(F.when(known, F.col("niveau")),
                 F.when(known, F.struct("n", "niveau"))).alias("niveau_dominant"),
        (100 * F.max(F.when(known, F.col("n"))) / F.sum("n")).alias("part_dominant"),
        (100 * F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)) / F.sum("n"))
        .alias("part_manquant"))


def credit_class(df: DataFrame, column: str = "crclscod", min_share: float = 0.01,
                 name: str = "classe_credit") -> DataFrame:
    """Add the initial letter of the code; letters under ``min_share`` are merged."""
    letter = F.substring(column, 1, 1)
    shares = df.filter(F.col(column).isNotNull()).groupBy(letter.alias("_letter")).agg(
        F.count(F.lit(1)).alias("_n"))
    shares = shares.withColumn("_share", F.col("_n") / F.sum("_n").over(Window.partitionBy()))
    return (df.join(F.broadcast(shares), letter == F.col("_letter"), "left")  # one row per letter
            .withColumn(name, F.when(F.col("_share") < min_share, fv.OTHERS).otherwise(letter))
            .drop("_letter", "_n", "_share"))


def _rate_columns(total: Column, digits: int | None = 2) -> list[Column]:
    n, k = F.col("n"), F.col("churners")
    cells = {"taux": 100 * k / n, "ic_bas": 100 * wilson_bound(k, n, -1),
             "ic_haut": 100 * wilson_bound(k, n, 1), "part": 100 * n / total}
    return [(c if digits is None else F.bround(c, digits)).alias(name) for name, c in cells.items()]


def churn_rate_table(df: DataFrame, group: Column, target: str = "churn",
                     levels: Sequence[str] | None = None, sort_by_rate: bool = False,
                     digits: int | None = 2) -> DataFrame:
    """Rate per group with its Wilson interval; the missing group comes last.

    ``ordre`` gives the display order: listed levels first, else the group value, else the rate.
    """
    label = F.coalesce(group.cast("string"), F.lit(MISSING))
    table = df.groupBy(label.alias("groupe")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).alias("churners"), F.min(group).alias("_key"))
    whole = Window.partitionBy()                      # one row per group
    out = table.select("groupe", "n", "churners", *_rate_columns(F.sum("n").over(whole), digits),
                       "_key")
    if sort_by_rate:
        order = [F.col("taux").desc(), F.col("groupe")]
    elif levels is not None:
        position = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col("groupe"))
        order = [(F.col("groupe") == MISSING), position]
    else:
        order = [(F.col("groupe") == MISSING), F.col("_key").asc_nulls_last()]
    return out.withColumn("ordre", F.row_number().over(Window.orderBy(*order))).drop("_key")


def quantile_bins(df: DataFrame, columns: Sequence[str], q: int = 10, keep: Sequence[str] = ()
                  ) -> DataFrame:
    """Long form with quantile classes: ``keep..., variable, value, classe, gauche, droite``.

    Classes are right-closed, the lowest edge is included, equal edges are merged, nulls dropped.
    The edge table has one row per variable.
    """
    probs = [i / q for i in range(q + 1)]
    edges = exact_quantiles(df, columns, probs).select(
        "variable", F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(q + 1)]))
        .alias("bords"))
    long = unpivot_values(df, columns, keep)
    # Position = edges strictly below the value; the minimum belongs to the first class.
    below = F.greatest(F.size(F.filter("bords", lambda e: e < F.col("value"))), F.lit(1))
    return (long.join(F.broadcast(edges), "variable")
            .withColumn("classe", below)
            .select(*keep, "variable", "value", "classe",
                    F.element_at("bords", F.col("classe")).alias("gauche"),
                    F.element_at("bords", F.least(F.col("classe") + 1, F.size("bords")))
                    .alias("droite")))


def two_way_rate(df: DataFrame, row: str, col: str, target: str = "churn") -> DataFrame:
    """Rate (%) and size of every crossing, long; absent crossings are absent."""
    return (df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col)
            .agg(F.bround(100 * F.avg(target), 1).alias("taux"), F.count(F.lit(1)).alias("n")))


def two_way_pivot(df: DataFrame, row: str, col: str, levels: Sequence[str], target: str = "churn"
                  ) -> DataFrame:
    """The same crossing, wide: ``<level>_taux`` and ``<level>_n`` (0 when empty)."""
    cells = two_way_rate(df, row, col, target)
    wide = cells.groupBy(row).pivot(col, list(levels)).agg(F.first("taux").alias("taux"),
                                                           F.first("n").alias("n"))
    return wide.select(row, *[e for v in levels for e in (
        F.col(f"`{v}_taux`"), F.coalesce(F.col(f"`{v}_n`"), F.lit(0)).alias(f"{v}_n"))])


def _pairwise(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rank correlation of each pair over the rows that have both values, all pairs in one job.

    The pair is a group of the distributed ranking, so no task holds a whole variable.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"),
                               F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)])
    long = df.select(F.inline(cells)).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranks = value_ranks(long, ["x", "y"], ["pair"]).select("pair", "variable", "value", "avg_rank")

    def rank_of(c: str) -> DataFrame:
        return ranks.filter(F.col("variable") == c).select(
            "pair", F.col("value").alias(c), F.col("avg_rank").alias(f"r{c}"))

    # Equal (x, y) are counted before the joins: a frequent value is a few rows, not one hot key.
    weighted = long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = weighted.join(rank_of("x"), ["pair", "x"]).join(rank_of("y"), ["pair", "y"])
    w, x, y = F.col("w"), F.col("rx"), F.col("ry")
    sums = rows.groupBy("pair").agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
    n = F.col("n")
    spread = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx"))
                    * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    rho = F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), spread)
    names = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("var_1"),
                               F.lit(b).alias("var_2")) for i, (a, b) in enumerate(pairs)])
    known = df.sparkSession.range(1).select(F.inline(names))
    return known.join(sums.select("pair", rho.alias("rho")), "pair", "left").drop("pair")


def null_masks(df: DataFrame, columns: Sequence[str], id_col: str) -> dict[str, tuple]:
    """Per column a fingerprint of the rows without a value: equal ones have the same null rows.

    One pass: how many, and two order-free combinations of the hashes of their ids.
    """
    aggs = []
    for c in columns:
        gap = F.col(c).isNull()
        aggs += [F.count_if(gap).alias(f"{c}_n"),
                 F.bit_xor(F.when(gap, F.xxhash64(id_col))).alias(f"{c}_a"),
                 F.sum(F.when(gap, F.xxhash64(id_col, F.lit(1)).cast("decimal(38,0)"))).alias(f"{c}_b")]
    row = df.agg(*aggs).first()                            # one row
    return {c: (row[f"{c}_n"], row[f"{c}_a"], row[f"{c}_b"]) for c in columns}


def spearman_matrix(df: DataFrame, columns: Sequence[str], id_col: str = "customer_id",
                    digits: int | None = 2) -> DataFrame:
    """Upper triangle of the pairwise rank correlations: ``var_1, var_2, rho``.

    Each pair uses the rows that have both values.  Those rows follow from the null masks of the two
    columns, so pairs over the same rows share one ranking of each column, and their correlations
    are one aggregate over the rows' ranks.  What is left alone on its rows is ranked pair by pair.
    """
    masks = null_masks(df, columns, id_col)
    scopes: dict[frozenset, list[tuple[str, str]]] = {}
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            scopes.setdefault(frozenset(masks[c] for c in (a, b) if masks[c][0]), []).append((a, b))
    shared = {i: (scope, pairs) for i, (scope, pairs) in enumerate(scopes.items()) if len(pairs) > 1}
    out = _by_scope(df, columns, masks, shared, id_col) if shared else None
    alone = [pairs[0] for pairs in scopes.values() if len(pairs) == 1]
    if alone:
        part = _pairwise(df, alone)
        out = part if out is None else out.unionByName(part)
    return out if digits is None else out.withColumn("rho", F.bround("rho", digits))


def _by_scope(df: DataFrame, columns: Sequence[str], masks: dict[str, tuple],
              scopes: dict[int, tuple[frozenset, list[tuple[str, str]]]], id_col: str) -> DataFrame:
    """Correlations of the pairs of each scope (a set of null masks), all scopes in one job: a
    ranking by scope and column, the ranks of a row side by side, one aggregate per scope."""
    cells = []
    for i, (scope, pairs) in scopes.items():
        holders = [next(c for c in columns if masks[c] == mask) for mask in scope]
        there = all_present(holders) if holders else F.lit(True)
        cells += [F.when(there, F.struct(F.lit(i).alias("scope"), F.lit(c).alias("variable"),
                                         F.col(c).cast("double").alias("value")))
                  for c in sorted({c for pair in pairs for c in pair}, key=columns.index)]
    long = df.select(id_col, F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
    counts = long.groupBy("scope", "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = running_totals(counts, ["value"], {"n": F.col("n")}, ["scope", "variable"]).select(
        "scope", "variable", "value", (F.col("n_cum") + (1 - F.col("n")) / F.lit(2.0)).alias("rank"))
    side = long.join(ranks, ["scope", "variable", "value"]).groupBy("scope", id_col).agg(*[
        F.max(F.when(F.col("variable") == c, F.col("rank"))).alias(c) for c in columns])
    pairs = [(i, a, b) for i, (_, of) in scopes.items() for a, b in of]
    table = side.groupBy("scope").agg(*[F.corr(a, b).alias(f"r{k}")
                                        for k, (_, a, b) in enumerate(pairs)])
    lines = F.array(*[F.struct(F.lit(i).alias("_scope"), F.lit(a).alias("var_1"),
                               F.lit(b).alias("var_2"), F.col(f"r{k}").alias("rho"))
                      for k, (i, a, b) in enumerate(pairs)])
    return (table.select("scope", F.inline(lines)).filter("scope = _scope")
            .select("var_1", "var_2", "rho"))


def top_correlated_pairs(matrix: DataFrame, threshold: float = 0.8, strict: bool = False
                         ) -> DataFrame:
    strength = F.abs("rho")
    keep = strength > threshold if strict else strength >= threshold
    return matrix.filter(keep).orderBy(strength.desc(), "var_1", "var_2")


def segment_table(df: DataFrame, axes: Sequence[str], target: str = "churn", min_size: int = 0
                  ) -> DataFrame:
    """Size, share, rate and gap to the mean of each complete crossing of the axes."""
    whole = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(target).alias("_rate"))
    table = (df.filter(all_present(axes)).groupBy(*axes)
             .agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("churners"))
             .filter(F.col("n") >= min_size).crossJoin(F.broadcast(whole)))  # one row
    return table.select(*axes, "n", *_rate_columns(F.col("_n")), F.bround(
        100 * (F.col("churners") / F.col("n") - F.col("_rate")), 2).alias("ecart_pts"))


def pooled_segments(table: DataFrame, edges: Sequence[float] = (0, 40, 50, 60, 100)) -> DataFrame:
    """Segments pooled by band of their rate: how many, customers, weighted rate."""
    band = F.lit(len(edges) - 1)
    for i in reversed(range(1, len(edges) - 1)):
        band = F.when(F.col("taux") < edges[i], F.lit(i)).otherwise(band)
    return table.groupBy(band.alias("bande")).agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("n").alias("clients"),
        (F.sum(F.col("n") * F.col("taux")) / F.sum("n")).alias("taux_pondere"))


def binned_rates(df: DataFrame, columns: Sequence[str], q: int = 10, target: str = "churn"
                 ) -> DataFrame:
    """Rate of each quantile class of each variable: ``variable, classe, n, churners, taux``."""
    binned = quantile_bins(df, columns, q, [target])
    return (binned.groupBy("variable", "classe")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("churners"))
            .withColumn("taux", F.bround(100 * F.col("churners") / F.col("n"), 2)))


def spearman_with_target(df: DataFrame, columns: Sequence[str], target: str = "churn") -> DataFrame:
    """Rank correlation of each variable with the 0/1 target, from per-value counts."""
    ranks = value_ranks(df, columns, sums={"pos": F.sum(target)}, keep=[target])
    n, r, k = F.col("n").cast("double"), F.col("avg_rank"), F.col("pos").cast("double")
    s = ranks.groupBy("variable").agg(
        F.sum(n).alias("n"), F.sum(n * r).alias("sr"), F.sum(n * r * r).alias("srr"),
        F.sum(k).alias("sy"), F.sum(k * r).alias("sry"))
    cov = F.col("sry") - F.col("sr") * F.col("sy") / F.col("n")
    var_r = F.col("srr") - F.col("sr") * F.col("sr") / F.col("n")
    var_y = F.col("sy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select("variable", F.try_divide(cov, F.sqrt(var_r * var_y)).alias("rho"))


def decile_contrast(df: DataFrame, columns: Sequence[str], target: str = "churn") -> DataFrame:
    """Spread of the rate between the quantile classes of each variable, and its direction."""
    spread = binned_rates(df, columns, 10, target).groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("taux").alias("taux_min"),
        F.max("taux").alias("taux_max"),
        F.bround(F.max("taux") - F.min("taux"), 1).alias("amplitude_pts"))
    return spread.join(spearman_with_target(df, columns, target), "variable").withColumn(
        "rho", F.bround("rho", 3))


def level_counts(df: DataFrame, columns: Sequence[str], target: str = "churn") -> DataFrame:
    """Long contingency counts ``variable, niveau, n, pos`` (a missing value is a level)."""
    return unpivot_levels(df, columns, [target]).groupBy("variable", "niveau").agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).alias("pos"))


def chi2_from_counts(counts: DataFrame) -> DataFrame:
    """Chi-square of level x target without correction: ``variable, n, chi2, ddl, cramers_v``.

    With a 0/1 target, chi2 = sum (pos - n p)^2 / (n p (1 - p)) over the levels.
    """
    whole = Window.partitionBy("variable")
    total, pos = F.sum("n").over(whole), F.sum("pos").over(whole)
    rows = counts.withColumns({"_total": total, "_p": pos / total})
    gap = F.col("pos") - F.col("n") * F.col("_p")
    term = F.try_divide(gap * gap, F.col("n") * F.col("_p") * (1 - F.col("_p")))
    table = rows.groupBy("variable").agg(
        F.max("_total").alias("n"), F.sum(term).alias("chi2"),
        (F.count(F.lit(1)) - 1).alias("ddl"))
    return table.withColumn("cramers_v", F.when(
        F.col("ddl") > 0, F.sqrt(F.col("chi2") / F.col("n"))))


def categorical_contrast(df: DataFrame, columns: Sequence[str], target: str = "churn",
                         min_n: int = 500) -> DataFrame:
    """Extreme levels among those with at least ``min_n`` rows, and Cramer's V over all levels."""
    counts = level_counts(df, columns, target).withColumn(
        "taux", F.bround(100 * F.col("pos") / F.col("n"), 2))
    big = F.col("n") >= min_n
    rate = F.when(big, F.col("taux"))
    table = counts.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_modalites"),
        F.min_by(F.when(big, F.col("niveau")), F.when(big, F.struct("taux", "niveau")))
        .alias("modalite_min"),
        F.min(rate).alias("taux_min"),
        F.max_by(F.when(big, F.col("niveau")), F.when(big, F.struct("taux", "niveau")))
        .alias("modalite_max"),
        F.max(rate).alias("taux_max"),
        F.bround(F.max(rate) - F.min(rate), 1).alias("ecart_pts"))
    v = chi2_from_counts(counts).select("variable", F.bround("cramers_v", 3).alias("cramers_v"))
    return table.join(v, "variable")


def medians_by_target(df: DataFrame, columns: Sequence[str], target: str = "churn") -> DataFrame:
    """Median of each class and the relative gap in percent."""
    q = exact_quantiles(df, columns, [0.5], [target])
    wide = q.groupBy("variable").agg(
        F.max(F.when(F.col(target) == 0, F.col("q0"))).alias("mediane_0"),
        F.max(F.when(F.col(target) == 1, F.col("q0"))).alias("mediane_1"))
    return wide.withColumn("ecart_pct", 100 * safe_divide(
        F.col("mediane_1") - F.col("mediane_0"), F.abs("mediane_0")))


def cross_tab(df: DataFrame, row: str, target: str = "churn", label: str = "All") -> DataFrame:
    """Row percentages of the two classes with a margin row."""
    known = df.filter(F.col(row).isNotNull())
    table = known.rollup(row).agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg((F.col(target) == 0).cast("double"))).alias("pct_0"),
        (100 * F.avg((F.col(target) == 1).cast("double"))).alias("pct_1"))
    return table.withColumn(row, F.coalesce(F.col(row).cast("string"), F.lit(label)))


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 40, skew_log: float = 2.0
               ) -> DataFrame:
    """Equal-width histograms, long: ``variable, echelle, pct_zero, classe, debut, fin, n``.

    Strongly skewed non-negative variables use log10 classes over their positive values.
    """
    long = unpivot_values(df, columns)
    v = F.col("value")
    shape = long.groupBy("variable").agg(
        F.count(v).alias("_n"), F.skewness(v).alias("_skew"), F.min(v).alias("_min"),
        F.max(v).alias("_max"), F.min(F.when(v > 0, v)).alias("_minpos"),
        (100 * F.avg((v == 0).cast("double"))).alias("pct_zero"))
    use_log = ((F.abs(unbiased_skew(F.col("_skew"), F.col("_n"))) > skew_log)
               & (F.col("_min") >= 0) & F.col("_minpos").isNotNull())
    shape = shape.withColumn("echelle", F.when(use_log, "log10").otherwise("lineaire"))
    is_log = F.col("echelle") == "log10"
    shape = shape.select("variable", "echelle", "pct_zero",
                         F.when(is_log, F.log10("_minpos")).otherwise(F.col("_min")).alias("_lo"),
                         F.when(is_log, F.log10("_max")).otherwise(F.col("_max")).alias("_hi"))
    rows = long.join(F.broadcast(shape), "variable")   # one row per variable
    rows = rows.filter(~is_log | (v > 0)).withColumn(
        "_x", F.when(is_log, F.log10(v)).otherwise(v))
    step = (F.col("_hi") - F.col("_lo")) / bins
    index = F.when(step > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / step),
                                     F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return (rows.groupBy("variable", "echelle", "pct_zero", "_lo", "_hi", index.alias("classe"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("variable", "echelle", "pct_zero", "classe",
                    (F.col("_lo") + F.col("classe") * step).alias("debut"),
                    (F.col("_lo") + (F.col("classe") + 1) * step).alias("fin"), "n"))


def box_statistics(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles and whiskers (last data point within 1.5 interquartile ranges)."""
    by = list(by)
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by).select(
        *by, "variable", F.col("q0").alias("q1"), F.col("q1").alias("mediane"),
        F.col("q2").alias("q3"))
    long = unpivot_values(df, columns, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("value")
    rows = long.join(q, [*by, "variable"])             # one row per group and variable
    return rows.groupBy(*by, "variable", "q1", "mediane", "q3").agg(
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("moustache_bas"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("moustache_haut"))


def step_bins(column: str, low: float, high: float, step: int) -> Column:
    """Left edge of the ``step``-wide class inside [low, high]; null outside."""
    c = F.col(column)
    return F.when(c.between(low, high), F.floor(c / step) * step)


def capped(column: str, cap: int) -> Column:
    """Value capped at ``cap`` (the last class is open)."""
    return F.when(F.col(column).isNotNull(), F.least(F.col(column), F.lit(cap)))


def tenure_peaks(df: DataFrame, windows: dict[str, Sequence[int]] | None = None,
                 others: tuple[int, int] = (13, 40), target: str = "churn") -> DataFrame:
    """Rate and size at the suspected contract ends against the other months."""
    # Months of the suspected ends.
    windows = windows or {"11-12": (11, 12), "23-24": (23, 24), "35-36": (35, 36)}
    label = F.when(F.col("months").between(*others), "autres")
    for name, months in reversed(list(windows.items())):
        label = F.when(F.col("months").isin(*months), name).otherwise(label)
    return (df.withColumn("fenetre", label).filter(F.col("fenetre").isNotNull())
            .groupBy("fenetre").agg(F.count(F.lit(1)).alias("n"),
                                    (100 * F.avg(target)).alias("taux")))
