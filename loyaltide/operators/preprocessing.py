"""Learned column transforms: fit = one-row or few-row table, apply = column expressions.

Fitted parameters are one-row DataFrames (medians, clipping bounds) or the same numbers as a mapping;
applied as a mapping they become literals, so the transform stays inside one generated stage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import MISSING, log1p_nonneg, signed_log1p
from loyaltide.operators.describe import unpivot_levels
from loyaltide.operators.ranking import quantile_row, row_numbers, unpivot_values


Learned = DataFrame | Mapping[str, object]


def attach(df: DataFrame, learned: Learned) -> tuple[DataFrame, Callable[[str], Column]]:
    """Make learned parameters available by name: literals for a mapping, a broadcast join of the
    single row for a one-row table."""
    if isinstance(learned, DataFrame):
        return df.crossJoin(F.broadcast(learned)), F.col
    return df, lambda name: F.lit(learned[name])


# --- Column roles --------------------------------------------------------------------------

def subset(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The listed columns that exist."""
    return [c for c in names if c in df.columns]


def category_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def binary_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: is every recorded value of the column 0 or 1?  One pass for all columns."""
    return df.agg(*[F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)).alias(c)
                    for c in columns])


def binary_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    candidates = [c for c in numeric_columns(df) if c not in exclude]
    if not candidates:
        return []
    flags = binary_flags(df, candidates).first()
    return [c for c in candidates if flags[c]]


def other_numeric(df: DataFrame, exclude: Sequence[str], include_binary: bool = False
                  ) -> list[str]:
    binary = set() if include_binary else set(binary_columns(df, exclude))
    return [c for c in numeric_columns(df) if c not in exclude and c not in binary]


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


# --- Numeric transforms --------------------------------------------------------------------

def fit_winsorizer(df: DataFrame, columns: Sequence[str], lower: float = 0.01,
                   upper: float = 0.99) -> DataFrame:
    """One row of clipping bounds ``<c>_low, <c>_high``."""
    return quantile_row(df, columns, [lower, upper], ["low", "high"])


def winsorize(df: DataFrame, bounds: Learned, columns: Sequence[str],
              keep_degenerate: bool = True) -> DataFrame:
    """Clip to the learned bounds; equal bounds mean no clipping, null stays null."""
    out, learned = attach(df, bounds)
    clipped = {}
    for c in columns:
        low, high, x = learned(f"{c}_low"), learned(f"{c}_high"), F.col(c).cast("double")
        inside = F.when(x < low, low).when(x > high, high).otherwise(x)
        clipped[c] = F.when(high <= low, x).otherwise(inside) if keep_degenerate else inside
    return out.withColumns(clipped).drop(*[f"{c}_{s}" for c in columns for s in ("low", "high")])


def fit_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``<c>_med`` and whether the column had nulls (``<c>_gap``)."""
    gaps = df.agg(*[(F.count(F.lit(1)) > F.count(c)).alias(f"{c}_gap") for c in columns])
    return quantile_row(df, columns, [0.5], ["med"]).crossJoin(gaps)   # one row each


def impute_median(df: DataFrame, medians: Learned, columns: Sequence[str],
                  indicator: bool = False) -> DataFrame:
    """Fill nulls by the learned median; optionally a 0/1 indicator per column whose fit rows had
    nulls (0 everywhere for the others)."""
    out, learned = attach(df, medians)
    new = {c: F.coalesce(F.col(c).cast("double"), learned(f"{c}_med")) for c in columns}
    if indicator:
        new |= {f"{c}_manquant": (F.col(c).isNull() & learned(f"{c}_gap")).cast("int")
                for c in columns}
    return out.withColumns(new).drop(*[f"{c}_{s}" for c in columns for s in ("med", "gap")])


def neutralize_leaks(df: DataFrame, medians: Learned,
                     columns: Sequence[str] = fv.LEAK_COLUMNS) -> DataFrame:
    """Remove every trace of absence in the columns that reveal an already gone customer."""
    return impute_median(df, medians, subset(df, columns))


def fit_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: most frequent value, the smallest on ties."""
    return df.agg(*[F.mode(c, deterministic=True).alias(f"{c}_mode") for c in columns])


def impute_mode(df: DataFrame, modes: Learned, columns: Sequence[str]) -> DataFrame:
    out, learned = attach(df, modes)
    return out.withColumns({c: F.coalesce(F.col(c), learned(f"{c}_mode")) for c in columns}).drop(
        *[f"{c}_mode" for c in columns])


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation, nulls ignored."""
    return df.agg(*[e for c in columns for e in (
        F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"))])


def standardize(df: DataFrame, stats: Learned, columns: Sequence[str]) -> DataFrame:
    """z-scores; a constant column is only centred."""
    out, learned = attach(df, stats)
    return out.withColumns({
        c: (F.col(c) - learned(f"{c}_mean")) / F.when(learned(f"{c}_sd") > 0, learned(f"{c}_sd"))
        .otherwise(1.0) for c in columns}).drop(
            *[f"{c}_{s}" for c in columns for s in ("mean", "sd")])


def log_columns(df: DataFrame, positive: Sequence[str] = fv.LOG_COLUMNS,
                signed: Sequence[str] = fv.SIGNED_LOG_COLUMNS) -> DataFrame:
    """Log of the skewed columns, signed log of the two-tailed ones; the rest unchanged."""
    return df.withColumns({**{c: log1p_nonneg(c) for c in subset(df, positive)},
                           **{c: signed_log1p(c) for c in subset(df, signed)}})


# --- Categories ----------------------------------------------------------------------------

def category_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
                           for c in columns})


def fit_levels(df: DataFrame, columns: Sequence[str], min_share: float | None = 0.01,
               min_count: int | None = None) -> DataFrame:
    """Level table ``variable, niveau, n, frequent, code``; codes count levels in text order,
    the missing level last."""
    counts = unpivot_levels(df, columns).groupBy("variable", "niveau").agg(
        F.count(F.lit(1)).alias("n"))
    per_variable = Window.partitionBy("variable")
    enough = F.lit(True)
    if min_share is not None:
        enough = F.col("n") / F.sum("n").over(per_variable) >= min_share
    if min_count is not None:
        enough = enough & (F.col("n") >= min_count)
    return counts.withColumns({
        "frequent": enough,
        "code": F.row_number().over(per_variable.orderBy(F.col("niveau") == MISSING, "niveau")) - 1})


def one_hot(df: DataFrame, levels: DataFrame, columns: Sequence[str], infrequent: bool = False
            ) -> DataFrame:
    """0/1 column per frequent level; unknown levels are all zero, or go to one ``infrequent`` slot.

    The names of the result's columns are the frequent levels, so those come to the driver; a
    column with very many levels is better served by :func:`one_hot_vector`.
    """
    kept = (levels.filter("frequent").select("variable", "niveau")
            .orderBy("variable", "niveau").collect())
    by_column = {c: [r["niveau"] for r in kept if r["variable"] == c] for c in columns}
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns}
    out: list[Column] = []
    for c in columns:
        out += [(text[c] == v).cast("int").alias(f"{c}_{v}") for v in by_column[c]]
        if infrequent:
            out.append((~text[c].isin(*by_column[c])).cast("int").alias(f"{c}_infrequent"))
    return df.select("*", *out).drop(*columns)


def one_hot_vector(df: DataFrame, levels: DataFrame, columns: Sequence[str], id_col: str,
                   infrequent: bool = False) -> DataFrame:
    """The same coding as sparse arrays, for any number of levels: ``id, positions, size``.

    Positions (from 0, ascending) of the slots that are 1, and the number of slots.  Levels get
    their slots by distributed numbering and meet the rows in one join over all columns.
    """
    slots = row_numbers(levels.filter("frequent").filter(F.col("variable").isin(*columns))
                        .select("variable", "niveau"), ["variable", "niveau"], name="slot")
    total = slots.agg(F.count(F.lit(1)).alias("_n"))
    text = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in columns]
    long = df.select(id_col, *text).unpivot(id_col, list(columns), "variable", "niveau")
    rest = {c: i for i, c in enumerate(columns)}
    other = F.try_element_at(F.create_map(*[F.lit(x) for kv in rest.items() for x in kv]),
                             F.col("variable"))
    found = long.join(slots, ["variable", "niveau"], "left").crossJoin(total)     # one row
    slot = F.when(F.col("slot").isNotNull(), F.col("slot") - 1)
    if infrequent:
        slot = F.coalesce(slot, F.col("_n") + other)
    return found.groupBy(id_col).agg(
        F.sort_array(F.collect_list(slot)).alias("positions"),
        (F.max("_n") + (len(columns) if infrequent else 0)).alias("size"))


def one_hot_sparse(df: DataFrame, levels: DataFrame, column: str, size: int,
                   infrequent: bool = False) -> DataFrame:
    """Replace ``column`` by ``<column>_vecteur``, sparse vectors with one slot per frequent level.

    ``levels`` is ``variable, niveau, slot`` and meets the rows in a join; other levels are all
    zeros, or share the last of the ``size`` slots if there is one for them (``infrequent``).
    """
    slots = levels.filter((F.col("variable") == column) & F.col("slot").isNotNull()).select(
        F.col("niveau").alias("_level"), F.col("slot").alias("_slot"))
    text = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    other = size - 1 if infrequent else size
    nominal = {"ml_attr": {"type": "nominal", "num_vals": size}}
    rows = (df.withColumn("_text", text).join(slots, F.col("_text") == F.col("_level"), "left")
            .withColumn("_place", F.coalesce("_slot", F.lit(other)).cast("double"))
            .withMetadata("_place", nominal))
    coder = OneHotEncoder(inputCol="_place", outputCol=f"{column}_vecteur", dropLast=not infrequent,
                          handleInvalid="error" if infrequent else "keep")
    return coder.fit(rows).transform(rows).drop(column, "_text", "_level", "_slot", "_place")


def ordinal_codes(df: DataFrame, levels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Level position as a number; unknown -1, null stays null.  Spark picks the join by size."""
    out = df
    for c in columns:
        table = levels.filter((F.col("variable") == c) & (F.col("niveau") != MISSING)).select(
            F.col("niveau").alias("_level"), F.col("code").alias("_code"))
        out = (out.join(table, F.col(c) == F.col("_level"), "left")
               .withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce("_code", F.lit(-1))))
               .drop("_level", "_code"))
    return out


# --- Splines -------------------------------------------------------------------------------

def fit_knots(df: DataFrame, columns: Sequence[str], n_knots: int = 5) -> DataFrame:
    """One row of quantile knots ``<c>_k0 ...`` per column."""
    probs = [i / (n_knots - 1) for i in range(n_knots)]
    return quantile_row(df, columns, probs, [f"k{i}" for i in range(n_knots)])


def spline_basis(df: DataFrame, knots: Learned, column: str, n_knots: int = 5,
                 degree: int = 3) -> DataFrame:
    """B-spline basis of one column by the de Boor recursion, constant outside the knots.

    The knot vector is extended on both sides by the first and last gap, as in the usual
    construction with ``n_knots + degree - 1`` functions summing to one.
    """
    out, learned = attach(df, knots)
    base = [learned(f"{column}_k{i}").cast("double") for i in range(n_knots)]
    first, last = base[1] - base[0], base[-1] - base[-2]
    t = ([base[0] - first * (degree - i) for i in range(degree)] + base
         + [base[-1] + last * (i + 1) for i in range(degree)])
    x = F.least(F.greatest(F.col(column).cast("double"), base[0]), base[-1])
    out = out.withColumn("_x", F.when(F.col(column).isNotNull(), x))
    x = F.col("_x")
    # The right end belongs to the last inner interval, so that the basis is defined on it.
    end = degree + n_knots - 2
    level = {f"_b0_{i}": ((x >= t[i]) & ((x < t[i + 1]) if i != end else (x <= t[i + 1])))
             .cast("double") if i <= end else F.lit(0.0) for i in range(len(t) - 1)}
    out = out.withColumns(level)
    for d in range(1, degree + 1):
        step = {}
        for i in range(len(t) - 1 - d):
            left = F.coalesce(F.try_divide(x - t[i], t[i + d] - t[i]), F.lit(0.0))
            right = F.coalesce(F.try_divide(t[i + d + 1] - x, t[i + d + 1] - t[i + 1]), F.lit(0.0))
            step[f"_b{d}_{i}"] = (left * F.col(f"_b{d - 1}_{i}")
                                  + right * F.col(f"_b{d - 1}_{i + 1}"))
        out = out.withColumns(step)
    size = n_knots + degree - 1
    out = out.withColumns({f"{column}_sp{i}": F.when(x.isNotNull(), F.col(f"_b{degree}_{i}"))
                           for i in range(size)})
    return out.select(*df.columns, *[f"{column}_sp{i}" for i in range(size)])


def column_shapes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable, n, niveaux``: recorded values and distinct values of each column."""
    long = unpivot_values(df, columns)
    return long.groupBy("variable").agg(F.count(F.lit(1)).alias("n"),
                                        F.countDistinct("value").alias("niveaux"))
