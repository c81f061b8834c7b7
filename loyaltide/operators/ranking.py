"""Global order statistics without a single-partition sort.

Everything that needs a total order over all rows (cumulative weights, row numbers, average ranks,
exact quantiles, AUC) is built on :func:`running_totals`:

1. range-partition the rows on the order columns and write them with their partition number, so
   that the ranges are frozen;
2. sum each partition (one small row per partition), take the exclusive running sum of those rows;
3. add that offset to a window confined to one partition.

Only the per-partition sums ever meet in one task.  Ties are spread over partitions because the
order columns end with a unique key, so one hot score or one hot group never lands in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide.staging import stage

_BUCKET = "_bucket"


def _ordering(order: Sequence[str | tuple[str, str]]) -> list[Column]:
    out = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        column = F.col(name)
        out.append(column.desc_nulls_last() if direction == "desc" else column.asc_nulls_last())
    return out


def running_totals(df: DataFrame, order: Sequence[str | tuple[str, str]],
                   values: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Add ``<name>_cum`` (inclusive running sum) and ``<name>_all`` (group total) per value.

    Args:
        df: rows; prune the columns first, they are written once.
        order: columns of the total order, ``"c"`` or ``("c", "desc")``; end with a unique key.
        values: name -> numeric expression to accumulate.
        by: groups within which sums restart; a group may span any number of partitions.
    """
    by = list(by)
    ordering = _ordering(order)
    valued = df.select("*", *[c.alias(f"_v_{n}") for n, c in values.items()])
    ranged = valued.repartitionByRange(*[F.col(c) for c in by], *ordering)
    staged = stage(ranged.withColumn(_BUCKET, F.spark_partition_id()), "ranges")

    sums = staged.groupBy(*by, _BUCKET).agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    group = Window.partitionBy(*by)
    before = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col(_BUCKET).alias("_k_bucket"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
        *[F.sum(f"_s_{n}").over(group).alias(f"{n}_all") for n in values])
    match = F.col(_BUCKET) == F.col("_k_bucket")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    local = (Window.partitionBy(*by, _BUCKET).orderBy(*ordering)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (staged.join(offsets, match)
            .select(*df.columns,
                    *[(F.sum(f"_v_{n}").over(local) + F.col(f"_o_{n}")).alias(f"{n}_cum")
                      for n in values],
                    *[F.col(f"{n}_all") for n in values]))


def row_numbers(df: DataFrame, order: Sequence[str | tuple[str, str]], by: Sequence[str] = (),
                name: str = "rn") -> DataFrame:
    """1-based position in a total order, plus ``<name>_n`` the size of the group."""
    out = running_totals(df, order, {"_one": F.lit(1).cast("bigint")}, by)
    return (out.withColumnRenamed("_one_cum", name).withColumnRenamed("_one_all", f"{name}_n"))


def unpivot_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
                   drop_nulls: bool = True) -> DataFrame:
    """Long form ``keep..., variable, value`` (double), one map-side pass, no job per column."""
    long = df.unpivot([F.col(c) for c in keep],
                      [F.col(c).cast("double").alias(c) for c in columns], "variable", "value")
    return long.filter(F.col("value").isNotNull()) if drop_nulls else long


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles of many columns: ``by..., variable, n, q0, q1, ...``.

    Rows are first collapsed to distinct values (map-side combine), then positions come from the
    running count, so a continuous column of any size is never held by one task.
    """
    long = unpivot_values(df, columns, by)
    counts = long.groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, ["value"], {"n": F.col("n")}, [*by, "variable"])
    exprs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n_all") - 1)
        exprs += [F.min(F.when(F.col("n_cum") > F.floor(pos), F.col("value"))).alias(f"_lo{i}"),
                  F.min(F.when(F.col("n_cum") > F.ceil(pos), F.col("value"))).alias(f"_hi{i}")]
    picked = ranked.groupBy(*by, "variable").agg(F.max("n_all").alias("n"), *exprs)
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(f"q{i}"))
    return picked.select(*by, "variable", "n", *out)


def quantile_row(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                 names: Sequence[str]) -> DataFrame:
    """The same quantiles as one wide row: columns ``<column>_<name>``."""
    table = exact_quantiles(df, columns, probs)
    return table.agg(*[
        F.max(F.when(F.col("variable") == c, F.col(f"q{i}"))).alias(f"{c}_{name}")
        for c in columns for i, name in enumerate(names)])


def value_ranks(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                sums: Mapping[str, Column] | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value: ``by..., variable, value, n, avg_rank, n_all`` (+ sums).

    Average ranks need only the running count over distinct values, so heavy ties shrink the work.
    """
    long = unpivot_values(df, columns, [*by, *keep])
    counts = long.groupBy(*by, "variable", "value").agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (sums or {}).items()])
    ranked = running_totals(counts, ["value"], {"n": F.col("n")}, [*by, "variable"])
    return ranked.withColumn("avg_rank",
                             F.col("n_cum") - F.col("n") + (F.col("n") + 1) / F.lit(2.0))
