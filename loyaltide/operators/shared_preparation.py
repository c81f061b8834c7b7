"""What many overlapping training sets teach about their columns, learned in the same passes.

Rows carry a cell (a fold, or a pair of outer and inner fold), and every training set is all cells but
a few.  Counts, sums and moments are taken once per value and cell; those of a training set are the
totals less the cells left out.  So five folds, or thirty nested ones, cost the jobs of one.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyaltide.operators.describe import unpivot_levels
from loyaltide.operators.ranking import running_totals, unpivot_values
from loyaltide.functions.expressions import MISSING
from loyaltide.staging import stage


@dataclass(frozen=True)
class Learned:
    """One training set: rows, and per column its facts.

    ``recorded``, ``total`` and ``only_01`` are keyed by numeric column; ``quantiles`` and ``scale``
    (mean and population deviation) by those with a value; ``levels`` (``variable, niveau, code,
    slot``) is a table, ``slots`` its number of frequent levels per column.
    """

    n: int
    recorded: Mapping[str, int]
    total: Mapping[str, float]
    only_01: Mapping[str, bool]
    quantiles: Mapping[str, tuple[float, ...]]
    scale: Mapping[str, tuple[float, float]]
    levels: DataFrame | None
    slots: Mapping[str, int]


@dataclass(frozen=True)
class Wanted:
    """What to learn: columns, quantiles, and how scales and frequent levels are defined.

    ``clip``: positions in ``probs`` of the bounds to which values are clipped before the scale.
    ``fill``: nulls count as the median in the scale.  Levels are frequent from ``share`` of the
    rows, or from ``count`` rows.
    """

    numeric: Sequence[str]
    categories: Sequence[str]
    probs: Sequence[float]
    median: int
    clip: tuple[int, int] | None = None
    fill: bool = False
    share: float | None = None
    count: int | None = None


def learn(rows: DataFrame, cell: str, left_out: Mapping[int, Collection[int]], wanted: Wanted
          ) -> dict[int, Learned]:
    """What each training set (all cells but those named) teaches, by its number in ``left_out``.

    ``cell`` is a column of few integers without nulls.  What reaches the driver is one line per
    cell, per column and training set, and never per value or level.
    """
    facts = _facts(rows, cell, wanted.numeric)
    cells = sorted(facts)
    kept = {p: [i for i, c in enumerate(cells) if c not in out] for p, out in left_out.items()}
    n = {p: sum(facts[cells[i]]["n"] for i in at) for p, at in kept.items()}
    counts = (stage(unpivot_values(rows, wanted.numeric, [cell]).groupBy("variable", "value")
                    .agg(*_per_cell(cell, cells)), "value-counts") if wanted.numeric else None)
    quantiles = _quantiles(counts, kept, len(cells), wanted.probs) if wanted.numeric else {}
    recorded = {p: {c: sum(facts[cells[i]][f"{c}_n"] for i in at) for c in wanted.numeric}
                for p, at in kept.items()}
    scale = _scales(counts, kept, quantiles, wanted, n, recorded) if wanted.numeric else {}
    levels, slots = _levels(rows, cell, cells, kept, n, wanted)
    return {p: Learned(
        n[p], recorded[p],
        {c: sum(facts[cells[i]][f"{c}_sum"] or 0.0 for i in at) for c in wanted.numeric},
        {c: all(facts[cells[i]][f"{c}_01"] for i in at) for c in wanted.numeric},
        {c: q for (v, c), q in quantiles.items() if v == p},
        {c: s for (v, c), s in scale.items() if v == p},
        levels.filter(F.col("plan") == p).drop("plan") if levels is not None else None,
        {c: slots.get((p, c), 0) for c in wanted.categories}) for p, at in kept.items()}


def _per_cell(cell: str, cells: Sequence[int]) -> list[Column]:
    return [F.count_if(F.col(cell) == c).alias(f"n{i}") for i, c in enumerate(cells)]


def _facts(rows: DataFrame, cell: str, numeric: Sequence[str]) -> dict[int, dict]:
    """Per cell: rows, and per column its values, their sum and whether all are 0 or 1."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in numeric:
        aggs += [F.count(c).alias(f"{c}_n"), F.sum(F.col(c).cast("double")).alias(f"{c}_sum"),
                 F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)).alias(f"{c}_01")]
    return {r[cell]: r.asDict() for r in rows.groupBy(cell).agg(*aggs).collect()}


def _sum(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0]) if columns else F.lit(0).cast("bigint")


def _per_plan(kept: Mapping[int, Sequence[int]], **parts: str) -> Column:
    """One struct per training set: its number, and the sums over its cells of ``<name><i>``."""
    return F.array(*[F.struct(F.lit(p).alias("plan"), *[
        _sum([F.col(pattern.format(i)) for i in at]).alias(name) for name, pattern in parts.items()])
        for p, at in kept.items()])


def _quantiles(counts: DataFrame, kept: Mapping[int, Sequence[int]], cells: int,
               probs: Sequence[float]) -> dict[tuple[int, str], tuple[float, ...]]:
    """Linear-interpolation quantiles by (training set, column), from one running count."""
    ranked = running_totals(counts, ["value"], {f"c{i}": F.col(f"n{i}") for i in range(cells)},
                            ["variable"])
    each = ranked.select("variable", "value", F.inline(_per_plan(kept, upto="c{}_cum",
                                                                 whole="c{}_all")))
    aggs = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("whole") - 1)
        aggs += [F.min(F.when(F.col("upto") > F.floor(at), F.col("value"))).alias(f"low{i}"),
                 F.min(F.when(F.col("upto") > F.ceil(at), F.col("value"))).alias(f"high{i}")]
    picked = (each.filter("whole > 0").groupBy("variable", "plan")
              .agg(F.max("whole").alias("whole"), *aggs))
    values = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("whole") - 1)
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        values.append((low + (high - low) * (at - F.floor(at))).alias(f"q{i}"))
    return {(r[1], r[0]): tuple(r[2:]) for r in picked.select("variable", "plan", *values).collect()}


def _scales(counts: DataFrame, kept: Mapping[int, Sequence[int]],
            quantiles: Mapping[tuple[int, str], tuple[float, ...]], wanted: Wanted,
            n: Mapping[int, int], recorded: Mapping[int, Mapping[str, int]]
            ) -> dict[tuple[int, str], tuple[float, float]]:
    """Mean and population deviation by (training set, column), from the counts of values.

    Sums are of distances from the median, so that large values with a small spread lose nothing.
    """
    if not quantiles:
        return {}
    lines = [(p, c, q[wanted.median], *((q[wanted.clip[0]], q[wanted.clip[1]]) if wanted.clip
                                        else (None, None))) for (p, c), q in quantiles.items()]
    known = counts.sparkSession.createDataFrame(
        lines, "plan int, variable string, middle double, low double, high double")
    each = counts.select("variable", "value", F.inline(_per_plan(kept, n="n{}")))
    value = F.when(F.col("low") < F.col("high"), F.least(F.greatest("value", "low"), F.col("high"))
                   ).otherwise(F.col("value"))
    gap = value - F.col("middle")
    sums = (each.join(F.broadcast(known), ["plan", "variable"])       # a line per column and plan
            .groupBy("plan", "variable").agg(F.sum(F.col("n") * gap).alias("s"),
                                             F.sum(F.col("n") * gap * gap).alias("ss")))
    out = {}
    for r in sums.collect():
        p, c = r["plan"], r["variable"]
        size = n[p] if wanted.fill else recorded[p][c]
        mean = r["s"] / size
        out[p, c] = (quantiles[p, c][wanted.median] + mean, max(r["ss"] / size - mean ** 2, 0) ** 0.5)
    return out


def _levels(rows: DataFrame, cell: str, cells: Sequence[int], kept: Mapping[int, Sequence[int]],
            n: Mapping[int, int], wanted: Wanted
            ) -> tuple[DataFrame | None, dict[tuple[int, str], int]]:
    """``plan, variable, niveau, code, slot``: position among all levels in text order (the missing
    one last) and, of frequent ones, among those; and the number of frequent ones.

    Numbers are distributed running counts, so a column may have any number of levels.
    """
    if not wanted.categories:
        return None, {}
    counts = (unpivot_levels(rows, wanted.categories, [cell]).groupBy("variable", "niveau")
              .agg(*_per_cell(cell, cells)))
    each = counts.select("variable", "niveau", F.inline(_per_plan(kept, n="n{}"))).filter("n > 0")
    enough = F.lit(True)
    if wanted.share is not None:
        whole = F.create_map(*[F.lit(x) for item in n.items() for x in item])
        enough = F.col("n") / whole[F.col("plan")] >= wanted.share
    if wanted.count is not None:
        enough = enough & (F.col("n") >= wanted.count)
    ready = each.select("plan", "variable", "niveau", (F.col("niveau") == MISSING).alias("last"),
                        enough.alias("frequent"))
    numbered = running_totals(ready, ["last", "niveau"], {
        "level": F.lit(1).cast("bigint"), "often": F.col("frequent").cast("bigint")},
        ["plan", "variable"])
    table = stage(numbered.select("plan", "variable", "niveau", "often_all",
                                  (F.col("level_cum") - 1).alias("code"),
                                  F.when(F.col("frequent"), F.col("often_cum") - 1).alias("slot")),
                  "levels")
    sizes = table.groupBy("plan", "variable").agg(F.max("often_all").alias("n")).collect()
    return table.drop("often_all"), {(r["plan"], r["variable"]): r["n"] for r in sizes}
