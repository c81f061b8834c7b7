"""Isotonic regression by pooling adjacent violators, range by range and then up a tree.

Rows collapse to distinct scores with their weight and sum.  Every range of scores is pooled in its
task: a stack of blocks with ascending means.  Neighbouring stacks are merged by pooling their blocks
once more, a few stacks at a time, until one is left; what meets in a task are pooled blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyaltide.operators.ranking import running_totals
from loyaltide.staging import stage

FAN = 16                       # stacks merged together
BLOCK = "part int, low double, high double, w double, s double"


def pooled(low: np.ndarray, high: np.ndarray, w: np.ndarray, s: np.ndarray) -> list[tuple]:
    """Blocks ``(low, high, weight, sum)`` with ascending means, of blocks in ascending order."""
    stack: list[tuple[float, float, float, float]] = []
    for block in zip(low.tolist(), high.tolist(), w.tolist(), s.tolist(), strict=True):
        # Means are compared by products: equal ones are one block.
        while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
            before = stack.pop()
            block = (before[0], block[1], before[2] + block[2], before[3] + block[3])
        stack.append(block)
    return stack


def _pool(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of one partition; the stack of a batch goes before the rows of the next one."""
    stack, part = [], None
    for batch in parts:
        if len(batch):
            part = int(batch["part"].iloc[0])
            held = pd.DataFrame(stack, columns=["low", "high", "w", "s"])
            rows = pd.concat([held, batch[["low", "high", "w", "s"]]]) if stack else batch
            stack = pooled(*(rows[c].to_numpy(np.float64) for c in ("low", "high", "w", "s")))
    if stack:
        yield pd.DataFrame(stack, columns=["low", "high", "w", "s"]).assign(part=part)[
            ["part", "low", "high", "w", "s"]]


def isotonic_blocks(df: DataFrame, score: str, target: str, weight: str | None = None) -> DataFrame:
    """``low, high, w, value``: the blocks of scores with one fitted value, ascending.

    Rows without a score or target take no part; without any other row there are no blocks.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    counts = (df.select(F.col(score).cast("double").alias("x"), F.col(target).cast("double").alias("y"),
                        w.alias("w")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x)")
              .groupBy((F.col("x") + F.lit(0.0)).alias("x"))
              .agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s")))
    ranged = (counts.repartitionByRange("x").sortWithinPartitions("x")
              .select(F.spark_partition_id().alias("part"), F.col("x").alias("low"),
                      F.col("x").alias("high"), "w", "s"))
    blocks = stage(ranged.mapInPandas(_pool, BLOCK), "isotonic-blocks")
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("low")
            part = int(pdf["part"].iloc[0]) // FAN
            return next(_pool(iter([pdf]))).assign(part=part)

        blocks = stage(blocks.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merge, BLOCK),
                       "isotonic-blocks")
        parts = -(-parts // FAN)
    return blocks.select("low", "high", "w", (F.col("s") / F.col("w")).alias("value"))


@dataclass
class IsotonicMap:
    """Fitted blocks as a map of scores: constant within a block, a straight line between two, and
    the outermost values beyond them."""

    blocks: DataFrame

    def apply(self, df: DataFrame, score: str, name: str) -> DataFrame:
        """Add the fitted value of each row's score; null for a null score.

        Scores and block ends are put in one order; the running number of ends before a score says
        between which two it lies, and those are looked up by number.
        """
        ends = (self.blocks.select(F.inline(F.array(*[F.struct(
            F.col(c).alias("x"), F.col("value").alias("v"), F.lit(i).alias("side"))
            for i, c in enumerate(("low", "high"))]))))
        asked = df.select(F.col(score).cast("double").alias("x")).filter("x IS NOT NULL").distinct()
        both = (ends.select("x", "v", "side", F.lit(1).alias("end"))
                .unionByName(asked.select("x", F.lit(None).cast("double").alias("v"),
                                          F.lit(2).alias("side"), F.lit(0).alias("end"))))
        placed = stage(running_totals(both, ["x", "side"], {"k": F.col("end").cast("bigint")}),
                       "isotonic-order")
        numbered = placed.filter("end = 1").select(F.col("k_cum").alias("k"), F.col("x").alias("ex"),
                                                   F.col("v").alias("ev"))
        before = numbered.select("k", F.col("ex").alias("x0"), F.col("ev").alias("v0"))
        after = numbered.select((F.col("k") - 1).alias("k"), F.col("ex").alias("x1"),
                                F.col("ev").alias("v1"))
        found = (placed.filter("end = 0").select("x", F.col("k_cum").alias("k"))
                 .join(before, "k", "left").join(after, "k", "left"))
        line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("x") - F.col("x0")) / (
            F.col("x1") - F.col("x0"))
        value = (F.when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull(), F.col("v0"))
                 .when(F.col("x") == F.col("x0"), F.col("v0")).otherwise(line))
        known = found.select(F.col("x").alias("_x"), value.alias(name))
        return (df.join(known, F.col(score).cast("double") == F.col("_x"), "left").drop("_x"))
