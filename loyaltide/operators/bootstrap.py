"""Bootstrap of the AUC: rows are ordered once, replicates never multiply the shuffled rows.

Each row draws an independent Poisson(1) weight per replicate from a hash of its id, so the draws do
not depend on partitioning and are the same for every score compared.  Rows are range-partitioned by
score; a task reads its sorted rows in batches and returns, per replicate, the weighted counts and
the area inside its range.  A score that spans several ranges is returned apart, so that ties still
count half.  Only ranges x replicates small rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyaltide.operators.metrics import roc_auc
from loyaltide.staging import stage

ID = "customer_id"


def _range_areas(n_boot: int):
    """Task function: sorted ``score, y, h`` rows -> segments ``replicate, s, edge, pos, neg, area``.

    ``edge`` 0 and 2 are the first and last score of the range, 1 what lies between.
    """
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        thresholds, p, total = [], np.exp(-1.0), 0.0
        for k in range(12):
            total += p
            thresholds.append(total)
            p /= k + 1
        steps = (np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]

        def weights(h: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                z = h.astype(np.uint64)[:, None] + steps
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                z = z ^ (z >> np.uint64(31))
            return np.searchsorted(thresholds, (z >> np.uint64(11)) / float(1 << 53), side="right")

        zero = np.zeros(n_boot)
        first = None                                   # (score, pos, neg) of the first score
        opened = None                                  # the score still being read
        pos, neg, area = zero.copy(), zero.copy(), zero.copy()   # strictly between the edges

        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.iloc[start:start + 2000]
                w = weights(part["h"].to_numpy())
                y = part["y"].to_numpy().astype(float)[:, None]
                s = part["score"].to_numpy()
                cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                up = np.add.reduceat(w * y, cut, axis=0)
                down = np.add.reduceat(w * (1 - y), cut, axis=0)
                for value, u, d in zip(s[cut], up, down, strict=True):
                    if opened is not None and value == opened[0]:
                        opened = (value, opened[1] + u, opened[2] + d)
                        continue
                    if opened is not None:
                        if first is None:
                            first = opened
                        else:
                            area += opened[1] * (neg + opened[2] / 2)
                            pos, neg = pos + opened[1], neg + opened[2]
                    opened = (value, u, d)
        if opened is None:
            return
        replicate = np.arange(1, n_boot + 1)
        if first is not None:
            middle = {"replicate": replicate, "s": first[0], "edge": 1, "pos": pos, "neg": neg,
                      "area": area}
            edges = [(0, first), (2, opened)]
            yield pd.DataFrame(middle)
        else:
            edges = [(0, opened)]
        for edge, (value, u, d) in edges:
            yield pd.DataFrame({"replicate": replicate, "s": value, "edge": edge, "pos": u,
                                "neg": d, "area": zero})

    return run


def bootstrap_auc(df: DataFrame, scores: Sequence[str], n_boot: int = 1000, seed: int = 42,
                  target: str = "churn", id_col: str = ID) -> DataFrame:
    """AUC of each score in each replicate: ``replicate, score, roc_auc``; one-class draws absent."""
    out = None
    for name in scores:
        rows = df.select(F.col(name).cast("double").alias("score"),
                         F.col(target).cast("int").alias("y"),
                         F.xxhash64(id_col, F.lit(seed)).alias("h"), F.col(id_col).alias("_id"))
        ordered = rows.repartitionByRange("score", "_id").sortWithinPartitions("score").select(
            "score", "y", "h")
        pieces = stage(ordered.mapInPandas(
            _range_areas(n_boot), "replicate int, s double, edge int, pos double, neg double, "
            "area double"), "bootstrap")
        # Edges of neighbouring ranges with the same score are one score again.
        single = (F.col("edge") != 1).cast("int")
        merged = pieces.groupBy("replicate", "s", single.alias("single")).agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("area").alias("area"))
        # A middle carries its range's first score and follows it.
        below = (Window.partitionBy("replicate").orderBy("s", F.desc("single"))
                 .rowsBetween(Window.unboundedPreceding, -1))
        placed = merged.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
        inner = F.when(F.col("single") == 1, F.col("pos") * F.col("neg") / 2).otherwise(
            F.col("area"))
        aucs = placed.groupBy("replicate").agg(F.try_divide(
            F.sum(F.col("pos") * F.col("below") + inner), F.sum("pos") * F.sum("neg"))
            .alias("roc_auc")).filter(F.col("roc_auc").isNotNull())
        part = aucs.select("replicate", F.lit(name).alias("score"), "roc_auc")
        out = part if out is None else out.unionByName(part)
    return out


def bootstrap_auc_ci(df: DataFrame, score: str, n_boot: int = 1000, alpha: float = 0.05,
                     seed: int = 42, target: str = "churn", id_col: str = ID) -> DataFrame:
    """AUC with its percentile interval and standard error."""
    draws = bootstrap_auc(df, [score], n_boot, seed, target, id_col)
    spread = draws.agg(                                     # at most n_boot rows
        F.percentile("roc_auc", alpha / 2).alias("ic_bas"),
        F.percentile("roc_auc", 1 - alpha / 2).alias("ic_haut"),
        F.stddev_samp("roc_auc").alias("erreur_type"), F.count(F.lit(1)).alias("n_tirages"))
    return roc_auc(df, score, target).withColumnRenamed("roc_auc", "auc").crossJoin(spread)


def bootstrap_auc_difference(df: DataFrame, score_a: str, score_b: str, n_boot: int = 1000,
                             alpha: float = 0.05, seed: int = 42, target: str = "churn",
                             id_col: str = ID) -> DataFrame:
    """Paired AUC difference A - B over the same resamples."""
    draws = bootstrap_auc(df, [score_a, score_b], n_boot, seed, target, id_col)
    pairs = draws.groupBy("replicate").agg(
        (F.max(F.when(F.col("score") == score_a, F.col("roc_auc")))
         - F.max(F.when(F.col("score") == score_b, F.col("roc_auc")))).alias("d"))
    spread = pairs.agg(F.percentile("d", alpha / 2).alias("ic_bas"),
                       F.percentile("d", 1 - alpha / 2).alias("ic_haut"),
                       F.avg((F.col("d") > 0).cast("double")).alias("part_positive"))
    a = roc_auc(df, score_a, target).withColumnRenamed("roc_auc", "a")
    b = roc_auc(df, score_b, target).withColumnRenamed("roc_auc", "b")
    return (a.crossJoin(b).crossJoin(spread)                # one row each
            .select((F.col("a") - F.col("b")).alias("difference"), "ic_bas", "ic_haut",
                    "part_positive"))
