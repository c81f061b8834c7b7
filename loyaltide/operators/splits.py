"""Seeded, stratified splits and folds: same rows on every run, on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import seeded_hash
from loyaltide.operators.ranking import row_numbers


def _class_positions(df: DataFrame, target: str, id_col: str, seed: int) -> DataFrame:
    """``_rn`` of ``_rn_n``: position in the seeded hash order of the row's class."""
    keyed = df.withColumn("_hash", seeded_hash(id_col, seed))
    return row_numbers(keyed, ["_hash", id_col], by=[target], name="_rn").drop("_hash")


def split_train_test(df: DataFrame, test_size: float = 0.2, target: str = "churn",
                     id_col: str = "customer_id", seed: int = 42,
                     name: str = "partition") -> DataFrame:
    """Add the partition: the first ``test_size`` of each class in hash order is the test part."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie strictly between 0 and 1")
    ranked = _class_positions(df, target, id_col, seed)
    return (ranked.withColumn(name, F.when(
        F.col("_rn") <= F.round(F.lit(test_size) * F.col("_rn_n")), fv.TEST)
        .otherwise(fv.TRAIN_OOF)).drop("_rn", "_rn_n"))


def make_folds(df: DataFrame, k: int = 5, target: str = "churn", id_col: str = "customer_id",
               seed: int = 0, name: str = "fold") -> DataFrame:
    """Add a frozen stratified fold number, shared by every comparison."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    ranked = _class_positions(df, target, id_col, seed)
    return ranked.withColumn(name, F.pmod(F.col("_rn"), F.lit(k)).cast("int")).drop("_rn", "_rn_n")


def split_summary(df: DataFrame, target: str = "churn", id_col: str = "customer_id",
                  partition: str = "partition") -> DataFrame:
    """Size, target rate and share of each part, and how many ids sit in more than one part."""
    parts = df.groupBy(partition).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("taux"))
    spread = (df.groupBy(id_col).agg(F.countDistinct(partition).alias("k"))
              .agg(F.count_if(F.col("k") > 1).alias("ids_communs")))
    total = parts.agg(F.sum("n").alias("_all"))
    return (parts.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(spread))  # one row each
            .select(partition, "n", "taux", (F.col("n") / F.col("_all")).alias("part"),
                    "ids_communs"))
