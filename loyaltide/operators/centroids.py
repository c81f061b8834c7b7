"""Nearest-centroid assignment with column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardised(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """z-scores (population deviation); a constant column becomes 0."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns
                     for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return (df.crossJoin(F.broadcast(stats))          # one row
            .select(*df.columns, *[
                F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")),
                           F.when(F.col(c).isNotNull(), 0.0)).alias(f"{prefix}{c}")
                for c in columns]))


def nearest_centroid(df: DataFrame, columns: Sequence[str], centroids: DataFrame,
                     name: str = "segment_id") -> DataFrame:
    """Add the id of the closest centroid (ties: lowest id).

    ``centroids`` has one row per cluster: ``segment_id`` and the same columns.  The k rows travel
    as one array, so the rows are neither multiplied nor shuffled.
    """
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct(
        "segment_id", F.array(*[F.col(c).cast("double") for c in columns]).alias("at"))))
        .alias("_centroids"))
    point = [F.col(c).cast("double") for c in columns]

    def distance(c):
        total = F.lit(0.0)
        for i, x in enumerate(point):
            total = total + (x - c["at"][i]) * (x - c["at"][i])
        return F.struct(total.alias("d"), c["segment_id"].alias("id"))

    return (df.crossJoin(F.broadcast(packed))          # one row
            .withColumn(name, F.array_min(F.transform("_centroids", distance))["id"])
            .drop("_centroids"))
