"""Behaviour segments: preparation, k-means, stability, profiles and names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.expressions import log1p_nonneg, signed_log1p
from loyaltide.operators import batched_kmeans, metrics
from loyaltide.operators.describe import chi2_from_counts, level_counts, unbiased_skew
from loyaltide.operators.preprocessing import (fit_medians, fit_scaler, impute_median,
                                               standardize)
from loyaltide.operators.ranking import exact_quantiles, unpivot_values
from loyaltide.operators.segments_by_rule import segment_rate_scores
from loyaltide.staging import stage

FEATURES = [*fv.CLUSTER_LOG, *fv.CLUSTER_SIGNED, *fv.CLUSTER_RAW]


@dataclass(frozen=True)
class Preparation:
    """Learned medians and scales (one-row tables)."""

    medians: DataFrame
    scaler: DataFrame


def _logged(df: DataFrame) -> DataFrame:
    return df.withColumns({**{c: log1p_nonneg(c) for c in fv.CLUSTER_LOG},
                           **{c: signed_log1p(c) for c in fv.CLUSTER_SIGNED}})


def fit_preparation(df: DataFrame) -> Preparation:
    """Medians, then scales of the filled and logged columns; target and other columns unread."""
    medians = stage(fit_medians(df, FEATURES), "medians")
    filled = _logged(impute_median(df.select(*FEATURES), medians, FEATURES))
    return Preparation(medians, stage(fit_scaler(filled, FEATURES), "scales"))


def prepare(df: DataFrame, fitted: Preparation, keep: Sequence[str] = ("customer_id",)
            ) -> DataFrame:
    """``keep`` plus the standardised segmentation columns."""
    rows = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return standardize(_logged(impute_median(rows, fitted.medians, FEATURES)), fitted.scaler,
                       FEATURES)


def with_vector(df: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="vector").transform(df)


def fit_kmeans(vectors: DataFrame, k: int = fv.N_CLUSTERS, n_init: int = 10, seed: int = 42,
               max_iter: int = 50, id_col: str = "customer_id") -> batched_kmeans.Clustering:
    """Best of ``n_init`` seeded starts (lowest within-cluster cost), all in the same passes."""
    rows = stage(batched_kmeans.as_rows(vectors, id_col), "kmeans-rows")
    starts = batched_kmeans.draw_starts(rows, [seed + i for i in range(n_init)], k)
    return min(batched_kmeans.fit_runs(rows, list(starts), max_iter), key=lambda r: r.cost)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings corrected for chance, from their contingency counts."""
    def pairs(n: Column) -> Column:
        n = n.cast("double")
        return n * (n - 1) / 2

    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    inner = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), pairs(F.sum("n")).alias("t"))
    out = inner.crossJoin(rows).crossJoin(cols)        # one row each
    chance = F.col("sa") * F.col("sb") / F.col("t")
    top = (F.col("sa") + F.col("sb")) / 2
    return out.select(F.coalesce(F.try_divide(F.col("s") - chance, top - chance), F.lit(1.0))
                      .alias("ari"))


def davies_bouldin(df: DataFrame, columns: Sequence[str], label: str = "segment_id") -> DataFrame:
    """Mean over clusters of the worst ratio of scatters to centre distance.

    Rows meet only their own centre; the pairs are k x k.
    """
    centres = df.groupBy(label).agg(*[F.avg(c).alias(f"c_{c}") for c in columns])
    rows = df.join(F.broadcast(centres), label)        # one row per cluster
    distance = F.sqrt(sum(((F.col(c) - F.col(f"c_{c}")) ** 2 for c in columns), F.lit(0.0)))
    scatter = rows.groupBy(label).agg(F.avg(distance).alias("s"))
    table = centres.join(scatter, label)
    left = table.select(F.col(label).alias("i"), F.col("s").alias("si"),
                        *[F.col(f"c_{c}").alias(f"i_{c}") for c in columns])
    right = table.select(F.col(label).alias("j"), F.col("s").alias("sj"),
                         *[F.col(f"c_{c}").alias(f"j_{c}") for c in columns])
    gap = F.sqrt(sum(((F.col(f"i_{c}") - F.col(f"j_{c}")) ** 2 for c in columns), F.lit(0.0)))
    pairs = left.join(F.broadcast(right), F.col("i") != F.col("j"))    # k x k rows
    return (pairs.groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / gap).alias("r"))
            .agg(F.avg("r").alias("davies_bouldin")))


def evaluate_k(vectors: DataFrame, ks: Sequence[int], seeds: Sequence[int] = (0, 1, 2, 3, 4),
               n_init: int = 10, max_iter: int = 50, id_col: str = "customer_id") -> DataFrame:
    """One row per k: cost, silhouette (all rows), Davies-Bouldin, stability over seeds, smallest
    cluster.

    Every k has one fit and one per seed, each the best of ``n_init`` starts.  All of these runs
    share their passes: ``max(ks)`` to draw the starts, at most ``max_iter`` to move the centres,
    and a few to measure what came out.
    """
    rows = stage(batched_kmeans.as_rows(vectors, id_col), "kmeans-rows")
    drawn = [s + i for s in (42, *[1000 * (s + 1) for s in seeds]) for i in range(n_init)]
    starts = batched_kmeans.draw_starts(rows, drawn, max(ks))
    runs = batched_kmeans.fit_runs(rows, [c[:k] for k in ks for c in starts], max_iter)
    fits = [min(runs[i:i + n_init], key=lambda r: r.cost) for i in range(0, len(runs), n_init)]
    labelled = stage(batched_kmeans.label_rows(rows, fits), "kmeans-labels")
    per_k = 1 + len(seeds)
    mains = list(range(0, len(fits), per_k))
    spread = batched_kmeans.spread_of(labelled, mains, [fits[i].sizes for i in mains])
    pairs = [(i + a, i + b) for i in mains for a, b in combinations(range(1, per_k), 2)]
    aris = batched_kmeans.agreement(labelled, pairs) if pairs else {}
    out = []
    for k, i, measures in zip(ks, mains, spread, strict=True):
        of_k = [aris[i + a, i + b] for a, b in combinations(range(1, per_k), 2)]
        sizes = fits[i].sizes
        out.append((k, fits[i].cost, measures["silhouette"], measures["davies_bouldin"],
                    sum(of_k) / len(of_k) if of_k else None, min(of_k, default=None),
                    round(100 * float(sizes.min() / sizes.sum()), 1)))
    return vectors.sparkSession.createDataFrame(
        out, "k int, inertie double, silhouette double, davies_bouldin double, "
             "ari_moyen double, ari_min double, plus_petit_cluster_pct double")


def cluster_profiles(df: DataFrame, label: str = "segment_id",
                     columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Median of the original columns per cluster, size and share."""
    medians = exact_quantiles(df, columns, [0.5], [label])
    wide = medians.groupBy(label).agg(*[
        F.max(F.when(F.col("variable") == c, F.col("q0"))).alias(c) for c in columns])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("part_pct", F.bround(
        100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))
    return sizes.join(wide, label)


def cluster_zscores(prepared: DataFrame, label: str = "segment_id",
                    columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    return prepared.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])


def name_clusters(profiles: DataFrame, label: str = "segment_id", strict: bool = True
                  ) -> DataFrame:
    """Names from the median profiles: longest tenure, lowest plan, the two heaviest of the rest by
    the sign of their usage change, and the remaining one.  ``strict`` rejects ambiguous results."""
    whole = Window.partitionBy()                       # five rows
    tenured = F.row_number().over(Window.orderBy(F.desc("months"), label)) == 1
    secondary = F.row_number().over(Window.orderBy("totmrc_Mean", label)) == 1
    rows = profiles.withColumns({"_tenured": tenured, "_secondary": secondary})
    rest = ~F.col("_tenured") & ~F.col("_secondary")
    heavy = F.row_number().over(Window.orderBy(rest.desc(), F.desc("mou_Mean"), label)) <= 2
    rows = rows.withColumn("_heavy", rest & heavy)
    # The last rule to apply wins when one cluster is both longest and cheapest.
    named = rows.withColumn("segment", F.when(F.col("_secondary"), fv.NAME_SECONDARY_LINES)
                            .when(F.col("_tenured"), fv.NAME_TENURED_OLD_DEVICE)
                            .when(F.col("_heavy") & (F.col("change_mou") < 0),
                                  fv.NAME_HEAVY_DECLINING)
                            .when(F.col("_heavy"), fv.NAME_HEAVY_GROWING)
                            .otherwise(fv.NAME_MODERATE_RECENT))
    named = named.withColumn("distincts", F.size(F.collect_set("segment").over(whole)))
    out = named.select(label, "segment", "distincts")
    if strict:
        found = out.agg(F.count(F.lit(1)).alias("k"), F.max("distincts").alias("d")).first()
        if found["k"] != fv.N_CLUSTERS or found["d"] != fv.N_CLUSTERS:
            raise ValueError(f"ambiguous naming: {found['d']} names for {found['k']} clusters")
    return out.select(label, "segment")


def assign_segments(vectors: DataFrame, model: batched_kmeans.Clustering, names: DataFrame
                    ) -> DataFrame:
    """Cluster id and name per row; names are one row per cluster."""
    return model.transform(vectors).join(F.broadcast(names), "segment_id")


def segment_auc_cv(df: DataFrame, segment: str, target: str = "churn", fold: str = "fold"
                   ) -> DataFrame:
    """Mean and population deviation over folds of the AUC of the out-of-fold segment rate."""
    scored = segment_rate_scores(df.select("customer_id", target, fold, F.coalesce(
        F.col(segment).cast("string"), F.lit("None")).alias(segment)), segment, target, fold,
        score="_score")
    return metrics.roc_auc(scored, "_score", target, [fold]).agg(
        F.avg("roc_auc").alias("auc_moyenne"), F.stddev_pop("roc_auc").alias("auc_ecart_type"))


def compare_segmentations(df: DataFrame, labels: Sequence[str], target: str = "churn",
                          min_n: int = 200) -> DataFrame:
    """Per labeling: number of segments, extreme rates, gap, Cramer's V and out-of-fold AUC."""
    counts = level_counts(df, labels, target)
    rate = F.when(F.col("n") >= min_n, 100 * F.col("pos") / F.col("n"))
    table = counts.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_segments"), F.min(rate).alias("taux_min"),
        F.max(rate).alias("taux_max"), (F.max(rate) - F.min(rate)).alias("ecart_pts"))
    aucs = None
    for label in labels:
        one = segment_auc_cv(df, label, target).withColumn("variable", F.lit(label))
        aucs = one if aucs is None else aucs.unionByName(one)
    return (table.join(chi2_from_counts(counts).select("variable", "cramers_v"), "variable")
            .join(aucs, "variable"))


def skew_before_after(df: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Skewness of each column before and after the log transforms."""
    def skews(rows: DataFrame, name: str) -> DataFrame:
        return unpivot_values(rows, columns).groupBy("variable").agg(
            unbiased_skew(F.skewness("value"), F.count("value")).alias(name))
    return skews(df, "avant").join(skews(_logged(df.select(*columns)), "apres"), "variable")


def projection(vectors: DataFrame, id_col: str = "customer_id") -> tuple[DataFrame, list[float]]:
    """Every row on the two principal components of all rows, and the explained variances."""
    model = PCA(k=2, inputCol="vector", outputCol="pc").fit(vectors)
    xy = vector_to_array("pc")
    points = model.transform(vectors).select(id_col, xy[0].alias("x"), xy[1].alias("y"))
    return points, [float(v) for v in model.explainedVariance]
