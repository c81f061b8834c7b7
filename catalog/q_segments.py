"""Behaviour segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base_sql import BASE, STORE
from catalog.q_metrics import auc_sql
from catalog.q_quality import long_sql
from catalog.registry import query, rounded, sql
from loyaltide import fixed_values as fv
from loyaltide.operators import centroids, segmentation as seg
from loyaltide.plans.score_table import SEGMENT_AXES, load_store
from loyaltide.sources.customer_base import load_customer_base as base
from loyaltide.staging import stage

_LOG = {**{c: f"CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest({c}, 0)) END" for c in fv.CLUSTER_LOG},
        **{c: f"sign({c}) * ln(1 + abs({c}))" for c in fv.CLUSTER_SIGNED}}
PREP = BASE + ", pf AS (SELECT customer_id, churn, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT CAST(median({c}) AS DOUBLE) FROM cust)) AS {c}" for c in seg.FEATURES) \
    + " FROM cust), pl AS (SELECT customer_id, churn, " + ", ".join(f"{_LOG.get(c, c)} AS {c}" for c in seg.FEATURES) \
    + " FROM pf), pz AS (SELECT customer_id, churn, " + ", ".join(
        f"({c} - (SELECT avg({c}) FROM pl)) / (SELECT stddev_pop({c}) FROM pl) AS {c}" for c in seg.FEATURES) + " FROM pl)"
_F = " ".join(seg.FEATURES)


@query("i01_segmentation_prepare", sql(PREP, f"SELECT customer_id, {', '.join(seg.FEATURES)} FROM pz", _F))
def i01(spark, sf):
    df = base(spark, sf)
    return rounded(seg.prepare(df, seg.fit_preparation(df)))


def vectors(spark, sf):
    df = base(spark, sf)
    ready = seg.prepare(df, seg.fit_preparation(df), ("customer_id", "churn", "fold"))
    return seg.with_vector(stage(ready, "prepared"))


@query("i02_fit_segmentation")
def i02(spark, sf):
    rows = vectors(spark, sf)
    return seg.fit_kmeans(rows).transform(rows).groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("i03_evaluate_k")
def i03(spark, sf):
    return seg.evaluate_k(vectors(spark, sf), range(3, 9))


ARI = STORE + """, ct AS (SELECT segment_id AS a, crclscod AS b, CAST(count(*) AS DOUBLE) AS n FROM scores GROUP BY 1, 2
), sa AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM ct GROUP BY a)
), sb AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM ct GROUP BY b)
), si AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS t FROM ct)"""


@query("i04_adjusted_rand", sql(ARI, "SELECT (si.s - sa.s * sb.s / si.t) / ((sa.s + sb.s) / 2 - sa.s * sb.s / si.t) AS ari FROM si, sa, sb", "ari:9"))
def i04(spark, sf):
    return rounded(seg.adjusted_rand(load_store(spark, sf).scores, "segment_id", "crclscod"), 9)


_LAB = PREP + STORE[len(BASE):] + ", lab AS (SELECT pz.* EXCLUDE (churn), segment_id FROM pz JOIN scores USING (customer_id))"


def _dist(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) ** 2" for c in seg.FEATURES) + ")"


@query("i05_davies_bouldin", sql(_LAB + ", ce AS (SELECT segment_id, " + ", ".join(f"avg({c}) AS {c}" for c in seg.FEATURES) + f""" FROM lab GROUP BY 1
), sc AS (SELECT l.segment_id, avg({_dist('l', 'c')}) AS s FROM lab l JOIN ce c USING (segment_id) GROUP BY 1
), pr AS (SELECT a.segment_id AS i, max((sa.s + sb.s) / {_dist('a', 'b')}) AS r FROM ce a JOIN ce b ON a.segment_id <> b.segment_id
   JOIN sc sa ON sa.segment_id = a.segment_id JOIN sc sb ON sb.segment_id = b.segment_id GROUP BY 1)""", "SELECT avg(r) AS davies_bouldin FROM pr", "davies_bouldin"))
def i05(spark, sf):
    labels = load_store(spark, sf).scores.select("customer_id", "segment_id")
    rows = vectors(spark, sf).drop("vector").join(labels, "customer_id")
    return rounded(seg.davies_bouldin(rows, seg.FEATURES))


@query("i06_cluster_profiles", sql(STORE, "SELECT segment_id, count(*) AS n, round_even(100 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 1) AS part_pct, "
    + ", ".join(f"CAST(median({c}) AS DOUBLE) AS {c}" for c in seg.FEATURES) + " FROM scores GROUP BY 1", "part_pct " + " ".join(f"{c}" for c in seg.FEATURES)))
def i06(spark, sf):
    return rounded(seg.cluster_profiles(load_store(spark, sf).scores))


@query("i07_cluster_zscores", sql(_LAB, "SELECT segment_id, " + ", ".join(f"avg({c}) AS {c}" for c in seg.FEATURES) + " FROM lab GROUP BY 1", _F))
def i07(spark, sf):
    labels = load_store(spark, sf).scores.select("customer_id", "segment_id")
    return rounded(seg.cluster_zscores(vectors(spark, sf).join(labels, "customer_id")))


@query("i08_name_clusters", STORE + """, p AS (SELECT segment_id, median(months) AS months, median(totmrc_Mean) AS plan, median(mou_Mean) AS mou, median(change_mou) AS ch FROM scores GROUP BY 1
), f AS (SELECT *, row_number() OVER (ORDER BY months DESC, segment_id) = 1 AS old, row_number() OVER (ORDER BY plan, segment_id) = 1 AS sec FROM p
), h AS (SELECT *, NOT old AND NOT sec AND row_number() OVER (ORDER BY NOT old AND NOT sec DESC, mou DESC, segment_id) <= 2 AS heavy FROM f)
SELECT segment_id, CASE WHEN sec THEN 'Lignes secondaires à petit forfait' WHEN old THEN 'Clients anciens à terminal ancien et bon marché' WHEN heavy AND ch < 0 THEN 'Gros consommateurs en baisse d''usage'
  WHEN heavy THEN 'Gros consommateurs en hausse d''usage' ELSE 'Usage modéré, clients récents' END AS segment FROM h""")
def i08(spark, sf):
    profiles = seg.cluster_profiles(load_store(spark, sf).scores)
    return seg.name_clusters(profiles, strict=False)


@query("i09_nearest_centroid", STORE + " SELECT customer_id, segment_id FROM scores")
def i09(spark, sf):
    df = load_store(spark, sf).scores.drop("segment_id")
    z = centroids.standardised(df, SEGMENT_AXES)
    names = [f"z_{c}" for c in SEGMENT_AXES]
    centres = z.groupBy("crclscod").agg(*[F.avg(c).alias(c) for c in names])
    order = F.array_position(F.array(*[F.lit(v) for v in (
        "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]), F.col("crclscod")) - 1
    return centroids.nearest_centroid(z, names, centres.withColumn("segment_id", order.cast("int"))) \
        .select("customer_id", "segment_id")


@query("i09_assign_segments")
def i09m(spark, sf):
    """Every row in the cluster of the fitted centres, with the name its profile gives it."""
    ready = vectors(spark, sf)
    fitted = seg.fit_kmeans(ready)
    assigned = fitted.transform(ready).select("customer_id", "segment_id")
    names = seg.name_clusters(seg.cluster_profiles(base(spark, sf).join(assigned, "customer_id")),
                              strict=False)
    return seg.assign_segments(ready, fitted, names).select("customer_id", "segment_id", "segment")


def seg_auc_sql(label: str, p: str = "") -> str:
    return f""", {p}cl AS (SELECT CAST({label} AS VARCHAR) AS s, fold AS f, count(*) AS n, sum(churn) AS pos FROM cust2 GROUP BY 1, 2
), {p}oo AS (SELECT s, f, coalesce(CAST(sum(pos) OVER (PARTITION BY s) - pos AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY s) - n, 0),
    CAST(sum(pos) OVER () - sum(pos) OVER (PARTITION BY f) AS DOUBLE) / (sum(n) OVER () - sum(n) OVER (PARTITION BY f))) AS sc FROM {p}cl
), {p}sr AS (SELECT c.fold, c.churn, sc AS score FROM cust2 c JOIN {p}oo ON CAST({label} AS VARCHAR) = s AND fold = f)"""


_CUST2 = STORE + ", cust2 AS (SELECT c.*, s.segment, s.segment_regles FROM cust c JOIN scores s USING (customer_id))"


@query("i10_segment_auc_cv", sql(_CUST2 + seg_auc_sql("segment") + auc_sql("sr", "score", "fold").replace(", auc AS", ", fauc AS").replace(", cum AS", ", fcum AS").replace("FROM cum", "FROM fcum").replace(", sc AS", ", fsc AS").replace("FROM sc", "FROM fsc"),
    "SELECT avg(roc_auc) AS auc_moyenne, stddev_pop(roc_auc) AS auc_ecart_type FROM fauc", "auc_moyenne auc_ecart_type"))
def i10(spark, sf):
    return rounded(seg.segment_auc_cv(labelled(spark, sf), "segment"))


def labelled(spark, sf):
    extra = load_store(spark, sf).scores.select("customer_id", "segment", "segment_regles")
    return base(spark, sf).join(extra, "customer_id")


def _named_auc(label: str, p: str) -> str:
    text = auc_sql(f"{p}sr", "score", "fold")
    for name in ("auc", "cum", "sc"):
        text = text.replace(f", {name} AS (", f", {p}{name}x AS (").replace(f"FROM {name}", f"FROM {p}{name}x")
    return seg_auc_sql(label, p) + text


@query("i12_compare_segmentations", sql(
    _CUST2 + _named_auc("segment", "a_") + _named_auc("segment_regles", "b_")
    + ", ll AS (SELECT 'segment' AS variable, segment AS l, churn FROM cust2 UNION ALL SELECT 'segment_regles', segment_regles, churn FROM cust2)"
      ", lg AS (SELECT variable, l, CAST(count(*) AS DOUBLE) AS n, CAST(sum(churn) AS DOUBLE) AS pos FROM ll GROUP BY 1, 2)"
      ", lh AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS t, sum(pos) OVER (PARTITION BY variable) AS tp FROM lg)"
      ", lk AS (SELECT variable, count(*) AS n_segments, min(100 * pos / n) FILTER (WHERE n >= 50) AS taux_min, max(100 * pos / n) FILTER (WHERE n >= 50) AS taux_max,"
      " sqrt(sum((pos - n * tp / t) ** 2 / (n * tp / t * (1 - tp / t))) / max(t)) AS cramers_v FROM lh GROUP BY 1)"
      ", la AS (SELECT 'segment' AS variable, avg(roc_auc) AS auc_moyenne, stddev_pop(roc_auc) AS auc_ecart_type FROM a_aucx UNION ALL SELECT 'segment_regles', avg(roc_auc), stddev_pop(roc_auc) FROM b_aucx)",
    "SELECT lk.*, taux_max - taux_min AS ecart_pts, auc_moyenne, auc_ecart_type FROM lk JOIN la USING (variable)",
    "taux_min taux_max cramers_v ecart_pts auc_moyenne auc_ecart_type"))
def i12(spark, sf):
    return rounded(seg.compare_segmentations(labelled(spark, sf), ["segment", "segment_regles"],
                                             min_n=50))


@query("i11_projection")
def i11(spark, sf):
    return seg.projection(vectors(spark, sf))[0]


@query("i13_skew_before_after", sql(
    BASE + f", l AS ({long_sql(seg.FEATURES, '')}), lg AS (SELECT " + ", ".join(f"{_LOG.get(c, c)} AS {c}" for c in seg.FEATURES)
    + f" FROM cust), l2 AS ({long_sql(seg.FEATURES, '', 'lg')}), a AS (SELECT variable, skewness(value) AS avant FROM l GROUP BY 1), b AS (SELECT variable, skewness(value) AS apres FROM l2 GROUP BY 1)",
    "SELECT * FROM a JOIN b USING (variable)", "avant apres"))
def i13(spark, sf):
    return rounded(seg.skew_before_after(base(spark, sf)))
