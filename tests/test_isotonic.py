"""Pooled ranges merged up a tree equal one pooling of everything."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from loyaltide.operators import isotonic


def max_min(x, y):
    """The definition: the largest over starts of the smallest mean to any end beyond."""
    values = np.unique(x)
    s = np.array([y[x == v].sum() for v in values])
    w = np.array([(x == v).sum() for v in values])
    cs, cw = np.r_[0, s.cumsum()], np.r_[0, w.cumsum()]
    fit = [max(min((cs[b] - cs[a]) / (cw[b] - cw[a]) for b in range(i + 1, len(values) + 1))
               for a in range(i + 1)) for i in range(len(values))]
    return dict(zip(values.tolist(), fit, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_definition(spark, monkeypatch, seed):
    monkeypatch.setattr(isotonic, "FAN", 2)
    r = np.random.default_rng(seed)
    x = np.round(r.uniform(0, 1, 300), 2 if seed else 3)
    y = (r.uniform(0, 1, 300) < x).astype(int)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y int")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = isotonic.isotonic_blocks(df, "x", "y")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = max_min(x, y)
    got = isotonic.IsotonicMap(blocks).apply(df, "x", "v").collect()
    assert len(got) == 300 and all(q.v == pytest.approx(want[q.x]) for q in got)
    rows = blocks.orderBy("low").collect()
    assert all(a.value < b.value and a.high < b.low for a, b in zip(rows, rows[1:], strict=False))


def test_between_and_beyond_blocks_as_spark_does(spark):
    r = np.random.default_rng(9)
    x = np.round(r.uniform(0, 1, 200), 2)
    y = (r.uniform(0, 1, 200) < x).astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    asked = spark.createDataFrame([(float(v),) for v in np.linspace(-0.2, 1.2, 57)] + [(None,)],
                                  "x double")
    model = IsotonicRegression(featuresCol="f", labelCol="y", predictionCol="p").fit(
        VectorAssembler(inputCols=["x"], outputCol="f").transform(df))
    want = {q.x: q.p for q in model.transform(VectorAssembler(
        inputCols=["x"], outputCol="f").transform(asked.filter("x IS NOT NULL"))).collect()}
    got = {q.x: q.v for q in isotonic.IsotonicMap(isotonic.isotonic_blocks(df, "x", "y")).apply(
        asked, "x", "v").collect()}
    assert got.pop(None) is None
    assert got == pytest.approx(want)


def test_hot_score_and_no_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 3000)
                                  .alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    blocks = isotonic.isotonic_blocks(df, "x", "y")
    assert blocks.agg(F.sum("w")).first()[0] == 3000
    assert isotonic.isotonic_blocks(df.filter("false"), "x", "y").count() == 0
