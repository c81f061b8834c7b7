"""Exact path-dependent Shapley contributions of tree ensembles.

For one leaf with value v, the game over the features of its path is a product: a feature inside the
coalition contributes 1 or 0 (does the row follow the path?), a feature outside contributes the share
of training rows that follow it.  The Shapley value of a product game only needs the elementary
coefficients of a small polynomial.  Leaves whose paths hold equally many features are one array, so
a batch of rows meets all of them in a few array operations.

Of a leaf with m features a row only matters by which of them follow the path: 2^m answers, worked
out once.  A row finds the bits of all leaves in one line of bits per feature, chosen by where its
value lies among the cuts of the model, and the contributions by those bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loyaltide.staging import staging_root

CELLS = 2_000_000              # rows x leaves x features looked at together
NEAR = 250_000                 # the same of answers looked up, so that they stay in the cache
ANSWERS = 4_000_000            # answers of the leaves with equally many features; above, none are kept

Path = tuple[float, list[tuple[int, float, float, float]]]


def node_table(model) -> pd.DataFrame:
    """The nodes of a fitted boosted model, written by Spark and read as one table: ``tree, id,
    value`` (log-odds, the margin times two), ``n`` (training rows), ``left, right`` (-1 at a leaf),
    ``feature, cut``.  It has the size of the model."""
    if not hasattr(model, "treeWeights"):
        raise ValueError("only boosted trees add up to log-odds")
    spark = SparkSession.active()
    path = f"{staging_root(spark)}/{spark.sparkContext.applicationId}/trees-{uuid4().hex}"
    model.write().save(path)
    node = F.col("nodeData")
    table = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["prediction"].alias("value"),
        node["impurityStats"][0].alias("n"), node["leftChild"].alias("left"),
        node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("cut")).toPandas()
    table["value"] *= 2.0 * np.asarray(model.treeWeights)[table["tree"]]
    return table


def ensemble_paths(model) -> list[Path]:
    """Every leaf of a fitted boosted model as ``(value, [(feature, low, high, share)])``.

    A path keeps, per feature, the interval ``low < x <= high`` and the product of the training
    shares of its splits.
    """
    paths: list[Path] = []
    for _, tree in node_table(model).groupby("tree"):
        nodes = {r.id: r for r in tree.itertuples()}
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            at, held = todo.pop()
            node = nodes[at]
            if node.left < 0:
                paths.append((node.value, [(f, *interval) for f, interval in held.items()]))
                continue
            low, high, share = held.get(node.feature, (-math.inf, math.inf, 1.0))
            for child, bounds in ((node.left, (low, min(high, node.cut))),
                                  (node.right, (max(low, node.cut), high))):
                part = share * nodes[child].n / node.n
                todo.append((child, {**held, node.feature: (*bounds, part)}))
    return paths


def expected_value(paths: Sequence[Path]) -> float:
    """Mean log-odds of the model under its training shares: the base of every explanation."""
    return float(sum(value * math.prod(share for *_, share in held) for value, held in paths))


def leaf_arrays(paths: Sequence[Path]) -> list[tuple[np.ndarray, ...]]:
    """``value, feature, low, high, share`` of the leaves, one set of arrays per path length."""
    by_size: dict[int, list[Path]] = {}
    for path in paths:
        by_size.setdefault(len(path[1]), []).append(path)
    return [(np.array([v for v, _ in of]), *(
        np.array([[step[i] for step in held] for _, held in of], np.int64 if i == 0 else np.float64)
        for i in range(4))) for m, of in sorted(by_size.items()) if m]


def gains(value: np.ndarray, share: np.ndarray, follows: np.ndarray) -> Iterator[np.ndarray]:
    """Per feature of the paths, what it adds to each leaf (columns) of each row of ``follows``
    (rows, leaves, features)."""
    m = share.shape[1]
    weights = np.array([math.factorial(k) * math.factorial(m - 1 - k) for k in range(m)]
                       ) / math.factorial(m)
    for i in range(m):
        poly = np.zeros((*follows.shape[:2], m))
        poly[:, :, 0] = 1.0
        for j in range(m):
            if j != i:
                shifted = poly[:, :, :-1] * follows[:, :, j, None]
                poly *= share[:, j, None]
                poly[:, :, 1:] += shifted
        yield value * (follows[:, :, i] - share[:, i]) * (poly @ weights)


class Answers:
    """The contributions of leaves with equally many features, by which of them follow the path."""

    def __init__(self, value: np.ndarray, feature: np.ndarray, low: np.ndarray, high: np.ndarray,
                 share: np.ndarray):
        leaves, m = feature.shape
        self.size = 2 ** m
        self.bits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kind = np.min_scalar_type(self.size - 1)
        for f in np.unique(feature).tolist():
            leaf, slot = np.nonzero(feature == f)
            a, b = low[leaf, slot], high[leaf, slot]
            cuts = np.unique(np.r_[a, b])
            cuts = cuts[np.isfinite(cuts)]
            at = np.arange(len(cuts) + 1)[:, None]           # cuts below the value
            line = np.zeros((len(cuts) + 2, leaves), kind)   # the last one: no number
            inside = (at > np.searchsorted(cuts, a) - np.isinf(a)) & (at <= np.searchsorted(cuts, b))
            line[:-1, leaf] = inside * (1 << slot)
            self.bits[f] = cuts, line
        leaf, slot = np.divmod(np.argsort(feature, axis=None, kind="stable"), m)
        used = feature[leaf, slot]
        self.starts = np.flatnonzero(np.r_[True, used[1:] != used[:-1]])
        self.features, self.leaf = used[self.starts], leaf
        self.place = np.arange(len(leaf)) * self.size
        follows = (np.arange(self.size)[:, None, None] >> np.arange(m) & 1).astype(np.float64)
        table = np.empty((m, leaves, self.size))
        for i, gain in enumerate(gains(value, share, np.broadcast_to(
                follows, (self.size, leaves, m)))):
            table[i] = gain.T
        self.table = table[slot, leaf].ravel()

    def add_to(self, phi: np.ndarray, x: np.ndarray) -> None:
        step = max(1, NEAR // len(self.leaf))
        for at in range(0, len(x), step):
            rows, found = x[at:at + step], None
            for f, (cuts, line) in self.bits.items():
                own = rows[:, f]
                code = np.where(np.isnan(own), len(cuts) + 1, np.searchsorted(cuts, own))
                found = line[code] if found is None else found + line[code]
            gain = self.table[found[:, self.leaf] + self.place]
            phi[at:at + step, self.features] += np.add.reduceat(gain, self.starts, axis=1)


def answers(leaves: Sequence[tuple[np.ndarray, ...]]) -> list[Answers | tuple[np.ndarray, ...]]:
    """The leaves, with their answers where these are few enough to keep."""
    return [Answers(*of) if of[1].size * 2 ** of[1].shape[1] <= ANSWERS else of for of in leaves]


def contributions(x: np.ndarray, leaves: Sequence[Answers | tuple[np.ndarray, ...]]) -> np.ndarray:
    """Contribution of each feature (columns of ``x``) to the log-odds of each row."""
    phi = np.zeros(x.shape)
    for of in leaves:
        if isinstance(of, Answers):
            of.add_to(phi, x)
            continue
        value, feature, low, high, share = of
        m = feature.shape[1]
        step = max(1, CELLS // (len(value) * m * m))
        for at in range(0, len(x), step):
            inside = x[at:at + step][:, feature]
            follows = ((inside > low) & (inside <= high)).astype(np.float64)
            for i, gain in enumerate(gains(value, share, follows)):
                to = np.zeros((len(value), x.shape[1]))
                to[np.arange(len(value)), feature[:, i]] = 1.0
                phi[at:at + step] += gain @ to
    return phi


def tree_contributions(vectors: DataFrame, paths: Sequence[Path], names: Sequence[str],
                       id_col: str = "customer_id", by: Sequence[int] | None = None,
                       group_names: Sequence[str] = ()) -> DataFrame:
    """Long contributions ``id, feature, contribution``; base + sum = log-odds of the row.

    ``by`` gives each feature the position of its group in ``group_names``: then a line is a group.
    The leaves have the size of the model and go to every task; batches of rows are independent.
    """
    leaves = leaf_arrays(paths)
    if by is not None:
        names = group_names
        group = np.zeros((len(by), len(names)))
        group[np.arange(len(by)), by] = 1.0

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = answers(leaves)
        for batch in batches:
            phi = contributions(np.stack(batch["x"].to_numpy()), known)
            phi = phi if by is None else phi @ group
            yield pd.DataFrame({id_col: batch[id_col], "contributions": list(phi)})

    rows = vectors.select(id_col, vector_to_array("features").alias("x"))
    id_type = rows.schema[id_col].dataType.simpleString()
    wide = rows.mapInPandas(explain, f"{id_col} {id_type}, contributions array<double>")
    named = F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in names]), F.col("contributions")),
                        lambda p: F.struct(p["0"].alias("feature"),
                                           p["contributions"].alias("contribution")))
    return wide.select(id_col, F.inline(named))
