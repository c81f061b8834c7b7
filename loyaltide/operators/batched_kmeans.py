"""Many k-means runs in the same passes over the rows.

Candidates for the number of clusters, seeds and starts are runs that differ only in their centres.
A pass reads the rows once, measures them against the centres of all runs still moving, and leaves one
line of counts and sums per centre and task; a grouped sum merges them.  Starts are drawn from all
rows by squared distance, one pass per centre: every row races with an exponential time whose rate is
its squared distance to the centres drawn so far, and the first one home is the next centre.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2048                    # rows measured at a time inside a task


@dataclass(frozen=True)
class Clustering:
    """Centres of one finished run, with its cost and cluster sizes over all rows."""

    centres: np.ndarray
    cost: float
    sizes: np.ndarray

    def transform(self, df: DataFrame, name: str = "segment_id", vector: str = "vector"
                  ) -> DataFrame:
        """Add the number of the nearest centre (the first one on ties) as an expression."""
        at = df.withColumn("_x", vector_to_array(vector))
        gaps = F.array(*[sum((F.pow(F.col("_x")[i] - float(v), F.lit(2))
                              for i, v in enumerate(c)), F.lit(0.0)) for c in self.centres])
        return (at.withColumn("_d", gaps)
                .withColumn(name, (F.array_position("_d", F.array_min("_d")) - 1).cast("int"))
                .drop("_x", "_d"))


def as_rows(vectors: DataFrame, id_col: str, vector: str = "vector") -> DataFrame:
    """``key, x``: a number that tells rows apart, and the vector as an array."""
    return vectors.select(F.xxhash64(id_col).alias("key"), vector_to_array(vector).alias("x"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.iloc[at:at + ROWS]
            yield part["key"].to_numpy(), np.stack(part["x"].to_numpy())


def _uniform(keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1], one per key and salt."""
    x = keys.view(np.uint64)[:, None] ^ salts[None, :]
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54


def draw_starts(rows: DataFrame, seeds: Sequence[int], k: int) -> np.ndarray:
    """``len(seeds) x k`` centres; the first few of a seed are its start for any smaller ``k``."""
    chosen: np.ndarray | None = None                       # seeds x drawn x dimensions
    for step in range(k):
        salts = np.array([np.random.default_rng((seed, step)).integers(0, 2 ** 63)
                          for seed in seeds], np.uint64)

        def race(batches: Iterator[pd.DataFrame], drawn=chosen, salts=salts
                 ) -> Iterator[pd.DataFrame]:
            best = key_of = place = None
            for keys, x in _blocks(batches):
                time = -np.log(_uniform(keys, salts))
                if drawn is not None:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        time = time / np.stack([
                            ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).min(axis=1)
                            for c in drawn], axis=1)
                time = np.where(np.isnan(time), np.inf, time)
                first = time.argmin(axis=0)
                value = time[first, np.arange(len(salts))]
                if place is None:
                    best, key_of, place = value, keys[first], x[first]
                new = value < best
                best[new], key_of[new], place[new] = value[new], keys[first[new]], x[first[new]]
            if place is not None:
                yield pd.DataFrame({"start": np.arange(len(salts)), "time": best, "key": key_of,
                                    "x": list(place)})

        winners = rows.mapInPandas(race, "start int, time double, key bigint, x array<double>")
        found = winners.groupBy("start").agg(
            F.min_by("x", F.struct("time", "key")).alias("x")).collect()     # one row per seed
        if not found:
            raise ValueError("no rows to cluster")
        drawn = np.stack([r["x"] for r in sorted(found, key=lambda r: r["start"])])[:, None, :]
        chosen = drawn if chosen is None else np.concatenate([chosen, drawn], axis=1)
    return chosen


def _nearest(x: np.ndarray, runs: Sequence[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each run: its number, the nearest centre of each row and the squared distance to it."""
    norm = (x ** 2).sum(axis=1)
    by_size: dict[int, list[int]] = {}
    for i, c in enumerate(runs):
        by_size.setdefault(len(c), []).append(i)
    for k, members in by_size.items():
        centres = np.concatenate([runs[i] for i in members])
        gap = ((centres ** 2).sum(axis=1) - 2.0 * (x @ centres.T)).reshape(len(x), -1, k)
        label = gap.argmin(axis=2)
        low = np.maximum(np.take_along_axis(gap, label[:, :, None], 2)[:, :, 0] + norm[:, None], 0)
        for j, i in enumerate(members):
            yield i, label[:, j], low[:, j]


def measure(rows: DataFrame, runs: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One pass: per run the size and the sum of each cluster, and the cost (squared distances)."""
    dims = runs[0].shape[1]
    first = np.cumsum([0, *[len(c) for c in runs]])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, cost, sums = np.zeros(first[-1]), np.zeros(first[-1]), np.zeros((first[-1], dims))
        for _, x in _blocks(batches):
            member = np.zeros((len(x), first[-1]))
            for i, label, low in _nearest(x, runs):
                member[np.arange(len(x)), first[i] + label] = 1.0
                cost[first[i]] += low.sum()
            n += member.sum(axis=0)
            sums += member.T @ x
        yield pd.DataFrame({"centre": np.arange(first[-1]), "n": n, "cost": cost, "s": list(sums)})

    parts = rows.mapInPandas(add_up, "centre int, n double, cost double, s array<double>")
    found = parts.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[
        F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims)]).orderBy("centre").collect()
    table = np.array([[r["n"], r["cost"], *r[3:]] for r in found])       # one row per centre
    return [(table[a:b, 0], table[a:b, 2:], float(table[a, 1]))
            for a, b in zip(first[:-1], first[1:], strict=True)]


def fit_runs(rows: DataFrame, starts: Sequence[np.ndarray], max_iter: int = 50,
             tolerance: float = 1e-4) -> list[Clustering]:
    """Lloyd's iterations of all runs together: at most ``max_iter`` passes, and one for the cost.

    A run stops when none of its centres moves further than ``tolerance``; an empty cluster keeps
    its centre.
    """
    centres = [np.array(c, np.float64) for c in starts]
    moving = list(range(len(centres)))
    for _ in range(max_iter):
        if not moving:
            break
        still = []
        for i, (n, sums, _) in zip(moving, measure(rows, [centres[i] for i in moving]), strict=True):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1.0)[:, None], centres[i])
            if np.sqrt(((new - centres[i]) ** 2).sum(axis=1)).max() > tolerance:
                still.append(i)
            centres[i] = new
        moving = still
    return [Clustering(c, cost, n) for c, (n, _, cost) in
            zip(centres, measure(rows, centres), strict=True)]


def label_rows(rows: DataFrame, runs: Sequence[Clustering]) -> DataFrame:
    """``x, labels``: the cluster of each row in every run."""
    centres = [r.centres for r in runs]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, x in _blocks(batches):
            found = np.empty((len(x), len(centres)), np.int32)
            for i, of, _ in _nearest(x, centres):
                found[:, i] = of
            yield pd.DataFrame({"x": list(x), "labels": list(found)})

    return rows.mapInPandas(label, "x array<double>, labels array<int>")


def spread_of(labelled: DataFrame, runs: Sequence[int], sizes: Sequence[np.ndarray]) -> list[dict]:
    """Two passes over ``x, labels``: per run (position in ``labels``) the mean silhouette by squared
    distances over all rows, and the Davies-Bouldin index.

    The mean squared distance of a row to a cluster follows from the cluster's size, sum and sum of
    squares, so no pair of rows is looked at.
    """
    ks = [len(s) for s in sizes]
    dims = labelled.select(F.size("x").alias("d")).first()["d"]
    first = np.cumsum([0, *ks])

    def grouped(columns: dict[str, str], task) -> np.ndarray:
        schema = "centre int, " + ", ".join(f"{c} {t}" for c, t in columns.items())
        aggs = [F.sum(F.col(c)[d]).alias(f"{c}{d}") for c, t in columns.items() if t != "double"
                for d in range(dims)]
        aggs = [F.sum(c).alias(c) for c, t in columns.items() if t == "double"] + aggs
        rows = labelled.mapInPandas(task, schema).groupBy("centre").agg(*aggs).orderBy("centre")
        return np.array([list(r)[1:] for r in rows.collect()], np.float64)  # one row per centre

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, square, s = np.zeros(first[-1]), np.zeros(first[-1]), np.zeros((first[-1], dims))
        for x, label in _labelled(batches):
            norm = (x ** 2).sum(axis=1)
            for j, i in enumerate(runs):
                at = first[j] + label[:, i]
                n += np.bincount(at, minlength=first[-1])
                square += np.bincount(at, norm, first[-1])
                for d in range(dims):
                    s[:, d] += np.bincount(at, x[:, d], first[-1])
        yield pd.DataFrame({"centre": np.arange(first[-1]), "n": n, "square": square, "s": list(s)})

    table = grouped({"n": "double", "square": "double", "s": "array<double>"}, sums)
    n, square, mean = table[:, 0], table[:, 1], table[:, 2:] / np.maximum(table[:, :1], 1.0)

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        silhouette, distance = np.zeros(first[-1]), np.zeros(first[-1])
        for x, label in _labelled(batches):
            norm = (x ** 2).sum(axis=1)
            for j, i in enumerate(runs):
                c = slice(first[j], first[j + 1])
                own = (np.arange(len(x)), label[:, i])
                apart = np.maximum(norm[:, None] + square[c] / np.maximum(n[c], 1.0)
                                   - 2.0 * (x @ mean[c].T), 0.0)
                size = n[c][label[:, i]]
                near = apart[own] * size / np.maximum(size - 1, 1.0)
                apart[own] = np.inf
                apart[:, n[c] == 0] = np.inf
                other = apart.min(axis=1)
                top = np.maximum(near, other)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.where((size > 1) & (top > 0) & np.isfinite(other),
                                 (other - near) / top, 0.0)
                silhouette[first[j]] += s.sum()
                far = np.sqrt(((x - mean[c][label[:, i]]) ** 2).sum(axis=1))
                distance[c] += np.bincount(label[:, i], far, ks[j])
        yield pd.DataFrame({"centre": np.arange(first[-1]), "silhouette": silhouette,
                            "distance": distance})

    found = grouped({"silhouette": "double", "distance": "double"}, gaps)
    out = []
    for j in range(len(runs)):
        c = slice(first[j], first[j + 1])
        filled = n[c] > 0
        centre, scatter = mean[c][filled], (found[c, 1] / np.maximum(n[c], 1.0))[filled]
        between = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
        np.fill_diagonal(between, np.inf)
        worst = ((scatter[:, None] + scatter[None]) / between).max(axis=1)
        out.append({"silhouette": float(found[first[j], 0] / n[c].sum()),
                    "davies_bouldin": float(worst.mean())})
    return out


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.iloc[at:at + ROWS]
            yield np.stack(part["x"].to_numpy()), np.stack(part["labels"].to_numpy())


def agreement(labelled: DataFrame, pairs: Sequence[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Adjusted Rand index of each pair of runs (positions in ``labels``), from one contingency
    aggregate: a row makes one cell per pair, combined before the shuffle."""
    cells = (labelled.select(F.inline(F.array(*[F.struct(
        F.lit(p).alias("pair"), F.col("labels")[a].alias("a"), F.col("labels")[b].alias("b"))
        for p, (a, b) in enumerate(pairs)])))
        .groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    found = cells.toPandas()                               # k x k rows per pair

    def two(n) -> float:
        n = np.asarray(n, np.float64)
        return float((n * (n - 1) / 2).sum())

    out = {}
    for p, part in found.groupby("pair"):
        rows, cols = two(part.groupby("a")["n"].sum()), two(part.groupby("b")["n"].sum())
        chance, top = rows * cols / two([part["n"].sum()]), (rows + cols) / 2
        out[pairs[p]] = (two(part["n"]) - chance) / (top - chance) if top != chance else 1.0
    return out
