"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees the words of the text and the
probabilities of all earlier categories (Read et al. 2009).  What a model learns from as earlier
probabilities are out-of-fold predictions: each training document's come from models that have not
seen it, as will be the case for new documents.  Words and word beginnings to look at are chosen by chi-square from
counts over all sampled labelled documents; models are logistic, fitted by Newton's method.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyaltide.llm.common import draw, text_batches
from loyaltide.staging import stage

MAX_DOCUMENTS = 6000           # labelled documents the chain is fitted on
WORDS = 200                    # words and word beginnings looked at per category
LEAST = 3                      # documents one must occur in
CHI_SQUARE = 15.0              # and how far from chance it must be
BEGINNINGS = (5, 6, 7)         # characters of a word beginning
FOLDS = 5
RIDGE = 0.05
STEPS = 8
STATS = 3
LETTERS = re.compile(r"[^\W\d_]+")

#: Categories in the order of the chain: name and the mark of a labelled document.
CATEGORIES = {
    "toxic_junk": "toxic = 1 AND quality = 0",
    "toxic_prose": "toxic = 1 AND quality = 1",
    "toxic": "toxic = 1",
}


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words of letters, and how the longer ones begin (``^abcde``)."""
    words = set(LETTERS.findall((text or "").lower()))
    starts = {"^" + w[:n] for n in BEGINNINGS for w in words if len(w) > n}
    return words | starts


def features(text: str | None, place: dict[str, int]) -> np.ndarray:
    """Presence of the chosen words, then length, share of marks, share of capitals."""
    x = np.zeros(len(place) + STATS, np.float32)
    found = words_of(text) & place.keys()
    x[[place[w] for w in found]] = 1.0
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if len(raw):
        n = len(raw)
        upper = np.count_nonzero((raw >= 65) & (raw <= 90))
        marks = np.count_nonzero((raw > 32) & (raw < 128)) - upper - np.count_nonzero(
            (raw >= 97) & (raw <= 122)) - np.count_nonzero((raw >= 48) & (raw <= 57))
        x[-STATS:] = np.log1p(n) / 10.0, marks / n * 4.0, upper / n * 4.0
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic weights, the intercept last; a constant label gives its prior."""
    w = np.zeros(x.shape[1] + 1)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    w[-1] = np.log(prior / (1.0 - prior))
    if not len(y) or y.min() == y.max():
        return w
    a = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a
        hessian[np.diag_indices_from(hessian)] += ridge
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
    return w


def apply_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


@dataclass
class Chain:
    names: list[str]
    place: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, marks: np.ndarray, fold: np.ndarray) -> None:
        """``marks``: documents x categories; ``fold``: 0 .. FOLDS - 1 per document."""
        self.weights, known = [], x
        for i in range(len(self.names)):
            y = marks[:, i].astype(np.float64)
            out = np.empty(len(y))
            for f in range(FOLDS):
                aside = fold == f
                if aside.any():
                    out[aside] = apply_logistic(known[aside], fit_logistic(known[~aside], y[~aside]))
            self.weights.append(fit_logistic(known, y))
            known = np.concatenate([known, out[:, None]], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        known, out = x, np.zeros((len(x), len(self.names)))
        for i, w in enumerate(self.weights):
            out[:, i] = apply_logistic(known, w)
            known = np.concatenate([known, out[:, i:i + 1]], axis=1)
        return out


def train(docs: DataFrame, labels: DataFrame, use: Column, categories: dict[str, str] | None = None,
          id_col: str = "doc_id", text_col: str = "text",
          max_documents: int = MAX_DOCUMENTS) -> Chain:
    """Fit on labelled documents whose label row satisfies ``use``.

    At most ``max_documents``, drawn by a hash of the id: a bounded sample.  Null ids and labels of
    which a category is unknown take no part; ids with several label rows have a mark if any row
    has it; repeated documents count once.
    """
    categories = categories or CATEGORIES
    names = list(categories)
    mark = [F.max(F.expr(f"CAST({c} AS INT)")).alias(f"_m{i}") for i, c in
            enumerate(categories.values())]
    known = " AND ".join(f"_m{i} IS NOT NULL" for i in range(len(names)))
    chosen = (labels.filter(use & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
              .agg(*mark).filter(known))
    marked = [f"_m{i}" for i in range(len(names))]
    chosen = draw(chosen, "_id", marked, max_documents)    # a few numbers a row
    rows = (docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
            .groupBy("_id", *marked).agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    rows = stage(rows.select(F.col("_id").cast("string").alias("id"), "text",
                             F.array(*[F.col(m) for m in marked]).alias("marks")), "toxicity-sample")
    k = len(names)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, np.ndarray] = {"": np.zeros(k + 1, np.int64)}
            for text, m in zip(batch["text"], batch["marks"], strict=True):
                one = np.r_[1, np.asarray(m)].astype(np.int64)
                found[""] += one
                for w in words_of(text):
                    found[w] = found[w] + one if w in found else one
            yield pd.DataFrame({"word": list(found), **{f"n{i}": [v[i] for v in found.values()]
                                                        for i in range(k + 1)}})

    schema = "word string, " + ", ".join(f"n{i} bigint" for i in range(k + 1))
    counts = (rows.mapInPandas(count, schema).groupBy("word")
              .agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k + 1)]).cache())
    total = counts.filter("word = ''").first()
    chain = Chain(names)
    if total is None or not total["n0"]:
        counts.unpersist()
        return chain
    n, place = float(total["n0"]), chain.place
    for i in range(1, k + 1):
        a, have, has = F.col(f"n{i}"), F.col("n0"), float(total[f"n{i}"])
        expected = have * F.lit(has / n)
        chi = (a - expected) * (a - expected) / (expected * (F.lit(1.0) - have / F.lit(n + 1.0)))
        best = (counts.filter((F.col("word") != "") & (have >= LEAST) & F.lit(0 < has < n)
                               & (chi >= CHI_SQUARE))
                .orderBy(chi.desc(), "word").limit(WORDS).collect())
        for r in best:
            place.setdefault(r["word"], len(place))
    counts.unpersist()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "marks": batch["marks"], "x": [
                features(t, place).tobytes() for t in batch["text"]]})

    sample = (rows.mapInPandas(encode, "id string, marks array<int>, x binary").toPandas()
              .sort_values("id", kind="stable"))
    x = np.stack([np.frombuffer(b, np.float32) for b in sample["x"]])
    fold = np.arange(len(x)) % FOLDS
    chain.fit(x, np.stack(sample["marks"].tolist()), fold)
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id`` and one probability per category, for every row, whole texts.

    Null and empty texts have no words; nothing learnt gives 0 throughout; repeated rows are scored
    each; an empty table gives an empty result; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            p = np.zeros((len(texts), len(chain.names)))
            for at in range(0, len(texts), 1000):
                x = np.stack([features(t, chain.place) for t in texts[at:at + 1000]])
                p[at:at + 1000] = chain.probabilities(x)
            out = pd.DataFrame(p, columns=chain.names)
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    schema = f"doc_id {id_type}, " + ", ".join(f"{c} double" for c in chain.names)
    return (text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(run, schema))
