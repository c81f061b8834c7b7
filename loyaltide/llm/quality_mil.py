"""Quality of a document by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` words each), a label belongs to the bag.  Every
passage is encoded by what its words look like; a gated attention (Ilse et al. 2018) learnt from
document labels alone says how much each passage counts; the weighted mean of the passages'
representations is scored.  Encoding and scoring cover whole texts; the network is fitted in numpy
on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyaltide.llm.common import draw, text_batches

PASSAGE = 100                  # words of a passage
SHAPES = 64                    # buckets of word shapes
REPEAT = 4                     # words of a repeated stretch
MAX_DOCUMENTS = 5000           # labelled documents the network is fitted on
HIDDEN, ATTENTION = 32, 16
EPOCHS, RATE, DECAY = 220, 0.01, 1e-4
CACHED_WORDS = 100_000
WORD_STATS = 7
FEATURES = SHAPES + WORD_STATS + 5


def word_row(word: str) -> np.ndarray:
    """Shape bucket, then what the word's characters are."""
    shape = []
    letters = digits = upper = marks = 0
    for c in word:
        if c.isalpha():
            letters += 1
            upper += c.isupper()
            kind = "A" if c.isupper() else "a"
        elif c.isdigit():
            digits += 1
            kind = "0"
        else:
            marks += 1
            kind = c if ord(c) < 128 else "?"
        if not shape or shape[-1] != kind:
            shape.append(kind)
    bucket = 0
    for c in "".join(shape[:12]):
        bucket = (bucket * 31 + ord(c)) % 1_000_003
    n = len(word)
    return np.array([bucket % SHAPES, n, letters, digits, upper, marks, letters == 0,
                     letters > 0 and upper == letters and n > 1], np.float32)


class Encoder:
    """Passage features of whole texts; words are looked at once per task."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, 1 + WORD_STATS), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                at = known[w] = len(known)
                if at >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[at] = word_row(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def passages(self, text: str | None) -> np.ndarray:
        """One row of features per passage; a text without words is one empty passage."""
        text = text or ""
        words = text.split()
        n = len(words)
        if not n:
            return np.zeros((1, FEATURES), np.float32)
        ids = self._ids(words)
        starts = np.arange(0, n, PASSAGE)
        if len(starts) > 1 and n - starts[-1] < PASSAGE // 2:
            starts = starts[:-1]                           # a short rest joins the last passage
        of = np.minimum(np.arange(n) // PASSAGE, len(starts) - 1)
        size = np.bincount(of).astype(np.float32)
        rows = self.rows[ids]
        out = np.zeros((len(starts), FEATURES), np.float32)
        shapes = np.bincount(of * SHAPES + rows[:, 0].astype(np.int64),
                             minlength=len(starts) * SHAPES).reshape(-1, SHAPES)
        out[:, :SHAPES] = np.sqrt(shapes / size[:, None])
        sums = np.add.reduceat(rows[:, 1:], starts, axis=0)
        out[:, SHAPES] = sums[:, 0] / size / 10.0          # mean word length
        out[:, SHAPES + 1:SHAPES + 5] = sums[:, 1:5] / np.maximum(sums[:, :1], 1.0)
        out[:, SHAPES + 5:SHAPES + 7] = sums[:, 5:7] / size[:, None]
        at = SHAPES + WORD_STATS
        same = np.zeros(n, np.float32)
        same[1:] = ids[1:] == ids[:-1]
        out[:, at] = np.add.reduceat(same, starts) / size
        again = np.zeros(n, np.float32)                    # stretches seen before in the text
        if n >= REPEAT:
            key = np.zeros(n - REPEAT + 1, np.uint64)
            for i in range(REPEAT):
                key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (ids[i:n - REPEAT + 1 + i].astype(
                    np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            _, first = np.unique(key, return_index=True)
            again[:len(key)] = 1.0
            again[first] = 0.0
        out[:, at + 1] = np.add.reduceat(again, starts) / size
        _, firsts = np.unique(of * (len(self.known) + 1) + ids, return_index=True)
        out[:, at + 2] = np.bincount(of[firsts], minlength=len(starts)) / size
        out[:, at + 3] = np.log1p(size) / 5.0
        out[:, at + 4] = np.log1p(n) / 10.0
        return out


@dataclass
class Network:
    """Passage encoder layer, gated attention and bag score; ``prior`` alone if nothing was learnt."""

    prior: float = 0.5
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES, np.float32))
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: standardised passages of all bags, ``starts``: first passage of each bag."""
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        t = np.tanh(h @ w["V"])
        g = 1.0 / (1.0 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        score = 1.0 / (1.0 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"h": h, "t": t, "g": g, "alpha": alpha, "z": z, "score": score, "bag": bag}

    def gradients(self, x, starts, y) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, starts)
        h, t, g, alpha, bag = f["h"], f["t"], f["g"], f["alpha"], f["bag"]
        dlogit = (f["score"] - y) / len(y)
        dz = dlogit[:, None] * w["c"]
        dalpha = (dz[bag] * h).sum(axis=1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, starts)[bag])
        dt = de[:, None] * w["a"] * g * (1 - t * t)
        dg = de[:, None] * w["a"] * t * g * (1 - g)
        dh = alpha[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
        dpre = dh * (1 - h * h)
        return {"W": x.T @ dpre, "b": dpre.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg,
                "a": (t * g).T @ de, "c": f["z"].T @ dlogit, "d": dlogit.sum()}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 3) -> None:
        """Full-batch Adam on the log loss of the bags."""
        self.prior = float((1.0 + y.sum()) / (2.0 + len(y)))
        if not len(y) or y.min() == y.max():
            return
        rows = np.concatenate(bags)
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 0.05
        x = (rows - self.mean) / self.scale
        starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]].astype(np.int64)
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.weights = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
                        "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION),
                        "a": init(ATTENTION), "c": init(HIDDEN),
                        "d": np.float32(np.log(self.prior / (1 - self.prior)))}
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(u) for k, u in self.weights.items()}
        for step in range(1, EPOCHS + 1):
            for k, grad in self.gradients(x, starts, y).items():
                grad = grad + DECAY * self.weights[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                self.weights[k] = (self.weights[k] - RATE * (m[k] / (1 - 0.9 ** step))
                                   / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not self.weights or not bags:
            return np.full(len(bags), self.prior)
        x = (np.concatenate(bags) - self.mean) / self.scale
        starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]].astype(np.int64)
        return self.forward(x.astype(np.float32), starts)["score"].astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, use: Column, label_col: str = "quality",
          id_col: str = "doc_id", text_col: str = "text",
          max_documents: int = MAX_DOCUMENTS) -> Network:
    """Fit on labelled documents whose label row satisfies ``use`` (on ``labels``' columns).

    About ``max_documents`` (20 % more at most), drawn by a hash of the id within each label: a
    bounded sample, taken to whole texts.  Null ids and null labels take no part, nor do ids with
    contradicting labels; of rows that repeat an id one text counts.
    """
    chosen = (labels.filter(use & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id"))
              .agg(F.min(label_col).alias("y"), F.max(label_col).alias("_y"))
              .filter("y = _y").drop("_y"))
    chosen = draw(chosen, "_id", ["y"], max_documents)     # two numbers a row
    rows = (docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
            .groupBy(F.col("_id").cast("string").alias("id"), F.col("y").cast("int").alias("y"))
            .agg(F.min_by("text", F.xxhash64("text")).alias("text")))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        for batch in batches:
            bags = [encoder.passages(text).astype("<f4").tobytes() for text in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "bag": bags})

    sample = (rows.mapInPandas(encode, "id string, y int, bag binary").toPandas()
              .sort_values("id", kind="stable"))
    network = Network()
    bags = [np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b in sample["bag"]]
    network.fit(bags, sample["y"].to_numpy(np.float32))
    return network


def scorer(network: Network):
    """Column function text -> score; every task has its own encoder."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder()
        for batch in batches:
            texts, out = batch.tolist(), []
            for at in range(0, len(texts), 256):
                out += network.scores([encoder.passages(t) for t in texts[at:at + 256]]).tolist()
            yield pd.Series(out, dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def score(docs: DataFrame, network: Network, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: better) for every row, whole texts.

    Null and empty texts are one passage without words; without training labels, or with labels of
    one kind, all rows score the smoothed share of good labels; repeated rows are scored each; an
    empty table gives an empty result; other columns are not read.
    """
    return text_batches(docs).select(F.col(id_col).alias("doc_id"),
                                     scorer(network)(F.col(text_col)).alias("score"))


def keep_good(docs: DataFrame, network: Network, least: float = 0.5,
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that score ``least`` or more.

    Null and empty texts are judged as one passage without words; repeated rows are judged alike; an
    empty table gives an empty one; columns may have any names.
    """
    return text_batches(docs).filter(scorer(network)(F.col(text_col)) >= least)
