"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Training follows the regularised leader (FTRL-proximal) with an elastic net, on a bounded sample
per language; a part of the sample is set aside to calibrate the temperature of the softmax.
Document frequencies are counted over all training documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide.llm.common import text_batches, unused

BUCKETS = 1 << 14              # hashed n-grams of one to three characters
NGRAMS = (1, 2, 3)
PER_LANGUAGE = 500             # sampled training documents of a language
SAMPLED = 128_000              # sampled training documents of all languages, shared out evenly
LEAST_SAMPLED = 20             # of a language, however many there are
BLOCK = 1024                   # rows of a block in the calibration
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([unicodedata.category(c)[0] == "L" for c in map(chr, range(0x110000))])


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a whole text's n-grams; None if it has no letter.

    Everything but letters counts as a blank."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    known = letters()[codes]
    if not known.any():
        return None
    x = np.where(known, codes, np.uint32(32))
    total = np.zeros(BUCKETS, np.int64)
    key = np.zeros(len(x), np.uint32)
    for n in NGRAMS:
        if len(x) < n:
            break
        key = key[:len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1:] + np.uint32(n)
        mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x9E3779B1)
        total += np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray            # language x bucket, mostly zeros
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1.0 + np.log(n)) * self.idf[at]
        return x / np.sqrt((x * x).sum())

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ self.vector(at, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*found) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS,
             seed: int = 7) -> None:
    """Follow the regularised leader, one document after the other."""
    k = len(model.languages)
    z, n = np.zeros((k, BUCKETS)), np.zeros((k, BUCKETS))
    zb, nb = np.zeros(k), np.zeros(k)

    def leader(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0,
                        -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, count, y = rows[i]
            x = model.vector(at, count)
            zi, ni = z[:, at], n[:, at]
            w, b = leader(zi, ni, L1), leader(zb, nb, 0.0)
            error = softmax(w @ x + b)
            error[y] -= 1.0
            g = error[:, None] * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[:, at] = zi + g - step * w
            n[:, at] = ni + g * g
            step = (np.sqrt(nb + error ** 2) - np.sqrt(nb)) / ALPHA
            zb, nb = zb + error - step * b, nb + error ** 2
    for row, seen in zip(z, n, strict=True):       # in place: with many languages z is large
        row[:] = leader(row, seen, L1)
    model.weights, model.bias = z, leader(zb, nb, 0.0)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    """Temperature of least log loss on rows the weights have not seen (golden section).

    Labels count as wrong once in ``rows + 2``, else rows without an error would ask for certainty.
    """
    if not rows:
        return 1.0
    logits = np.array([model.logits(at, n) for at, n, _ in rows])
    y = np.array([r[2] for r in rows])
    doubt = 1.0 / (len(rows) + 2)

    def loss(log_t: float) -> float:
        total = 0.0
        for i in range(0, len(y), BLOCK):
            s, right = logits[i:i + BLOCK] / np.exp(log_t), y[i:i + BLOCK]
            s = s - s.max(axis=1, keepdims=True)
            told = (1.0 - doubt) * s[np.arange(len(right)), right] + doubt * s.mean(axis=1)
            total += float((np.log(np.exp(s).sum(axis=1)) - told).sum())
        return total / len(y)

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn every language of the rows where ``use`` holds and the language is known.

    Counts over all of them: documents per language, documents per n-gram bucket.  The weights come
    from about ``per_language`` documents of each language (all, if fewer; with many languages an
    even share of ``SAMPLED``, but ``LEAST_SAMPLED`` or more), drawn by a hash of id and text; a fifth of
    those calibrates, never the first of a language.  Without such rows nothing is learnt.
    """
    rows = text_batches(docs).filter(use).select(F.col(id_col).cast("string").alias("id"),
                                   F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .collect()}                                                    # one row per language
    languages = sorted(counts)
    model = Model(languages, np.ones(BUCKETS), np.zeros((len(languages), BUCKETS)),
                  np.zeros(len(languages)))
    if not languages:
        return model

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found = grams(text)
                if found is not None:
                    df[found[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)})

    seen = (rows.select("text").mapInPandas(count, "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())          # one row per bucket
    total = next((r["n"] for r in seen if r["bucket"] < 0), 0)
    df = np.zeros(BUCKETS)
    for r in seen:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    model.idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(grams(t), lang, h) for t, lang, h in
                     zip(batch["text"], batch["lang"], batch["h"], strict=True)]
            found = [x for x in found if x[0] is not None]
            if found:
                yield pd.DataFrame({
                    "lang": [x[1] for x in found], "h": [x[2] for x in found],
                    "at": [x[0][0] for x in found], "n": [x[0][1] for x in found]})

    goal = min(per_language, max(LEAST_SAMPLED, SAMPLED // len(languages)))
    shares = docs.sparkSession.createDataFrame(
        [(lang, min(1.0, goal / n)) for lang, n in counts.items()], "lang string, share double")
    h = F.xxhash64("id", "text")
    sampled = (rows.join(F.broadcast(shares), "lang")
               .filter(F.pmod(h, F.lit(1_000_000)) < F.col("share") * 1_000_000)
               .groupBy("lang", h.alias("h")).agg(F.first("text").alias("text"))   # repeats are one
               .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
               .filter(F.col("place") <= 2 * goal).drop("place")
               .mapInPandas(encode, "lang string, h bigint, at array<int>, n array<bigint>")
               .toPandas().sort_values("h", kind="stable"))
    at = {lang: i for i, lang in enumerate(languages)}
    data = [(np.asarray(a), np.asarray(n), at[lang])
            for a, n, lang in zip(sampled["at"], sampled["n"], sampled["lang"], strict=True)]
    aside = ((sampled["h"].to_numpy() // 1_000_000) % 5 == 0) & sampled.duplicated("lang").to_numpy()
    fit_ftrl(model, [r for r, a in zip(data, aside, strict=True) if not a] or data)
    model.temperature = calibrate(model, [r for r, a in zip(data, aside, strict=True) if a])
    return model


def predictor(model: Model):
    """Column function text -> (lang_pred, score)."""
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [model.predict(t) for t in texts]
        return pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "lang_pred string, score double")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row, whole texts.

    Null texts and texts without a letter, and all texts if nothing was learnt, are ``und`` with
    score 0; repeated rows are scored each; an empty table gives an empty result; other columns are
    not read.
    """
    return (text_batches(docs).select(F.col(id_col).alias("doc_id"),
                        predictor(model)(F.col(text_col)).alias("_found"))
            .select("doc_id", "_found.lang_pred", "_found.score"))


def keep_known(docs: DataFrame, model: Model, least: float = 0.05,
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is told; ``und`` never is.

    With k languages the certainty must exceed an even share 1 / k by ``least`` of what is missing
    to 1, whatever their number.  The bound is low: a text of a word or two may be a good one.  Null
    and empty texts go; repeated rows are judged alike; an empty table gives an empty one; columns
    may have any names.
    """
    found, = unused(docs.columns, "_lang_found")
    even = 1.0 / max(len(model.languages), 1)
    out = text_batches(docs).withColumn(found, predictor(model)(F.col(f"`{text_col}`")))
    return (out.filter((F.col(f"{found}.lang_pred") != UNKNOWN)
                       & (F.col(f"{found}.score") >= even + least * (1.0 - even)))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
