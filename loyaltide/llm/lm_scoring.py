"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Tokens are lower-cased (A-Z) words and one end per text.  Counts of all training tokens come from
one grouped sum.  The model predicts symbols: the most frequent words, and for every other word the
bucket of its last two bytes.  The two symbols before a token, each scaled by the weights of its
position, add up to a prediction vector; its inner products with all symbols' vectors plus their
biases, normalised over all symbols, are the symbol's probability (Mnih and Hinton 2007).  A word of
a bucket then has its smoothed share of the bucket.  The probabilities of all words (and one for
words never seen, per bucket) add up to 1.

Training is one pass over all training tokens: every task starts from the unigram model, follows
noise-contrastive gradients (Mnih and Teh 2012) over its own rows, and the tasks' weights are
averaged by their numbers of tokens, in a grouped sum with one row per symbol.  Scoring normalises
each distinct context once per task, by matrix products over many of them.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyaltide.llm.common import text_batches
from loyaltide.staging import stage

WORDS = 448                    # frequent words with a symbol of their own (the end is one more)
BUCKETS = 63                   # symbols of all other words
DIM = 32
NOISE = 32                     # noise symbols of a minibatch
BATCH = 2048
RATE = 0.15
LOOKUP = 200_000               # at most so many frequent words' counts are known to every task
COUNTED = 500_000              # distinct words a task counts before it hands them on
CACHED_WORDS = 400_000
CONTEXTS = 16_384              # contexts normalised at a time
END = 0                        # the end of a text, and what stands before it
LN10 = float(np.log(10.0))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2 ** 63


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(rows: DataFrame) -> DataFrame:
    """``word (hash), bucket, n`` over all texts of ``rows`` (column ``text``), ends apart."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(c: Counter) -> pd.DataFrame:
            return pd.DataFrame({"word": [word_hash(w) for w in c],
                                 "bucket": [bucket_of(w) for w in c], "n": list(c.values())})
        counter: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counter.update(tokens_of(text))
                if len(counter) > COUNTED:
                    yield told(counter)
                    counter = Counter()
        yield told(counter).astype("int64")

    return (rows.select("text").mapInPandas(run, "word bigint, bucket bigint, n bigint")
            .groupBy("word").agg(F.max("bucket").alias("bucket"), F.sum("n").alias("n")))


@dataclass
class Vocabulary:
    """Counts every task knows: frequent words, and the totals."""

    tokens: int                    # N, ends included
    distinct: int                  # V, the end included
    ends: int
    hashes: np.ndarray             # of the most frequent words, most frequent first
    counts: np.ndarray
    bucket_tokens: np.ndarray      # words without a symbol of their own, per bucket
    bucket_words: np.ndarray

    @property
    def symbols(self) -> int:
        return 1 + WORDS + BUCKETS

    def unigram(self) -> np.ndarray:
        """Smoothed share of every symbol."""
        n = np.ones(self.symbols)
        n[END] += self.ends
        own = self.counts[:WORDS]
        n[1:1 + len(own)] += own
        n[1 + WORDS:] += self.bucket_tokens
        return n / n.sum()


class Reader:
    """Texts as symbols, with the part of the log probabilities that no model has to learn."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.rank = {h: i for i, h in enumerate(v.hashes.tolist())}
        self.known: dict[bytes, int] = {}
        size = 1024
        self.symbol = np.zeros(size, np.int64)
        self.log_count = np.zeros(size)            # log10(c + 1) where the count is known
        self.inside = np.zeros(size)               # log10 share of the bucket, without log_count
        self.rare = np.zeros(size, np.int64)       # hash of a word whose count is not known here
        self.is_rare = np.zeros(size, bool)
        self.in_bucket = np.log10(v.bucket_tokens + v.bucket_words + 1.0)

    def _add(self, word: bytes) -> int:
        at = self.known[word] = len(self.known)
        if at >= len(self.symbol):
            for name in ("symbol", "log_count", "inside", "rare", "is_rare"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        h = word_hash(word)
        rank = self.rank.get(h)
        b = bucket_of(word)
        own = rank is not None and rank < WORDS
        self.symbol[at] = 1 + rank if own else 1 + WORDS + b
        self.log_count[at] = 0.0 if rank is None else np.log10(self.v.counts[rank] + 1.0)
        self.inside[at] = 0.0 if own else -self.in_bucket[b]
        self.rare[at] = h
        self.is_rare[at] = rank is None
        return at

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, -1 for each end, and the position after each text."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, add, ids, ends = self.known, self._add, [], []
        for text in texts:
            for w in tokens_of(text):
                i = known.get(w)
                ids.append(add(w) if i is None else i)
            ids.append(-1)
            ends.append(len(ids))
        return np.array(ids, np.int64), np.array(ends, np.int64)

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < 0, END, self.symbol[ids])


def contexts(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before; the end stands before a text begins."""
    before = np.r_[END, symbols[:-1]]
    before2 = np.r_[END, END, symbols[:-2]][:len(symbols)]
    starts = np.r_[0, ends[:-1]]
    before[starts] = END
    before2[starts] = END
    second = starts + 1
    before2[second[second < ends]] = END
    return before, before2


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``out[at] += rows`` with repeated positions added up."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out[ordered[starts]] += np.add.reduceat(rows[order], starts, axis=0)


@dataclass
class LogBilinear:
    """``R``: context vectors, ``Q``: target vectors, ``b``: biases, ``C``: weights of positions."""

    R: np.ndarray
    Q: np.ndarray
    b: np.ndarray
    C: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 5) -> LogBilinear:
        r = np.random.default_rng(seed)
        k = len(unigram)
        small = lambda: (r.standard_normal((k, DIM)) * 0.1).astype(np.float32)
        return cls(small(), small(), np.log(unigram).astype(np.float32),
                   np.array([[1.0] * DIM, [0.5] * DIM], np.float32))

    def predict(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.R[one] * self.C[0] + self.R[two] * self.C[1]

    def learn(self, symbols: np.ndarray, ends: np.ndarray, unigram: np.ndarray,
              noise: np.random.Generator, history: dict[str, np.ndarray]) -> None:
        """Noise-contrastive AdaGrad steps over a stretch of texts."""
        one, two = contexts(symbols, ends)
        log_noise = np.log(unigram * NOISE).astype(np.float32)
        edges = np.cumsum(unigram)
        for at in range(0, len(symbols), BATCH):
            t, c1, c2 = symbols[at:at + BATCH], one[at:at + BATCH], two[at:at + BATCH]
            drawn = np.minimum(np.searchsorted(edges, noise.random(NOISE)), len(edges) - 1)
            h = self.predict(c1, c2)
            q, qn = self.Q[t], self.Q[drawn]
            good = np.einsum("ij,ij->i", h, q) + self.b[t] - log_noise[t]
            bad = h @ qn.T + (self.b[drawn] - log_noise[drawn])
            dg = -1.0 / (1.0 + np.exp(np.clip(good, -30, 30)))            # of -log sigmoid
            db = 1.0 / (1.0 + np.exp(-np.clip(bad, -30, 30)))
            n = np.float32(1.0 / len(t))
            dh = dg[:, None] * q + db @ qn
            grads = {"Q": np.zeros_like(self.Q), "b": np.zeros_like(self.b),
                     "R": np.zeros_like(self.R), "C": np.zeros_like(self.C)}
            _add_rows(grads["Q"], t, dg[:, None] * h)
            _add_rows(grads["Q"], drawn, db.T @ h)
            grads["b"] += np.bincount(t, dg, len(self.b)).astype(np.float32)
            grads["b"] += np.bincount(drawn, db.sum(axis=0), len(self.b)).astype(np.float32)
            for i, c in enumerate((c1, c2)):
                grads["C"][i] = (dh * self.R[c]).sum(axis=0)
                _add_rows(grads["R"], c, dh * self.C[i])
            for k, g in grads.items():
                g *= n
                history[k] += g * g
                getattr(self, k)[...] -= RATE * g / (np.sqrt(history[k]) + 1e-4)

    def rows(self) -> np.ndarray:
        """One row of numbers per symbol, and two for the positions."""
        main = np.concatenate([self.R, self.Q, self.b[:, None]], axis=1)
        rest = np.zeros((2, main.shape[1]), main.dtype)
        rest[:, :DIM] = self.C
        return np.concatenate([main, rest])

    @classmethod
    def of_rows(cls, rows: np.ndarray) -> LogBilinear:
        rows = rows.astype(np.float32)
        main = rows[:-2]
        return cls(main[:, :DIM].copy(), main[:, DIM:2 * DIM].copy(), main[:, 2 * DIM].copy(),
                   rows[-2:, :DIM].copy())

    def log10(self, symbols: np.ndarray, ends: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of every symbol.

        ``norms`` holds the log normaliser of every context met so far (NaN: not yet), so each
        distinct context is normalised once.
        """
        one, two = contexts(symbols, ends)
        k = len(self.b)
        pairs = one * k + two
        new = np.unique(pairs[np.isnan(norms[pairs])])
        for at in range(0, len(new), CONTEXTS):
            part = new[at:at + CONTEXTS]
            s = self.predict(part // k, part % k) @ self.Q.T + self.b
            top = s.max(axis=1, keepdims=True)
            norms[part] = np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]
        own = np.einsum("ij,ij->i", self.predict(one, two), self.Q[symbols]) + self.b[symbols]
        return (own - norms[pairs]) / LN10

    def no_norms(self) -> np.ndarray:
        return np.full(len(self.b) ** 2, np.nan)


@dataclass
class Model:
    vocabulary: Vocabulary
    network: LogBilinear
    counts: DataFrame              # word, bucket, n of all training words


def train(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text",
          lookup: int = LOOKUP) -> Model:
    """Count and learn from all rows where ``use`` holds (null texts are empty)."""
    rows = text_batches(docs).filter(use).select(F.col(text_col).alias("text"))
    counts = stage(count_words(rows), "lm-counts")
    ends = rows.count()
    # The words of the highest count levels that fit the bound together; a level is a twentieth of
    # a factor of two, so there are some hundred levels however many words there are.
    level = F.floor(F.log2("n") * 20)
    sizes = {r["level"]: r["w"] for r in counts.groupBy(level.alias("level"))
             .agg(F.count(F.lit(1)).alias("w")).collect()}
    fits, least = 0, max(sizes, default=0) + 1
    for at in sorted(sizes, reverse=True):
        fits += sizes[at]
        if fits > max(lookup, WORDS):
            break
        least = at
    top = (counts.filter(level >= least).toPandas()
           .sort_values(["n", "word"], ascending=[False, True], kind="stable"))
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    per_bucket = {r["bucket"]: (r["n"], r["w"]) for r in counts.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("w")).collect()}
    bucket_tokens = np.array([per_bucket.get(b, (0, 0))[0] for b in range(BUCKETS)], float)
    bucket_words = np.array([per_bucket.get(b, (0, 0))[1] for b in range(BUCKETS)], float)
    own = top.head(WORDS)                              # they are outside the buckets
    np.subtract.at(bucket_tokens, own["bucket"].to_numpy(np.int64), own["n"].to_numpy(float))
    np.subtract.at(bucket_words, own["bucket"].to_numpy(np.int64), 1.0)
    vocabulary = Vocabulary(int(words) + ends, int(distinct) + (ends > 0), ends,
                            top["word"].to_numpy(np.int64), top["n"].to_numpy(np.float64),
                            bucket_tokens, bucket_words)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)      # at most ``lookup`` words
    unigram = vocabulary.unigram()
    columns = [f"w{i}" for i in range(2 * DIM + 1)]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, network = Reader(shared.value), LogBilinear.start(unigram)
        history = {k: np.full_like(getattr(network, k), 1e-6) for k in ("R", "Q", "b", "C")}
        noise, seen = np.random.default_rng(17), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 500):
                ids, ends_ = reader.read(texts[at:at + 500])
                network.learn(reader.symbols(ids), ends_, unigram, noise, history)
                seen += len(ids)
        out = pd.DataFrame(network.rows().astype(np.float64) * seen, columns=columns)
        out.insert(0, "row", np.arange(len(out)))
        out["seen"] = float(seen)
        yield out

    schema = "row bigint, " + ", ".join(f"{c} double" for c in columns) + ", seen double"
    summed = (rows.mapInPandas(learn, schema).groupBy("row")
              .agg(*[F.sum(c).alias(c) for c in [*columns, "seen"]]).toPandas().sort_values("row"))
    if len(summed) and summed["seen"].iloc[0] > 0:
        network = LogBilinear.of_rows(summed[columns].to_numpy() / summed[["seen"]].to_numpy())
    else:
        network = LogBilinear.start(unigram)
    return Model(vocabulary, network, counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row, whole texts.

    Scores are log10 probabilities.  Null and empty texts consist of their end; repeated rows are
    scored each; nothing learnt means no word is known and all symbols are equally likely; an empty
    table gives an empty result; other columns are not read.  Words beyond those every task knows
    meet their counts in a join; they are rare by construction, so no key of it is hot.
    """
    v, network = model.vocabulary, model.network
    shared = docs.sparkSession.sparkContext.broadcast(v)
    id_type = docs.schema[id_col].dataType.simpleString()
    base_norm = float(np.log10(v.tokens + v.distinct + 1.0))
    end_known = v.ends > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, norms = Reader(shared.value), network.no_norms()
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 1000):
                ids, ends = reader.read(texts[at:at + 1000])
                symbols = reader.symbols(ids)
                is_end = ids < 0
                word = np.where(is_end, 0, ids)
                log_count = np.where(is_end, np.log10(v.ends + 1.0), reader.log_count[word])
                rare = ~is_end & reader.is_rare[word]
                inside = np.where(is_end | (symbols <= WORDS), 0.0, reader.inside[word] + log_count)
                starts = np.r_[0, ends[:-1]]
                add = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                hashes = reader.rare[word]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[at:at + 1000].array,
                    "n_tokens": ends - starts,
                    "n_known": add((~rare & (~is_end | end_known)).astype(np.int64)),
                    "base_score": add(log_count - base_norm),
                    "score": add(network.log10(symbols, ends, norms) + inside),
                    "rare": [hashes[a:b][rare[a:b]]
                             for a, b in zip(starts, ends, strict=True)]})

    scored = stage(text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
                   .mapInPandas(run, f"doc_id {id_type}, n_tokens bigint, n_known bigint, "
                                "base_score double, score double, rare array<bigint>")
                   .withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    most = float(v.counts.min()) if len(v.counts) else float("inf")
    beyond = model.counts.filter(F.col("n") <= most)
    late = (scored.select("row", F.explode("rare").alias("word")).join(beyond, "word")
            .groupBy("row").agg(F.count(F.lit(1)).alias("_known"),
                                F.sum(F.log10(F.col("n") + 1.0)).alias("_log")))
    more = F.coalesce("_log", F.lit(0.0))
    return (scored.drop("rare").join(late, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score")))
