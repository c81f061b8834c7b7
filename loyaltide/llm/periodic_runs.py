"""Periodic runs of words by seeds and diagonals.

A run with period ``q`` and length ``L`` is a diagonal: words ``i`` and ``i + q`` agree for
``L - q`` places in a row.  As ``L >= max(12, 2 q)``, a diagonal at a lag of at least ``K`` is at
least ``K`` long, so it holds two equal ``K``-grams ``q`` apart.  For the lags ``K .. 2K - 1`` the
``K``-grams of a document are indexed (6-grams for the lags below 8, then 8, 16, 32, ...), pairs of
equal ones at such a lag are its seeds, and each seed is extended both ways to its whole diagonal.
Seeds come in order of lag and place; the furthest word covered at the lag tells which of them lie
on a diagonal already extended, and the furthest word of runs found before which of them only
repeat a run of a smaller period.

Grams that occur once in their document leave the index, and longer grams are made of what is left
by joining the names of two halves.  A gram with a period ``p <= K / 2`` repeats every ``p`` words;
paired with every other occurrence it would cost the square of a run's length.  Two stretches of
that period that lie on one diagonal end together, or one of them is cut by the diagonal's end where
the other ends.  So pairs in which one side is the last gram of its stretch suffice (a gram without
another one at most ``K / 2`` further on), and there are only a few of them per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyaltide.llm.common import BLANKS, text_batches

SMALL = 6                      # words of the grams for lags below FIRST
FIRST = 8
CHUNK_WORDS = 200_000          # words of documents looked at together; a longer document alone

RUN = "struct<start:bigint,length:bigint,period:bigint>"

_A, _B, _C = (np.array([x], np.uint64) for x in
              (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of grams made of two shorter ones."""
    x = (left * _A) ^ (right + _B)
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, ...``, ``counts[k]`` numbers each, one after the other."""
    offset = np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + np.arange(len(offset)) - offset


def _repeated(names: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose name occurs twice or more, by name and place, and the number of the name."""
    if not len(place):
        return place, place
    order = np.argsort(names, kind="stable")
    sorted_ = names[order]
    same = sorted_[1:] == sorted_[:-1]
    twice = np.r_[same, False] | np.r_[False, same]
    group = np.cumsum(np.r_[True, ~same])[twice]
    return place[order[twice]], group


def _seeds_at(k: int, place: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal ``k``-grams at lags ``k .. 2k - 1``, one side the last of its stretch."""
    width = n + 4 * k
    key = group * width + place + 2 * k
    after = np.r_[np.where(group[1:] == group[:-1], place[1:] - place[:-1], width), width]
    last = after > k // 2
    own, at = key[last], place[last]
    lo, hi = np.searchsorted(key, own + k), np.searchsorted(key, own + 2 * k)
    right = _spread(lo, hi - lo)
    left = np.repeat(at, hi - lo)
    start, lag = [left], [place[right] - left]
    lo, hi = np.searchsorted(key, own - 2 * k, "right"), np.searchsorted(key, own - k, "right")
    before = _spread(lo, hi - lo)
    start.append(place[before])
    lag.append(np.repeat(at, hi - lo) - place[before])
    return np.concatenate(start), np.concatenate(lag)


def seeds(word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(k, place, lag)`` of all pairs of equal ``k``-grams needed, for one class of lags a time."""
    n = len(word)
    if n < 12:
        return
    one = _joined(word.astype(np.uint64), word.astype(np.uint64))
    two = _joined(one[:-1], one[1:])
    four = _joined(two[:-2], two[2:])
    six = _joined(four[:-2], two[4:])
    found = [np.flatnonzero(six[:-q] == six[q:]) for q in range(1, min(FIRST, len(six)))]
    yield SMALL, np.concatenate(found), np.repeat(np.arange(1, len(found) + 1),
                                                  [len(f) for f in found])
    k = FIRST
    names = _joined(four[:-4], four[4:])
    place, group = _repeated(names, np.arange(len(names)))
    while len(place):
        yield k, *_seeds_at(k, place, group, n)
        open_ = np.zeros(n + k, bool)
        open_[place] = True
        place = np.sort(place[open_[place + k]])
        longer = _joined(names[place], names[place + k])
        names = np.zeros(n, np.uint64)
        names[place] = longer
        k *= 2
        place, group = _repeated(longer, place)


def _to_extend(place: np.ndarray, lag: np.ndarray) -> Iterator[tuple[int, int]]:
    """Seeds by lag and place; of those next to one another, which share a diagonal, the first."""
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    new = np.r_[True, (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + 1)][:len(place)]
    return zip(place[new].tolist(), lag[new].tolist(), strict=True)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal items before the first difference of two rows of one length."""
    at, step, n = 0, 16, len(a)
    while at < n:
        differ = a[at:at + step] != b[at:at + step]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at += len(differ)
        step *= 2
    return n


def runs(word: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run in a row of word numbers, by start and period."""
    n = len(word)
    found: dict[tuple[int, int], int] = {}
    reach = np.zeros(n, np.int64)
    for k, place, lag in seeds(word):
        if found:
            # Both grams inside one run of a smaller period: the lag is a multiple of that period.
            reach[:] = 0
            for start, length in found:
                reach[start] = max(reach[start], start + length)
            np.maximum.accumulate(reach, out=reach)
            new = place + lag + k > reach[place]
            place, lag = place[new], lag[new]
        covered, lag_now = 0, 0
        for i, q in _to_extend(place, lag):
            if q != lag_now:
                covered, lag_now = 0, q
            if i < covered:
                continue
            forward = _agree(word[i:n - q], word[i + q:])
            if not forward:                               # names met by chance
                continue
            back = _agree(word[:i][::-1], word[q:i + q][::-1])
            covered = i + forward
            length = forward + back + q
            if length >= max(least, 2 * q):
                # Periods come in ascending order: the first one of a stretch is its smallest.
                found.setdefault((i - back, length), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def _chunks(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts in order, some documents at a time."""
    part, size = [], 0
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if part and size + len(words) > CHUNK_WORDS:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def _runs_of(part: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of every document: numbers of words differ between documents, so no run crosses."""
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for words in part for w in words),
                       np.int64)
    ends = np.cumsum([len(w) for w in part])
    word += np.repeat(np.arange(len(part)) * max(len(number), 1), np.diff(np.r_[0, ends]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in part]
    for start, length, period in runs(word, least):
        d = int(np.searchsorted(ends, start, "right"))
        out[d].append((start - int(ends[d - 1] if d else 0), length, period))
    return out


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words left when every run keeps its first period, joined by one space."""
    if found:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` per row: all runs of words, and the text without their repeats.

    Words are what stands between ASCII blanks.  A run is a stretch of words with smallest period
    ``q`` and at least ``max(least, 2 q)`` words that no neighbouring word extends; ``runs`` lists
    ``start`` (word number from 0), ``length`` and ``period`` by start and period.  ``least`` is 12
    or more: seeds count on it.  ``collapsed`` drops words that lie in some run after its first
    period and joins the others by one space.

    Null, empty and blank texts have no runs and collapse to the empty text; texts may be of any
    length (a document is looked at whole, in one task); repeated rows and null ids are rows like
    others; an empty table gives an empty result; other columns are not read.
    """
    if least < 12:
        raise ValueError("runs of fewer than 12 words are not indexed")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for part in _chunks(batch["text"].tolist()):
                found = _runs_of(part, least)
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
                texts = [_collapsed(w, f) for w, f in zip(part, found, strict=True)]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at:at + len(part)].array,
                                    "runs": rows, "collapsed": texts})
                at += len(part)

    return (text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(run, f"doc_id {id_type}, runs array<{RUN}>, collapsed string"))


def with_planted_period(docs: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """``doc_id, text``: every tenth document, by a checksum of its id, ends in a planted period.

    Let h be the crc32 of the id in decimal and g its tenth; where h is a multiple of ten and the
    text has n > 0 words, each word i from a = g % n on becomes word a + (i - a) % p of the
    original, p = 1 + (n - a) // (3 + g % 8).  A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.col(text_col), BLANKS, -1), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       (h % 10 == 0).alias("tenth"), F.floor(h / 10).alias("g"),
                       F.when(h % 10 == 0, words).alias("w"))
    planted = """
        CASE WHEN NOT tenth OR w IS NULL OR size(w) = 0 THEN text
        ELSE array_join(transform(sequence(0, size(w) - 1), i -> w[CAST(
               CASE WHEN i < g % size(w) THEN i
                    ELSE g % size(w) + (i - g % size(w))
                         % (1 + (size(w) - g % size(w)) DIV (3 + g % 8)) END AS INT)]), ' ') END"""
    return rows.select("doc_id", F.expr(planted).alias("text"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of the planted documents as numbers and digests, a row per row of ``docs``."""
    found = periodic_runs(with_planted_period(docs, id_col, text_col))
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, "
                  "'before', -r.start, 'short', -r.period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, "
                   "'\n')), '')")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"),
                    (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.short")).alias("period"),
                    F.expr("(1000 * best.length) DIV (-best.short)").alias("exponent_milli"),
                    _digest(lines).alias("runs_sha256"),
                    _digest(F.col("collapsed")).alias("collapsed_sha256")))
