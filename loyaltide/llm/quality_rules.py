"""Quality rules whose cut-offs adapt to each language and source.

Every document gets a few counts.  Their rates enter quantile sketches: logarithmic buckets of a
relative width (DDSketch, Masson et al. 2019), so a sketch is a set of (bucket, count) rows, two
sketches merge by adding counts, and neither order nor partitioning can change a quantile.  Sketches
of a language, and of all documents, are the merged counts of the finer ones.

A group's own cut-off of a rate is the largest of: its third quartile plus a multiple of the quartile
distance; a few occurrences in a document of the group's shorter kind (by the quartile of lengths),
which chance alone may bring; and, as far as the rate is usual in the group, a multiple of a high
quantile of the documents that have it (their rates have a long tail).  A group with ``n`` documents
weighs its own cut-off ``n / (n + k)`` against that of its language, and a language against all
documents, so nothing jumps with the size of a group.  The filter joins the cut-offs to the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide.llm.common import WORD
from loyaltide.staging import stage

WINDOW = 8                     # words of a repeated passage
ALPHA = 0.01                   # relative error of a quantile
GAMMA = (1 + ALPHA) / (1 - ALPHA)
LEAST = 1e-6                   # rates below are zero
ZERO = -100_000                # their bucket
PRIOR = 100                    # documents that weigh as much as the coarser group
REACH = 6.0                    # quartile distances beyond the quartile

#: rate -> occurrences (in words or characters) that chance may bring to a short document, and what
#: its length is counted in.
BY_CHANCE = {"symbols": (16.0, "word_chars"), "repeats": (16.0, "n_words"),
             "dup_lines": (16.0, "n_words"), "stutters": (16.0, "n_words")}
#: rate -> share of a group's documents that have it, up to which its tail counts for nothing; from
#: twice that share on it counts in full.
USUAL = {"symbols": 0.1, "repeats": 0.01, "dup_lines": 0.1, "stutters": 0.1}
HIGH, TIMES = 0.9, 2.0         # the tail: quantile of the documents that have the rate, multiple
#: Mean word lengths differ by chance with the square root of the number of words.
LENGTH, LENGTH_BY_CHANCE = "word_length", 24.0
RATES = [*BY_CHANCE, LENGTH]
SIZES = ["n_words", "word_chars"]
CUTS = [f"{r}_high" for r in RATES] + [f"{LENGTH}_low"]


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more; ``hashes`` has one number per window start."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(hashes) - 1

    def starts(s: Column) -> Column:
        twice = lambda k: (((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"]))
                           | ((k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"])))
        found = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(twice(k), s[k]["i"]))
        return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

    positions = F.transform(F.array(placed), starts)[0]
    covered = F.aggregate(
        positions, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("n"),
                                (i + WINDOW).alias("end")))
    return covered["n"]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts per document: ``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_stutters`` (words equal to the one before).  All 0 for a null text.  Whole texts, one row at a time, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
                     F.col(source_col).alias("source"), text.alias("_text"))
    df = df.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.col("_hashes")[i + k] for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_windows", windows)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("_lines", lines)
    symbols = F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", ""))
    stutters = F.size(F.filter("_hashes", lambda h, i: (i > 0) & (
        h == F.col("_hashes")[F.greatest(i - 1, F.lit(0))])))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return df.select(
        "doc_id", "lang", "source", n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(repeated, _repeat_words(F.col("_windows"))).otherwise(F.lit(0)).cast("bigint")
        .alias("n_repeat_words"), stutters.cast("bigint").alias("n_stutters"))


def rates(measured: DataFrame) -> DataFrame:
    """The rates the rules look at; null for a document without words."""
    words = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    return (measured
            .withColumn("symbols", F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
                        + words * 0.0)
            .withColumn("repeats", F.col("n_repeat_words") / words)
            .withColumn("dup_lines", F.col("n_dup_lines") / words)
            .withColumn("stutters", F.col("n_stutters") / words)
            .withColumn("word_length", F.col("word_chars") / words))


def sketch(rows: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Mergeable quantile sketches: ``by..., rate, bucket, n``.  Nulls take no part."""
    long = rows.select(*by, F.explode(F.array(*[
        F.struct(F.lit(v).alias("rate"), F.col(v).alias("value")) for v in values])).alias("_e"))
    value = F.col("_e.value")
    bucket = F.when(value < LEAST, F.lit(ZERO)).otherwise(
        F.ceil(F.log(value) / F.lit(math.log(GAMMA)))).cast("int")
    return (long.filter(value.isNotNull())
            .groupBy(*by, F.col("_e.rate").alias("rate"), bucket.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], probs: dict[str, float],
              tail: dict[str, float] | None = None) -> DataFrame:
    """``by..., rate, n`` and one column per quantile (a bucket's middle); with ``tail`` also
    ``n_tail`` and the quantiles by nearest rank, the largest of a few, of the values that are not
    zero (null if there are none)."""
    group = Window.partitionBy(*by, "rate")
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(
        F.lit(2.0 / (GAMMA + 1)) * F.pow(F.lit(GAMMA), F.col("bucket")))
    zeros = F.coalesce(F.sum(F.when(F.col("bucket") == ZERO, F.col("n"))).over(group), F.lit(0))
    aggs = [F.max("_all").alias("n"), *[
        F.min(F.when(F.col("_to") > F.lit(p) * (F.col("_all") - 1), F.col("_at"))).alias(k)
        for k, p in probs.items()]]
    if tail:
        n_tail, to = F.col("_all") - F.col("_zeros"), F.col("_to") - F.col("_zeros")
        aggs += [F.max(n_tail).alias("n_tail"), *[
            F.min(F.when((to > 0) & (to >= F.lit(p) * n_tail), F.col("_at"))).alias(k)
            for k, p in tail.items()]]
    return (sketches.withColumn("_to", F.sum("n").over(running))
            .withColumn("_all", F.sum("n").over(group)).withColumn("_at", at)
            .withColumn("_zeros", zeros).groupBy(*by, "rate").agg(*aggs))


def own_cuts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Cut-offs of each group by its own documents: ``by..., n`` and one column per cut-off."""
    table = quantiles(sketches, by, {"q1": 0.25, "q3": 0.75}, {"high": HIGH})
    wide = table.groupBy(*by).agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("rate") == r, F.col(q))).alias(f"{r}_{q}")
        for r in RATES + SIZES for q in ("q1", "q3", "n_tail", "high")])
    cuts = []
    for r, (few, length) in BY_CHANCE.items():
        usual = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"{r}_n_tail") / F.col("n")
                                               / USUAL[r] - 1.0))
        cuts.append(F.greatest(
            F.col(f"{r}_q3") + REACH * (F.col(f"{r}_q3") - F.col(f"{r}_q1")),
            F.lit(few) / F.col(f"{length}_q1"),
            F.coalesce(TIMES * usual * F.col(f"{r}_high"), F.lit(0.0))).alias(f"{r}_high"))
    reach = F.greatest(REACH * (F.col(f"{LENGTH}_q3") - F.col(f"{LENGTH}_q1")),
                       F.lit(LENGTH_BY_CHANCE) / F.sqrt(F.col("n_words_q1")))
    cuts += [(F.col(f"{LENGTH}_q3") + reach).alias(f"{LENGTH}_high"),
             (F.col(f"{LENGTH}_q1") - reach).alias(f"{LENGTH}_low")]
    return wide.select(*by, "n", *cuts)


def thresholds(measured: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Cut-offs per language and source: ``t_lang, t_source`` and ``<rate>_high`` / ``<rate>_low``.

    Learnt from the documents that pass the base rules; null languages and sources are groups.
    """
    good = rates(measured.filter(~base_failed())).withColumns(
        {c: F.col(c).cast("double") for c in SIZES})
    fine = stage(sketch(good, RATES + SIZES, ["lang", "source"]), "rule-sketches")
    levels = []
    for prefix, table in (("p", own_cuts(fine, ["lang", "source"])),
                          ("l", own_cuts(merge(fine, ["lang"]), ["lang"])),
                          ("e", own_cuts(merge(fine, []), []))):
        levels.append(table.select(*[F.col(c).alias(f"{prefix}_{c}") for c in table.columns]))
    pair, lang, every = levels
    joined = (pair.join(lang, F.col("p_lang").eqNullSafe(F.col("l_lang")))
              .crossJoin(F.broadcast(every)))              # one row
    weight = {d: F.col(f"{d}_n") / (F.col(f"{d}_n") + prior) for d in "pl"}

    def shrunk(cut: str) -> Column:
        of_lang = weight["l"] * F.col(f"l_{cut}") + (1 - weight["l"]) * F.col(f"e_{cut}")
        return (weight["p"] * F.col(f"p_{cut}") + (1 - weight["p"]) * of_lang).alias(cut)

    return joined.select(F.col("p_lang").alias("t_lang"), F.col("p_source").alias("t_source"),
                         *[shrunk(c) for c in CUTS])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def apply_rules(docs: DataFrame, prior: float = PRIOR, **columns: str) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` per document.

    Null and empty texts have no words and fail the base rule; null languages and sources form
    groups like others; repeated rows are judged alike, one row each; an empty table gives an empty
    result; other columns are not looked at.
    """
    measured = stage(measure(docs, **columns), "rule-counts")
    cuts = thresholds(measured, prior)
    rated = rates(measured)
    joined = rated.join(cuts, rated["lang"].eqNullSafe(cuts["t_lang"])
                        & rated["source"].eqNullSafe(cuts["t_source"]), "left")
    broken = F.lit(False)
    for r in RATES:
        broken = broken | F.coalesce(F.col(r) > F.col(f"{r}_high"), F.lit(False))
    broken = broken | F.coalesce(F.col(LENGTH) < F.col(f"{LENGTH}_low"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", base_failed().alias("base_failed"),
                         (~base_failed() & ~broken).alias("kept"))


def _rules_sql() -> str:
    """The same counts, sketches, cut-offs and verdicts in DuckDB."""
    rate = {"symbols": "n_symbols / greatest(word_chars, 1)", "repeats": "n_repeat_words / n_words",
            "dup_lines": "n_dup_lines / n_words", "stutters": "n_stutters / n_words",
            "word_length": "word_chars / n_words"}
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, CAST({r} AS DOUBLE) AS v FROM rated WHERE NOT base_failed"
                              for r in RATES + SIZES)
    broken = [f"coalesce({r} > {r}_high, false)" for r in RATES]
    broken.append(f"coalesce({LENGTH} < {LENGTH}_low, false)")
    cuts = []
    for r, (few, length) in BY_CHANCE.items():
        usual = f"greatest(0, least(1, {r}_n_tail / n / {USUAL[r]!r}::DOUBLE - 1))"
        cuts.append(f"greatest({r}_q3 + {REACH!r}::DOUBLE * ({r}_q3 - {r}_q1), {few!r}::DOUBLE / {length}_q1, "
                    f"coalesce({TIMES!r}::DOUBLE * {usual} * {r}_high, 0)) AS {r}_high")
    reach = (f"greatest({REACH!r}::DOUBLE * ({LENGTH}_q3 - {LENGTH}_q1), "
             f"{LENGTH_BY_CHANCE!r}::DOUBLE / sqrt(n_words_q1))")
    cuts += [f"{LENGTH}_q3 + {reach} AS {LENGTH}_high", f"{LENGTH}_q1 - {reach} AS {LENGTH}_low"]

    def level(name: str, by: str) -> str:
        part = f"PARTITION BY {by}{', ' if by else ''}rate"
        of = f"{by}, " if by else ""
        goal = "min(CASE WHEN upto > {p}::DOUBLE * (n - 1) THEN mid END) AS {q}"
        wide = ", ".join(f"max({q}) FILTER (WHERE rate = '{r}') AS {r}_{q}"
                         for r in RATES + SIZES for q in ("q1", "q3", "n_tail", "high"))
        return f""", {name} AS (SELECT {of}n, {', '.join(cuts)} FROM (SELECT {of}CAST(max(n) AS DOUBLE) AS n, {wide} FROM (
  SELECT {of}rate, max(n) AS n, {goal.format(p=0.25, q='q1')}, {goal.format(p=0.75, q='q3')}, CAST(max(n - zeros) AS DOUBLE) AS n_tail,
    min(CASE WHEN upto > zeros AND upto - zeros >= {HIGH!r}::DOUBLE * (n - zeros) THEN mid END) AS high
  FROM (SELECT *, sum(k) OVER ({part} ORDER BY bucket) AS upto, sum(k) OVER ({part}) AS n,
      coalesce(sum(CASE WHEN bucket = {ZERO} THEN k END) OVER ({part}), 0) AS zeros FROM
    (SELECT {of}rate, bucket, mid, count(*) AS k FROM sketch GROUP BY ALL)) GROUP BY ALL) GROUP BY ALL))"""

    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 8) AS t(k) GROUP BY 1),
counted AS (
  SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutters
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w) w
  LEFT JOIN covered USING (doc_id)),
rated AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  {', '.join(f'CASE WHEN n_words > 0 THEN CAST({e.split(" / ")[0]} AS DOUBLE) / {e.split(" / ")[1]} END AS {r}' for r, e in rate.items())} FROM counted),
sketch AS (SELECT *, CASE WHEN bucket = {ZERO} THEN 0.0::DOUBLE ELSE {2.0 / (GAMMA + 1)!r}::DOUBLE * pow({GAMMA!r}::DOUBLE, bucket) END AS mid
  FROM (SELECT lang, source, rate, CASE WHEN v < {LEAST!r}::DOUBLE THEN {ZERO} ELSE CAST(ceil(ln(v) / {math.log(GAMMA)!r}::DOUBLE) AS INTEGER) END AS bucket
        FROM ({long}) WHERE v IS NOT NULL)){level('fine', 'lang, source')}{level('by_lang', 'lang')}{level('everything', '')},
cuts AS (SELECT p.lang, p.source, {', '.join(f"p.n / (p.n + {float(PRIOR)!r}::DOUBLE) * p.{c} + (1 - p.n / (p.n + {float(PRIOR)!r}::DOUBLE)) * (l.n / (l.n + {float(PRIOR)!r}::DOUBLE) * l.{c} + (1 - l.n / (l.n + {float(PRIOR)!r}::DOUBLE)) * e.{c}) AS {c}" for c in CUTS)}
  FROM fine p JOIN by_lang l ON p.lang IS NOT DISTINCT FROM l.lang, everything e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(broken)}) AS kept
FROM rated LEFT JOIN cuts ON rated.lang IS NOT DISTINCT FROM cuts.lang AND rated.source IS NOT DISTINCT FROM cuts.source
"""


SQL = _rules_sql()
