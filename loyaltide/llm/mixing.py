"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; ``target / source_size`` copies of each of its documents
would meet it exactly.  The whole part is given to every document.  Of ``m`` equal documents with
the fractional part ``p``, ``floor(m * p)`` get one more at once, and what remains of ``m * p`` is
the fraction of a single document.  Fractions are rounded by duels: a document and the pool of the documents after it trade probability so that the words
they stand for together stay the same, in a random direction whose odds keep every probability
unchanged in expectation, until one side is integral (a pool takes its gain or loss in proportion,
so it is known by two numbers).  Documents duel in blocks of bounded size, largest first; what is
left over of a block is one small document, which enters a block of the next level, and so on: a
reduction tree whose levels are plain grouped aggregations.  A source misses its target by less
than the one document left at the root.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide.llm.common import WORD, uniform, unused
from loyaltide.staging import stage

FAN = 64                       # documents (or residuals) of a block
CHUNK = 100_000                # equal rows reported by one task


def words(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(totals: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """Targets per source: weight-proportional shares of ``share`` times all words, capped.

    ``totals`` has one row per source (``source``, ``source_size``).  Sources take the weights in
    code point order, null last.  Filling by weight with caps has a closed form: in the order of
    cap / weight, the first source whose share of what is left does not exceed its cap fixes the
    level of all later ones.  One row per source, so the windows run over pre-aggregated rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (totals
              .withColumn("_rank", F.row_number().over(by_name))
              .withColumn("_w", F.element_at(pattern, (F.pmod(F.col("_rank") - 1, F.lit(len(weights)))
                                                       + 1).cast("int")))
              .withColumn("_cap", F.col("source_size") * F.lit(cap))
              .withColumn("_ratio", F.col("_cap") / F.col("_w")))
    order = Window.orderBy("_ratio", "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    level = ((F.lit(share) * F.sum("source_size").over(everything)
              - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    levelled = ranked.withColumn("_level", level)
    open_level = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))
    filled = levelled.withColumn("_fill", F.min(open_level).over(everything)["_level"])
    return filled.select(*totals.columns, F.coalesce(
        F.least(F.col("_cap"), F.col("_fill") * F.col("_w")), F.col("_cap")).alias("target"))


def _duel(acc: Column, x: Column) -> Column:
    """One step of the fold: document ``x`` against the pool of all later ones of its block.

    The pool's probabilities are ``a * p + b`` of those it came with; it has ``size`` words in all
    and stood for ``mass`` of them at first.
    """
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), acc["a"] * x["p"] + acc["b"]))
    size = F.greatest(F.lit(0.0), acc["size"] - x["s"])
    mass0 = F.greatest(F.lit(0.0), acc["mass"] - x["p"] * x["s"])
    mass = F.least(size, acc["a"] * mass0 + acc["b"] * size)
    mine, lack, room = p * x["s"], (F.lit(1.0) - p) * x["s"], size - mass
    gain, loss = F.least(lack, mass), F.least(mine, room)       # most that x can win or lose
    up = x["u"] * (gain + loss) < loss
    settled = acc["a"] == 0.0                                   # the pool had been used up before
    closed = settled | F.when(up, lack <= mass).otherwise(mine <= room)
    part = F.when(settled, F.lit(0.0)).otherwise(
        F.when(closed, F.when(up, gain / mass).otherwise(loss / room)).otherwise(F.lit(1.0)))
    extra = F.when(F.when(settled, acc["b"] > 0.5).otherwise(up), F.lit(1)).otherwise(F.lit(0))
    done = F.struct(*[x[n].alias(n) for n in ("id", "size", "m", "whole", "full")],
                    extra.alias("extra"))
    return F.struct(
        F.when(closed, F.array_append(acc["done"], done)).otherwise(acc["done"]).alias("done"),
        F.when(closed, acc["cur"]).otherwise(x.withField("p", p + F.when(up, gain).otherwise(-loss)
                                                         / x["s"])).alias("cur"),
        (acc["a"] * (F.lit(1.0) - part)).alias("a"),
        (acc["b"] * (F.lit(1.0) - part) + F.when(up | settled, F.lit(0.0)).otherwise(part)).alias("b"),
        size.alias("size"), mass0.alias("mass"))


def _level(items: DataFrame) -> DataFrame:
    """Fold every block (``source``, ``block``) of ``item`` structs to ``done`` and ``cur``."""
    kind = items.schema["item"].dataType
    closed = (f"array<struct<id:{kind['id'].dataType.simpleString()},size:bigint,m:bigint,"
              f"whole:int,full:bigint,extra:int>>")
    start = F.struct(F.array().cast(closed).alias("done"), F.lit(None).cast(kind).alias("cur"),
                     F.lit(1.0).alias("a"), F.lit(0.0).alias("b"),
                     F.col("_size").alias("size"), F.col("_mass").alias("mass"))
    return (items.groupBy("source", "block")
            .agg(F.sort_array(F.collect_list("item")).alias("_items"),
                 F.sum("item.s").alias("_size"), F.sum(F.expr("item.p * item.s")).alias("_mass"))
            .withColumn("_out", F.aggregate("_items", start, _duel))
            .select("source", "block", "_out.done", "_out.cur"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
        cap: float = 2.0, seed: int = 11, name: str = "mix") -> DataFrame:
    """Copies of each document so that the sources meet their targets.

    Returns one row per distinct (id, source, size): ``id, source, size, m, source_size, target,
    copies, more`` where ``m`` counts equal rows of the input; ``more`` of them get ``copies + 1``
    copies, the others ``copies``.

    Null texts have size 0 and get the whole part; a null source is a source of its own, last in
    order; null ids are documents like others.  Repeated rows differ by one copy at most, so a row
    that repeats without end moves its source no further from the target than any other.  An empty
    table gives an empty result.  Other columns are not looked at.  All random numbers are hashes of
    id, size and ``seed``: reruns agree.
    """
    sizes = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                              words(F.col(text_col)).alias("size"))
                  .groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("m")), f"{name}-sizes")
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"),
                                         F.count(F.lit(1)).alias("units"))
    targets = stage(source_targets(totals, weights, share, cap).coalesce(1), f"{name}-targets")

    most = targets.agg(F.max("units")).first()[0] or 1
    blocks = math.ceil(most / FAN)                          # of the largest source
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share_of = F.col("m") * F.greatest(F.lit(0.0), F.col("_r") - F.col("whole"))
    rows = (sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]))
            .select("id", sizes["source"].alias("source"), "size", "m", "units", ratio.alias("_r"))
            .withColumn("whole", F.floor(F.col("_r") + F.lit(1e-12)).cast("int"))
            .withColumn("full", F.least(F.floor(share_of + F.lit(1e-9)), F.col("m")))
            .withColumn("p", F.greatest(F.lit(0.0), share_of - F.col("full"))))
    open_rows = (F.col("p") > 1e-9) & (F.col("size") > 0)
    out = [rows.filter(~open_rows).select("id", "source", "size", "m", F.col("whole").alias("copies"),
                                          F.col("full").alias("more"))]
    s = F.col("size").cast("double")
    key = [F.col("id"), F.col("size")]
    items = rows.filter(open_rows).select(
        "source", F.pmod(F.xxhash64(*key, F.lit(seed)),
                         F.ceil(F.col("units") / FAN)).cast("bigint").alias("block"),
        F.struct((-s).alias("by"), F.xxhash64(*key, F.lit(seed + 1)).alias("tie"), F.col("id"),
                 s.alias("s"), "p", uniform(*key, F.lit(seed + 2)).alias("u"), "size", "m",
                 "whole", "full").alias("item"))
    depth = 0
    while True:
        level = stage(_level(items), f"{name}-level{depth}")
        out.append(level.select("source", F.explode("done").alias("d")).select(
            "d.id", "source", "d.size", "d.m", F.col("d.whole").alias("copies"),
            (F.col("d.full") + F.col("d.extra")).alias("more")))
        if blocks == 1:
            break
        depth, blocks = depth + 1, math.ceil(blocks / FAN)
        # A fresh number for the next duels of a residual: the old one has been used.
        fresh = uniform(F.col("cur.id"), F.col("cur.size"), F.lit(seed + 2 + 7 * depth))
        items = level.filter(F.col("cur").isNotNull()).select(
            "source", F.floor(F.col("block") / FAN).alias("block"),
            F.col("cur").withField("u", fresh).alias("item"))
    last = uniform(F.col("cur.id"), F.col("cur.size"), F.lit(seed + 1_000_003))
    out.append(level.filter(F.col("cur").isNotNull()).select(
        "cur.id", "source", "cur.size", "cur.m", F.col("cur.whole").alias("copies"),
        (F.col("cur.full") + F.when(last < F.col("cur.p"), 1).otherwise(0)).alias("more")))
    decided = out[0]
    for part in out[1:]:
        decided = decided.unionByName(part)
    return (decided.join(targets, decided["source"].eqNullSafe(targets["source"]))
            .select("id", decided["source"].alias("source"), "size", "m", "source_size", "target",
                    F.col("copies").cast("int").alias("copies"), "more"))


def _numbered(rows: DataFrame, key: Sequence[str], number: str) -> DataFrame:
    """Rows with their place among the rows of the same key, from 1.

    Counted by key and written partition, so rows of one key are numbered in many tasks; what meets
    in one task per key is a count for each partition.
    """
    part, before, at, *names = unused([*rows.columns, number], "_part", "_before", "_at",
                                       *[f"_key{i}" for i in range(len(key))])
    written = stage(rows.withColumn(part, F.spark_partition_id()), "mix-repeats")
    counts = written.groupBy(*key, part).agg(F.count(F.lit(1)).alias(before))
    upto = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*[F.col(k).alias(name) for k, name in zip(key, names, strict=True)],
                           F.col(part).alias(at),
                           F.coalesce(F.sum(before).over(upto), F.lit(0)).alias(before))
    match = F.col(part) == F.col(at)
    for k, name in zip(key, names, strict=True):
        match = match & F.col(k).eqNullSafe(F.col(name))
    own = Window.partitionBy(*key, part).orderBy(F.lit(0))
    return (written.withColumn(number, F.row_number().over(own)).join(offset, match)
            .withColumn(number, F.col(number) + F.col(before)))


def apply_mix(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id",
              text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows: every document as often as decided, with the columns of ``docs``.

    Nulls match nulls; of rows with one id, source and size, as many get one more copy as decided
    (which of them is open: they are equal but for other columns).  Rows of sources with target 0 go.
    An empty table gives an empty result; ``docs`` may have any columns, under any names.
    """
    size, key, source, n, m, copies, more, number, copy = unused(
        docs.columns, "_size", "_id", "_source", "_n", "_m", "_copies", "_more", "_number", "_copy")
    sized = docs.withColumn(size, words(F.col(f"`{text_col}`")))
    d = decisions.select(F.col("id").alias(key), F.col("source").alias(source),
                         F.col("size").alias(n), F.col("m").alias(m), F.col("copies").alias(copies),
                         F.col("more").alias(more)).filter((F.col(copies) > 0) | (F.col(more) > 0))
    match = (F.col(f"`{id_col}`").eqNullSafe(F.col(key))
             & F.col(f"`{source_col}`").eqNullSafe(F.col(source)) & (F.col(size) == F.col(n)))
    joined = sized.join(d, match)
    divided = (F.col(more) > 0) & (F.col(more) < F.col(m))
    parts = [joined.filter(~divided).withColumn(
        copies, F.col(copies) + F.when(F.col(more) > 0, 1).otherwise(0))]
    if not d.filter(divided).isEmpty():
        placed = _numbered(joined.filter(divided), [key, source, n], number)
        parts.append(placed.withColumn(
            copies, F.col(copies) + F.when(F.col(number) <= F.col(more), 1).otherwise(0)))
    out = None
    for part in parts:
        part = (part.filter(F.col(copies) > 0)
                .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
                .select(*[F.col(f"`{c}`") for c in docs.columns]))
        out = part if out is None else out.unionByName(part)
    return out


def mix_report(docs: DataFrame, **kwargs) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and source, copies."""
    d = mix(docs, **kwargs)
    # Many equal rows are made in chunks that different tasks write.
    chunks = (d.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / CHUNK))))
              .repartition("id", "size", "_chunk")
              .withColumn("_from", F.col("_chunk") * CHUNK + 1)
              .withColumn("_to", F.least(F.col("m"), (F.col("_chunk") + 1) * CHUNK))
              .filter("_from <= _to"))
    rows = chunks.withColumn("_row", F.explode(F.sequence(F.col("_from"), F.col("_to"))))
    copies = F.col("copies") + F.when(F.col("_row") <= F.col("more"), 1).otherwise(0)
    return rows.select(F.col("id").alias("doc_id"), F.col("size"), F.col("source_size"),
                       F.col("target"), (F.col("size") * copies).alias("taken"), "source",
                       copies.alias("copies"))
