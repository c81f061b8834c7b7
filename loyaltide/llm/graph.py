"""Connected components of a link table, and a small filter that spares shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyaltide.llm.common import unused
from loyaltide.staging import stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` (the smallest node) for every node of ``edges`` (``a``, ``b``).

    Alternating large and small stars (Kiveris et al. 2014): every round links each node's larger
    neighbours, then its smaller ones, to the smallest node around it, until nothing changes.  Each
    round is two grouped minima and two joins; its links are written, so lineage stays short.
    """
    links = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                                F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(least, F.col("a") == F.col("u"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Large star keeps a link from every node to its least neighbour.
        large = large.unionByName(least.filter("m < u").select(F.col("u").alias("a"),
                                                               F.col("m").alias("b")))
        large = stage(large.filter("a <> b").distinct(), name)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = (large.join(low, F.col("a") == F.col("u"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"))
        small = small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        links = stage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .filter("a <> b").distinct(), name)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def keep_marked(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str,
                bits: int) -> DataFrame:
    """Rows of ``df`` whose key may be among the wanted ones, before a join that makes sure.

    The wanted keys set bits of a bitmap of ``2 ** bits`` positions, held in words of 64: at most
    ``2 ** (bits - 6)`` rows of 16 bytes whatever the data, so it may be broadcast.  With more keys
    than it can tell apart it merely filters less.
    """
    at, word, bit, mask = unused([*df.columns, wanted_column], "_p", "_word", "_bit", "_mask")

    def place(c):
        return F.pmod(F.xxhash64(F.col(c)), F.lit(2 ** bits))

    words = (wanted.select(place(wanted_column).alias(at))
             .select(F.shiftright(at, 6).alias(word), (F.col(at) % 64).cast("int").alias(bit))
             .groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias(mask)))
    placed = df.withColumn(at, place(column)).withColumn(word, F.shiftright(at, 6))
    return (placed.join(F.broadcast(words), word)
            .filter(F.expr(f"(shiftright({mask}, CAST({at} % 64 AS INT)) & 1L) = 1L"))
            .select(*[F.col(f"`{c}`") for c in df.columns]))
