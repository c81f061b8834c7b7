"""Shards of near equal bytes by k-d tree partitioning.

A node of the tree holds some documents and has to become ``k`` shards.  It is split along its
widest metadata dimension (log length, source, language) where ``ceil(k / 2) / k`` of its bytes lie
on the left: a weighted median, found by grouped sums over all documents of all open nodes at once,
first over the values of the dimension, then over one byte of a hash after the other within the
value that holds the median (two rounds: a 65536th of that value's bytes).  Nothing but one row per
open node reaches the driver; the tree has one split fewer than there are shards.

Documents with equal texts share their place in the tree, so a group of copies stays in one shard
and near one another, unless it is larger than a ``GROUP``-th of a shard: then its members are
placed one by one, because the shards must stay equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide.staging import stage

CODES = 250                    # values of a dimension
BYTES = 256                    # values of one byte of the hash
GROUP = 20
SLOT_ROWS = 4096               # rows numbered together
DIMENSIONS = ("d_length", "d_source", "d_lang")


@dataclass
class Node:
    """Shards ``first .. first + k - 1``; once split: left where (dimension, bytes) < ``at``."""

    first: int
    k: int
    dim: str = ""
    at: list[int] = field(default_factory=list)      # value, first byte, second byte
    before: int = 0                                  # bytes left of the cut known so far
    children: list[Node] = field(default_factory=list)

    @property
    def left_k(self) -> int:
        return (self.k + 1) // 2


def _leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in _leaves(c)] if node.children else [node]


def _where(node: Node, leaf) -> Column:
    """The tree as one nested CASE over the metadata columns; ``leaf`` gives a leaf's value."""
    if not node.children:
        return leaf(node)
    code, b1, b2 = node.at
    d, h1, h2 = F.col(node.dim), F.col("h1"), F.col("h2")
    left = (d < code) | ((d == code) & ((h1 < b1) | ((h1 == b1) & (h2 < b2))))
    return F.when(left, _where(node.children[0], leaf)).otherwise(_where(node.children[1], leaf))


def _cut(placed: DataFrame, root: Node, open_: list[Node], totals: dict[int, int],
         keys: list[tuple], value) -> dict[int, tuple[int, int, bool]]:
    """Per open node: the value at which the running bytes reach the left share, the bytes before
    it, and whether the share is nearer to its end than to its start.

    ``keys`` are the parts of the cut known so far; ``value`` gives a node's next column.
    """
    at = {n.first: n for n in open_}

    def leaf(n: Node) -> Column:
        if n.first not in at:
            return F.lit(None).cast("int")
        inside = F.lit(True)
        for k, column in zip(n.at, keys, strict=False):
            inside = inside & (column(n) == k)
        return F.when(inside, value(n).cast("int"))

    sums = (placed.select(_where(root, lambda n: F.lit(n.first)).alias("node"),
                          _where(root, leaf).alias("v"), "size")
            .filter(F.col("v").isNotNull())
            .groupBy("node", "v").agg(F.sum("size").alias("bytes")))
    running = Window.partitionBy("node").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    goal = _case({f: totals[f] * n.left_k / n.k - n.before for f, n in at.items()})
    cut = F.struct("v", (F.col("to") - F.col("bytes")).alias("b"),
                   (F.col("to") - F.col("goal") < F.col("bytes") / 2).alias("near"))
    rows = (sums.withColumn("to", F.sum("bytes").over(running)).withColumn("goal", goal)
            .groupBy("node").agg(F.coalesce(
                F.min(F.when(F.col("to") >= F.col("goal"), cut)), F.max(cut)).alias("c")))
    return {r["node"]: (r["c"]["v"], r["c"]["b"], r["c"]["near"]) for r in rows.collect()}


def _case(values: dict[int, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.col("node") == k, F.lit(float(v))).otherwise(out)
    return out


def kd_tree(placed: DataFrame, shards: int) -> Node:
    """Split until every leaf is one shard.  ``placed``: ``size, h1, h2`` and the dimensions."""
    root = Node(0, shards)
    while open_ := [n for n in _leaves(root) if n.k > 1]:
        node = _where(root, lambda n: F.lit(n.first)).alias("node")
        stats = placed.select(node, "size", *DIMENSIONS).groupBy("node").agg(
            F.sum("size").alias("bytes"),
            *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
        by_node = {r["node"]: r for r in stats}
        totals = {n.first: by_node[n.first]["bytes"] if n.first in by_node else 0 for n in open_}
        for n in open_:
            widths = {d: by_node[n.first][d] if n.first in by_node else 0 for d in DIMENSIONS}
            n.dim = max(DIMENSIONS, key=lambda d: widths[d])
        keys = [lambda n: F.col(n.dim), lambda n: F.col("h1"), lambda n: F.col("h2")]
        for i in range(3):
            cuts = _cut(placed, root, open_, totals, keys[:i], keys[i])
            for n in open_:
                v, before, near = cuts.get(n.first, (0, 0, False))
                n.at.append(v + 1 if near and i == 2 else v)
                n.before += before
        for n in open_:
            n.children = [Node(n.first, n.left_k), Node(n.first + n.left_k, n.k - n.left_k)]
    return root


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    A null text counts as empty (size 8, checksum 0); null languages and sources are values of
    their own; repeated rows are rows like others and share their group's shard; an empty table
    gives an empty result; other columns are not looked at.  ``slot`` numbers the rows of a shard
    from 0 without gaps.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("sig"),
        F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), "shard-sizes")
    total, longest = base.agg(F.sum("size"), F.max("size")).first()
    total, rows = total or 0, base.count()
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(CODES)).cast("int")
    same = ["sig", "text_crc32", "size"]
    groups = base.groupBy(*same).agg(
        F.count(F.lit(1)).alias("copies"), F.min("lang").alias("g_lang"),
        F.min("source").alias("g_source")).select(
            *[F.col(c).alias(f"g_{c}") for c in same],
            ((F.col("size") * F.col("copies") > F.lit(total / (shards * GROUP)))
             & (F.col("copies") > 1)).alias("large"), "g_lang", "g_source")
    match = F.col("sig") == F.col("g_sig")
    for c in same[1:]:
        match = match & (F.col(c) == F.col(f"g_{c}"))
    place = F.when(F.col("large"), F.xxhash64("sig", "doc_id")).otherwise(F.xxhash64("sig"))
    span = F.log2(F.lit(float(max(longest or 8, 16)))) - 3.0           # sizes start at 8 = 2 ** 3
    length = F.floor((F.log2("size") - 3.0) / span * (CODES - 1)).cast("int")
    placed = stage(
        base.join(groups, match)
        .select("doc_id", "size", "text_crc32", "sig", place.alias("h"), length.alias("d_length"),
                code(F.col("g_source")).alias("d_source"), code(F.col("g_lang")).alias("d_lang"))
        .withColumn("h1", F.shiftright("h", 8).bitwiseAND(BYTES - 1).cast("int"))
        .withColumn("h2", F.col("h").bitwiseAND(BYTES - 1).cast("int")).drop("h"), "shard-places")
    tree = kd_tree(placed, shards)
    buckets = max(1, -(-rows // (shards * SLOT_ROWS)))
    sharded = placed.select(
        "doc_id", "size", "text_crc32", "sig", _where(tree, lambda n: F.lit(n.first)).alias("shard"),
        F.pmod(F.xxhash64("sig", "doc_id"), F.lit(buckets)).alias("bucket"))
    counts = sharded.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = (Window.partitionBy("shard").orderBy("bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0))
                            .alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("sig", "doc_id")
    return (sharded.withColumn("row", F.row_number().over(inside))
            .join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("offset") + F.col("row") - 1).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard, each file a range of slots.

    Needs ids that name one row each."""
    ids = sharded.select(F.col("doc_id").alias("_sid"), F.col("shard"), F.col("slot").alias("_slot"))
    (docs.join(ids, docs[id_col].eqNullSafe(ids["_sid"]))
     .repartitionByRange(F.col("shard"), F.col("_slot"))
     .sortWithinPartitions("shard", "_slot").drop("_sid", "_slot")
     .write.partitionBy("shard").parquet(path))
