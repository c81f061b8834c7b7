"""MinHash near-duplicates by an inverted join over signature coordinates.

A document is the set of its distinct word n-grams; equal sets are one node.  A node's signature has
one least hash per coordinate, and the node is posted under each (coordinate, value).  Sets that link
agree in a share of coordinates close to their similarity, so pairs that agree in fewer than
``matches`` coordinates are left out: at the default 64 coordinates and 38 matches a pair at the
bound of 85 % is lost once in several million pairs.

* Prefix: a node's postings that nobody shares are dropped, and with fewer than ``matches`` left it
  has no partner.  Of ``c`` postings left, by ascending length of their lists, two nodes that agree
  in ``matches`` share one of the first ``c - matches + 1``; only those lists are merged.
* Skip: the other, longer lists are never merged.  Collisions of a pair met in a prefix are counted
  by probing the two signatures.

A list is not multiplied out: every node of a list is paired only with the least node of the list,
and nodes connected by such pairs form a cluster.  Every link lies inside one.  Only numbers move
until the clusters are known; then their sets are read from the texts.

* Narrow: a cluster of a few blocks' size is brought together once.  Collisions between different
  components are counted by coordinate, and pairs above the threshold are confirmed on full sets
  unless they have been connected meanwhile.
* Wide: in a larger cluster the pairs with the least nodes are confirmed first, and lists whose
  nodes are all connected by then are done.  The rest forms smaller clusters, which meet as above,
  in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyaltide.llm.common import give_back, text_batches
from loyaltide.llm.graph import components, keep_marked
from loyaltide.llm.jaccard_join import Shingler, node_of
from loyaltide.staging import stage

COORDINATES = 64
MATCHES = 38
ROWS = 2048                    # elements hashed at a time
BLOCK_SETS = 1024              # sets brought together
BLOCK_ELEMENTS = 500_000
NARROW = 8                     # blocks that one call holds, 32 MB of elements
PACK_SETS = 512                # sets of small clusters handed to one call
CACHED_SETS = 100_000          # sets a task remembers to have signed, about 10 MB


class Signer:
    """Least hashes of a set under ``coordinates`` hash functions, each value salted by its place."""

    def __init__(self, coordinates: int):
        r = np.random.default_rng(20240131)
        self.factor, self.offset, self.salt = (
            r.integers(0, 2 ** 64, coordinates, np.uint64) for _ in range(3))
        self.factor |= np.uint64(1)

    def sign(self, elements: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), 2 ** 64 - 1, np.uint64)
        for at in range(0, len(elements), ROWS):
            x = elements[at:at + ROWS, None] * self.factor + self.offset
            np.minimum(least, x.min(axis=0), out=least)
        x = (least ^ self.salt) * self.factor
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def signatures(docs: DataFrame, n: int, coordinates: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, node, signature`` per row; without words the last two are null, and a
    task gives the signature of a set it met before to none but the first."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, signer, told = Shingler(n), Signer(coordinates), set()
        for batch in batches:
            sizes, nodes, signed = [], [], []
            for text in batch["text"]:
                s = shingler.set_of(text)
                node = node_of(s)
                sizes.append(len(s))
                nodes.append(node)
                signed.append(None if node is None or node in told else signer.sign(s))
                if len(told) > CACHED_SETS:                # told again, which does no harm
                    told.clear()
                told.add(node)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes,
                                "node": pd.array(nodes, "Int64"), "signature": signed})
        give_back()

    return (text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(run, f"doc_id {id_type}, n_shingles bigint, node bigint, "
                              "signature array<bigint>"))


def full_sets(texts: DataFrame, n: int) -> DataFrame:
    """``node, elements`` of ``text``, once per different set of a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for batch in batches:
            sets = {node_of(s): s.view(np.int64) for s in map(shingler.set_of, batch["text"])
                    if len(s)}
            yield pd.DataFrame({"node": pd.array(list(sets), "Int64"),
                                "elements": list(sets.values())})
        give_back()

    return texts.mapInPandas(run, "node bigint, elements array<bigint>")


def prefixes(signed: DataFrame, matches: int) -> DataFrame:
    """``node, token``: the postings of which two nodes with ``matches`` collisions share one.

    Several tasks may have signed a node: its postings are ranked without repeats, and repeats in
    the length of a list only move it in the order that all nodes share.
    """
    tokens = signed.select("node", F.explode("signature").alias("token"))
    lists = stage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("nodes"),
                                              F.min("node").alias("one"), F.max("node").alias("two"))
                  .filter("one <> two").select("token", "nodes"), "minhash-lists")
    shared = keep_marked(tokens, "token", lists, "token", 24).join(lists, "token")
    own = Window.partitionBy("node")
    return (shared.withColumn("rank", F.dense_rank().over(own.orderBy("nodes", "token")))
            .withColumn("left", F.max("rank").over(own))
            .filter(F.col("rank") <= F.col("left") - matches + 1).select("node", "token"))


def confirmed(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` with enough common elements on full sets."""
    def side(name: str) -> DataFrame:
        return profiles.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"),
                               F.col("elements").alias(f"elements_{name}"))

    met = pairs.select("b").distinct()
    both = pairs.join(side("a"), "a").join(side("b").join(met, "b", "left_semi"), "b")
    return (both.withColumn("common", F.size(F.array_intersect("elements_a", "elements_b")))
            .filter(F.expr(f"100 * common >= {percent} * (size_a + size_b - common)"))
            .select("a", "b"))


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Number of elements that a sorted set shares with each of the others."""
    all_ = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, all_), len(one) - 1)
    return np.add.reduceat(one[at] == all_, np.cumsum([0] + [len(o) for o in others[:-1]]))


def open_links(signature: np.ndarray, sets: list[np.ndarray], label: np.ndarray, left: np.ndarray,
               right: np.ndarray, matches: int, percent: int) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right`` (positions) that connect what has different labels."""
    label = np.unique(label, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    out = []
    for i in left.tolist():
        near = right[label[right] != label[i]]
        if not len(near):
            continue
        near = near[(signature[near] == signature[i]).sum(axis=1) >= matches]
        if not len(near):
            continue
        common = _common(sets[i], [sets[j] for j in near])
        for j in near[100 * common >= percent * (size[i] + size[near] - common)].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def resolve(rows: DataFrame, sets: DataFrame, coordinates: int, matches: int,
            percent: int) -> DataFrame:
    """Links ``a, b`` within the clusters of ``cluster, node, size, label, blocks, block``, whose
    sets are ``node, elements``: nodes of two blocks meet once."""
    count, size = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    packs = max(1, -(-count // PACK_SETS), -(-(size or 0) // BLOCK_ELEMENTS))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    placed = (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("cluster", "node", "label", "block", low.alias("low"), high.alias("high"),
                      F.when(F.col("blocks") > 1, F.xxhash64("cluster", low, high))
                      .otherwise(F.pmod(F.xxhash64("cluster"), F.lit(packs))).alias("pack"))
              .join(sets, "node"))

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        signer, out = Signer(coordinates), []
        for (_, lo, hi), part in pdf.groupby(["cluster", "low", "high"], sort=False):
            nodes, block = part["node"].to_numpy(), part["block"].to_numpy()
            left = np.flatnonzero(block == lo)
            right = left if lo == hi else np.flatnonzero(block == hi)
            if len(nodes) > 1 and len(left) and len(right):
                sets = [x.view(np.uint64) for x in part["elements"]]
                out += [(nodes[i], nodes[j]) for i, j in open_links(
                    np.stack([signer.sign(x) for x in sets]), sets, part["label"].to_numpy(),
                    left, right, matches, percent)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return placed.groupBy("pack").applyInPandas(check, "a bigint, b bigint")


def blocked(members: DataFrame) -> DataFrame:
    """``members`` (``node, cluster, size``, maybe more), dealt to blocks of bounded sets and
    elements; clusters that one call can hold stay in one."""
    whole = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"),
                                           F.sum("size").alias("all"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("all") / BLOCK_ELEMENTS))
    blocks = F.when(blocks <= NARROW, 1).otherwise(blocks).cast("int")
    return (members.join(whole.select("cluster", blocks.alias("blocks")), "cluster")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))


def sets_of(members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``node, elements``, once each, of ``members`` (``node, doc_id``) and maybe of other nodes
    with their ids, from ``texts`` (``doc_id, text``)."""
    wanted = stage(members.select(F.col("doc_id").alias("_id")).distinct(), "minhash-wanted")
    read = (keep_marked(texts, "doc_id", wanted, "_id", 22)
            .join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text"))
    return full_sets(read, n).dropDuplicates(["node"])


def wide_links(wide: DataFrame, texts: DataFrame, prefix: DataFrame, pairs: DataFrame, n: int,
               percent: int, coordinates: int, matches: int) -> DataFrame:
    """Links ``a, b`` of ``wide`` (``node, doc_id, size``): least nodes of lists first, then what
    they leave apart, in blocks."""
    profiles = stage(wide.select("node", "size").join(sets_of(wide, texts, n), "node"),
                     "minhash-profiles")
    pairs = pairs.join(wide.select(F.col("node").alias("a")), "a", "left_semi")
    links = stage(confirmed(pairs, profiles, percent), "minhash-star")
    label = components(links, "minhash-label").select("node", F.col("root").alias("label"))
    members = stage(wide.select("node", "size").join(label, "node", "left")
                    .withColumn("label", F.coalesce("label", "node")), "minhash-members")
    labelled = stage(prefix.join(members.select("node", "label"), "node"), "minhash-labelled")
    open_ = (labelled.groupBy("token").agg(F.min("label").alias("one"), F.max("label").alias("two"),
                                           F.min("node").alias("b"))
             .filter("one <> two").select("token", "b"))
    together = (labelled.join(open_, "token").filter("node <> b")
                .select(F.col("node").alias("a"), "b").distinct())
    clusters = components(together, "minhash-open").toDF("node", "cluster")
    rows = stage(blocked(clusters.join(members, "node")), "minhash-blocks")
    more = resolve(rows, profiles.select("node", "elements"), coordinates, matches, percent)
    return links.unionByName(stage(more, "minhash-more"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 85, coordinates: int = COORDINATES,
                    matches: int = MATCHES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row: documents connected by links.

    Two documents link when ``100 * intersection >= percent * union``, confirmed on the full sets of
    pairs that agree in ``matches`` of ``coordinates``; no list, bucket or partner is capped.  Fewer
    than ``n`` words are one element, the whole sequence.  Null, empty and blank texts have no
    elements, link with nothing and are their own component, as are null ids without links.
    Repeated rows are rows each; a component's id is its smallest id, and rows with that id are
    ``kept``.  Empty tables give an empty result; other columns are not read.
    """
    base = stage(signatures(docs, n, coordinates, id_col, text_col), "minhash-base")
    nodes = stage(base.filter(F.col("node").isNotNull()).groupBy("node")
                  .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size")),
                  "minhash-nodes")
    signed = base.filter(F.col("signature").isNotNull()).select("node", "signature")
    prefix = stage(prefixes(signed, matches), "minhash-prefix")

    least = (prefix.groupBy("token").agg(F.min("node").alias("b"), F.max("node").alias("last"))
             .filter("b <> last").select("token", "b"))
    pairs = stage(prefix.join(least, "token").filter("node <> b")
                  .select(F.col("node").alias("a"), "b").distinct(), "minhash-pairs")
    clusters = components(pairs, "minhash-cluster").toDF("node", "cluster")
    placed = stage(blocked(clusters.join(nodes, "node")).withColumn("label", F.col("node")),
                   "minhash-placed")
    narrow, wide = placed.filter("blocks = 1"), placed.filter("blocks > 1")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    links = stage(resolve(narrow, sets_of(narrow, texts, n), coordinates, matches, percent),
                  "minhash-links")
    if not wide.isEmpty():
        links = links.unionByName(
            wide_links(wide, texts, prefix, pairs, n, percent, coordinates, matches))

    linked = components(links, "minhash-linked")
    smallest = (linked.join(nodes.select("node", "doc_id"), "node")
                .groupBy("root").agg(F.min("doc_id").alias("component_id")))
    named = linked.join(smallest, "root").select("node", "component_id")
    by_node = (nodes.select("node", "doc_id").join(named, "node", "left")
               .select(F.col("node").alias("_node"),
                       F.coalesce("component_id", "doc_id").alias("component_id")))
    return (base.join(by_node, base["node"] == by_node["_node"], "left")
            .select("doc_id", "n_shingles",
                    F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The same components in DuckDB: all pairs that share an n-gram, counted on whole sets.
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, component_id, n.doc_id = component_id AS kept
FROM m JOIN n ON n.doc_id = m.doc_id
"""
