"""Exact n-gram Jaccard join by parity sketches.

A document is the set of its distinct word n-grams.  Sets of one size band (sizes up to a power of
two) are XOR-hashed into a sketch of ``p`` lanes: every element is dealt to one lane and flips that
lane by its 64-bit hash.  An element in which two sets differ changes one lane, so the number of
lanes that differ never exceeds the symmetric difference.  Sets that link differ in at most ``d``
elements, so of ``p`` lanes at least ``p - d`` agree; in any order of lanes by their content that
all sets share, the first ``d + 1`` lanes of both then have one in common (pigeonhole).  Lanes with
many elements come first, they say most.  Equality of such lanes joins the sets; sets near the top
of a band also enter the next one.

Lanes move once, dealt to ranges of (lane, set): a common lane spreads over ranges, whose first and
last lanes are linked afterwards.

Joined sets form candidate clusters (components of "shares a lane").  Every link lies inside one.
Their texts, which are smaller than their sets, are brought together in blocks of bounded size, cut
into sets again there and verified exactly by counting common elements.  Equal sets are one node
throughout, whatever the number of copies; nodes are 64-bit hashes of sets, elements 64-bit hashes
of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyaltide.llm.common import WORD, give_back, text_batches, unused
from loyaltide.llm.graph import components, keep_marked
from loyaltide.staging import stage

SLACK = 1.3                    # lanes per element that may differ
BLOCK_SETS = 1024              # sets verified together
BLOCK_ELEMENTS = 500_000
PACK_SETS = 512                # sets of small clusters handed to one call
COLUMNS = 2048                 # elements counted at a time
RANGE_ROWS = 200_000           # sorted lanes looked at together
CACHED_WORDS = 50_000          # about 6 MB
CACHED_SETS = 100_000          # sets a task remembers to have told, about 10 MB

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
                np.uint64)


class Shingler:
    """Sets of hashed word n-grams: lower-cased A-Z, words between ASCII blanks."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def set_of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.n:
            whole = b" ".join(words)
            return np.array([xxhash.xxh3_64_intdigest(whole, len(words))], np.uint64)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        new = {w: xxhash.xxh3_64_intdigest(w) for w in words if w not in known}
        known.update(new)
        h = np.array([known[w] for w in words], np.uint64)
        count = len(h) - self.n + 1
        out = np.zeros(count, np.uint64)
        for i in range(self.n):
            out = _scatter((out ^ h[i:i + count]) * _MIX[i % len(_MIX)])
        return np.unique(out)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[4]
    return x ^ (x >> np.uint64(29))


def most_different(n: int, percent: int) -> int:
    """Largest symmetric difference of a set of ``n`` elements to a set it links with."""
    return n * (100 - percent) // percent


def lanes(elements: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a set: its foremost lanes, in its own size band and maybe the next."""
    n = len(elements)
    if not n:
        return np.empty(0, np.int64)
    d = most_different(n, percent)
    band = n.bit_length() - 1
    out = []
    for b in (band, band + 1):
        if b > band and n * 100 < 2 ** b * percent:        # no partner is that large
            break
        p = int(SLACK * most_different(2 ** (b + 1) - 1, percent)) + 4
        lane = ((elements >> np.uint64(20)) % np.uint64(p)).astype(np.int64)
        order = np.argsort(lane, kind="stable")
        sorted_ = lane[order]
        starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        value = np.zeros(p, np.uint64)
        count = np.zeros(p, np.int64)
        value[sorted_[starts]] = np.bitwise_xor.reduceat(
            _scatter(elements * _MIX[1])[order], starts)
        count[sorted_[starts]] = np.diff(np.r_[starts, n])
        salt = _MIX[3:4] * np.uint64(b)                       # arrays wrap around silently
        key = _scatter((value ^ np.arange(p, dtype=np.uint64)) * _MIX[2] + salt)
        out.append(key[np.lexsort((key, -count))[:d + 1]])
    return np.concatenate(out).view(np.int64)


def node_of(elements: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - 2 ** 63 if len(elements) else None


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, node, row, keys``: a hash of id and text, keys once per set and task."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, told = Shingler(n), set()
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in batch["text"]:
                s = shingler.set_of(text)
                node = node_of(s)
                sizes.append(len(s))
                nodes.append(node)
                if node is None or node in told:
                    keys.append(np.empty(0, np.int64))
                else:
                    if len(told) > CACHED_SETS:
                        told.clear()
                    told.add(node)
                    keys.append(lanes(s, percent))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes,
                                "node": pd.array(nodes, "Int64"), "row": batch["row"],
                                "keys": keys})
        del shingler, told
        give_back()

    return (text_batches(with_row(docs, id_col, text_col))
            .mapInPandas(run, f"doc_id {id_type}, n_shingles bigint, node bigint, row bigint, "
                              "keys array<bigint>"))


def with_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, row``: ``row`` is a 64-bit hash of both."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(id_col, text_col).alias("row"))


def shared(keyed: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all nodes of each key of ``key, node``, from one shuffle.

    Rows are sorted in ranges of (key, node), so that the rows of a common key lie in many of them.  A
    range links the nodes of a key to the first one it has; the first and last key of every range
    (two rows each) say which keys go on in another.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray, key: list[int] | None = None) -> pa.RecordBatch:
            keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                               keys], ["a", "b", "key"])

        def whole() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, size = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                    size += batch.num_rows
                if size >= RANGE_ROWS:
                    yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    held, size = [], 0
            if held:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))

        last = None                                           # key, and first node it has here
        for key, node in whole():
            new = np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(at < 0, last[1] if last else 0, node[at])
            if last is None:
                yield rows(first[:1], first[:1], [int(key[0])])
            last = int(key[-1]), int(first[-1])
            links = np.unique(np.stack([node, first])[:, node != first], axis=1)
            yield rows(*links)
        if last:
            yield rows(np.array([last[1]]), np.array([last[1]]), [last[0]])

    ranges = keyed.select("key", "node").repartitionByRange("key", "node").sortWithinPartitions(
        "key", "node")
    found = stage(ranges.mapInArrow(run, "a bigint, b bigint, key bigint").distinct(),
                  "jaccard-shared")
    ends = found.filter("key IS NOT NULL").select("key", "a")             # two rows per range
    on = ends.groupBy("key").agg(F.min("a").alias("b"))
    return (found.filter("key IS NULL").select("a", "b")
            .unionByName(ends.join(on, "key").filter("a <> b").select("a", "b").distinct()))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
           percent: int) -> list[tuple[int, int]]:
    """Pairs (one of ``left``, one of ``right``, as positions) that link: a spanning forest."""
    values, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = df > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1.0
        common += part[left] @ part[right].T
    sizes = np.array([len(s) for s in sets], np.int64)
    both = common.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(100 * both >= percent * union), strict=True):
        a, b = find(int(left[i])), find(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(left[i]), int(right[j])))
    return out


def verify(placed: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links ``a, b`` that span the linked sets of ``cluster, node, row, size, blocks, block``; the
    texts of their rows are in ``row, text``."""
    count, size = placed.agg(F.count(F.lit(1)), F.sum("size")).first()
    packs = max(1, -(-count // PACK_SETS), -(-(size or 0) // BLOCK_ELEMENTS))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    # One row of those that repeat: the join has put them together.
    read = (keep_marked(texts, "row", placed, "row", 24).join(placed, "row")
            .dropDuplicates(["row"]))
    met = (read.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("cluster", "node", "text", "block", low.alias("low"), high.alias("high"),
                   F.when(F.col("blocks") > 1, F.xxhash64("cluster", low, high))
                   .otherwise(F.pmod(F.xxhash64("cluster"), F.lit(packs))).alias("pack")))

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        shingler, out = Shingler(n), []
        for (_, lo, hi), part in pdf.groupby(["cluster", "low", "high"], sort=False):
            nodes = part["node"].to_numpy()
            block = part["block"].to_numpy()
            left = np.flatnonzero(block == lo)
            right = left if lo == hi else np.flatnonzero(block == hi)
            if len(nodes) > 1 and len(left) and len(right):
                sets = [shingler.set_of(t) for t in part["text"]]
                out += [(nodes[i], nodes[j]) for i, j in linked(sets, left, right, percent)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return met.groupBy("pack").applyInPandas(check, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: documents connected by links.

    Two documents link when ``100 * intersection >= percent * union``.  Fewer than ``n`` words are
    one element, the whole sequence.  Null, empty and blank texts have no elements, link with
    nothing and are their own component, as are null ids without links.  Repeated rows are rows
    each; a component's id is its smallest id.  Empty tables give an empty result; other columns
    are not read.  Nothing is capped: exact for every pair of different texts.
    """
    base = stage(sketches(docs, id_col, text_col, n, percent), "jaccard-sketches")
    near = shared(base.select(F.explode("keys").alias("key"), "node"))
    clusters = components(near, "jaccard-near").toDF("node", "cluster")
    nodes = (base.filter(F.col("node").isNotNull()).groupBy("node")
             .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"),
                  F.min("row").alias("row")))
    members = stage(clusters.join(nodes, "node"), "jaccard-members")
    whole = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"),
                                           F.sum("size").alias("elements"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("elements") / BLOCK_ELEMENTS))
    placed = stage(members.join(whole.select("cluster", blocks.cast("int").alias("blocks")), "cluster")
                   .select("cluster", "node", "row", "size", "blocks",
                           F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")),
                   "jaccard-placed")
    texts = with_row(docs, id_col, text_col).select("row", "text")
    links = stage(verify(placed, texts, n, percent), "jaccard-links")
    linked_nodes = components(links, "jaccard-linked")
    smallest = (linked_nodes.join(members.select("node", "doc_id"), "node")
                .groupBy("root").agg(F.min("doc_id").alias("component_id")))
    by_node = linked_nodes.join(smallest, "root").select("node", "component_id")
    alone = nodes.join(by_node, "node", "left").select(
        F.col("node").alias("_node"),
        F.coalesce("component_id", F.col("doc_id")).alias("component_id"))
    return (base.join(alone, base["node"] == alone["_node"], "left")
            .select("doc_id", "n_shingles",
                    F.coalesce("component_id", base["doc_id"]).alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of every component the row with the smallest id.

    Documents without words (null, empty, blank) link with nothing: they all stay.  Rows that repeat
    an id stay once per different text.  Rows with a null id stay if their component has no other
    id, once per text.  An empty table gives an empty one; other columns, under any names, come along.
    """
    keep, filled, has, content, copy = unused(docs.columns, "_keep", "_filled", "_has", "_text",
                                              "_copy")
    found = jaccard_components(docs, n, percent, id_col, text_col)
    stays = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .select(F.col("doc_id").alias(keep), (F.col("n_shingles") > 0).alias(filled))
             .distinct())
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    marked = docs.withColumn(has, F.coalesce(text, F.lit("")).rlike(WORD))
    named = marked.join(stays, (key == F.col(keep)) & (F.col(has) == F.col(filled)))
    nameless = marked.filter(key.isNull()).join(
        stays.filter(F.col(keep).isNull()), F.col(has) == F.col(filled))
    out = None
    for part in (named, nameless):
        # The join has put equal ids and marks together (equal texts have equal marks): numbering
        # them moves no row again.
        same = Window.partitionBy(key, F.col(has), F.col(content)).orderBy(F.lit(0))
        part = (part.withColumn(content, F.xxhash64(text))
                .withColumn(copy, F.row_number().over(same))
                .filter((F.col(copy) == 1) | ~F.col(has))
                .select(*[F.col(f"`{c}`") for c in docs.columns]))
        out = part if out is None else out.unionByName(part)
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The same components in DuckDB, all pairs that share an n-gram counted.
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, min(reach) AS component_id
FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY 1, 2
"""
