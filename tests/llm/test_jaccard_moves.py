"""What the Jaccard join moves: lanes once, whatever a lane's size, and documents once."""

from __future__ import annotations

import random

import pytest

from loyaltide.llm import jaccard_join
from loyaltide.llm.graph import components


@pytest.mark.parametrize("parts", [1, 7])
def test_shared_connects_the_nodes_of_every_key(spark, parts):
    pick = random.Random(3)
    rows = [(5, node) for node in range(1, 400)]                  # one key in many ranges
    rows += [(key, pick.randrange(400, 5000)) for key in range(100, 700) for _ in range(2)]
    rows += rows[:50] + [(9, 6000), (9, 6000), (10, 6001)]        # repeats, and nodes alone
    pick.shuffle(rows)
    held = {"spark.sql.shuffle.partitions": str(parts),
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {name: spark.conf.get(name) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        links = jaccard_join.shared(spark.createDataFrame(rows, "key bigint, node bigint"))
        got = {r["node"]: r["root"] for r in components(links).collect()}
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    root = {node: node for _, node in rows}
    changed = True
    while changed:
        least: dict[int, int] = {}
        for key, node in rows:
            least[key] = min(least.get(key, node), root[node])
        changed = False
        for key, node in rows:
            if least[key] < root[node]:
                root[node], changed = least[key], True
    several = {r for r in root.values() if list(root.values()).count(r) > 1}
    assert got == {node: r for node, r in root.items() if r in several}


def test_shared_takes_an_empty_table(spark):
    assert jaccard_join.shared(spark.createDataFrame([], "key bigint, node bigint")).count() == 0


def test_documents_are_moved_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = [f"w{i}" for i in range(40)]
        docs = spark.createDataFrame([(i, " ".join(words[i % 3:]), "x") for i in range(30)],
                                     "doc_id bigint, text string, lang string")
        got = jaccard_join.keep_one(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert moved and not [x for x in moved if "_text" in x]      # none for the numbering
        assert sorted(r["doc_id"] for r in got.collect()) == [0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
