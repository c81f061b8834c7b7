"""MinHash near-duplicates against all pairs, with near copies of every distance."""

from __future__ import annotations

import contextlib
import io
import random
import re

import numpy as np
import pytest

from loyaltide.llm import minhash_join
from loyaltide.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def wanted(rows, n, percent):
    return sorted(((*r, r[0] == r[2]) for r in brute.jaccard_components(rows, n, percent)), key=str)


def test_op13_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = wanted(docs, 5, 85)
    assert rows_of(QUERIES["op13_minhash_join"](spark, sf_dir)) == want
    assert any(not kept for *_, kept in want)


def test_odd_rows(odd, none):
    assert rows_of(minhash_join.near_duplicates(odd)) == wanted([r[:2] for r in ODD], 5, 85)
    assert minhash_join.near_duplicates(none).count() == 0


def family(r, size, words, edits):
    """A text and copies of it, each with ``edits`` words changed."""
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        copy = list(base)
        for at in r.sample(range(words), edits):
            copy[at] = f"x{r.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    out = [t for edits in range(6) for t in family(r, 25, 150, edits)]
    walk = [f"c{i}" for i in range(100)]                      # a chain: each links the next only
    for i in range(40):
        out.append(" ".join(walk[i:] + [f"d{j}" for j in range(i)]))
    out += ["one two three", "one two three", "ONE two\tthree", "one two"]
    common = " ".join(f"p{i}" for i in range(40))             # a passage in unlike documents
    out += [f"{common} " + " ".join(f"q{r.randrange(10 ** 6)}" for _ in range(60)) for _ in range(60)]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [7, 1024])
def test_near_copies_chains_and_passages(make, texts, monkeypatch, block):
    """Also where what stays open is dealt to many blocks."""
    monkeypatch.setattr(minhash_join, "BLOCK_SETS", block)
    want = wanted(texts, 5, 85)
    assert rows_of(minhash_join.near_duplicates(make([(i, t, "en", "a") for i, t in texts]))) == want
    assert len({r[2] for r in want}) > 30 and sum(not r[3] for r in want) > 60


@pytest.mark.parametrize("block, times", [(1024, 1), (7, 6)])
def test_full_sets_move_seldom(spark, make, texts, monkeypatch, block, times):
    """Once to their clusters after those that hold a set twice have met, and none is written;
    clusters beyond a block write theirs once."""
    plain, moved, written = minhash_join.stage, [], []

    def noted(df, name):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain("formatted")
        moved.extend(re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[[^]]*\belements", plan.getvalue()))
        written.extend([name] if "elements" in df.columns else [])
        return plain(df, name)

    monkeypatch.setattr(minhash_join, "stage", noted)
    monkeypatch.setattr(minhash_join, "BLOCK_SETS", block)
    monkeypatch.setattr(minhash_join, "NARROW", 1, raising=False)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rows_of(minhash_join.near_duplicates(make([(i, t, "en", "a") for i, t in texts])))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert found == wanted(texts, 5, 85) and 0 < len(moved) <= times
    assert written == ([] if block > len(texts) else ["minhash-profiles"])


def test_a_third_of_all_rows_equal(make, texts):
    rows = texts + [(1000 + i, texts[0][1]) for i in range(len(texts) // 2)]
    got = rows_of(minhash_join.near_duplicates(make([(i, t, "en", "a") for i, t in rows])))
    assert got == wanted(rows, 5, 85)


def test_open_links_connect_what_is_apart():
    sets = [np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64),
            np.arange(50, 150, dtype=np.uint64), np.arange(100, dtype=np.uint64) + np.uint64(1)]
    signer = minhash_join.Signer(64)
    signature = np.stack([signer.sign(s) for s in sets])
    at = np.arange(4)
    found = minhash_join.open_links(signature, sets, np.array([1, 2, 3, 1]), at, at, 38, 85)
    assert found == [(0, 1)]


def test_signatures_estimate_the_similarity():
    signer = minhash_join.Signer(512)
    a, b = (signer.sign(np.random.default_rng(0).integers(0, 2 ** 63, 1000).astype(np.uint64)[s])
            for s in (slice(0, 900), slice(100, 1000)))
    assert (a == b).mean() == pytest.approx(0.8, abs=0.06)
