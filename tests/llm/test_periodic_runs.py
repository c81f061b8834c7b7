"""Periodic runs against a walk along every lag, on whole small tables and on made-up texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loyaltide.llm import periodic_runs
from loyaltide.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD


def rows_of(df):
    return [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256,
             r.collapsed_sha256) for r in df.collect()]


def test_op12_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = rows_of(QUERIES["op12_periodic_runs"](spark, sf_dir))
    want = [(d.doc_id, *brute.run_row(d.text, d.doc_id)) for d in docs]
    assert sorted(got) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 10


def test_odd_rows(odd, none):
    got = rows_of(periodic_runs.run_report(odd))
    assert sorted(got, key=str) == sorted(((d, *brute.run_row(t, d)) for d, t, *_ in ODD), key=str)
    assert periodic_runs.run_report(none).count() == 0
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(odd).collect()}
    assert found[1].runs == found[2].runs == [] and found[3].collapsed == ""
    assert [tuple(r) for r in found[6].runs] == [(0, 9900, 11)]
    assert found[6].collapsed == "the cat sat on the mat and looked at the dog"


def made_up(r):
    size, letters = r.choice([0, 5, 12, 20, 40, 100, 300]), r.choice([1, 2, 2, 3, 5, 50])
    if r.random() < 0.4:
        return [r.randrange(letters) for _ in range(size)]
    w = []
    while len(w) < size:
        piece = [r.randrange(letters) for _ in range(r.choice([1, 2, 3, 6, 7, 8, 9, 15, 16, 17, 40]))]
        if w and r.random() < 0.3:
            at = r.randrange(len(w))
            piece = w[at:at + r.randrange(1, 60)]
        w += piece * r.choice([1, 1, 2, 3, 8])
    return w[:size]


@pytest.mark.parametrize("seed", range(4))
def test_made_up_texts(seed):
    r = random.Random(seed)
    for _ in range(400):
        w = made_up(r)
        assert periodic_runs.runs(np.array(w, np.int64)) == brute.runs(w), w


@pytest.mark.parametrize("w", [([0] * 50 + [1]) * 3, (([0] * 20 + [1]) * 3 + [2]) * 3,
                               ([0, 1] * 30 + [2]) * 4, [0] * 500])
def test_runs_inside_runs(w):
    assert periodic_runs.runs(np.array(w)) == brute.runs(w)


def test_seeds_stay_in_proportion():
    """A word repeated all along, and long stretches of one word, make few seeds per word."""
    for w in (np.zeros(60_000, np.int64), np.tile(np.r_[np.zeros(3000, np.int64), 1], 20)):
        assert sum(len(p) for _, p, _ in periodic_runs.seeds(w)) < 16 * len(w)


def test_no_run_crosses_documents(make):
    """The end of a document and the start of the next one are not neighbours."""
    text = "a b c d e f g"
    got = periodic_runs.periodic_runs(make([(i, text, "en", "a") for i in range(6)], parts=1))
    assert all(r.runs == [] and r.collapsed == text for r in got.collect())


def test_least_is_at_least_twelve(odd):
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(odd, least=6)
