"""Collocations against counts of every phrase, and the automata on their own."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from loyaltide.llm import collocations
from loyaltide.llm.collocations import Automaton
from tests.llm import brute
from tests.llm.conftest import ODD


def report(docs, **kw):
    return sorted(tuple(r) for r in collocations.mine(docs, **kw).collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(6000)]
    out = []
    for i in range(240):
        text = []
        for _ in range(r.randrange(1, 60)):
            text.append(r.choice(words))
            if r.random() < 0.2:
                text += ["New", "york", "City,"][:r.randrange(1, 4)]
            if r.random() < 0.1:
                text.append(r.choice(["a.b", "x\ty", "semi;colon", "line\nend", "Ünï", "in spite of it"]))
        out.append((i, " ".join(text), r.choice(["en", "de", None]), "s"))
    return out + [(1000 + i, "the very same text of many rows", "en", "s") for i in range(120)]


@pytest.mark.parametrize("least", [3, 30])
def test_equals_counts_of_every_phrase(make, rows, least):
    want = sorted(brute.collocations([(lang, t) for _, t, lang, _ in rows], least))
    assert report(make(rows), least=least) == want and len(want) > 5


def test_many_ranges(make, rows, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_WORDS", 400)
    monkeypatch.setattr(collocations, "RANGE_PHRASES", 20)
    want = sorted(brute.collocations([(lang, t) for _, t, lang, _ in rows], 3))
    assert report(make(rows), least=3) == want


def test_top_is_cut_after_ties_by_phrase(make, rows):
    want = sorted(brute.collocations([(lang, t) for _, t, lang, _ in rows], 3, top=7))
    assert report(make(rows), least=3, top=7) == want


def test_odd_rows(odd, none):
    assert report(odd, least=2) == sorted(brute.collocations([(la, t) for _, t, la, _ in ODD], 2))
    assert report(none) == [] and report(odd, least=10 ** 6) == []


def made_up(r, n):
    return Counter(tuple(r.choices([11, 22, 33, 44], k=r.randrange(1, 5))) for _ in range(n))


def automaton(grams, summed=True):
    symbols = np.unique([x for g in grams for x in g])
    paths = [np.array([np.searchsorted(symbols, g[i]) if i < len(g) else -1 for g in grams])
             for i in range(4)]
    return Automaton.of(paths, np.array(list(grams.values())), summed).with_symbols(symbols)


def sequences(a):
    paths, weights = a.sequences()
    return Counter({tuple(int(x) for x in p if x): int(w)
                    for *p, w in zip(*paths, weights, strict=True)})


def test_union_sums_weights():
    r = random.Random(1)
    parts = [made_up(r, 60) for _ in range(4)]
    shards = [Automaton.unpack(automaton(p).pack()) for p in parts]
    assert [sequences(a) for a in shards] == parts
    assert sequences(collocations.unite(shards)) == sum(parts, Counter())


@pytest.mark.parametrize("arcs", [1, 50, 10 ** 6])
def test_union_some_at_a_time(monkeypatch, arcs):
    monkeypatch.setattr(collocations, "UNION_ARCS", arcs)
    r = random.Random(2)
    parts = [made_up(r, 60) for _ in range(9)]
    whole = collocations.unite_packed([automaton(p).pack() for p in parts])
    assert sequences(whole) == sum(parts, Counter())


def test_equal_states_are_merged():
    """Every first symbol goes on alike: one state holds what follows, whatever its number."""
    grams = {(i, 7, 8 + j): 1 for i in range(100, 200) for j in range(5)}
    symbols = np.unique([x for g in grams for x in g])
    a = Automaton.of([np.searchsorted(symbols, [g[i] for g in grams]) for i in range(3)],
                     np.ones(len(grams), np.int64))
    assert [len(level[1]) for level in a.levels] == [100, 1, 5]


def test_composition_weighs_beginnings():
    grams = {(11,): 9, (11, 22): 5, (11, 22, 33): 3, (44, 11): 2}
    a = automaton(grams, summed=False)
    asked = [(11, 22, 33, 0), (44, 11, 22, 0), (55, 11, 0, 0), (11, 33, 0, 0)]
    found = np.stack(a.along([np.array(x) for x in zip(*asked, strict=True)]), axis=1)
    assert found[:, :3].tolist() == [[9, 5, 3], [0, 2, 0], [0, 0, 0], [9, 0, 0]]
