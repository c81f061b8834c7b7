"""Leaves answer from a table."""

from __future__ import annotations

import math

import numpy as np
import pytest

from loyaltide.operators import tree_contributions as tc


def test_leaves_answer_from_a_table(monkeypatch):
    pick = np.random.default_rng(7)
    cuts, paths = [-1.0, 0.0, 0.5, 2.0], []
    for _ in range(300):
        held = []
        for f in pick.choice(9, int(pick.integers(1, 7)), replace=False).tolist():
            low, high = sorted(pick.choice([-math.inf, *cuts, math.inf], 2, replace=False).tolist())
            held.append((f, low, high, float(pick.random())))
        paths.append((float(pick.normal()), held))
    leaves = tc.leaf_arrays(paths)
    x = pick.choice([*cuts, -3.0, -0.5, 0.2, 1.0, 9.0, math.nan], (500, 10))
    plain = tc.contributions(x, leaves)
    known = tc.answers(leaves)
    monkeypatch.setattr(tc, "gains", None)                 # a row works nothing out
    assert all(isinstance(of, tc.Answers) for of in known)
    assert tc.contributions(x, known) == pytest.approx(plain, abs=1e-12)
    assert not plain[:, 9].any()
