"""Every registered query with comparison SQL gives the same rows in DuckDB."""

from __future__ import annotations

import pytest

from catalog import load_all
from catalog.compare import compare_all, connect
from catalog.registry import ORACLES

load_all()


@pytest.fixture(scope="module")
def outcomes(spark, sf_dir, request):
    chosen = [i.callspec.params["name"] for i in request.session.items
              if i.originalname == "test_same_rows"]
    return compare_all(spark, connect(sf_dir), sf_dir, chosen, tolerant=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(outcomes, name):
    assert outcomes[name].startswith("ok"), outcomes[name]


def test_entry_runs(spark):
    import __spark_entry__ as driver
    rows = driver.entry(spark).collect()
    assert len(rows) == 5
    whole = next(r for r in rows if r["groupe"] == "Portefeuille entier")
    assert abs(whole["n_portfolio_equiv"] - 100000) < 1e-3
    assert set(driver.oracle_sql()) <= set(driver.queries())
