"""Run registered queries next to their SQL: ``python -m catalog.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

import duckdb
from pyspark.sql import SparkSession


def session(cpus: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("compare")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float):
        return "" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return str(v)
    return str(v)


def frame(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted(tuple(_cell(r[i]) for i in order) for r in rows))


def _close(x: str, y: str) -> bool:
    try:
        return x == y or math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-6)
    except ValueError:
        return False


def compare(spark: SparkSession, con, fn, sql: str, sf_dir: str, tolerant: bool = False) -> str:
    """``ok ...`` or the first difference; ``tolerant`` accepts a last rounded digit off by one."""
    df = fn(spark, sf_dir)
    got = frame(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = frame([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {sorted(set(got[0]) ^ set(want[0]))}"
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} vs {len(want[1])}: {got[1][:2]} / {want[1][:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True)
           if a != b and not (tolerant and all(map(_close, a, b)))]
    if bad:
        diff = [(c, x, y) for c, x, y in zip(got[0], *bad[0], strict=True) if x != y]
        return f"VALUES {len(bad)}/{len(got[1])} e.g. {diff}"
    return f"ok {len(got[1])} rows"


def compare_all(spark: SparkSession, con, sf_dir: str, names: list[str], workers: int = 6,
                tolerant: bool = False) -> dict[str, str]:
    """Outcome of each named query, several at a time (each with its own DuckDB cursor)."""
    from catalog.registry import ORACLES, QUERIES
    from loyaltide.plans.score_table import load_store
    load_store(spark, sf_dir)                          # shared by most queries, built once

    def run(name: str) -> str:
        try:
            return compare(spark, con.cursor(), QUERIES[name], ORACLES[name], sf_dir, tolerant)
        except Exception as exc:  # noqa: BLE001 - report every query
            return f"ERROR {type(exc).__name__}: {str(exc)[:600]}"

    with ThreadPoolExecutor(workers) as pool:
        return dict(zip(names, pool.map(run, names), strict=True))


def main(argv: list[str]) -> int:
    from catalog import load_all
    from catalog.registry import ORACLES, QUERIES
    load_all()
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    spark, con, failed = session(), connect(sf_dir), 0
    for name in names:
        t = time.time()
        try:
            if name in ORACLES:
                result = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
            else:
                result = f"ok (no SQL) {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as exc:  # noqa: BLE001 - report every query
            result = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        failed += not result.startswith("ok")
        if not result.startswith("ok") or "-v" in sys.argv or time.time() - t > 4:
            print(f"{name}: {result} [{time.time() - t:.1f}s]", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main([a for a in sys.argv[1:] if a != "-v"]))
