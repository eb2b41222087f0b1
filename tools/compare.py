"""Runs queries and their SQL side by side: ``python tools/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from polyview.plans import ORACLES, QUERIES  # noqa: E402
from polyview.session import build_session  # noqa: E402
from polyview.sources.registry import TABLES  # noqa: E402

TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    return ("null",) if value is None or (isinstance(value, float) and math.isnan(value)) else (str(type(value)), value)


def difference(spark_df, con, sql: str) -> str | None:
    """None if both sides hold the same rows, else what differs first."""
    names = sorted(spark_df.columns)
    got = sorted([tuple(cell(r[c]) for c in names) for r in spark_df.collect()])
    res = con.execute(sql)
    cols = {d[0]: i for i, d in enumerate(res.description)}
    types = {d[0]: str(d[1]) for d in res.description}
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    want = sorted([tuple(cell(r[cols[c]]) for c in names) for r in res.fetchall()])
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {str(bad[0])[:600]}"
    kinds = {n: t for n, t in spark_df.dtypes}
    odd = {n: (kinds[n], types[n]) for n in names if TYPES.get(kinds[n]) != types[n]}
    return f"types {odd}" if odd else None


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    chosen = args[1:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = difference(df, con, ORACLES[name])
                verdict = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                problem, verdict = None, f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problem, verdict = error, f"FAILED {str(error)[:1200]}"
        failed += problem is not None
        print(f"{time.time() - start:6.1f}s {name}: {verdict}", flush=True)
    print(f"{len(chosen)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
