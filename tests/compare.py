"""Runs registered queries next to their SQL in DuckDB: ``python -m tests.compare [names...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _cell(v.item())
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_cell(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str = SF_DIR) -> tuple[str, str]:
    t0 = time.time()
    got = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return ("rows", f"{len(got)} rows {t1 - t0:.1f}s")
    want = con.sql(sql).df()
    t2 = time.time()
    info = f"{len(got)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return ("COLUMNS", f"{sorted(got.columns)} vs {sorted(want.columns)}")
    for c in got.columns:
        a, b = got[c].dtype.kind, want[c].dtype.kind
        if a != b and {a, b} - {"i", "u"} and not {a, b} <= {"O", "T", "U", "M"}:
            info += f" DTYPE {c}:{got[c].dtype}/{want[c].dtype}"
    g, w = rows(got), rows(want)
    if g == w:
        return ("ok", info)
    diff = [(x, y) for x, y in zip(g, w) if x != y][:3]
    return ("DIFF", f"{info} want {len(want)} rows; first differences {diff}")


def main() -> int:
    from muletrace.plans import catalog
    from muletrace.session import build_session

    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck()
    qs, sqls = catalog.all_queries(), catalog.all_check_sql()
    bad = 0
    for name in sys.argv[1:] or list(qs):
        try:
            status, info = compare(spark, con, name, qs[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001
            status, info = "ERROR", str(e)[:700]
        bad += status not in ("ok", "rows")
        print(f"{status:8} {name}: {info}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
