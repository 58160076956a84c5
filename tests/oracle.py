"""Compare queries with their SQL: python tests/oracle.py SF_DIR [NAME...]."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def duck(sf: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def compare(df, con, sql: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    if cols != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {cols}"
    idx = [list(rel.columns).index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in idx) for r in rel.fetchall())
    got = Counter(tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).toLocalIterator())
    if got == want:
        return ""
    extra, missing = list((got - want).items()), list((want - got).items())
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {extra[:3]}; only SQL {missing[:3]}"


def main() -> int:
    import __spark_entry__ as e

    from kernmill.session import get_spark

    sf, names = sys.argv[1], sys.argv[2:]
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(sf), 0
    qs, sql = e.queries(), e.oracle_sql()
    for n in names or qs:
        t = time.time()
        try:
            if n in sql:
                why = compare(qs[n](spark, sf), con, sql[n])
                said = "ok" if not why else f"DIFF {why[:700]}"
            else:
                said = f"rows {qs[n](spark, sf).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"DIFF {type(x).__name__}: {str(x)[:500]}"
        bad += said.startswith("DIFF")
        print(f"{n} {time.time() - t:.1f}s {said}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
