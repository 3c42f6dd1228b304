"""Runs the registered queries against their SQL: python -m catalog.check [sf_dir] [name...]"""

from __future__ import annotations

import hashlib
import sys
import time

import duckdb
import pandas as pd

from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from keysift.session import session

TABLES = ["documents", "pages", "conversations", "events", "labels", "benchmark", "nation", "part"]


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool):
            return v
        return float(v) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)
    return sorted((tuple(map(cell, row)) for row in frame.itertuples(index=False)), key=repr)


TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "decimal(3,2)": "DECIMAL(3,2)"}


def compare(spark, sf_dir: str, name: str) -> tuple[bool, int, str]:
    df = QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, len(got), f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    other = {c: (t, types[c]) for c, t in df.dtypes if TYPES[t] != types[c]}
    if other:
        return False, len(got), f"types {other}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return True, len(a), hashlib.sha256(repr(a).encode()).hexdigest()[:12]
    left = [x for x in a if x not in set(b)][:2]
    right = [x for x in b if x not in set(a)][:2]
    return False, len(a), f"{len(a)} / {len(b)} rows; only here {left}; only there {right}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = session("local[8]", **{"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, rows, note = compare(spark, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            ok, rows, note = False, 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24} {rows:7} rows {time.time() - start:6.1f}s {note if not ok else ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
