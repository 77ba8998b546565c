"""Run queries against their SQL counterparts: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import signal
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, (list, tuple)):
        return repr([_value(y) for y in x])
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return repr(float(x))
    return str(x)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if mine != theirs:
        only, other = sorted(set(mine) - set(theirs))[:3], sorted(set(theirs) - set(mine))[:3]
        return False, f"rows {len(mine)} vs {len(theirs)}; columns {sorted(names)}; only Spark {only}; only SQL {other}"
    return True, f"{len(mine)} rows"


def _too_long(signum, frame):
    raise TimeoutError("query ran too long")


if __name__ == "__main__":
    signal.signal(signal.SIGALRM, _too_long)
    from swarmframe.queries import ALL
    from swarmframe.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(ALL)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    limit = float(os.environ.get("CHECK_SECONDS", "120"))
    for name in wanted:
        signal.setitimer(signal.ITIMER_REAL, limit)
        start = time.time()
        try:
            ok, note = compare(spark, con, ALL[name][0], ALL[name][1], sf)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        signal.setitimer(signal.ITIMER_REAL, 0)
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} match")
    spark.stop()
