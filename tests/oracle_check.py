"""Run registered queries against their SQL statement in DuckDB.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

RAW = ("region nation customer supplier part orders lineitem events documents embeddings "
       "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.10g}")
    return value


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str, run, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    frame = run(spark, sf_dir)
    mine = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    if sql is None:
        return bool(mine), f"{len(mine)} rows, {took:.1f}s, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(names)}"
    a, b = _rows(frame.columns, mine), _rows(names, theirs)
    note = f"{len(a)} rows, {took:.1f}s"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    odd = [f"{c}:{t}/{types[c]}" for c, t in frame.dtypes if kinds.get(t, t) != types[c]]
    if odd:
        note += f" TYPES {odd}"
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3] if len(a) < 50000 else a[:2]
        only_b = [x for x in b if x not in set(a)][:3] if len(b) < 50000 else b[:2]
        return False, f"{note} vs {len(b)} rows\n    cols {sorted(names)}\n    spark {only_a}\n    sql   {only_b}"
    if not a:
        return False, f"{note} EMPTY"
    return not odd, note


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from ledgerloom.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session(), connect(args.sf)
    every, sqls = queries(), oracle_sql()
    failed = []
    for name in args.names or list(every):
        try:
            ok, note = compare(spark, con, name, args.sf, every[name], sqls.get(name))
        except Exception as exc:  # keep going and report at the end
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(("ok   " if ok else "FAIL ") + f"{name}: {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
