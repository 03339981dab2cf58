"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]

Compares row count, column names and the multiset of rows. Values are
compared exactly (floats by repr) and, separately, with floats rounded to
6 decimals, so a last-bit difference is told apart from a real one.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def _norm(v, digits=None):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if v != v:
            return "nan"
        return repr(round(v, digits) + 0.0) if digits is not None else repr(v + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    return v


def _rows(cols, rows, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i], digits) for i in order) for r in rows)


_SPARK_TYPES = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64",
                "double": "float64", "float": "float32", "string": "text", "boolean": "bool",
                "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}
_DUCK_TYPES = {"TINYINT": "int8", "SMALLINT": "int16", "INTEGER": "int32", "BIGINT": "int64",
               "DOUBLE": "float64", "FLOAT": "float32", "VARCHAR": "text", "BOOLEAN": "bool",
               "DATE": "date", "TIMESTAMP": "timestamp"}


def spark_types(df):
    return {f.name: _SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields}


def duck_types(cur):
    return {c[0]: _DUCK_TYPES.get(str(c[1]), str(c[1])) for c in cur.description}


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as entry
    from almacen.session import build_session
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if name not in sqls:
            print(f"{name:26s} rows={len(s_rows):6d} (no oracle) {t1 - t0:.1f}s")
            continue
        cur = con.execute(sqls[name])
        d_cols = [c[0] for c in cur.description]
        d_rows = cur.fetchall()
        same_cols = sorted(s_cols) == sorted(d_cols)
        st, dtp = spark_types(df), duck_types(cur)
        type_diff = {c: (st[c], dtp.get(c)) for c in st if st[c] != dtp.get(c)}
        exact = same_cols and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
        loose = same_cols and _rows(s_cols, s_rows, 6) == _rows(d_cols, d_rows, 6)
        status = "OK" if exact else ("~OK(float)" if loose else "MISMATCH")
        print(f"{name:26s} rows={len(s_rows):6d}/{len(d_rows):6d} cols={'ok' if same_cols else 'DIFF'} "
              f"types={'ok' if not type_diff else type_diff} {status} {t1 - t0:.1f}s", flush=True)
        if type_diff:
            bad.append(name + ":types")
        if not exact:
            bad.append(name)
            if not same_cols:
                print("   spark:", s_cols, "\n   duck: ", d_cols)
            else:
                a, b = _rows(s_cols, s_rows, 6), _rows(d_cols, d_rows, 6)
                print("   only spark:", list((a - b).items())[:3])
                print("   only duck: ", list((b - a).items())[:3])
    print("MISMATCHES:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
