"""Command line: build the warehouse, then ask it questions.

    python -m almacen build --csv /data/invoice_lines.csv --out /warehouse/retail
    python -m almacen build --tables /root/testdata/sf0.01 --out /tmp/wh
    python -m almacen query --star /tmp/wh q01_kpis
    python -m almacen query --star /tmp/wh --sql "SELECT segmento, count(*) AS n FROM dim_cliente GROUP BY 1"

``--csv`` reads existing raw CSV files; ``--tables`` derives the raw feed
from the TPC-H-style driver tables first. Runs on whatever master
``spark-submit`` or ``--master`` gives.
"""

from __future__ import annotations

import argparse
import json

from .operators import profile
from .functions import fixed
from .plans import warehouse
from .session import build_session, release_scratch


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="almacen")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build", help="raw feed -> star schema")
    src = b.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="raw feed CSV file, directory or glob")
    src.add_argument("--tables", help="directory of driver tables (*.parquet)")
    b.add_argument("--out", required=True, help="output directory for the star")
    b.add_argument("--master", default=None, help="default: spark-submit's, else local[*]")
    b.add_argument("--ts-format", default=fixed.INVOICE_TS_FORMAT, help="layout of InvoiceDate")
    b.add_argument("--multi-line", action="store_true", help="values may hold line breaks (one task per file)")
    b.add_argument("--keep", type=int, default=2, help="published builds to keep in --out")
    q = sub.add_parser("query", help="run a named question or SQL over a built star")
    q.add_argument("--star", required=True, help="directory written by `build`")
    q.add_argument("--sql", help="SQL over the views dim_fecha, dim_cliente, dim_producto, "
                                 "dim_geografia, fact_ventas")
    q.add_argument("name", nargs="?", help="question name, e.g. q01_kpis (see plans.queries)")
    q.add_argument("--rows", type=int, default=50, help="rows to show")
    q.add_argument("--master", default=None, help="default: spark-submit's, else local[*]")
    args = ap.parse_args(argv)
    if args.cmd == "query":
        return _query(args)

    spark = build_session(master=args.master, app="almacen-build", shuffle_partitions=None)
    steps: dict[str, float] = {}
    if args.csv:
        star = warehouse.build_from_csv(spark, args.csv, base=args.out, timings=steps,
                                        ts_format=args.ts_format, multi_line=args.multi_line)
    else:
        star = warehouse.build(spark, args.tables, base=args.out, timings=steps)
    warehouse.retire(spark, args.out, args.keep)
    summary = {r["metric"]: r["value"] for r in profile.warehouse_summary(
        {k: (v.drop("anio") if k == "fact_ventas" else v) for k, v in star.tables.items()}).collect()}
    print(json.dumps({"out": args.out, "rows": star.rows, "summary": summary, "steps_sec": steps}))
    spark.stop()
    return 0


def _query(args) -> int:
    from .plans import queries
    spark = build_session(master=args.master, app="almacen-query", shuffle_partitions=None)
    star = warehouse.load(spark, args.star)
    if star is None:
        raise SystemExit(f"no completed build at {args.star}")
    if args.sql:
        star.register_views(spark)
        df = spark.sql(args.sql)
    elif args.name in queries.ANALYTIC:
        df = queries.ANALYTIC[args.name](star)
    else:
        raise SystemExit(f"unknown question {args.name!r}; one of: {', '.join(queries.ANALYTIC)}")
    df.show(args.rows, truncate=False)
    release_scratch(spark)
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
