"""Command line: run one of the business queries and show its rows.

    python -m storeline --tables /data/chain q1 --key "cold brew"
    python -m storeline --driver-dir /root/testdata/sf0.01 q3 --as-of 2001-08-01
    python -m storeline --tables /data/chain counts

``--tables`` reads stored domain tables (one Parquet folder per table);
``--driver-dir`` maps the driver's test tables. Output is ``show()`` of the
first ``--rows`` rows; the query itself runs on Spark over all rows.
"""

from __future__ import annotations

import argparse
import sys

from storeline.plans import queries as Q

COMMANDS = {
    "counts": ("row count per table", lambda t, a: Q.table_counts(t)),
    "q1": ("product availability by UPC / name / brand",
           lambda t, a: Q.product_availability(t, a.key, literal=a.literal,
                                               accent_insensitive=a.accent_insensitive)),
    "q2": ("best seller per store, past month",
           lambda t, a: Q.top_selling_past_month(t, a.as_of, n=a.n or 1)),
    "q3": ("best store(s) of the quarter", lambda t, a: Q.best_store_this_quarter(t, a.as_of)),
    "q4": ("vendor statistics", lambda t, a: Q.vendor_stats(t)),
    "q5": ("reorder alert", lambda t, a: Q.reorder_alert(t)),
    "q6": ("items bought with a keyword product by members",
           lambda t, a: Q.loyalty_bundle(t, a.key, n=a.n or 3, dedupe=a.dedupe)),
    "q7": ("widest assortment per ownership type", lambda t, a: Q.variety_by_ownership(t)),
}


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m storeline", description=__doc__.split("\n")[0])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder of stored domain tables")
    src.add_argument("--driver-dir", help="folder of the driver's test tables")
    p.add_argument("command", choices=sorted(COMMANDS),
                   help="; ".join(f"{k}: {v[0]}" for k, v in COMMANDS.items()))
    p.add_argument("--key", default="", help="search key (q1) or keyword (q6)")
    p.add_argument("--as-of", default=None, help="query date, default today (q2, q3)")
    p.add_argument("--n", type=int, default=None,
                   help="top-n per store (q2, default 1) / items (q6, default 3)")
    p.add_argument("--literal", action="store_true", help="q1: no LIKE wildcards")
    p.add_argument("--accent-insensitive", action="store_true", help="q1: ignore accents")
    p.add_argument("--dedupe", action="store_true", help="q6: count each receipt once")
    p.add_argument("--rows", type=int, default=50, help="rows to show")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    if spark is None:
        from storeline.session import local_session
        spark = local_session()
    if args.tables:
        from storeline.sources.tables import read_tables
        t = read_tables(spark, args.tables)
    else:
        from storeline.sources.driver import driver_tables
        t = driver_tables(spark, args.driver_dir)
    COMMANDS[args.command][1](t, args).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
