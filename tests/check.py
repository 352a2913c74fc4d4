"""``python -m tests.check [--sf DIR] [name ...]``: compare registered queries with their SQL."""

from __future__ import annotations

import argparse
import time

from tests.compare import connect, differences
from tests.conftest import make_session


def main() -> None:
    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = make_session()
    con = connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in args.names or queries:
        start = time.time()
        try:
            got = queries[name](spark, args.sf).toPandas()
            took = time.time() - start
            if name in oracles:
                start = time.time()
                diff = differences(got, con.execute(oracles[name]).df())
                verdict = ("ok" if diff is None else f"DIFF {diff}") + f" (sql {time.time() - start:.1f}s)"
            else:
                verdict = "rows only"
            print(f"{name}: {len(got)} rows {took:.1f}s {verdict}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main()
