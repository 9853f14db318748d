"""Run registered queries against their DuckDB oracle: python tests/run_oracle.py [sf_dir] [name...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402
from pitlane.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.queries())
    spark = local_session(8)
    con = duck(sf)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf)
            if n in oracle:
                ok, msg = compare(df, oracle[n], con)
            else:
                ok, msg = True, f"rows-only: {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:28s} {time.time() - t:6.2f}s  {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
