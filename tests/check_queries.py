"""Compare registered queries with their SQL: ``python tests/check_queries.py [sf] [prefix ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from emberlog.session import build_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracle:
                problem = differences(df, con, oracle[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        kind = "" if name in oracle else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{kind} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failing")


main()
