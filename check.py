"""Run registered queries against their SQL: python check.py [sf_dir] [name or module…]."""

from __future__ import annotations

import sys
import tempfile
import time
import traceback

from corpusloom import build_session
from registry import MODULES
from tests.oracle import connect, differences


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = set(sys.argv[2:])
    spark = build_session(
        "check", "local[8]", 8, spark__driver__memory="8g", spark__ui__enabled="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if wanted and not wanted & {name, module.__name__.split(".")[-1]}:
                continue
            start = time.time()
            try:
                result = query(spark, sf_dir).toArrow()
                took = time.time() - start
                sql = module.ORACLE.get(name)
                start = time.time()
                problem = differences(result, con.execute(sql).to_arrow_table()) if sql else None
                sql_took = time.time() - start
                state = "no sql" if not sql else "ok" if problem is None else f"DIFFERS {problem[:600]}"
                failed += problem is not None
                print(f"{name}: {state} ({result.num_rows} rows, {took:.1f}s, sql {sql_took:.1f}s)", flush=True)
            except Exception as error:  # noqa: BLE001
                failed += 1
                lines = str(error).strip().splitlines() or [repr(error)]
                print(f"{name}: FAILED {lines[0][:700]}", flush=True)
                if wanted:
                    traceback.print_exc(limit=6)
    print(f"{failed} problems")
    return failed


if __name__ == "__main__":
    sys.exit(main())
