"""Command line: python tests/check_all.py [sf_dir] [name part ...] compares queries with SQL."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_module  # noqa: E402
from tabloom.session import build_session  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry_module.oracle_sql()
    bad = 0
    for name, fn in entry_module.queries().items():
        if wanted and not any(part in name for part in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                found = differences(spark, con, fn, oracles[name], sf_dir)
            else:
                found = [] if fn(spark, sf_dir).collect() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        spark.catalog.clearCache()
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {time.time() - start:6.1f}s {name} {'' if name in oracles else '(rows only)'} {' '.join(found)}", flush=True)
    print(f"{bad} failing")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
