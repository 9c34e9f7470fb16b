"""python tests/run_check.py [sf] [query ...]: print a comparison line per query."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_module  # noqa: E402
from tests.oracle_check import connect, differences, duck_rows, spark_rows  # noqa: E402
from tests.session import local_session  # noqa: E402

if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    directory = f"/root/testdata/sf{scale}"
    spark = local_session()
    con = connect(directory)
    oracle = entry_module.oracle_sql()
    for name, run in entry_module.queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        try:
            names, rows = spark_rows(run(spark, directory))
        except Exception as error:  # noqa: BLE001
            print("FAIL ", name, str(error)[:1500], flush=True)
            continue
        took = time.time() - begin
        if name not in oracle:
            print("NOSQL", name, len(rows), f"{took:.1f}s", flush=True)
            continue
        begin = time.time()
        try:
            duck_names, duck = duck_rows(con, oracle[name])
        except Exception as error:  # noqa: BLE001
            print("SQLERR", name, str(error)[:1500], flush=True)
            continue
        duck_took = time.time() - begin
        bad = differences(rows, duck)
        ok = names == duck_names and len(rows) == len(duck) and not bad
        print("ok   " if ok else "DIFF ", name, len(rows), len(duck), f"{took:.1f}s duck {duck_took:.2f}s", flush=True)
        if not ok:
            if names != duck_names:
                print("   columns only in one:", set(names) ^ set(duck_names))
            else:
                print("   ", names)
                for a, b in bad:
                    print("    spark", a)
                    print("    duck ", b)
