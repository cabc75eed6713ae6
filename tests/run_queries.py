"""Compare registered queries with their SQL twins: python tests/run_queries.py [name part ...]"""

from __future__ import annotations

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from compare import SF_DIR, diff, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def main() -> None:
    parts = sys.argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck()
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, SF_DIR)
            if name in sqls:
                msg, exact = diff(df, sqls[name], con)
                state = ("exact" if exact else "close") if msg is None else "DIFF " + msg[:700]
            else:
                state = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            state = "ERROR " + str(e).split("JVM stacktrace")[0][:900]
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:36s} {time.time() - t0:6.2f}s {state}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
