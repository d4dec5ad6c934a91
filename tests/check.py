"""Run registered queries against their SQL twins: python tests/check.py [name-part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from headrace.session import get_spark  # noqa: E402

folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                          "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
queries, sql = entry.queries(), entry.oracle_sql()
wanted = [n for n in queries if not sys.argv[1:] or any(p in n for p in sys.argv[1:])]
bad = 0
for name in wanted:
    t0 = time.time()
    try:
        df = queries[name](spark, folder)
        problem = compare(df, folder, sql[name]) if name in sql else (None if df.count() else "no rows")
    except Exception as exc:
        problem = f"{type(exc).__name__}: {str(exc)[:900]}"
    bad += problem is not None
    print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - t0:.1f}s", flush=True)
    if problem is not None:
        print("   ", problem, flush=True)
print(f"{len(wanted) - bad} of {len(wanted)} agree")
