"""Compare queries by name: python tests/check.py <folder> [name ...] (all when none is named)."""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from compare import connection, difference, types_of  # noqa: E402

from parcelspan.plans.registry import all_queries, all_sql  # noqa: E402
from parcelspan.session import build_session  # noqa: E402

spark = build_session(
    "check", **{"spark.master": "local[8]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
)
spark.sparkContext.setLogLevel("ERROR")
folder, names = sys.argv[1], sys.argv[2:]
queries, sql = all_queries(), all_sql()
con = connection(folder)
bad = 0
for name in names or queries:
    began = time.time()
    try:
        df = queries[name](spark, folder)
        if name in sql:
            problem = difference(df, con, sql[name])
            odd = {k: v for k, v in types_of(con, sql[name]).items() if "HUGEINT" in v or "DECIMAL" in v or "TIME ZONE" in v}
            problem = problem or (f"check types {odd}" if odd else None)
        else:
            problem = None if df.count() else "no rows"
    except Exception as e:  # noqa: BLE001
        problem = f"{type(e).__name__}: {str(e)[:700]}"
    bad += problem is not None
    rows = "" if problem else f"ok{'' if name in sql else ' (rows only)'}"
    print(f"{name}: {rows or problem} {time.time() - began:.1f}s", flush=True)
print(f"{len(names or queries)} queries, {bad} bad")
