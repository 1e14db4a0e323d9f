"""Compare all queries with their SQL: ``python tests/check_all.py SF [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as e  # noqa: E402
from marketlake import session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402

if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = session.build(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(sf_dir), e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            problem = difference(queries[name](spark, sf_dir), con, oracle[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':5}{name:25}{time.time() - start:6.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ; without SQL: {sorted(set(queries) - set(oracle))}")
