"""Time the main operators on the fare table replicated k times.

Only the stored sf0.1 fare table is replicated (union of k copies, written
once as parquet under the given scratch folder); nothing is synthesised. The
point is the growth of each operator's cost with row count on one machine.
Usage: python tools/scale_probe.py SCRATCH_DIR [k ...]
"""

from __future__ import annotations

import json
import os
import sys
import time
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from farelens.operators import metrics as M  # noqa: E402
from farelens.operators import outliers as O  # noqa: E402
from farelens.operators import search as Q  # noqa: E402
from farelens.operators.questions import match_questions  # noqa: E402
from farelens.operators.screen import screen_log  # noqa: E402
from farelens.plans.dashboard import dashboard_feeds  # noqa: E402
from farelens.plans.inputs import question_log, sql_log  # noqa: E402
from farelens.session import build_session  # noqa: E402
from farelens.sources import flights_table  # noqa: E402

OPS = {
    "kpi_bundle": M.kpi_bundle,
    "dashboard_feeds": dashboard_feeds,
    "outlier_report": lambda d: O.outlier_report(d),
    "route_search": lambda d: Q.search_flights(d, "NATION_5", "NATION_13"),
    "question_match": lambda d: match_questions(question_log(d)),
    "sql_screen": lambda d: screen_log(sql_log(d)),
}


def main() -> None:
    scratch = sys.argv[1]
    ks = [int(k) for k in sys.argv[2:]] or [1, 10, 30]
    spark = build_session(8, app="farelens-scale")
    base = flights_table(spark, "/root/testdata/sf0.1")
    out = {}
    for k in ks:
        path = f"{scratch}/fares_x{k}"
        if not os.path.exists(f"{path}/_SUCCESS"):
            reduce(lambda a, b: a.unionByName(b), [base] * k).write.parquet(path)
        df = spark.read.parquet(path)
        rows = df.count()
        times = {}
        for name, op in OPS.items():
            best = None
            for _ in range(2):
                t = time.perf_counter()
                op(df).write.format("noop").mode("overwrite").save()
                took = time.perf_counter() - t
                best = took if best is None else min(best, took)
            times[name] = round(best, 3)
        out[k] = {"rows": rows, "seconds": times}
        print(json.dumps({"k": k, "rows": rows, "seconds": times}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
