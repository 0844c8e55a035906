"""Write the physical plan of every registered query to PLANS.md.

Plans are taken with spark.sql.autoBroadcastJoinThreshold=-1, so the only
broadcasts left are the explicit, byte-checked ones: the shape the
queries take when every input is large. Usage:
    python tools/dump_plans.py [sf_dir] [out_file]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from farelens import schema as S  # noqa: E402
from farelens.functions.parsing import PY_WHITESPACE, with_parsed  # noqa: E402
from farelens.plans.catalog import QUERIES  # noqa: E402
from farelens.session import build_session  # noqa: E402
from farelens.sources.flights import flights_from_star  # noqa: E402
from farelens.sources.layout import bucket_name, with_bucket  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    spark = build_session(8, app="farelens-plans")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    lines = ["# Physical plans", "",
             f"Every registered query over `{sf_dir}`, planned with automatic broadcast",
             "joins disabled (the at-scale shape; only size-checked broadcasts remain).",
             "Generated by `tools/dump_plans.py`.", ""]
    ingest = (with_bucket(with_parsed(flights_from_star(spark, sf_dir)), 8).hint("rebalance", 8, bucket_name(8))
              .sortWithinPartitions(bucket_name(8), S.SOURCE, S.DESTINATION))
    plans = [("ingest: fare table derivation, parse, buckets of routes, files sorted by route", ingest)]
    plans += [(name, q(spark, sf_dir)) for name, q in QUERIES.items()]
    for name, df in plans:
        plan = df._jdf.queryExecution().executedPlan().treeString()
        # the whitespace set used for trimming prints as raw control characters
        plan = plan.replace(PY_WHITESPACE, "<whitespace>")
        lines += [f"## {name}", "", "```"]
        lines += [ln for ln in plan.splitlines() if ln.strip()]
        lines += ["```", ""]
    with open(out, "w") as f:
        f.write("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
