"""Audit the physical plan of every registered query.

Per key: number of shuffles, broadcasts, and flags for shapes that do not
scale (cartesian products, nested-loop joins, single-partition exchanges,
Python evaluation).  usage: python scripts/plan_audit.py [sf_dir]
"""
import re
import sys

sys.path.insert(0, ".")
from hostlens.plans.registry import QUERIES, load_all  # noqa: E402
from hostlens.session import build_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = build_spark()
load_all()
for k, fn in sorted(QUERIES.items()):
    plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    flags = []
    if "CartesianProduct" in plan:
        flags.append("CARTESIAN")
    if "BroadcastNestedLoopJoin" in plan:
        flags.append("BNLJ")
    if "SinglePartition" in plan:
        flags.append("SINGLE_PARTITION")
    if re.search(r"(ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas)", plan):
        flags.append("PYTHON")
    n_ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan))
    n_bc = plan.count("BroadcastExchange")
    wgl = plan.count("WindowGroupLimit")
    print(f"{k:28s} shuffles={n_ex:2d} broadcasts={n_bc:2d} wgl={wgl} {' '.join(flags)}")
