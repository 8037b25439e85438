"""List registered queries whose physical plan holds a nested-loop or
cartesian join, a Python UDF, or a scan that reads every column."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakeloom.plans.registry import all_queries  # noqa: E402
from lakeloom.session import get_spark  # noqa: E402

WATCH = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
         "FlatMapGroupsInPandas", "MapInPandas")

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = get_spark(master="local[4]", shuffle_partitions=4)
spark.sparkContext.setLogLevel("ERROR")
for name, fn in sorted(all_queries().items()):
    plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    hits = [w for w in WATCH if w in plan]
    if hits:
        print(name, hits)
print("done")
