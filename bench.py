"""Run the headline queries and print one JSON line."""

import json
import os
import time

from tidemark.plans import catalog
from tidemark.session import local_session

sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
spark = local_session(os.environ.get("BENCH_CPUS", "8"))
spark.sparkContext.setLogLevel("ERROR")
took = {}
for query in catalog.QUERIES:
    start = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took[query.__name__] = round(time.time() - start, 3)
print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
