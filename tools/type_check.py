"""Compare Spark result types of every query with its DuckDB oracle types."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from lakeloom.plans.registry import all_oracles, all_queries  # noqa: E402
from lakeloom.session import get_spark  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "binary": "BLOB",
                 "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE", "smallint": "SMALLINT"}

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = get_spark(master="local[4]", shuffle_partitions=4)
spark.sparkContext.setLogLevel("ERROR")
con = duckdb.connect()
for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split():
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
qs, os_ = all_queries(), all_oracles()
for name in sorted(qs):
    df = qs[name](spark, sf)
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    desc = con.execute(f"DESCRIBE {os_[name]}").fetchall()
    dt = {r[0]: r[1] for r in desc}
    diff = {c: (st[c], dt.get(c)) for c in st if st[c] != dt.get(c)}
    if diff:
        print(name, diff)
