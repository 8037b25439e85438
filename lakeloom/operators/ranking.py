"""Skew-safe per-group ranking.

``row_number().over(Window.partitionBy(k).orderBy(o))`` sends every row of a
key to one task; when one key holds a third of the data that task does a third
of the work.  :func:`rank_within_groups` computes the same 1-based row number
without a per-key exchange:

1. range-partition on ``(keys, order)`` -- the range boundaries split a hot key
   across many tasks because the order columns make the sort key fine-grained;
2. number rows locally inside each ``(partition, key)`` slice, which is bounded
   by one range partition;
3. add the row count of the same key in all earlier partitions, from a small
   table of ``(key, partition) -> count`` (at most #keys + #partitions rows).

The range-partitioned rows are checkpointed once into the shared checkpoint folder: Spark re-samples range
bounds whenever an exchange is recomputed, and steps 2 and 3 must agree on
which partition every row is in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

_PID = "__pid"


def rank_within_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                       out: str = "rn", num_partitions: int | None = None,
                       with_count: str | None = None, weight: Column | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row inside its key group, or with
    ``weight`` the sum of the weights up to and with the row.

    ``order`` must make rows unique inside a group (add a tie-breaker), so
    the result is deterministic.  ``with_count`` also adds the group size.
    """
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols).withColumn(_PID, F.spark_partition_id())
    # range bounds are re-sampled whenever the exchange is planned again, and
    # the two branches below must see the same partition ids: cut lineage once
    # with a reliable checkpoint into spark.checkpoint.dir (one RDD, one set
    # of bounds; also what a lost executor recovers from)
    ranged = cut_lineage(ranged)
    local_w = W.partitionBy(_PID, *keys).orderBy(*order_cols)
    upto = F.row_number().over(local_w) if weight is None else F.sum(weight).over(local_w.rowsBetween(W.unboundedPreceding, 0))
    local = ranged.withColumn("__local", upto)
    counts = ranged.groupBy(*keys, _PID).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__cnt"))
    prior_w = W.partitionBy(*keys).orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(prior_w), F.lit(0)))
    if with_count:
        offsets = offsets.withColumn(with_count, F.sum("__cnt").over(W.partitionBy(*keys)))
    extra = [with_count] if with_count else []
    o = offsets.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
                       F.col(_PID).alias("__opid"), "__off", *extra)
    cond = [local[_PID] == o["__opid"]] + [local[k].eqNullSafe(o[f"__k_{i}"]) for i, k in enumerate(keys)]
    joined = local.join(o, cond, "left")
    return (joined.withColumn(out, (F.col("__local") + F.col("__off")).cast("long"))
            .drop("__local", "__off", _PID, "__opid", *[f"__k_{i}" for i in range(len(keys))]))
