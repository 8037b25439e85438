"""Hot keys: one key holding a third of the rows must not land in one task."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators import relational as rel
from lakeloom.operators.ranking import rank_within_groups

SF = "/root/testdata/sf0.01"


def _skewed(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    # 'view' and 'click' events (about 40% of rows) all share key 0
    return e.select(F.when(F.col("event_type").isin("view", "click"), F.lit(0)).otherwise(F.col("user_id") + 1)
                    .alias("k"), "ts", "event_id")


def test_rank_within_groups_splits_hot_key(spark):
    df = _skewed(spark)
    n_parts = 8
    ranged = df.repartitionByRange(n_parts, "k", "ts").withColumn("pid", F.spark_partition_id())
    hot = ranged.where(F.col("k") == 0).groupBy("pid").count().collect()
    assert len(hot) >= 3, "the hot key should span several range partitions"
    got = rank_within_groups(df, ["k"], ["ts"], num_partitions=n_parts)
    want = df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("ts")))
    assert got.select("event_id", "rn").exceptAll(want.select("event_id", F.col("rn").cast("long"))).count() == 0


def test_first_per_key_combines_map_side(spark):
    df = _skewed(spark)
    out = rel.first_per_key(df, "k", ["ts"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    # partial aggregation before the exchange: the hot key is reduced per task
    assert plan.count("Aggregate") >= 2
    want = {r.k: r.event_id for r in df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("ts")))
            .where("rn = 1").collect()}
    assert {r.k: r.event_id for r in out.collect()} == want
