"""Session and shared-storage helpers.

Every operator in the library is a plain DataFrame/Column function; this module
only holds the few session-level settings the operators rely on:

* the session time zone is pinned to UTC (the test tables are ``timestamp_ntz``
  and the streaming operators cast them to ``timestamp`` before watermarks);
* adaptive query execution with skew-join splitting is on, so hot keys found at
  run time are split instead of landing in one task;
* small tables are broadcast by Spark's own rules; joins with an exploded side,
  whose size the planner underestimates, ask for a merge join instead;
* lineage is cut with ``DataFrame.checkpoint()`` into the shared folder named by
  ``spark.checkpoint.dir``.  The cluster sets it; only tests set their own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the library expects; applied only when the session leaves them unset.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "lakeloom", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, creating a local one for tests and tools."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode runs executors inside the driver JVM
            builder = builder.config("spark.driver.memory", os.environ.get("LAKELOOM_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


SQL_DEFAULTS = {k: v for k, v in DEFAULT_CONF.items() if k.startswith("spark.sql.")}


def apply_sql_defaults(spark: SparkSession) -> None:
    """Apply the library's runtime SQL settings to an existing session.

    Used by the registered queries, which receive a session they did not
    create; settings that the caller has made are kept.
    """
    own = spark.conf.getAll
    for k, v in SQL_DEFAULTS.items():
        if k not in own:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3, ABFS);
    we read it and never replace it.  Tests and local tools have none, so a
    fresh folder under the system temp dir is used there; a cluster session
    without one raises ``ValueError``.
    """
    conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            conf_dir = None
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="lakeloom-ckpt-")
    spark.sparkContext.setCheckpointDir(conf_dir)
    return spark.sparkContext.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the shared checkpoint folder (reliable, not local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables next to the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "staging", name)


def ensure_parallelism(df: DataFrame, factor: int = 1) -> DataFrame:
    """Spread rows over the cluster's cores before CPU-heavy per-row work.

    A small input stored as one file (one row group) scans as one task; when
    the plan has fewer partitions than ``factor`` x default parallelism the
    rows are redistributed round-robin.  On large inputs the scan already has
    many more splits than cores and this is a no-op, so no shuffle is added.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001 - planning only, no job
    if "Exchange" in plan or "AdaptiveSparkPlan" in plan:
        # already shuffled: it has shuffle-partition parallelism, and asking an
        # adaptive plan for its partitions would run its stages eagerly
        return df
    target = df.sparkSession.sparkContext.defaultParallelism * factor
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that the library itself wrote below the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - Hadoop's file system, for any store
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001
