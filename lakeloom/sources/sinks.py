"""Sinks and catalog writes (SNK-1 .. SNK-6)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c
from ..operators.ranking import rank_within_groups


class ConflictError(RuntimeError):
    pass


def _fs(spark, path: str):
    jvm = spark._jvm  # noqa: SLF001 - Hadoop FileSystem for the atomic swap only
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p  # noqa: SLF001


def path_exists(spark, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def overwrite_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> DataFrame:
    """Full overwrite of a table that ``df`` may itself read (SNK-1).

    Spark cannot overwrite a path it is reading, so the result is written to a
    sibling staging folder first.  The old folder is then moved aside, the
    staging folder renamed into place (metadata-only moves on HDFS/ABFS) and the
    old one removed; if the second move fails the old table is put back.
    Returns the re-read table.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.__staging_{uuid.uuid4().hex}"
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(staging)
    fs, target = _fs(spark, path)
    _, stage = _fs(spark, staging)
    _, aside = _fs(spark, f"{path.rstrip('/')}.__old_{uuid.uuid4().hex}")
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(stage, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"could not move {staging} to {path}")
    if had:
        fs.delete(aside, True)
    return spark.read.format(fmt).load(path)


def write_text(df: DataFrame, path: str, text_col: str, partition_col: str | None = None,
               mode: str = "overwrite") -> None:
    """Write documents or log lines as text files, one folder per key (SNK-2).

    With a key, rows are rebalanced on it first (AQE ``rebalance``): each key
    lands in few files instead of one file per task and key, and a key with
    a third of the rows is split over several tasks rather than one.
    """
    out = df.select(*([partition_col] if partition_col else []), F.col(text_col).alias("value"))
    if partition_col:
        out = out.hint("rebalance", partition_col)
    w = out.write.mode(mode)
    if partition_col:
        w = w.partitionBy(partition_col)
    w.text(path)


def write_binary(df: DataFrame, path: str, b64_col: str, keep=(), mode: str = "overwrite") -> None:
    """Decode base64 and store the bytes in a parquet binary column (SNK-3)."""
    df.select(*keep, F.unbase64(F.col(b64_col)).alias("content")).write.mode(mode).parquet(path)


# Shortcut conflict policies.
POLICIES = ("Abort", "GenerateUniqueName", "CreateOrOverwrite", "OverwriteOnly")


def register(new: DataFrame, catalog: DataFrame, policy: str = "Abort",
             keys=("path", "name")) -> DataFrame:
    """Apply requested entries to a catalog under a conflict policy (SNK-4).

    * ``Abort``: any request whose key exists, or is requested twice, raises.
    * ``GenerateUniqueName``: conflicting requests get ``name_<k>``, numbered
      in request order after the highest ``_<k>`` suffix that the catalog or a
      request uses for that name in the same path; of several requests for a
      free key the first keeps it.
    * ``CreateOrOverwrite``: requests replace existing rows with the key; of
      several for one key the last in order of the columns counts.
    * ``OverwriteOnly``: like CreateOrOverwrite, but every request must
      target an existing row, else it raises.

    Returns the catalog after the change.  Everything is joins on the key and
    a skew-safe row number per (path, name), with no driver round-trip.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown conflict policy {policy}")
    keys = list(keys)
    cols = catalog.columns
    existing_keys = catalog.select(*keys).distinct().withColumn("__hit", F.lit(True))
    requests = new
    if policy in ("CreateOrOverwrite", "OverwriteOnly"):
        requests = new.groupBy(*keys).agg(F.max(F.struct(*[c for c in new.columns if c not in keys])).alias("__last")) \
            .select(*keys, "__last.*") if len(new.columns) > len(keys) else new.distinct()
    elif policy == "Abort":
        twice = new.groupBy(*keys).count().where("count > 1").select(*keys).withColumn("__hit", F.lit(True))
        existing_keys = existing_keys.unionByName(twice).distinct()
    req = requests.join(existing_keys, keys, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    if policy == "Abort":
        checked = req.withColumn("__ok", F.when(F.col("__hit"), F.raise_error(
            F.concat(F.lit("entry exists: "), F.concat_ws("/", *[F.col(k) for k in keys])))).otherwise(True))
        return catalog.unionByName(checked.where(F.col("__ok")).select(*cols))
    if policy == "OverwriteOnly":
        req = req.withColumn("__ok", F.when(~F.col("__hit"), F.raise_error(
            F.concat(F.lit("no entry to overwrite: "), F.concat_ws("/", *[F.col(k) for k in keys])))).otherwise(True))
        req = req.where(F.col("__ok"))
    if policy in ("CreateOrOverwrite", "OverwriteOnly"):
        kept = catalog.join(req.select(*keys).distinct(), keys, "left_anti")
        return kept.unionByName(req.select(*cols))
    # GenerateUniqueName: candidates name_1, name_2, ... per conflicting request.
    path_key, name_key = keys[0], keys[1]
    order = [F.col(c) for c in new.columns]
    numbered = rank_within_groups(req, [path_key, name_key], order, out="__k")
    fresh = numbered.where((~F.col("__hit")) & (F.col("__k") == 1))
    numbered = numbered.where(F.col("__hit") | (F.col("__k") > 1)).withColumn("__k", F.when(F.col("__hit"), F.col("__k")).otherwise(F.col("__k") - 1))
    # Existing suffixed names under the same base name shift the numbering.
    taken = (catalog.select(path_key, F.col(name_key).alias("__taken"))
             .unionByName(new.select(path_key, F.col(name_key).alias("__taken"))).where(F.col("__taken").rlike(r"_[0-9]+$")))
    base_taken = taken.select(path_key,
                              F.regexp_replace("__taken", r"_[0-9]+$", "").alias(name_key),
                              F.regexp_extract("__taken", r"_([0-9]+)$", 1).try_cast("decimal(38,0)").alias("__used"))
    offset = base_taken.groupBy(path_key, name_key).agg(F.max("__used").alias("__max_used"))
    renamed = (numbered.join(offset, [path_key, name_key], "left")
               .withColumn(name_key, F.concat(F.col(name_key), F.lit("_"),
                                              (F.col("__k") + F.coalesce("__max_used", F.lit(0))).cast("string"))))
    return catalog.unionByName(fresh.select(*cols)).unionByName(renamed.select(*cols))


def delete_matching(df: DataFrame, name_col: str, pattern: str) -> DataFrame:
    """Remove records whose name contains ``pattern`` (SNK-5); rows with a
    null name stay (a failed delete does not stop the rest)."""
    n = F.col(name_col)
    return df.where(n.isNull() | ~n.contains(pattern))


def ensure_hierarchy(paths: DataFrame, path_col: str, existing: DataFrame | None = None,
                     existing_col: str = "path") -> DataFrame:
    """Folders to create so every path's segments exist (SNK-6).

    Each path expands to all of its prefixes (bounded by its depth), the
    prefixes are de-duplicated by a shuffle on the prefix itself and the
    existing folders are removed with ``left_anti``.  Output: ``folder``,
    ``parent`` (null at the root) and ``depth``.
    """
    segs = F.filter(F.split(_c(path_col), "/"), lambda s: s != "")
    pref = (paths.select(segs.alias("__s"))
            .select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("__s"), F.lit(1))),
                                          lambda n: F.struct(F.array_join(F.slice("__s", 1, n), "/").alias("folder"),
                                                             n.alias("depth")))).alias("__f"))
            .select("__f.folder", "__f.depth")
            .where(F.col("folder") != ""))
    folders = pref.distinct()
    if existing is not None:
        folders = folders.join(existing.select(F.col(existing_col).alias("folder")), "folder", "left_anti")
    parent = F.when(F.col("depth") > 1, F.regexp_replace("folder", "/[^/]*$", ""))
    return folders.select("folder", parent.alias("parent"), F.col("depth").cast("int").alias("depth"))
