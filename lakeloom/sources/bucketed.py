"""A parquet table cut into buckets by key, merged bucket by bucket (the table behind STM-3).

A merge writes the touched buckets to a new folder and then one small commit
file that names, for every bucket, the folder that holds it, and the id of the
batch applied.  Creating that file is the only step that changes what readers
see, so data and batch id change together, a failed merge leaves the table as it
was, and a batch that is replayed is found to be applied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Commits whose folders readers may still be using.
KEPT_COMMITS = 2


class BucketedTable:
    """``BucketedTable.create(df, path, key)`` or ``BucketedTable(spark, path)`` of an existing one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001 - Hadoop's file system, for any store

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 64) -> BucketedTable:
        """Write ``df`` as a new table; an existing one raises ``FileExistsError``."""
        table = cls(df.sparkSession, path)
        if table._commits():
            raise FileExistsError(path)
        state = {"key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "batch": -1, "folders": {}}
        state["folders"] = table._write(df, state)
        table._commit(0, state)
        return table

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001

    def _commits(self) -> list[int]:
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def _state(self, commit: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/_commits/{commit:012d}", wholetext=True)
        return json.loads(rows.first()[0])

    def state(self) -> dict:
        """The last commit: key, buckets, schema, applied batch, folder of each bucket."""
        return self._state(self._commits()[-1])

    def _commit(self, number: int, state: dict) -> None:
        """Create the commit file in one step; a commit of that number by someone else raises."""
        draft = self._path(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = self._path(f"{self.path}/_commits/{number:012d}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"commit {number} of {self.path} was made by another writer")

    @staticmethod
    def bucket(key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, state: dict) -> dict[str, str]:
        """Write rows by bucket to a new folder; the folders of the buckets that have rows."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = df.withColumn("__bucket", self.bucket(state["key"], state["buckets"])).repartition("__bucket")
        rows.write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]
        return {name.split("=")[1]: f"{folder}/{name}" for name in found if name.startswith("__bucket=")}

    def _read(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/{f}" for b, f in sorted(state["folders"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read(self.state())

    def merge(self, updates: DataFrame, batch_id: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
        """Apply a batch to the buckets that hold its keys; returns them (none if the batch was applied before).

        ``merged(base, updates)`` gets the touched buckets' rows and returns their
        new rows, with the table's columns and keys.
        """
        number = self._commits()[-1]
        state = self._state(number)
        if batch_id <= state["batch"]:
            return []
        hit = updates.select(self.bucket(state["key"], state["buckets"]).alias("b")).distinct().collect()  # one number a bucket at most
        touched = sorted({str(r["b"]) for r in hit} & state["folders"].keys())
        if touched:
            rows = merged(self._read(state, touched), updates).select(*[f["name"] for f in state["schema"]["fields"]])
            state["folders"] |= dict.fromkeys(touched) | self._write(rows, state)
            state["folders"] = {b: f for b, f in state["folders"].items() if f}
        self._commit(number + 1, state | {"batch": batch_id})
        self._vacuum()
        return touched

    def _vacuum(self) -> None:
        """Remove folders that no kept commit names, and older commits."""
        commits = self._commits()
        old, kept = commits[:-KEPT_COMMITS], commits[-KEPT_COMMITS:]
        used = {f for c in kept for f in self._state(c)["folders"].values()}
        for c in old:
            for f in self._state(c)["folders"].values():
                if f not in used:
                    self._fs.delete(self._path(f"{self.path}/{f}"), True)
            self._fs.delete(self._path(f"{self.path}/_commits/{c:012d}"), False)
