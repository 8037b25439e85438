"""Directory walk, appended lines, file export, the bucketed table and streams fed late rows."""

import base64
import io
import os

import pytest
from pyspark.sql import functions as F

from lakeloom.sources import files
from lakeloom.sources.bucketed import BucketedTable
from lakeloom.streaming import tracking


def test_walk_lists_files_and_empty_folders(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/t/a b/empty")
    os.makedirs(f"{tmp_dir}/t/é")
    for name, data in (("x.txt", b""), ("a b/y%20.bin", b"123"), ("é/_z", b"1")):
        with open(f"{tmp_dir}/t/{name}", "wb") as f:
            f.write(data)
    rows = files.walk_paths(spark, f"{tmp_dir}/t").collect()
    assert {(r.name, r.contentLength, r.isDirectory) for r in rows} == {
        ("x.txt", 0, False), ("a b", 0, True), ("a b/empty", 0, True), ("a b/y%20.bin", 3, False), ("é", 0, True), ("é/_z", 1, False)}
    assert all(r.lastModified and r.permissions is None and r.creationTime is None for r in rows)
    assert {r.name for r in files.walk_paths(spark, f"file:{tmp_dir}/t/", recursive=False).collect()} == {"x.txt", "a b", "é"}
    assert files.walk_paths(spark, f"{tmp_dir}/nothing").count() == 0


class Watched(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.seen = []

    def read(self, n=-1):
        self.seen.append((self.tell(), n))
        return super().read(n)


def test_only_new_bytes_are_read():
    old = b"".join(b"line %d\n" % i for i in range(100_000))
    f = Watched(old + b"half")
    assert list(files.complete_lines(f, len(old), len(old) + 4)) == [] and f.seen == [(len(old), 4)]
    f = Watched(old + b"half and half\r\nlast\nopen")
    size = len(old) + 4
    assert list(files.complete_lines(f, size, size + 20)) == [(len(old), "half and half"), (len(old) + 15, "last")]
    assert min(at for at, _ in f.seen) >= size - files.BACK_BYTES
    data = b"a\n\nbcd\nlong line\nx\n"
    for step in range(1, len(data) + 1):  # however the file is cut, each line comes once
        got = [x for at in range(0, len(data), step) for x in files.complete_lines(io.BytesIO(data), at, min(at + step, len(data)))]
        assert got == [(0, "a"), (2, ""), (3, "bcd"), (7, "long line"), (17, "x")]


def test_tail_of_growing_files(spark, tmp_dir):
    folder, sink, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    os.makedirs(f"{folder}/sub")
    want = []
    for name, text, new in (("run.log", "a\nb", ["a"]), ("run.log", "c\n", ["bc"]), ("sub/é.log", "x\n", ["x"]), ("skip.txt", "no\n", []), ("run.log", "", [])):
        with open(f"{folder}/{name}", "a") as f:
            f.write(text)
        want += new
        assert sorted(r.line for r in files.tail_bytes(spark, folder, sink, ckpt, suffix=".log").collect()) == sorted(want)


def test_failed_export_leaves_nothing(spark, tmp_dir):
    good = [(f"d{i % 3}/{i}.bin", base64.b64encode(bytes([i])).decode()) for i in range(20)]
    df = spark.createDataFrame(good, "name string, content string").repartition(4)
    files.export_files(df, f"{tmp_dir}/e", "name", "content")
    seen = {r.name: r.contentLength for r in files.walk_paths(spark, f"{tmp_dir}/e").where("not isDirectory").collect()}
    assert seen == {n: 1 for n, _ in good} and open(f"{tmp_dir}/e/d1/7.bin", "rb").read() == b"\x07"
    for bad in (("x.bin", "%%%"), ("../x.bin", "AA=="), ("/x.bin", "AA==")):
        with pytest.raises(Exception):
            files.export_files(df.unionAll(spark.createDataFrame([bad], df.schema)), f"{tmp_dir}/f", "name", "content")
        assert not os.path.exists(f"{tmp_dir}/f") and [n for n in os.listdir(tmp_dir) if "__export" in n] == []
    files.export_files(spark.createDataFrame([("new.bin", None)], df.schema), f"{tmp_dir}/e", "name", "content", overwrite=False)
    assert files.walk_paths(spark, f"{tmp_dir}/e").where("not isDirectory").count() == 21
    files.export_files(spark.createDataFrame([("only.bin", "AA==")], df.schema), f"{tmp_dir}/e", "name", "content")
    assert os.listdir(f"{tmp_dir}/e") == ["only.bin"]


def test_one_key_rewrites_one_bucket(spark, tmp_dir):
    base = spark.range(100).select(F.col("id").alias("k"), F.lit("Running").alias("status"), F.lit(None).cast("timestamp").alias("ts"))
    table = BucketedTable.create(base, f"{tmp_dir}/t", "k", buckets=8)
    before = table.state()["folders"]
    update = spark.createDataFrame([(7, "Done")], "k long, status string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))

    def merged(b, u):
        return tracking.refresh_status_batch(b, u, "k", "status", "ts", ["Running"])

    touched = table.merge(update, 0, merged)
    after = table.state()["folders"]
    assert len(touched) == 1 and {b for b in before if before[b] != after[b]} == set(touched) and before.keys() == after.keys()
    assert {r.k for r in table.read().where("status = 'Done'").collect()} == {7} and table.read().count() == 100
    assert table.merge(update.withColumn("status", F.lit("Late")), 0, merged) == [] and table.state()["folders"] == after

    def fails(b, u):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        table.merge(update, 1, fails)
    assert table.state()["folders"] == after and table.state()["batch"] == 0
    assert table.merge(update.withColumn("k", F.lit(1000).cast("long")), 1, merged) is not None and table.read().count() == 100
    for i in range(2, 6):  # old folders go, the table stays
        table.merge(update.withColumn("k", F.lit(i).cast("long")), i, merged)
    assert table.read().where("status = 'Done'").count() == 5 and len(os.listdir(f"{tmp_dir}/t/_commits")) == len([c for c in os.listdir(f"{tmp_dir}/t/_commits") if c.endswith(".crc")]) + 2
    with pytest.raises(FileExistsError):
        BucketedTable.create(base, f"{tmp_dir}/t", "k")


def test_late_rows_are_counted(spark, tmp_dir):
    src, sink, ckpt = (f"{tmp_dir}/{x}" for x in ("in", "out", "ckpt"))
    late = 0
    for hour, minute in ((10, 5), (15, 0), (10, 10), (20, 0)):
        spark.createDataFrame([(f"2024-01-01 {hour}:{minute:02d}:00", "Failed")], "ts string, state string").select(F.to_timestamp_ntz("ts").alias("ts"), "state").write.mode("append").parquet(src)
        stream = spark.readStream.schema("ts timestamp_ntz, state string").parquet(src)
        q = tracking.state_counts(stream, "ts", "state", watermark="1 hour").writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        late += tracking.late_rows(q)
    assert late == 1
    assert {(r.window_start.hour, r.n_failed) for r in spark.read.parquet(sink).collect()} == {(10, 1), (15, 1)}
