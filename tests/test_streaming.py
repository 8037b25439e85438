"""Stream = batch twin for the streaming operators (STM-1, STM-4, STM-5)."""

import os

from pyspark.sql import functions as F

from lakeloom.plans.stream_queries import EVENT_OPERATION_STATE
from lakeloom.functions.text import map_lookup
from lakeloom.streaming import tracking

SF = "/root/testdata/sf0.001"


def _events(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.select("user_id", "ts", map_lookup(F.col("event_type"), EVENT_OPERATION_STATE).alias("state"))


def test_track_until_terminal_matches_batch(spark, tmp_dir):
    ev = _events(spark)
    src = os.path.join(tmp_dir, "src")
    ev.write.parquet(src)
    timeout = 6 * 3600
    stream = spark.readStream.schema(ev.schema).parquet(src)
    out = tracking.track_until_terminal(stream, "user_id", "ts", "state", timeout_s=timeout, watermark="1 hour")
    sink, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: (r.final_status, r.decided_at) for r in spark.read.parquet(sink).collect()}
    batch = tracking.terminal_state_batch(ev, "user_id", "ts", "state", timeout).collect()
    max_ts = ev.agg(F.max("ts")).first()[0]
    import datetime as dt
    settled = {r.user_id: (r.final_status, r.decided_at) for r in batch
               if r.first_ts + dt.timedelta(seconds=timeout) < max_ts - dt.timedelta(hours=1)}
    assert settled, "test needs settled operations"
    for k, v in settled.items():
        if k in got:
            assert got[k][0] == v[0], (k, got[k], v)
    # every terminal decision the stream made agrees with the batch twin
    assert all(got[k][0] == {r.user_id: r.final_status for r in batch}[k] for k in got)
    assert len(set(settled) - set(got)) == 0


def test_state_counts_stream_matches_batch(spark, tmp_dir):
    ev = _events(spark)
    src = os.path.join(tmp_dir, "src")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    out = tracking.state_counts(stream, "ts", "state", watermark="1 hour")
    sink, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    q = out.writeStream.outputMode("append").format("parquet").option("path", sink) \
        .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.window_start: (r.n_running, r.n_failed) for r in spark.read.parquet(sink).collect()}
    want = {r.window_start: (r.n_running, r.n_failed) for r in tracking.state_counts(ev, "ts", "state").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_refresh_status_stream_matches_batch(spark, tmp_dir):
    ev = _events(spark).withColumnRenamed("user_id", "k").withColumnRenamed("state", "status")
    base = spark.range(0, 300).select(F.col("id").alias("k"),
                                      F.when(F.col("id") % 3 == 0, "Succeeded").otherwise("InProgress")
                                      .alias("status"))
    table_path = os.path.join(tmp_dir, "status")
    base.write.parquet(table_path)
    src = os.path.join(tmp_dir, "src")
    ev.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).write.parquet(os.path.join(src, "a"))
    stream = spark.readStream.schema(ev.schema).parquet(src + "/*")
    ckpt = os.path.join(tmp_dir, "ckpt")
    w = tracking.refresh_status_stream(stream, table_path, "k", "status", "ts", ["InProgress", "Pending"], ckpt)
    w.trigger(availableNow=True).start().awaitTermination()
    ev.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).write.parquet(os.path.join(src, "b"))
    w = tracking.refresh_status_stream(spark.readStream.schema(ev.schema).parquet(src + "/*"), table_path, "k",
                                       "status", "ts", ["InProgress", "Pending"], ckpt)
    w.trigger(availableNow=True).start().awaitTermination()
    got = {r.k: r.status for r in spark.read.parquet(table_path).collect()}
    # batch twin applied in the same two steps (a row closed by the first
    # batch is not reopened by the second)
    first = tracking.refresh_status_batch(base, ev.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")),
                                          "k", "status", "ts", ["InProgress", "Pending"])
    second = tracking.refresh_status_batch(first, ev.where(F.col("ts") >= F.lit("2024-01-15")
                                                          .cast("timestamp_ntz")),
                                           "k", "status", "ts", ["InProgress", "Pending"])
    want = {r.k: r.status for r in second.collect()}
    assert got == want


def test_lines_added_to_known_files_are_read(spark, tmp_dir):
    from lakeloom.streaming.tracking import tail_lines
    folder, sink = f"{tmp_dir}/in", f"{tmp_dir}/out"
    os.makedirs(folder)
    for text, expected in (("a\nb\n", ["a", "b"]), ("c\n", ["a", "b", "c"]), ("", ["a", "b", "c"])):
        with open(f"{folder}/run.log", "a") as f:
            f.write(text)
        rows = tail_lines(spark, folder, sink).orderBy("line_no").collect()
        assert [r.line for r in rows] == expected
        assert [r.line_no for r in rows] == list(range(1, len(expected) + 1))


def test_tracker_state_goes_after_the_retention(spark, tmp_dir):
    import datetime as dt
    start = dt.datetime(2024, 1, 1)
    schema = "k long, ts timestamp_ntz, state string"
    folder, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "out", "ckpt"))
    rows_held = []

    def feed(*events):
        spark.createDataFrame([(k, start + dt.timedelta(hours=h), s) for k, h, s in events], schema).coalesce(1).write.mode("append").parquet(folder)
        out = tracking.track_until_terminal(spark.readStream.schema(schema).parquet(folder), "k", "ts", "state", timeout_s=3600,
                                            watermark="1 minute", retention_s=10 * 3600)
        q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        rows_held.append(q.lastProgress.stateOperators[0].numRowsTotal)
        found = spark.read.parquet(sink).withColumn("decided_at", F.col("decided_at").cast("timestamp_ntz")).orderBy("k", "decided_at")
        return [(r.k, r.final_status, r.decided_at) for r in found.collect()]

    hour = lambda h: start + dt.timedelta(hours=h)
    feed((1, 0, "Running"), (1, 0.5, "Succeeded"), (2, 0, "Running"), (0, 4, "Running"))
    first = [(1, "Succeeded", hour(0.5)), (2, "TimedOut", hour(1))]
    assert feed((1, 5, "Failed"), (2, 5, "Failed"), (0, 6, "Running"))[-2:] == first  # remembered: no second outcome
    assert rows_held[-1] >= 2
    feed((9, 40, "Running"))
    assert rows_held[-1] == 1  # key 9 alone
    again = feed((1, 41, "Failed"), (9, 60, "Running"))
    assert [r for r in again if r[0] == 1] == [(1, "Succeeded", hour(0.5)), (1, "Failed", hour(41))]
    assert [r for r in again if r[0] == 2] == first[1:]
