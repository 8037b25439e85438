"""Registered queries for the streaming operators (STM-1, STM-3, STM-4,
STM-5).  STM-1, STM-3 and STM-4 have a query on the stream, fed in several
batches, and one on their batch twin; STM-5 runs its streams into parquet sinks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import text
from ..sources import files
from ..sources.bucketed import BucketedTable
from ..streaming import tracking
from .io_queries import scratch_dir
from .registry import query, table

# Event type -> operation state stand-in for the stream tests.
EVENT_OPERATION_STATE = {"purchase": "Succeeded", "error": "Failed", "signup": "NotStarted",
                         "view": "InProgress", "click": "Running"}
TRACK_TIMEOUT_S = 12 * 3600
#: Users are operations here, so they are remembered for longer than the events span.
TRACK_RETENTION_S = 80 * 86_400
_STATE_SQL = ("CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' "
              "WHEN 'signup' THEN 'NotStarted' WHEN 'view' THEN 'InProgress' ELSE 'Running' END")


def operation_events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", "ts", text.map_lookup(F.col("event_type"), EVENT_OPERATION_STATE)
                    .alias("state"))


@query("terminal_state", sql=f"""
WITH e AS (SELECT user_id, ts, {_STATE_SQL} AS st FROM events),
a AS (SELECT user_id, min(ts) AS first_ts,
             min(ts) FILTER (WHERE st IN ('Succeeded', 'Failed')) AS term_ts,
             arg_min(st, ts) FILTER (WHERE st IN ('Succeeded', 'Failed')) AS term_st FROM e GROUP BY 1)
SELECT user_id, first_ts,
  CASE WHEN term_ts <= first_ts + INTERVAL {TRACK_TIMEOUT_S} SECOND THEN term_st ELSE 'TimedOut' END AS final_status,
  CASE WHEN term_ts <= first_ts + INTERVAL {TRACK_TIMEOUT_S} SECOND THEN term_ts
       ELSE first_ts + INTERVAL {TRACK_TIMEOUT_S} SECOND END AS decided_at
FROM a
""")
def q_terminal_state(spark, sf):
    return tracking.terminal_state_batch(operation_events(spark, sf), "user_id", "ts", "state", TRACK_TIMEOUT_S)


def run_in_batches(spark, events, build, keys: str, parts: int = 4):
    """Feed ``events`` to a stream in ``parts`` runs by time, then one event far ahead under a null
    key that moves the watermark past all of them; returns what the stream emitted for real keys."""
    root = scratch_dir(spark, "batches")
    folder, sink, ckpt = (os.path.join(root, x) for x in ("in", "out", "ckpt"))
    low, high = (int(x) for x in events.agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))), F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first())
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    part = F.least(F.floor((at - low) * parts / (high - low + 1)), F.lit(parts - 1))
    last = events.limit(1).withColumns({keys: F.lit(None).cast(events.schema[keys].dataType),
                                        "ts": F.timestamp_micros(F.lit(high + 90 * 86_400_000_000)).cast("timestamp_ntz")})
    for batch in [*(events.where(part == i) for i in range(parts)), last, last]:
        batch.write.mode("append").parquet(folder)
        out = build(spark.readStream.schema(events.schema).parquet(folder))
        q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.where(F.col(keys).isNotNull()) if keys in out.columns else out


@query("terminal_state_stream", sql=f"""
WITH e AS (SELECT user_id, ts, {_STATE_SQL} AS st FROM events),
a AS (SELECT user_id, min(ts) AS first_ts,
             min(ts) FILTER (WHERE st IN ('Succeeded', 'Failed')) AS term_ts,
             arg_min(st, ts) FILTER (WHERE st IN ('Succeeded', 'Failed')) AS term_st FROM e GROUP BY 1)
SELECT user_id,
  CASE WHEN term_ts <= first_ts + INTERVAL {TRACK_TIMEOUT_S} SECOND THEN term_st ELSE 'TimedOut' END AS final_status,
  CASE WHEN term_ts <= first_ts + INTERVAL {TRACK_TIMEOUT_S} SECOND THEN term_ts
       ELSE first_ts + INTERVAL {TRACK_TIMEOUT_S} SECOND END AS decided_at
FROM a
""")
def q_terminal_state_stream(spark, sf):
    events = operation_events(spark, sf).select("user_id", "ts", "state")
    found = run_in_batches(spark, events, lambda s: tracking.track_until_terminal(
        s, "user_id", "ts", "state", TRACK_TIMEOUT_S, watermark="1 hour", retention_s=TRACK_RETENTION_S), "user_id")
    return found.withColumn("decided_at", F.col("decided_at").cast("timestamp_ntz"))


@query("refresh_status", sql=f"""
WITH latest AS (SELECT user_id, arg_max({_STATE_SQL}, ts) AS st FROM events GROUP BY user_id)
SELECT c.c_custkey,
  CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AND l.st IS NOT NULL THEN l.st
       WHEN c.c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'InProgress' ELSE 'Succeeded' END AS status
FROM customer c LEFT JOIN latest l ON c.c_custkey = l.user_id
""")
def q_refresh_status(spark, sf):
    c = table(spark, sf, "customer")
    base = c.select("c_custkey", F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "InProgress")
                    .otherwise("Succeeded").alias("status"))
    upd = operation_events(spark, sf).select(F.col("user_id").alias("c_custkey"), F.col("state").alias("status"), "ts")
    return tracking.refresh_status_batch(base, upd, "c_custkey", "status", "ts", ["InProgress", "Pending"])


#: Parts of the events by time in the order in which they arrive: the second before the first, and the first once more.
ARRIVAL = (1, 0, 3, 2, 0, 4)
OPEN = ("InProgress", "Pending", "Running")


def _refresh_sql() -> str:
    """Batch after batch: the latest update of a key counts if the row is open and has none as new."""
    parts = f"""
WITH e AS (SELECT user_id, ts, {_STATE_SQL} AS st, (epoch_us(ts) - lo) * 5 // (hi - lo + 1) AS part
  FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)),
s0 AS (SELECT c_custkey AS k, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'InProgress' ELSE 'Succeeded' END AS status, CAST(NULL AS TIMESTAMP) AS ts FROM customer)"""
    for i, part in enumerate(ARRIVAL):
        parts += f""",
u{i} AS (SELECT user_id, max(ts) AS ts, arg_max(st, ts) AS st FROM e WHERE part = {part} GROUP BY 1),
s{i + 1} AS (SELECT k, CASE WHEN a THEN st ELSE status END AS status, CASE WHEN a THEN uts ELSE ts END AS ts FROM (
  SELECT k, status, s.ts, st, u.ts AS uts, coalesce(u.ts IS NOT NULL AND status IN {OPEN} AND (s.ts IS NULL OR u.ts > s.ts), false) AS a
  FROM s{i} s LEFT JOIN u{i} u ON s.k = u.user_id))"""
    return parts + f" SELECT k AS c_custkey, status, ts AS updated FROM s{len(ARRIVAL)}"


@query("refresh_status_stream", sql=_refresh_sql())
def q_refresh_status_stream(spark, sf):
    """STM-3 on the stream: six micro-batches, some late and one sent twice, merged into a bucketed table."""
    root = scratch_dir(spark, "refresh")
    c = table(spark, sf, "customer")
    base = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "InProgress").otherwise("Succeeded").alias("status"),
                    F.lit(None).cast("timestamp_ntz").alias("ts"))
    held = BucketedTable.create(base, os.path.join(root, "table"), "k", buckets=8)
    events = operation_events(spark, sf).select(F.col("user_id").alias("k"), F.col("state").alias("status"), "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    for i, part in enumerate(ARRIVAL):
        events.where(F.floor((at - low) * 5 / (high - low + 1)) == part).write.parquet(os.path.join(root, "in", f"p={i}"))
        stream = spark.readStream.schema(events.schema).parquet(os.path.join(root, "in", "*"))
        tracking.refresh_status_table(stream, held, "status", "ts", OPEN, os.path.join(root, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    return held.read().select(F.col("k").alias("c_custkey"), "status", F.col("ts").alias("updated"))


@query("state_counts_stream", sql=f"""
SELECT date_trunc('hour', ts) AS window_start,
       CAST(count(*) FILTER (WHERE {_STATE_SQL} IN ('Running', 'InProgress', 'NotStarted')) AS BIGINT) AS n_running,
       CAST(count(*) FILTER (WHERE {_STATE_SQL} = 'Failed') AS BIGINT) AS n_failed
FROM events GROUP BY 1
""")
def q_state_counts_stream(spark, sf):
    """STM-4 on the stream: windows come out when the watermark has passed them."""
    events = operation_events(spark, sf).select("user_id", "ts", "state")
    return run_in_batches(spark, events, lambda s: tracking.state_counts(s, "ts", "state", watermark="1 hour"), "user_id")


@query("tail_bytes", sql="""
SELECT user_id % 8 AS run, CAST(event_id AS VARCHAR) || ' ' || event_type AS line FROM events
""")
def q_tail_bytes(spark, sf):
    """STM-5 by byte offset: files grow and new ones come between three runs; each run reads the new bytes."""
    root = scratch_dir(spark, "bytes")
    folder, sink, ckpt = os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "ckpt")
    e = table(spark, sf, "events").select((F.col("user_id") % 8).alias("run"), "event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("line"))
    for turn in range(3):
        # runs 6 and 7 have no file before the last turn
        new = e.where((F.when(F.col("run") >= 6, 2).otherwise(F.col("event_id") % 3)) == turn)
        new.repartition("run").sortWithinPartitions("run", "event_id").select("run", "line").foreachPartition(_appender(folder))
        out = files.tail_bytes(spark, folder, sink, ckpt, suffix=".log")
    return out.select(F.regexp_extract("file", "run-([0-9]+)[.]log", 1).cast("long").alias("run"), "line")


def _appender(folder: str):
    """Appends the rows' lines to one log file per run; a run's rows are in one task."""
    def run(rows):
        fs, top = files.store(folder)
        out, name = None, None
        fs.create_dir(top, recursive=True)
        for row in rows:
            if row["run"] != name:
                if out:
                    out.close()
                name = row["run"]
                out = fs.open_append_stream(f"{top}/run-{name}.log")
            out.write(f"{row['line']}\n".encode())
        if out:
            out.close()
    return run


@query("state_counts", sql=f"""
SELECT date_trunc('hour', ts) AS window_start,
       CAST(count(*) FILTER (WHERE {_STATE_SQL} IN ('Running', 'InProgress', 'NotStarted')) AS BIGINT) AS n_running,
       CAST(count(*) FILTER (WHERE {_STATE_SQL} = 'Failed') AS BIGINT) AS n_failed
FROM events GROUP BY 1
""")
def q_state_counts(spark, sf):
    return tracking.state_counts(operation_events(spark, sf), "ts", "state")


@query("tail_log", sql="""
SELECT CAST(event_id AS VARCHAR) || ' ' || event_type AS line FROM events
""")
def q_tail_log(spark, sf):
    root = scratch_dir(spark, "tail")
    folder, sink, ckpt = os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "ckpt")
    e = table(spark, sf, "events").select("ts", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type")
                                          .alias("line"))
    first_half = e.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    second_half = e.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    first_half.select("line").write.text(os.path.join(folder, "a"))
    tracking.tail_log(spark, folder + "/*", sink, ckpt, glob="part-*")
    # new files arrive; the second run reads only them (checkpoint = offset)
    second_half.select("line").write.text(os.path.join(folder, "b"))
    return tracking.tail_log(spark, folder + "/*", sink, ckpt, glob="part-*").select("line")


@query("log_page", sql="""
SELECT run, line_no, line FROM (
  SELECT user_id % 16 AS run, CAST(row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS BIGINT) AS line_no,
         CAST(event_id AS VARCHAR) || ' ' || event_type AS line FROM events)
WHERE line_no BETWEEN 4 AND 23
""")
def q_log_page(spark, sf):
    """STM-5 with offset and size: 20 lines of each run's log file after the first three."""
    root = scratch_dir(spark, "logs")
    e = table(spark, sf, "events").withColumn("line", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type"))
    e = e.withColumn("run", F.col("user_id") % 16)
    files = e.repartition("run").sortWithinPartitions("run", "event_id")
    files.select("run", F.col("line").alias("value")).write.partitionBy("run").text(root)
    page = tracking.log_page(tracking.numbered_lines(spark, root, glob="part-*"), 3, 20)
    return page.select(F.regexp_extract("file", "/run=([0-9]+)/", 1).cast("long").alias("run"), "line_no", "line")
