"""Streaming operators over feeds of state changes (STM-1 .. STM-5).

The reference polls a service until an operation reaches a terminal state.
Here the same questions run as Structured Streaming jobs over a stream of
state-change events, each with a batch twin that computes the same answer
on a static DataFrame (used by the oracle checks and by tests that compare
stream and batch results).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.status import FAILED, SUCCEEDED
from ..operators.ranking import rank_within_groups
from ..operators.relational import merge_updates

TERMINAL = (SUCCEEDED, FAILED)
TIMED_OUT = "TimedOut"

# Polling limits of the reference clients, in seconds.
OPERATION_TIMEOUT_S = 300
STATEMENT_TIMEOUT_S = 60
SESSION_TIMEOUT_S = 600

#: How long a decided operation's key is remembered, in seconds of event time.
RETENTION_S = 30 * 86_400


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Cast a ``timestamp_ntz`` column to ``timestamp`` (session zone UTC),
    which watermarks require."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# ---------------------------------------------------------------------------
# STM-1: first terminal state within a deadline from the first event
# ---------------------------------------------------------------------------

def terminal_state_batch(events: DataFrame, key: str, ts: str, status: str,
                         timeout_s: int = OPERATION_TIMEOUT_S, terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """Batch twin of :func:`track_until_terminal`.

    Per key: the deadline is ``first event + timeout``; the result is the
    earliest terminal status at or before the deadline, else ``TimedOut`` at
    the deadline.  Two map-side-combinable aggregates, no window.
    """
    term = F.col(status).isin(*terminal)
    agg = events.groupBy(key).agg(
        F.min(ts).alias("first_ts"),
        F.min(F.when(term, F.struct(F.col(ts).alias("t"), F.col(status).alias("s")))).alias("__term"))
    deadline = F.col("first_ts") + F.make_dt_interval(secs=F.lit(timeout_s))
    ok = F.col("__term").isNotNull() & (F.col("__term.t") <= deadline)
    # a terminal event after the deadline does not count, but an earlier
    # terminal one may exist only if it is the minimum -- so min is enough
    return agg.select(key, "first_ts",
                      F.when(ok, F.col("__term.s")).otherwise(F.lit(TIMED_OUT)).alias("final_status"),
                      F.when(ok, F.col("__term.t")).otherwise(deadline).alias("decided_at"))


def _microseconds(t: pd.Series) -> pd.Series:
    t = pd.to_datetime(t)
    if t.dt.tz is not None:
        t = t.dt.tz_convert("UTC").dt.tz_localize(None)
    return t.astype("datetime64[us]").astype("int64")


def _tracker(key_col: str, ts_col: str, status_col: str, timeout_us: int, terminal: tuple, retention_us: int):
    """State per key: first event, earliest terminal event and its status, and, once the outcome is out, when the state goes."""
    def decided(state, first, best, status):
        """Keep the key until the retention after its outcome is over."""
        limit = first + timeout_us
        gone_ms = (min(best if best is not None else limit, limit) + retention_us) // 1000 + 1
        if gone_ms <= state.getCurrentWatermarkMs():
            state.remove()
        else:
            state.update((first, best, status, gone_ms))
            state.setTimeoutTimestamp(gone_ms)

    def outcome(k, first, best, status) -> pd.DataFrame:
        on_time = best is not None and best <= first + timeout_us
        at = best if on_time else first + timeout_us
        return pd.DataFrame({key_col: [k], "final_status": [status if on_time else TIMED_OUT],
                             "decided_at": [pd.Timestamp(at, unit="us")]})

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, best, status, gone_ms = state.get if state.exists else (None, None, None, 0)
        if gone_ms:
            if gone_ms > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(gone_ms)
                return
            state.remove()
            first = best = status = None
            if state.hasTimedOut:
                return
        if state.hasTimedOut:
            decided(state, first, best, status)
            yield outcome(key[0], first, best, status)
            return
        for pdf in pdfs:
            if pdf.empty:
                continue
            us = _microseconds(pdf[ts_col])
            first = int(us.min()) if first is None else min(first, int(us.min()))
            ends = pdf[status_col].isin(terminal)
            if ends.any():
                at = int(us[ends].min())
                name = min(pdf[status_col][ends & (us == at)])
                if best is None or (at, name) < (best, status):
                    best, status = at, name
        if first is None:
            return
        # due once the watermark has passed the outcome's time: no earlier event can come then
        due_ms = min(first + timeout_us, best if best is not None else first + timeout_us) // 1000 + 1
        if due_ms <= state.getCurrentWatermarkMs():
            decided(state, first, best, status)
            yield outcome(key[0], first, best, status)
        else:
            state.update((first, best, status, 0))
            state.setTimeoutTimestamp(due_ms)

    return fn


def track_until_terminal(stream: DataFrame, key: str, ts: str, status: str,
                         timeout_s: int = OPERATION_TIMEOUT_S, watermark: str = "10 minutes",
                         terminal: Sequence[str] = TERMINAL, retention_s: int = RETENTION_S) -> DataFrame:
    """Emit each operation's outcome once (STM-1): its earliest terminal status
    within ``timeout_s`` of its **first** event, else ``TimedOut``.

    The outcome is emitted when the event-time watermark has passed it, so events
    out of order within the watermark count as in the batch twin; later ones are
    late and dropped.  State per key is four small values.  It is kept for
    ``retention_s`` after the outcome's time, so that a key's later events don't
    start it anew, and removed when the watermark has passed that; an event of
    the key that is not late then starts a new operation with an outcome of its own.
    """
    key_type = stream.schema[key].dataType
    out_schema = T.StructType([T.StructField(key, key_type), T.StructField("final_status", T.StringType()),
                               T.StructField("decided_at", T.TimestampType())])
    state_schema = T.StructType([T.StructField("first", T.LongType()), T.StructField("best", T.LongType()),
                                 T.StructField("status", T.StringType()), T.StructField("gone_ms", T.LongType())])
    s = event_time(stream, ts).withWatermark(ts, watermark)
    fn = _tracker(key, ts, status, int(timeout_s) * 1_000_000, tuple(terminal), int(retention_s) * 1_000_000)
    return s.groupBy(key).applyInPandasWithState(fn, out_schema, state_schema, "append", "EventTimeTimeout")


# ---------------------------------------------------------------------------
# STM-3: refresh open rows of a status table per micro-batch
# ---------------------------------------------------------------------------

def refresh_status_batch(base: DataFrame, updates: DataFrame, key: str, status: str, ts: str,
                         open_statuses: Sequence[str]) -> DataFrame:
    """Batch twin: apply the latest update per key to the open rows only.

    Where ``base`` has a column ``ts``, the time of its last update, updates that
    are not newer are ignored and the column is kept current.
    """
    latest = updates.groupBy(key).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(status).alias("s"))).alias("__new"))
    upd = base.where(F.col(status).isin(*open_statuses)).join(latest, key)
    if ts in base.columns:
        upd = upd.where(F.col(ts).isNull() | (F.col("__new.t") > F.col(ts))).withColumn(ts, F.col("__new.t").cast(base.schema[ts].dataType))
    return merge_updates(base, upd.withColumn(status, F.col("__new.s")).drop("__new"), key)


def refresh_status_stream(stream: DataFrame, table_path: str, key: str, status: str, ts: str,
                          open_statuses: Sequence[str], checkpoint: str):
    """Keep a status table current from a stream of updates (STM-3).

    ``foreachBatch``: per micro-batch take the latest update per key, merge
    it into the open rows, and write the table through a staged swap.  The
    last applied batch id is stored next to the table, so a replayed batch
    after a failure is skipped.  Give the table a column ``ts`` to ignore updates
    that arrive after newer ones.
    """
    from ..sources.sinks import overwrite_table, path_exists

    def apply(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        marker = f"{table_path.rstrip('/')}.__batch"
        if path_exists(spark, marker) and batch_id <= spark.read.parquet(marker).first()["batch_id"]:
            return
        base = spark.read.parquet(table_path)
        merged = refresh_status_batch(base, batch, key, status, ts, open_statuses)
        overwrite_table(merged, table_path)
        spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).write.mode("overwrite").parquet(marker)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def refresh_status_table(stream: DataFrame, table, status: str, ts: str, open_statuses: Sequence[str], checkpoint: str):
    """STM-3 on a :class:`~lakeloom.sources.bucketed.BucketedTable`: a micro-batch rewrites the buckets that hold its keys.

    The batch id is committed with the data, so a replayed batch changes nothing;
    with a column ``ts`` in the table, updates that arrive after newer ones don't
    either.  Updates of keys that the table lacks are left out.
    """
    key = table.state()["key"]

    def apply(batch: DataFrame, batch_id: int):
        batch.persist()
        try:
            table.merge(batch, batch_id, lambda base, new: refresh_status_batch(base, new, key, status, ts, open_statuses))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


# ---------------------------------------------------------------------------
# STM-4: running / failed counts over time
# ---------------------------------------------------------------------------

def late_rows(query) -> int:
    """Rows that a finished or running stream has dropped because they came after the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def state_counts(events: DataFrame, ts: str, status: str, width: str = "1 hour",
                 running: Sequence[str] = ("Running", "InProgress", "NotStarted"),
                 failed: Sequence[str] = (FAILED,), watermark: str | None = None) -> DataFrame:
    """Counts of running and failed states per event-time window (STM-4).
    With ``watermark`` it is the streaming form (append mode emits each
    window once it closes); without, the batch twin."""
    e = event_time(events, ts)
    if watermark:
        e = e.withWatermark(ts, watermark)
    return (e.groupBy(F.window(ts, width).alias("w"))
            .agg(F.count_if(F.col(status).isin(*running)).alias("n_running"),
                 F.count_if(F.col(status).isin(*failed)).alias("n_failed"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n_running", "n_failed"))


# ---------------------------------------------------------------------------
# STM-5: tail a log folder
# ---------------------------------------------------------------------------

def tail_log(spark, folder: str, sink: str, checkpoint: str, glob: str = "*.log"):
    """Append new log lines to ``sink`` (parquet); the checkpoint is the read
    offset, so each run picks up only files added since the last (STM-5)."""
    lines = (spark.readStream.format("text").option("pathGlobFilter", glob).load(folder)
             .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")))
    q = (lines.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


def numbered_lines(spark, folder: str, glob: str = "*.log") -> DataFrame:
    """``file, line_no, line`` of the log files below ``folder``; line numbers begin at 1.

    Lines are numbered by their place in the file (block, then order within the
    block) with the skew-safe ranking, so a huge file is not numbered in one task.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"),
                     F.monotonically_increasing_id().alias("__nth"), F.col("value").alias("line")))
    return rank_within_groups(lines, ["file"], ["__block", "__nth"], out="line_no").select("file", "line_no", "line")


def log_page(lines: DataFrame, offset: int = 0, size: int | None = None) -> DataFrame:
    """Of each file the lines after the first ``offset``, at most ``size`` of them (STM-5)."""
    page = lines.where(F.col("line_no") > offset)
    return page if size is None else page.where(F.col("line_no") <= offset + size)


def tail_lines(spark, folder: str, sink: str, glob: str = "*.log") -> DataFrame:
    """Append to ``sink`` (parquet) the lines that it doesn't have yet, also those added to files read before.

    The offset of each file is the last line number in the sink, so a run that
    failed before its commit is simply run again.
    """
    from ..sources.sinks import path_exists
    new = numbered_lines(spark, folder, glob)
    if path_exists(spark, sink):
        known = spark.read.parquet(sink).groupBy("file").agg(F.max("line_no").alias("__last"))
        new = new.join(known, "file", "left").where(F.col("line_no") > F.coalesce("__last", F.lit(0))).drop("__last")
    new.write.mode("append").parquet(sink)
    return spark.read.parquet(sink)
