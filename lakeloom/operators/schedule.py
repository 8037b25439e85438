"""Schedules: expand to firing times and find missed runs (DTE-4, DTE-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import known_zone


def expand_schedule(schedules: DataFrame, key: str, window_from=None, window_to=None) -> DataFrame:
    """Firing times of enabled schedules (DTE-4).

    Input columns: ``enabled``, ``type`` (Cron, Daily, Weekly), ``start``,
    ``end`` (local wall-clock ``timestamp_ntz``), ``tz`` (Windows or IANA
    zone), ``interval`` (minutes, Cron), ``times`` (``HH:mm`` list) and
    ``weekdays`` (day names).  Output: ``key``, ``fire_local``, ``fire_utc``.
    Bounds are inclusive; ``window_from``/``window_to`` clip the expansion so
    the output is bounded by the period asked for.  ``fire_utc`` is null where
    the zone's name is not known.
    """
    s = schedules.where(F.coalesce(F.col("enabled"), F.lit(False)))
    lo, hi = F.col("start"), F.col("end")
    if window_from is not None:
        lo = F.greatest(lo, F.lit(window_from).cast("timestamp_ntz"))
    if window_to is not None:
        hi = F.least(hi, F.lit(window_to).cast("timestamp_ntz"))
    s = s.withColumn("__lo", lo).withColumn("__hi", hi).where(F.col("__lo") <= F.col("__hi"))
    # first firing at or after the window start, on the schedule's own grid,
    # so the generated sequence covers only the window asked for
    step_us = F.col("interval").cast("long") * 60_000_000
    behind = F.unix_micros(F.col("__lo").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    skips = F.when(behind > 0, F.ceil(behind / step_us)).otherwise(F.lit(0)).cast("long")
    first = F.col("start") + F.make_dt_interval(secs=(skips * step_us / 1_000_000).cast("decimal(18,6)"))
    cron = s.where((F.col("type") == "Cron") & (F.col("interval") > 0)).withColumn("__first", first) \
        .where(F.col("__first") <= F.col("__hi")).select(
            key, "tz", F.explode(F.sequence(F.col("__first"), F.col("__hi"),
                                            F.make_dt_interval(mins=F.col("interval").cast("int")))).alias("fire_local"))
    cal = s.where(F.col("type").isin("Daily", "Weekly")).select(
        key, "tz", "type", "weekdays", "times", "__lo", "__hi",
        F.explode(F.sequence(F.to_date("__lo"), F.to_date("__hi"))).alias("__day"))
    cal = cal.where((F.col("type") == "Daily")
                    | F.coalesce(F.array_contains("weekdays", F.date_format("__day", "EEEE")), F.lit(False)))
    cal = cal.select(key, "tz", "__lo", "__hi", "__day", F.explode("times").alias("__time"))
    cal = cal.select(key, "tz", "__lo", "__hi", F.to_timestamp_ntz(F.concat(
        F.col("__day").cast("string"), F.lit(" "), F.col("__time"), F.lit(":00"))).alias("fire_local"))
    cal = cal.where(F.col("fire_local").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    out = cron.unionByName(cal)
    utc = F.to_utc_timestamp(F.col("fire_local").cast("timestamp"), known_zone(F.col("tz")))
    return out.select(key, "fire_local", utc.cast("timestamp_ntz").alias("fire_utc"))


def slot_start(ts: Column, minutes: int) -> Column:
    """Start of the ``minutes``-wide slot containing ``ts`` (UTC epoch grid)."""
    us = F.unix_micros(ts.cast("timestamp"))
    step = int(minutes) * 60 * 1_000_000
    return F.timestamp_micros(F.floor(us / step) * step).cast("timestamp_ntz")


def missed_runs(expected: DataFrame, actual: DataFrame, key: str, fire_col: str, run_col: str,
                slot_minutes: int = 60) -> DataFrame:
    """Expected firings with no run in their slot (DTE-5): ``left_anti`` on
    ``(key, slot)``; both sides shuffle on the same keys."""
    e = expected.withColumn("__slot", slot_start(F.col(fire_col), slot_minutes))
    a = actual.select(key, slot_start(F.col(run_col), slot_minutes).alias("__slot")).distinct()
    return e.join(a, [key, "__slot"], "left_anti").withColumnRenamed("__slot", "slot")
