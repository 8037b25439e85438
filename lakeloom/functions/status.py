"""State mapping, labels and schedule descriptions (MTH-1, MTH-2, STR-15,
STR-16, STM-2 flags).  Column in, column out; no Python per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, _lit, map_lookup

# Deployment statuses used throughout.
SUCCEEDED, FAILED, CANCELLED, IN_PROGRESS, PENDING = "Succeeded", "Failed", "Cancelled", "InProgress", "Pending"

# Batch state -> deployment status (rule R2); anything else is InProgress.
BATCH_STATE_TO_STATUS = {
    "success": "Succeeded",
    "error": "Failed", "dead": "Failed",
    "killed": "Cancelled",
    "starting": "InProgress", "running": "InProgress", "submitting": "InProgress",
    "not_started": "Pending", "not_submitted": "Pending",
}

# Job status -> deployment status (rule R2); anything else is InProgress.
JOB_STATUS_TO_STATUS = {"Completed": "Succeeded", "Failed": "Failed", "Cancelled": "Cancelled"}

# Node size and session state display names.
NODE_SIZE_LABELS = {
    "Small": "Small (4 cores, 28 GB RAM)",
    "Medium": "Medium (8 cores, 56 GB RAM)",
    "Large": "Large (16 cores, 112 GB RAM)",
    "XLarge": "XLarge (32 cores, 224 GB RAM)",
    "XXLarge": "XXLarge (64 cores, 448 GB RAM)",
}
SESSION_STATE_LABELS = {
    "InProgress": "In Progress", "Cancelled": "Cancelled", "NotStarted": "Not Started",
    "Succeeded": "Succeeded", "Failed": "Failed", "Unknown": "Unknown",
}

# Job status colours, matched case-insensitively; default gray.
JOB_STATUS_COLOURS = {
    "completed": "#107C10", "succeeded": "#107C10",
    "failed": "#D13438", "error": "#D13438",
    "running": "#0078D4", "inprogress": "#0078D4",
    "pending": "#F7630C", "queued": "#F7630C",
}
DEFAULT_COLOUR = "#605E5C"

# SKU prefix -> pricing tier (case-sensitive), else Unknown.
PRICING_TIERS = (("F", "Fabric"), ("P", "Premium"), ("A", "Azure"))


def map_batch_state(state: Column | str) -> Column:
    """Batch state to deployment status (R2)."""
    return map_lookup(_c(state), BATCH_STATE_TO_STATUS, IN_PROGRESS)


def map_job_status(status: Column | str) -> Column:
    """Job status to deployment status (R2)."""
    return map_lookup(_c(status), JOB_STATUS_TO_STATUS, IN_PROGRESS)


def label(code: Column | str, labels: Mapping[str, str]) -> Column:
    """Known label, else the code itself (STR-15)."""
    c = _c(code)
    return map_lookup(c, labels, c)


def status_colour(status: Column | str) -> Column:
    """Job status colour, case-insensitive; null status gives null."""
    s = _c(status)
    return F.when(s.isNotNull(), map_lookup(F.lower(s), JOB_STATUS_COLOURS, DEFAULT_COLOUR))


def pricing_tier(sku: Column | str) -> Column:
    """Pricing tier from the SKU's first letter (MTH-1)."""
    s = _c(sku)
    out = F.lit("Unknown")
    for prefix, tier in reversed(PRICING_TIERS):
        out = F.when(s.startswith(prefix), F.lit(tier)).otherwise(out)
    return F.when(s.isNull(), F.lit("Unknown")).otherwise(out)


def describe_schedule(job_type: Column | str, cfg: Column | str, enabled: Column | str) -> Column:
    """One line per schedule: ``jobType - type`` + details + `` (Disabled)`` (STR-16).

    ``cfg`` is a struct with ``type``, ``interval``, ``times`` and ``weekdays``.
    """
    c = _c(cfg)
    details = (F.when((c["type"] == "Daily") & c["times"].isNotNull(),
                      F.concat(F.lit(" at "), F.array_join(c["times"], ", ")))
               .when((c["type"] == "Weekly") & c["weekdays"].isNotNull() & c["times"].isNotNull(),
                     F.concat(F.lit(" on "), F.array_join(c["weekdays"], ", "),
                              F.lit(" at "), F.array_join(c["times"], ", ")))
               .when((c["type"] == "Cron") & c["interval"].isNotNull(),
                     F.concat(F.lit(" every "), c["interval"].cast("string"), F.lit(" minutes")))
               .otherwise(F.lit("")))
    disabled = F.when(~_c(enabled), F.lit(" (Disabled)")).otherwise(F.lit(""))
    return F.concat(_c(job_type), F.lit(" - "), c["type"], details, disabled)


def state_flags(status: Column | str, read_error: Column | str | None = None) -> Column:
    """Operation flags (STM-2): running = Running or NotStarted; complete =
    Succeeded or Failed.  A read error reports running=false, complete=true,
    succeeded=false, failed=false."""
    s = _c(status)
    err = F.lit(False) if read_error is None else F.coalesce(_c(read_error), F.lit(False))
    return F.struct(
        F.when(err, False).otherwise(F.coalesce(s.isin("Running", "NotStarted"), F.lit(False))).alias("is_running"),
        F.when(err, True).otherwise(F.coalesce(s.isin("Succeeded", "Failed"), F.lit(False))).alias("is_complete"),
        F.when(err, False).otherwise(F.coalesce(s == "Succeeded", F.lit(False))).alias("is_succeeded"),
        F.when(err, False).otherwise(F.coalesce(s == "Failed", F.lit(False))).alias("is_failed"),
    )


def is_open(job_id: Column | str, status: Column | str) -> Column:
    """Has a job and the status is not terminal (FLT-9)."""
    s = _c(status)
    return _c(job_id).isNotNull() & (s.isNull() | ~s.isin(SUCCEEDED, FAILED, CANCELLED))


# Grace after the job end before a deployment counts as failed.
GRACE_MINUTES = 10


def in_grace(end_ts: Column | str, now, minutes: int = GRACE_MINUTES) -> Column:
    """``end + minutes > now``; a missing end is never in grace (DTE-3)."""
    e = _c(end_ts)
    return F.coalesce(e + F.expr(f"INTERVAL {int(minutes)} MINUTES") > _lit(now), F.lit(False))
