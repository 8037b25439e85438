"""Validation functions (VAL-1, VAL-2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, js_trim

# Pool name rules and the range-check messages.
RESERVED_POOL_NAME = "starter pool"
NAME_PATTERN = r"^[a-zA-Z0-9\-_ ]+$"
NAME_MAX_LENGTH = 64
MIN_AT_LEAST_ONE = "Minimum {what} must be at least 1"
MAX_AT_LEAST_ONE = "Maximum {what} must be at least 1"
MIN_ABOVE_MAX = "Minimum {what} cannot be greater than maximum {what}"


def valid_name(s: Column | str) -> Column:
    """Non-blank, 1-64 characters of ``[A-Za-z0-9_ -]``, not the reserved
    name after trim + lower-case (VAL-2).  Null is invalid."""
    x = _c(s)
    t = js_trim(x)
    ok = ((F.length(t) > 0) & F.length(x).between(1, NAME_MAX_LENGTH) & x.rlike(NAME_PATTERN)
          & (F.lower(t) != RESERVED_POOL_NAME))
    return F.coalesce(ok, F.lit(False))


def range_errors(min_col: Column, max_col: Column, what: str = "node count") -> Column:
    """Messages in fixed order for a (min, max) pair (VAL-1); ``what`` is
    ``node count`` (autoscale) or ``executors`` (dynamic allocation)."""
    msgs = F.array(
        F.when(min_col < 1, F.lit(MIN_AT_LEAST_ONE.format(what=what))),
        F.when(max_col < 1, F.lit(MAX_AT_LEAST_ONE.format(what=what))),
        F.when(min_col > max_col, F.lit(MIN_ABOVE_MAX.format(what=what))),
    )
    return F.filter(msgs, lambda m: m.isNotNull())
