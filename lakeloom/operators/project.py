"""Projections and filters (PRJ-1 .. PRJ-5, FLT-1 .. FLT-9).

Narrow transformations only: no shuffle, predicates stay plain columns so
Catalyst can push them into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import is_open
from ..functions.text import _c, _lit, file_extension


class MissingColumnError(ValueError):
    pass


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Stop with a message when a required column is missing (PRJ-1).
    Checked on the schema, before any job runs."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnError(
            f"Source column(s) {', '.join(repr(m) for m in missing)} not found; "
            f"available: {', '.join(df.columns)}")
    return df


def drop_if_exists(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns when present, no error otherwise (PRJ-2)."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present) if present else df


def extract_nested(df: DataFrame, path: str, out: str) -> DataFrame:
    """Add ``out`` = value at a dotted struct path; through an array of
    structs the result is an array (PRJ-3)."""
    return df.withColumn(out, F.col(path))


def append_result(df: DataFrame, originals: Sequence[str], out: str) -> DataFrame:
    """Original columns in order, then the result, never twice (PRJ-4)."""
    cols = list(originals) if out in originals else [*originals, out]
    return df.select(*cols)


def merge_metadata(base: DataFrame, override: DataFrame, key: str | Sequence[str],
                   fields: Sequence[str]) -> DataFrame:
    """Field by field: the override value unless it is null (PRJ-5).

    A left join on the key.  Several overrides of a key are reduced first, field
    by field to the largest value that is not null, so no row multiplies.
    """
    keys = [key] if isinstance(key, str) else list(key)
    o = override.groupBy(*keys).agg(*[F.max(f).alias(f"__o_{f}") for f in fields])
    j = base.join(o, keys, "left")
    return j.select(*[F.coalesce(F.col(f"__o_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
                      for c in base.columns])


def filter_eq(df: DataFrame, col: str, value, ignore_case: bool = False) -> DataFrame:
    """Equality filter; case-insensitive for region, sku, colour (FLT-1)."""
    if ignore_case:
        return df.where(F.lower(F.col(col)) == F.lower(_lit(value)))
    return df.where(F.col(col) == _lit(value))


def name_matches(name: Column, term: str, case_sensitive: bool = False, exact: bool = False) -> Column:
    """Literal substring (or whole) match; null names never match (FLT-2)."""
    if exact:
        return (name == F.lit(term)) if case_sensitive else (F.lower(name) == F.lit(term.lower()))
    if case_sensitive:
        return F.coalesce(name.contains(F.lit(term)), F.lit(False))
    return F.coalesce(F.lower(name).contains(F.lit(term.lower())), F.lit(False))


def search_name(df: DataFrame, col: str, term: str, case_sensitive: bool = False, exact: bool = False) -> DataFrame:
    return df.where(name_matches(F.col(col), term, case_sensitive, exact))


def search_any(df: DataFrame, cols: Sequence[str | Column], term: str | None) -> DataFrame:
    """Case-insensitive OR over columns; an empty term keeps all (FLT-3).
    Each column may be a fallback chain given as a ``coalesce`` Column."""
    if not term:
        return df
    t = term.lower()
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.coalesce(_c(c), F.lit(""))).contains(F.lit(t)), F.lit(False))
    return df.where(cond)


def variant_kind(union: Column, kinds: Sequence[str]) -> Column:
    """Name of the first populated field of a struct-of-structs union."""
    out = F.lit(None).cast("string")
    for k in reversed(kinds):
        out = F.when(union[k].isNotNull(), F.lit(k)).otherwise(out)
    return out


def filter_variant(df: DataFrame, union: str, kind: str, pred: Column | None = None) -> DataFrame:
    """Rows whose union holds ``kind``, optionally testing a nested field (FLT-4)."""
    cond = F.col(f"{union}.{kind}").isNotNull()
    if pred is not None:
        cond = cond & F.coalesce(pred, F.lit(False))
    return df.where(cond)


def filter_array_any(df: DataFrame, arr: str, value: str, mode: str = "equals") -> DataFrame:
    """Any element equals or contains ``value`` (FLT-5)."""
    if mode == "equals":
        return df.where(F.coalesce(F.array_contains(F.col(arr), value), F.lit(False)))
    return df.where(F.coalesce(F.exists(F.col(arr), lambda x: x.contains(value)), F.lit(False)))


def filter_expired(df: DataFrame, ts: str, now) -> DataFrame:
    """Expired = strictly before ``now``; a missing time is not expired (FLT-6).
    ``now`` is passed in so results are repeatable."""
    return df.where(F.col(ts) < _lit(now))


def exclude_types(df: DataFrame, col: str, excluded: Sequence[str]) -> DataFrame:
    """Drop unsupported kinds; rows with a null kind are kept (FLT-7)."""
    c = F.col(col)
    return df.where(c.isNull() | ~c.isin(list(excluded)))


def filter_extension(df: DataFrame, col: str, accepted: Sequence[str]) -> DataFrame:
    """Keep names whose last dot part (lower-case) is accepted (FLT-8).
    ``accepted`` entries may carry the leading dot."""
    acc = [a.lower().lstrip(".") for a in accepted]
    return df.where(file_extension(col).isin(acc))


def filter_open(df: DataFrame, job_col: str, status_col: str) -> DataFrame:
    """Deployments with a job whose status is not terminal (FLT-9)."""
    return df.where(is_open(job_col, status_col))
