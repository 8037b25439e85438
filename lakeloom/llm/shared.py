"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Rows of about this many bytes go to Python, and come back, at once; a longer row goes alone.
BATCH_BYTES = 8 << 20

#: A driver-held or broadcast table may have this many rows of a few numbers each (some 100 MB).
BROADCAST_ROWS = 2_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``, with its DuckDB oracle where there is one."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage like ``checkpoint()`` and survives lost executors, in
    columns that later steps can prune.
    """
    return scratch_table(df, name)[0]


def scratch_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like :func:`written`, with the folder's path, for tables that go before the query ends."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows; count it first.

    Only for frames of a few fixed-width columns, read from a written table.
    Beyond the bound Spark shuffles both sides of the join instead.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bytes_of(name: str) -> Column:
    """UTF-8 bytes of a text column."""
    return F.encode(F.col(name), "UTF-8")


def over_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """Lift a function of one batch to ``mapInArrow``; empty batches are skipped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return run


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send batches of ``BATCH_BYTES`` to Python, not of 64 MB; a setting that the caller has made is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's rows in slices of ``BATCH_BYTES`` on average."""
    rows = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def slices(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """The list in runs of about ``chars`` characters (a longer text is a run of its own)."""
    start = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= chars or i == len(texts):
            yield texts[start:i]
            start, size = i, 0


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the value's decimal text, modulo ``mod``; null for null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def appended(df: DataFrame, inputs: dict[str, Column | str], make: Callable, fields: str) -> DataFrame:
    """``df`` with columns made in Python from ``inputs``; nothing is shuffled.

    ``make()`` is called once per task and returns a function from a batch of the
    input columns to a list of arrow arrays, one for each field of ``fields``.
    A batch has about ``BATCH_BYTES``, and what one took is given back after it,
    since workers stay for later tasks.
    An input given as the name of a column of ``df`` is read where it is, so that
    long texts go to the task once.  All columns of ``df`` pass through untouched;
    a name of ``inputs`` or ``fields`` among them (in any case) raises ``ValueError``.
    """
    own = df.columns
    given = {c.lower() for c in own}
    if clash := [c for c in (*inputs, *T.StructType.fromDDL(fields).names) if c.lower() in given]:
        raise ValueError(f"the table already has columns named {', '.join(clash)}; rename them or choose other names")
    at = {c: [n for n in own if n.lower() == v.lower()] for c, v in inputs.items() if isinstance(v, str)}
    here = {c: names[0] for c, names in at.items() if len(names) == 1}
    full = df.withColumns({c: F.col(v) if isinstance(v, str) else v for c, v in inputs.items() if c not in here})
    places = {c: own.index(n) for c, n in here.items()}
    out = T.StructType.fromDDL(fields).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, pool = make(), pa.default_memory_pool()
        for batch in chain.from_iterable(map(parts, batches)):
            if batch.num_rows:
                given = pa.RecordBatch.from_arrays([*batch.columns, *(batch.column(i) for i in places.values())], names=[*batch.schema.names, *places]) if places else batch
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *fn(given)], names=[*own, *out])
                pool.release_unused()

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])
    return full.mapInArrow(run, schema)
