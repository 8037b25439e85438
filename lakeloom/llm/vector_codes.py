"""Vector code compression: one short code per part, k-means with norm-of-sum bounds.

Vectors become integers, are cut into equal parts, and each part position has a
codebook refined in rounds of exact integer arithmetic.  Every part carries an
upper bound on the distance to its entry and, for each group of neighbouring
entries, a lower bound on the distances to the group's other entries, each with
the round in which it was measured.  The history of codebooks is kept, so a
bound measured in round T holds now after moving by the *net* displacement of
an entry between codebook T and the present one.  That displacement is the norm
of the summed moves and never more than the sum of the moves' norms, by which
bounds usually drift.  Only parts whose bounds meet are measured again, first
against their own entry, then against the groups whose bound still is too low.

A round is one pass over a table that holds vectors and bounds side by side
(nothing is shuffled but per-entry sums), written to the shared folder.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_path
from .shared import query, read, scratch_table, small, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries that share a lower bound.
GROUP = 4
#: Components of so many steps or more have squared distances that a long can't hold.
LARGEST = 1 << 27
STATE = "__id {id}, __label {label}, __v array<int>, __code binary, __up binary, __low binary, __stamp binary"


@dataclass
class Codebooks:
    """Codebooks of every round: ``history[r]`` is entries x parts x width."""
    history: list[np.ndarray] = field(default_factory=list)

    def moved(self, part: int) -> np.ndarray:
        """For each round and entry how far the entry is from where it was then (rounded up)."""
        now = self.history[-1][part]
        gap = np.stack([book[part] for book in self.history]) - now
        return np.sqrt((gap * gap).sum(axis=2).astype(float)) * (1 + 1e-12)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.history[-1].ravel().tolist())).encode()).hexdigest()


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    gap = x - entries
    return (gap * gap).sum(axis=-1)


def _up(d2: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d2.astype(float)).astype(np.float32), np.float32(np.inf))


def _down(d2: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d2.astype(float)).astype(np.float32), np.float32(-np.inf))


@dataclass
class Bounds:
    """Entry, bounds and the rounds of the bounds, of one part position of some vectors.

    ``low[:, g]`` bounds the distances to the entries of group g, the assigned
    entry left out; ``stamp[:, 0]`` is the round of ``up`` and ``stamp[:, 1 + g]``
    that of ``low[:, g]``.
    """
    code: np.ndarray
    up: np.ndarray
    low: np.ndarray
    stamp: np.ndarray

    @staticmethod
    def fresh(n: int, entries: int) -> Bounds:
        groups = -(-entries // GROUP)
        return Bounds(np.zeros(n, np.uint8), np.full(n, np.inf, np.float32), np.zeros((n, groups), np.float32), np.zeros((n, 1 + groups), np.uint8))

    def assign(self, x: np.ndarray, books: Codebooks, part: int) -> int:
        """Move every part to its nearest entry (ties to the lower index); returns the distances measured."""
        entries, moved, now = books.history[-1][part], books.moved(part), len(books.history) - 1
        k, groups = len(entries), self.low.shape[1]
        up = self.up + moved[self.stamp[:, 0], self.code]
        furthest = np.stack([moved[:, g * GROUP : (g + 1) * GROUP].max(axis=1) for g in range(groups)], axis=1)
        low = self.low - furthest[self.stamp[:, 1:], np.arange(groups)]
        open_ = np.flatnonzero(low.min(axis=1) <= up)
        if not len(open_):
            return 0
        old = self.code[open_]
        best = squares(x[open_], entries[old])
        up_now = _up(best)
        self.up[open_], self.stamp[open_, 0] = up_now, now
        measured = len(open_)
        to_scan = low[open_] <= up_now[:, None]
        rows = np.flatnonzero(to_scan.any(axis=1))
        if not len(rows):
            return measured
        at, old, before, scan = open_[rows], old[rows], best[rows], to_scan[rows]
        dist = np.full((len(rows), k), np.iinfo(np.int64).max)
        dist[np.arange(len(rows)), old] = before
        for g in range(groups):
            own = np.flatnonzero(scan[:, g])
            if len(own):
                span = slice(g * GROUP, min((g + 1) * GROUP, k))
                dist[own, span] = squares(x[at[own], None, :], entries[None, span])
                measured += len(own) * (span.stop - span.start)
        new = dist.argmin(axis=1)  # the first of equals
        self.code[at] = new
        self.up[at] = _up(dist[np.arange(len(rows)), new])
        for g in range(groups):
            span = slice(g * GROUP, min((g + 1) * GROUP, k))
            others = dist[:, span].copy()
            mine = (new >= span.start) & (new < span.stop)
            others[mine, new[mine] - span.start] = np.iinfo(np.int64).max
            seen = scan[:, g]
            nearest = others.min(axis=1)
            found = np.where(nearest == np.iinfo(np.int64).max, np.float32(np.inf), _down(nearest))
            # a group that was not scanned keeps its moved bound; the entry just left counts for it from now on
            kept = np.minimum(low[at, g].astype(np.float32), found)
            left = ~seen & (old != new) & (old >= span.start) & (old < span.stop)
            self.low[at, g] = np.where(seen, found, np.where(left, np.nextafter(kept, np.float32(-np.inf)), self.low[at, g]))
            self.stamp[at, 1 + g] = np.where(seen | left, now, self.stamp[at, 1 + g])
        return measured


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _rows(column: pa.Array, kind, n: int, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, *shape).copy()


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.array([row.tobytes() for row in x], pa.binary())


def _unpack(batch: pa.RecordBatch, parts: int, entries: int) -> tuple[np.ndarray, list[Bounds]]:
    """Parts (n x parts x width) and their bounds."""
    n, groups = batch.num_rows, -(-entries // GROUP)
    x = _matrix(batch.column("__v"), n).reshape(n, parts, -1)
    code, up = _rows(batch.column("__code"), np.uint8, n, (parts,)), _rows(batch.column("__up"), np.float32, n, (parts,))
    low = _rows(batch.column("__low"), np.float32, n, (parts, groups))
    stamp = _rows(batch.column("__stamp"), np.uint8, n, (parts, 1 + groups))
    return x, [Bounds(code[:, p].copy(), up[:, p].copy(), low[:, p].copy(), stamp[:, p].copy()) for p in range(parts)]


def integers(df: DataFrame, vector_col: str, id_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """Rows ``__id``, ``__label``, ``__v`` (integers) of the vectors without a null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), v.alias("__f")).filter(F.col("__f").isNotNull() & ~bad)
    too_far = F.raise_error(F.lit(f"a vector component of {LARGEST} steps or more: its squared distances don't fit in a long"))
    step = F.transform("__f", lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale).cast("int")).otherwise(too_far.cast("int")))
    return kept.select("__id", "__label", step.alias("__v"))


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Parts of the vectors with the smallest ids (each id once, with its smallest vector; a null id comes last)."""
    ids = [r[0] for r in vectors.select("__id").distinct().orderBy(F.asc_nulls_last("__id")).limit(entries).collect()]
    if not ids:
        return None
    own = F.col("__id").isin([i for i in ids if i is not None])
    own = F.coalesce(own, F.lit(False)) | (F.col("__id").isNull() & F.lit(None in ids))
    rows = vectors.filter(own).groupBy("__id").agg(F.min("__v").alias("v")).orderBy(F.asc_nulls_last("__id")).collect()
    wide = len(rows[0]["v"])
    if wide % parts or any(len(r["v"]) != wide for r in rows):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _round(state: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """The state after an assignment to the present codebooks, and the distances that each vector took."""
    shape = books.history[-1].shape
    shipped = state.sparkSession.sparkContext.broadcast(books)
    fresh = "__code" not in state.columns

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if fresh:
                sizes = batch.column("__v").value_lengths().to_numpy(zero_copy_only=False)
                if (sizes != parts * shape[2]).any():
                    raise ValueError(f"vectors must have one length, a multiple of {parts}")
                x = _matrix(batch.column("__v"), n).reshape(n, parts, -1)
                bounds = [Bounds.fresh(n, shape[1]) for _ in range(parts)]
            else:
                x, bounds = _unpack(batch, parts, shape[1])
            measured = sum(b.assign(x[:, p], shipped.value, p) for p, b in enumerate(bounds))
            own = [_binary(np.stack([getattr(b, name) for b in bounds], axis=1)) for name in ("code", "up", "low", "stamp")]
            per = np.full(n, measured // n, np.int64)
            per[: measured % n] += 1
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), batch.column("__v"), *own, pa.array(per)],
                                             names=["__id", "__label", "__v", "__code", "__up", "__low", "__stamp", "__measured"])

    kinds = dict(state.dtypes)
    return state.mapInArrow(run, STATE.format(id=kinds["__id"], label=kinds["__label"]) + ", __measured long")


def _sums(state: DataFrame, parts: int, entries: int) -> dict[tuple[int, int], int]:
    """Component sums of the parts of every entry, and their counts at place -1."""
    def run(batches):
        total = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("__v"), n).reshape(n, parts, -1)
            code = _rows(batch.column("__code"), np.uint8, n, (parts,)).astype(np.int64)
            if total is None:
                total = np.zeros((parts * entries, x.shape[2] + 1), np.int64)
            slot = (code + np.arange(parts) * entries).ravel()
            order = np.argsort(slot, kind="stable")
            used, starts, counts = np.unique(slot[order], return_index=True, return_counts=True)
            total[used, :-1] += np.add.reduceat(x.reshape(n * parts, -1)[order], starts, axis=0)
            total[used, -1] += counts
        if total is not None:
            slot, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.where(place == total.shape[1] - 1, -1, place)), pa.array(total[slot, place])],
                                             names=["slot", "place", "total"])

    rows = state.select("__v", "__code").mapInArrow(run, "slot long, place long, total long")
    return {(r[0], r[1]): r[2] for r in rows.groupBy("slot", "place").agg(F.sum("total")).collect()}  # components of all entries at most


def _next(book: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Entries moved to the floor of their parts' mean; unused entries stay."""
    out = book.copy()
    for p in range(book.shape[0]):
        for e in range(book.shape[1]):
            slot = p * book.shape[1] + e
            if count := sums.get((slot, -1), 0):
                out[p, e] = [sums.get((slot, i), 0) // count for i in range(book.shape[2])]
    return out


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors, and the codebooks of every round.

    Rows: the id and label columns, ``codes`` (binary, one index per part),
    ``error`` (long, squared distances summed over parts) and ``measured`` (long,
    distances that the last round measured; the bounds answered for the rest).
    Vectors that are null or hold null or non-finite components are dropped.  A
    null id orders after all others; an id's repeated rows are one seed, with its
    smallest vector, and are each coded.  Fewer ids than entries give as many
    entries; an empty table gives no rows and no codebook.  Vectors of several
    lengths, or of one that ``parts`` doesn't divide, and components of 2**27
    steps or more raise an error.  Other columns are not read.
    """
    kinds = {id_col: dict(df.dtypes)[id_col], label_col: dict(df.dtypes)[label_col]}
    vectors = written(integers(df, vector_col, id_col, label_col, scale), "vectors")
    seeds = first_codebooks(vectors, parts, entries)
    books = Codebooks([] if seeds is None else [seeds])
    if seeds is None:
        empty = vectors.select(F.col("__id").alias(id_col), F.col("__label").alias(label_col), F.lit(b"").alias("codes"),
                               F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("measured"))
        return empty, books
    state, path = vectors, None
    for r in range(rounds + 1):
        if r:
            books.history.append(_next(books.history[-1], _sums(state, parts, seeds.shape[1])))
        new, new_path = scratch_table(_round(state.drop("__measured"), books, parts), f"bounds-{r}")
        if path:  # the table of the round before serves nobody any more
            remove_path(df.sparkSession, path)
        state, path = new, new_path
    last = df.sparkSession.sparkContext.broadcast(books.history[-1])

    def finish(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                x, code = _matrix(batch.column("__v"), n).reshape(n, parts, -1), _rows(batch.column("__code"), np.uint8, n, (parts,))
                error = sum(squares(x[:, p], last.value[p][code[:, p]]) for p in range(parts))
                yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), batch.column("__code"), pa.array(error), batch.column("__measured")],
                                                 names=[id_col, label_col, "codes", "error", "measured"])

    return state.select("__id", "__label", "__v", "__code", "__measured").mapInArrow(
        finish, f"`{id_col}` {kinds[id_col]}, `{label_col}` {kinds[label_col]}, codes binary, error long, measured long"), books


def code_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **shape) -> DataFrame:
    """Per vector: id, ``code`` (hex), ``error``, ``label_error`` (summed over equal labels, nulls together), ``codebooks_sha256``."""
    codes, books = compress(df, id_col, vector_col, label_col, **shape)
    if not books.history:
        return codes.select(F.col(id_col).alias("vec_id"), F.lit("").alias("code"), "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = written(codes, "codes")
    per = written(codes.groupBy(F.col(label_col).alias("__l")).agg(F.sum("error").alias("label_error")), "labels")
    joined = codes.join(small(per), codes[label_col].eqNullSafe(per["__l"]))
    return joined.select(F.col(id_col).alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in DuckDB: every round assigns all parts to all entries."""
    out = [f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS x
  FROM kept, range({PARTS}) r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, x.p, any_value(x) AS x,
    min({{'d': CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': e}}) AS m
  FROM x JOIN c{r} USING (p) GROUP BY vec_id, x.p)""")
        if r < ROUNDS:
            out.append(f"""u{r} AS (
  SELECT p, m.e AS e, i, CAST(sum(x[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r}, range(1, 65) g(i) WHERE i <= len(x) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{r} c LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM u{r} GROUP BY p, e) n ON c.p = n.p AND c.e = n.e)""")
    return ",\n".join(out) + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM c{ROUNDS}),
v AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM v, h"""


OP13_SQL = _sql()


@query("op13_vector_codes", OP13_SQL)
def op13_vector_codes(spark, sf_dir):
    return code_report(read(spark, sf_dir, "embeddings"))
