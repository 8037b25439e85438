"""Ids that may occur in texts, found by the bytes of one gram of each (JN-10).

A gram is a run of at most 8 bytes and is held as a number, so numpy makes all
grams of many texts at once.  A filter of bounded size, filled in Spark from the
ids' grams, drops the texts' other grams where they are made; what it lets
through is compared with the ids themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the longest gram.
LONGEST = 8
#: Bits of the filter as a power of two: at least, and at most (32 MB).
LEAST_BITS, MOST_BITS = 16, 28
#: Counters of the ids' grams as a power of two: at least, and at most (16 MB).
LEAST_COUNTERS, MOST_COUNTERS = 12, 22
#: Bytes whose grams are made at once, and of the texts that are searched at once (a longer text alone).
WINDOW, CALL_BYTES = 1 << 17, 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _runs(data: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place, size, numbers) of the runs of bytes of each size, some places at a time."""
    for at in range(0, len(data), WINDOW):
        part = data[at : at + WINDOW + sizes[-1] - 1].astype(np.uint64)
        v = part
        for k in range(1, sizes[-1] + 1):
            if k > 1:
                v = (v[:-1] << np.uint64(8)) | part[k - 1 :]
            if not len(v):
                break
            if k in sizes:
                yield at, k, _mixed(v[:WINDOW] + np.uint64(k))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column (nulls have none), and where each row begins and the last ends."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8), ends - ends[0]


def _pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``CALL_BYTES`` bytes each."""
    ends, start = _bytes(column)[1], 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + CALL_BYTES, "right")) - 1)
        yield start, column.slice(start, stop - start)
        start = stop


def _of_rows(column: pa.Array, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, gram) of the grams of a column of ids, each of the id's own length or the largest of ``sizes``."""
    data, ends = _bytes(column.cast(pa.binary()))
    rows, places, found = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64))
    own = np.minimum(np.diff(ends), sizes[-1])
    for at, k, keys in _runs(data, sizes):
        place = np.arange(at, at + len(keys))
        row = np.searchsorted(ends, place, "right") - 1
        inside = (own[row] == k) & (place + k <= ends[row + 1])
        rows.append(row[inside])
        places.append((place - ends[row])[inside])
        found.append(keys[inside])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(found)


def counted(ids: DataFrame, col: str, n: int, sizes: list[int]) -> np.ndarray:
    """How often the grams of ``n`` ids occur, in a bounded table of counters that grams share by hash.

    Tasks count and Spark adds up; the sums come to the driver, at most 4 million
    however many the grams.  A shared counter only makes a gram look more frequent.
    """
    power = min(MOST_COUNTERS, max(LEAST_COUNTERS, (4 * n).bit_length()))

    def run(batches):
        total, any_rows = np.zeros(1 << power, np.int64), False
        for batch in batches:
            for _, part in _pieces(batch.column(0).cast(pa.binary())):
                any_rows = True
                np.add.at(total, (_of_rows(part, sizes)[2] >> np.uint64(64 - power)).astype(np.int64), 1)
        if any_rows:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    sums = ids.select(col).mapInArrow(run, "at long, n long").groupBy("at").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out = np.zeros(1 << power, np.int32)
    out[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return out


def rarest(ids: DataFrame, col: str, counts: np.ndarray, sizes: list[int]) -> DataFrame:
    """``ids`` with ``__g`` and ``__at``: of each id's grams the one of the smallest counter, and its first place in bytes."""
    own, shipped = ids.columns, ids.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        shift = np.uint64(64 - (len(shipped.value).bit_length() - 1))
        for batch in batches:
            for start, part in _pieces(batch.column(col).cast(pa.binary())):
                row, place, key = _of_rows(part, sizes)
                order = np.lexsort((place, key.view(np.int64), shipped.value[(key >> shift).astype(np.int64)], row))
                best = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                rows = batch.slice(start, len(part)).take(pa.array(row[best]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(key[best].view(np.int64)), pa.array(place[best])], names=[*own, "__g", "__at"])

    return ids.mapInArrow(run, T.StructType([*ids.schema.fields, T.StructField("__g", T.LongType()), T.StructField("__at", T.LongType())]))


class Exact:
    """Ids as numbers of 8 bytes each, to compare many places of a text with them at once."""

    def __init__(self, ids: list[bytes]):
        self.size = np.array([len(x) for x in ids], np.int64)
        self.count = (self.size + 7) // 8
        self.first = np.cumsum(self.count) - self.count
        self.value = np.frombuffer(b"".join(x + bytes(-len(x) % 8) for x in ids), ">u8").astype(np.uint64)
        self.mask = np.full(len(self.value), np.uint64(2**64 - 1))
        rest = self.size % 8
        some = np.flatnonzero(rest)
        self.mask[(self.first + self.count - 1)[some]] <<= (64 - 8 * rest[some]).astype(np.uint64)

    def at(self, data: np.ndarray, start: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Which of the ids ``which`` stand in ``data`` at ``start``; they end within it."""
        v = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
        for k in (1, 2, 4):
            v = (v[:-k] << np.uint64(8 * k)) | v[k:]
        stay, n = np.arange(len(start)), 0
        out = np.zeros(len(start), bool)
        while len(stay):
            chunk = self.first[which[stay]] + n
            stay = stay[v[start[stay] + 8 * n] & self.mask[chunk] == self.value[chunk]]
            n += 1
            ends = self.count[which[stay]] == n
            out[stay[ends]] = True
            stay = stay[~ends]
        return out


def _first_come(start: np.ndarray, end: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places, by start, that are taken if ``which`` decides among those that overlap, then the start."""
    order = np.argsort(start, kind="stable")
    start, end, which = start[order], end[order], which[order]
    before = np.concatenate([[0], np.maximum.accumulate(end)[:-1]]) if len(end) else end
    alone = start >= before
    alone[:-1] &= start[1:] >= np.maximum.accumulate(end)[:-1]
    others = np.flatnonzero(~alone)
    others = others[np.lexsort((start[others], which[others]))]
    if len(others):
        taken = bytearray(int(end.max()))
        for i, a, b in zip(others.tolist(), start[others].tolist(), end[others].tolist(), strict=True):
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                alone[i] = True
    return order[alone]


@dataclass
class Known:
    """A filter of grams: two bits of 2**``power`` for each."""
    bits: np.ndarray
    power: int
    sizes: list[int]

    @staticmethod
    def of(index: DataFrame, col: str, n: int, sizes: list[int]) -> Known:
        """The filter of a table's grams; it comes to the driver in words of 64 bits, at most 32 MB however many the grams."""
        power = min(MOST_BITS, max(LEAST_BITS, (24 * n).bit_length()))
        places = F.array(F.shiftrightunsigned(col, 64 - power), F.col(col).bitwiseAND(F.lit((1 << power) - 1)))
        words = (index.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("at"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow())
        bits = np.zeros(1 << (power - 6), "<i8")
        bits[words.column("at").to_numpy()] = words.column("bits").to_numpy()
        return Known(bits.view(np.uint8), power, sizes)

    def _has(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def hits(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, gram) of the grams in rows of bytes that the filter lets through, once in a row or more often."""
        rows, places, found = ([np.zeros(0, np.int64)] for _ in range(3))
        for at, k, keys in _runs(data, self.sizes):
            place = np.flatnonzero(self._has(keys >> np.uint64(64 - self.power)))
            place = place[self._has(keys[place] & np.uint64((1 << self.power) - 1))]
            row = np.searchsorted(ends, place + at, "right") - 1
            inside = place + (at + k) <= ends[row + 1]
            rows.append(row[inside])
            places.append(place[inside] + at)
            found.append(keys[place[inside]].view(np.int64))
        return np.concatenate(rows), np.concatenate(places), np.concatenate(found)

    def found(self, df: DataFrame, text_col: str) -> DataFrame:
        """Rows of ``df``'s other columns and ``__g``: the grams of each row's text that may be known."""
        spark, others = df.sparkSession, [c for c in df.columns if c != text_col]
        shipped = spark.sparkContext.broadcast(self)

        def run(batches):
            for batch in batches:
                text = batch.column("__t")
                for start, part in _pieces(text):
                    row, _, key = shipped.value.hits(*_bytes(part))
                    if len(row):
                        order = np.lexsort((key, row))
                        row, key = row[order], key[order]
                        new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
                        at = pa.array(row[new] + start)
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in others), pa.array(key[new])], names=[*others, "__g"])

        rows = df.select(*others, F.col(text_col).cast("string").cast("binary").alias("__t"))
        return rows.mapInArrow(run, T.StructType([*(df.schema[c] for c in others), T.StructField("__g", T.LongType())]))


def replaced(docs: DataFrame, seq_col: str, text_col: str, index: DataFrame, known: Known, ordered: bool) -> DataFrame:
    """``docs`` with the ids of ``index`` (__g, __mseq, __old, __new; it goes to every task) replaced in ``text_col``, in order of number and id.

    No id may share a character with a new id.  Then what was replaced is never
    changed again and no id comes into being, so of the places where ids are in
    the text those of earlier ids are taken first, from left to right, and later
    ones that overlap them are not there any more.  ``ordered``: only ids of
    numbers below the row's are replaced.
    """
    table = index.select("__g", "__at", "__mseq", F.col("__old").cast("binary").alias("o"), F.col("__new").cast("binary").alias("n")).toArrow()
    grams, places, number, olds, news = (table.column(c).to_pylist() for c in ("__g", "__at", "__mseq", "o", "n"))
    # mappings without a number come first where all apply, and never where numbers decide
    rank = sorted((i for i in range(len(olds)) if not ordered or number[i] is not None), key=lambda i: (number[i] is not None, number[i] or 0, olds[i]))
    keys, shift, number = (np.array([x[i] or 0 for i in rank], np.int64) for x in (grams, places, number))
    by_key = np.argsort(keys, kind="stable")
    shipped = docs.sparkSession.sparkContext.broadcast((known, keys[by_key], by_key, shift, number, Exact([olds[i] for i in rank]), [news[i] for i in rank]))

    def fold(seq: pa.Array, column: pa.Array) -> pa.Array:
        known, keys, by_key, shift, number, olds, news = shipped.value
        data, ends = _bytes(column)
        row, place, key = known.hits(data, ends)
        lo = np.searchsorted(keys, key, "left")
        n = np.searchsorted(keys, key, "right") - lo
        which = by_key[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        row, start = np.repeat(row, n), np.repeat(place, n) - shift[which]
        may = (start >= ends[row]) & (start + olds.size[which] <= ends[row + 1]) & seq.is_valid().to_numpy(zero_copy_only=False)[row]
        if ordered:
            may &= number[which] < seq.fill_null(0).to_numpy()[row]
        row, start, which = row[may], start[may], which[may]
        there = olds.at(data, start, which)
        row, start, which = row[there], start[there], which[there]
        took = _first_come(start, start + olds.size[which], which)
        row, start, which = row[took], start[took], which[took]
        new, size = [news[w] for w in which.tolist()], olds.size[which]
        text, kept = data.tobytes(), np.concatenate([[0], start + size]).tolist()
        parts = [x for a, b, w in zip(kept, start.tolist(), new, strict=False) for x in (text[a:b], w)]
        parts.append(text[kept[-1] :])
        more = np.bincount(row, np.fromiter(map(len, new), np.int64, len(new)) - size, len(column)).astype(np.int64)
        until = np.concatenate([[0], np.cumsum(np.diff(ends) + more)]).astype(np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(until), pa.py_buffer(b"".join(parts))])
        return pc.if_else(column.is_valid(), out, None).cast(pa.binary())

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for seq, text in columns:
            yield pa.concat_arrays([fold(seq.slice(start, len(part)), part) for start, part in _pieces(text)] or [pa.array([], pa.binary())])

    fn = F.arrow_udf(run, "binary")
    return docs.withColumn(text_col, fn(F.col(seq_col).cast("long"), F.col(text_col).cast("string").cast("binary")).cast("string"))
