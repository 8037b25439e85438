"""Benchmark items inside documents: MinHash containment search by size, exact check.

Items are grouped into size classes: ``u`` is a power of two, at least 1.25
times the item's shingle count.  A document's shingle sequence is cut into
blocks of ``u``; two neighbouring blocks form a window, so a passage as long as
an item lies whole in some window, however long the document is.  Within a class
the Jaccard similarity of an item with a window that contains it is therefore
bounded below, and the number of MinHash values (one-value bands) follows from
that bound and the chosen miss probability.  A window that shares a value with
an item makes the document a candidate for it; the candidate is confirmed by the
containment of the item's shingles in the whole document's set.  Items of the
smallest class have too few shingles for that bound and are looked up exactly, by
as many of their shingles as make sure that a document containing the item has one.

The items are a stated query set.  They are indexed in blocks of at most about
``BLOCK_SHINGLES`` shingles (some 100 MB with their signatures), each block is
shipped to the tasks, and the documents are passed over once per block: nothing
of the documents is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import appended, bytes_of, query, read
from .shingles import WordHashes, alnum_words, permutations, shingle_sequence

BLOCK_SHINGLES = 2_000_000
SMALLEST, SLACK, SEED = 8, 1.25, 11
FILTER_BITS = 22


def size_class(n: int) -> int:
    """Block length for an item of ``n`` shingles."""
    return max(SMALLEST, 1 << math.ceil(math.log2(SLACK * n)))


def values_needed(containment: float, miss: float) -> int:
    """MinHash values for which the least similar window is missed with probability ``miss`` at most.

    The smallest item of a class has u / (2 * SLACK) shingles against a window of 2u;
    of the class SMALLEST, whose items may be smaller, no values are used.
    """
    q = 1 / (2 * SLACK)
    low = containment * q / (q + 2 - containment * q)
    return math.ceil(math.log(miss) / math.log1p(-low))


def block_minima(seq: np.ndarray, u: int, a: np.ndarray, b: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """MinHash values (functions x blocks) of the blocks of ``u`` shingles of a sequence."""
    step = max(chunk // u, 1) * u
    out = []
    for at in range(0, len(seq), step):
        part = seq[at : at + step]
        hashed = np.multiply.outer(a, part)
        hashed += b[:, None]
        out.append((np.minimum.reduceat(hashed, np.arange(0, len(part), u), axis=1) >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(out, axis=1)


def _items_at(value: np.ndarray, item: np.ndarray, wanted: np.ndarray) -> set[int]:
    """Items that have one of the wanted values; ``value`` is sorted."""
    left, right = np.searchsorted(value, wanted, "left"), np.searchsorted(value, wanted, "right")
    found: set[int] = set()
    for x, y in zip(left[left < right], right[left < right], strict=True):
        found.update(item[x:y].tolist())
    return found


class ItemIndex:
    """MinHash values of one block of items, by size class (short ones: shingles), with the items' shingle sets."""

    def __init__(self, items: list[tuple[int, np.ndarray]], containment: float, miss: float):
        self.containment = containment
        self.a, self.b = permutations(values_needed(containment, miss), SEED)
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.classes = {}
        short = [k for k, s in enumerate(self.sets) if size_class(len(s)) == SMALLEST]
        keys = [self.sets[k][: len(self.sets[k]) - max(math.ceil(containment * len(self.sets[k]) - 1e-9), 1) + 1] for k in short]
        key = np.concatenate([np.empty(0, np.uint64), *keys])
        item = np.repeat(np.array(short, np.int64), [len(x) for x in keys])
        order = np.argsort(key, kind="stable")
        self.short = key[order], item[order]
        self.short_filter = np.zeros(1 << FILTER_BITS, bool)
        self.short_filter[key & np.uint64((1 << FILTER_BITS) - 1)] = True
        for u in sorted({size_class(len(s)) for s in self.sets} - {SMALLEST}):
            own = [k for k, s in enumerate(self.sets) if size_class(len(s)) == u]
            value = np.concatenate([block_minima(self.sets[k], 1 << 62, self.a, self.b)[:, 0] for k in own])
            item = np.repeat(np.array(own), len(self.a))
            order = np.argsort(value, kind="stable")
            self.classes[u] = value[order], item[order]
            self.filter[value & ((1 << FILTER_BITS) - 1)] = True

    def candidates(self, seq: np.ndarray) -> set[int]:
        """Items that share a value of the same size class with a window of the sequence, and short ones that share a key shingle."""
        found: set[int] = set()
        if len(self.short[0]):
            found |= _items_at(*self.short, np.unique(seq[self.short_filter[seq & np.uint64((1 << FILTER_BITS) - 1)]]))
        base, minima = None, None
        for u, (value, item) in self.classes.items():
            if base is None:
                minima = block_minima(seq, u, self.a, self.b)
            else:
                for _ in range(int(math.log2(u // base))):
                    if minima.shape[1] > 1:
                        if minima.shape[1] % 2:
                            minima = np.concatenate([minima, minima[:, -1:]], axis=1)
                        minima = np.minimum(minima[:, ::2], minima[:, 1::2])
            base = u
            windows = np.minimum(minima[:, :-1], minima[:, 1:]) if minima.shape[1] > 1 else minima
            flat = windows.reshape(-1)
            flat = np.unique(flat[self.filter[flat & ((1 << FILTER_BITS) - 1)]])
            found |= _items_at(value, item, flat)
        return found

    def hits(self, seq: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, its shingles, those in the text) of every item contained to the threshold."""
        if not len(seq) or not self.ids:
            return []
        found = self.candidates(seq)
        whole = np.unique(seq) if found else seq
        out = []
        for k in found:
            at = np.minimum(np.searchsorted(whole, self.sets[k]), len(whole) - 1)
            common = int((whole[at] == self.sets[k]).sum())
            if common >= self.containment * len(self.sets[k]) - 1e-9:
                out.append((self.ids[k], len(self.sets[k]), common))
        return sorted(out)


def _item_blocks(items: DataFrame, id_col: str, text_col: str, k: int) -> list[list[tuple[int, np.ndarray]]]:
    """The items' shingle sets in blocks of bounded size, one block at a time in the driver."""
    def sets(batches):
        hashes = WordHashes()
        for batch in batches:
            raw = [np.unique(shingle_sequence(alnum_words(t), k, hashes)) if t else np.empty(0, np.uint64)
                   for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": pa.array([len(r) for r in raw], pa.int64()),
                                              "shingles": pa.array([r.tobytes() for r in raw], pa.binary())})

    own = (items.select(F.col(id_col).cast("long").alias("id"), bytes_of(text_col).alias("__text"))
           .mapInArrow(sets, "id long, n long, shingles binary").filter("id is not null and n > 0"))
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = math.ceil(total / BLOCK_SHINGLES)
    for i in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).distinct().collect()
        yield [(r.id, np.frombuffer(r.shingles, np.uint64)) for r in rows]


def contained_items(docs: DataFrame, items: DataFrame, text_col: str = "text", *, item_id: str = "item_id",
                    item_text: str = "text", out: str = "hits", shingle_words: int = 5, containment: float = 0.8,
                    miss: float = 1e-6) -> DataFrame:
    """``docs`` with ``out``: array of (item_id, n_item, n_hit) of the items that a text contains.

    An item is contained if at least ``containment`` of its distinct shingles of
    ``shingle_words`` words (letters and digits, A-Z lower-cased) occur anywhere
    in the text.  A text or item with fewer words has its whole sequence as its
    one shingle, so a short item is found only in a text that is just that
    sequence.  Null, empty and wordless texts contain nothing; such items, and
    items with a null id, are contained in nothing.  Items that repeat an id
    with another text each count.  Repeated documents are each searched; every
    column of ``docs`` passes through, so ``out`` must not be one of them.  No
    items, or no documents, give no hits.
    """
    parts = []
    done = docs
    for i, block in enumerate(_item_blocks(items, item_id, item_text, shingle_words)):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, containment, miss))

        def make(index=index):
            hashes = WordHashes()

            def run(batch: pa.RecordBatch) -> list[pa.Array]:
                found = [index.value.hits(shingle_sequence(alnum_words(t), shingle_words, hashes)) if t else []
                         for t in batch.column("__text").to_pylist()]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_hit", pa.int64())]))
                rows = [[dict(zip(("item_id", "n_item", "n_hit"), h, strict=True)) for h in hits] for hits in found]
                return [pa.array(rows, kind)]
            return run

        parts.append(f"__hits{i}")
        done = appended(done, {"__text": bytes_of(text_col)}, make,
                        f"{parts[-1]} array<struct<item_id:bigint,n_item:bigint,n_hit:bigint>>")
    none = F.array().cast("array<struct<item_id:bigint,n_item:bigint,n_hit:bigint>>")
    found = F.concat(*[F.col(p) for p in parts]) if parts else none
    return done.withColumn(out, found).drop(*parts)


def without_contained_items(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no item; columns as they were."""
    flagged = contained_items(docs, items, text_col, out="__contained", **options)
    return flagged.filter(F.size("__contained") == 0).drop("__contained")


OP2_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
si AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS s FROM i WHERE len(w) > 0),
sd AS (SELECT DISTINCT doc_id, r, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS s FROM d WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id)
SELECT any_value(doc_id) AS doc_id, si.item_id, any_value(n_item) AS n_item, count(*) AS n_hit
FROM sd JOIN si USING (s) JOIN n ON n.item_id = si.item_id
GROUP BY r, si.item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9
"""


@query("op2_decontaminate", OP2_SQL)
def op2_decontaminate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contained_items(docs, read(spark, sf_dir, "benchmark")).filter(F.size("hits") > 0)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
