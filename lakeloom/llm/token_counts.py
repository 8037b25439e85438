"""Tokens per section of a text, from one encoding of the whole text.

The text is encoded once.  Byte-level tokens have known byte lengths, so running
sums give every token's span, and an interval join within the row (binary
search over sorted section bounds) finds the sections that it touches.  A token
that crosses a boundary goes by an explicit rule:

* ``first``: to the section that holds its first byte;
* ``majority``: to the section that holds most of its bytes, ties to the earlier;
* ``split``: to each section in proportion to the bytes that it holds.

Bytes outside every section count for section -1.  Under ``first`` and
``majority`` counts are whole; under each rule they add up to the tokens of the
text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import query, read

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "majority", "split")


def load_ranks(path: str = RANKS_PATH) -> dict[bytes, int]:
    """Token bytes and ranks; the driver reads them and ships them with the tasks (a MB)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def allocate(starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, rule: str) -> np.ndarray:
    """Token counts of the sections [left, right), sorted and disjoint; the last count is of no section."""
    n = len(left)
    out = np.zeros(n + 1)
    if not len(starts):
        return out
    if not n:
        out[-1] = len(starts)
        return out
    a, b = np.searchsorted(right, starts, "right"), np.searchsorted(left, ends, "left") - 1
    inside = (a == b) & (left[np.minimum(a, n - 1)] <= starts) & (ends <= right[np.minimum(a, n - 1)])
    out += np.bincount(a[inside], minlength=n + 1)
    for t in np.flatnonzero(~inside):
        s, e = starts[t], ends[t]
        own = [(min(e, right[k]) - max(s, left[k]), k) for k in range(a[t], b[t] + 1)]
        none = (e - s) - sum(x for x, _ in own)
        if rule == "split":
            for x, k in [*own, (none, n)]:
                out[k] += x / (e - s)
        elif rule == "first":
            out[a[t] if own and left[a[t]] <= s else n] += 1
        else:
            out[max([*own, (none, n)], key=lambda y: (y[0], -y[1]))[1]] += 1
    return out


def _line_bounds(raw: bytes) -> list[int]:
    """Byte offsets at which lines begin, and the end; a line holds its line feed."""
    cuts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return [0, *cuts[cuts < len(raw)].tolist(), len(raw)]


def section_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                         ranks: dict[bytes, int], pattern: str = PATTERN, sections: str | None = None,
                         rule: str = "majority") -> DataFrame:
    """Rows ``doc_id, section, char_start, char_end, n_tokens``, in text order within a document.

    ``sections`` names a column array<struct<start, end>> of character spans that
    don't overlap (in any order; null or empty: none).  Without it a section is a
    line with its line feed.  Spans are clipped to the text; empty ones count
    nothing.  Section -1 (null bounds) is returned where tokens lie in no
    section.  Overlapping sections raise ``ValueError``.  Null and empty texts
    give no line sections, and zero for given sections.  Repeated rows are each
    counted; other columns are not read; an empty table gives no rows.
    ``n_tokens`` is double (whole but for ``split``).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text")]
    if sections:
        columns.append(F.transform(F.col(sections), lambda s: F.array(s["start"].cast("long"), s["end"].cast("long"))).alias("__sections"))

    def run(batches):
        import tiktoken
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            width[rank] = len(token)
        for batch in batches:
            out = [[], [], [], [], []]
            given = batch.column("__sections").to_pylist() if sections else None
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("__text").to_pylist(), strict=True)):
                text = text or ""
                raw = text.encode("utf-8")
                first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # byte at which each character begins
                at = np.append(first, len(raw))
                if given is None:
                    bounds = np.array(_line_bounds(raw)) if raw else np.zeros(1, np.int64)
                    left, right, order = bounds[:-1], bounds[1:], np.arange(len(bounds) - 1)
                    cl, cr = np.searchsorted(at, left), np.searchsorted(at, right)
                else:
                    spans = np.array([[s if s is not None else 0, e if e is not None else 0] for s, e in filter(None, given[i] or [])], np.int64).reshape(-1, 2)
                    spans = np.clip(spans, 0, len(first))
                    spans[:, 1] = np.maximum(spans[:, 0], spans[:, 1])
                    order = np.lexsort((spans[:, 1], spans[:, 0]))
                    cl, cr = spans[order, 0], spans[order, 1]
                    if (cl[1:] < cr[:-1]).any():
                        raise ValueError(f"sections of document {doc} overlap")
                    left, right = at[cl], at[cr]
                ends = np.cumsum(width[np.array(enc.encode_ordinary(text), np.int64)])
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                solid = np.flatnonzero(left < right)
                counts = np.zeros(len(left))
                got = allocate(starts, ends, left[solid], right[solid], rule)
                counts[solid] = got[:-1]
                rows = [(int(k), int(x), int(y), float(c)) for k, x, y, c in zip(order, cl, cr, counts, strict=True)]
                rows += [(-1, None, None, float(got[-1]))] if got[-1] > 0 else []
                for col, values in zip(out, ([doc] * len(rows), *zip(*rows)) if rows else ([],) * 5, strict=True):
                    col.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.float64()], strict=True)],
                                             names=["doc_id", "section", "char_start", "char_end", "n_tokens"])

    return docs.select(columns).mapInArrow(run, "doc_id long, section long, char_start long, char_end long, n_tokens double")


def joined_fields(docs: DataFrame, fields: list[str], separator: str = "\n", text: str = "joined",
                  sections: str = "sections") -> DataFrame:
    """``docs`` with its fields joined to one text and the span of each field, for ``section_token_counts``.

    Null fields count as empty; section k is ``fields[k]``, separators belong to none.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    start, spans = F.lit(0), []
    for p in parts:
        spans.append(F.struct(start.alias("start"), (start + F.length(p)).alias("end")))
        start = start + F.length(p) + len(separator)
    return docs.withColumns({text: F.concat_ws(separator, *parts), sections: F.array(*spans)})


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    return section_token_counts(read(spark, sf_dir, "documents"), ranks=load_ranks(), rule="majority")
