"""Spelling variants: a vocabulary composed with a one-edit transducer and itself.

Two words are near if one insertion, deletion or replacement turns one into the
other.  Near words are the pairs accepted by vocabulary o edit o vocabulary,
where the vocabulary is a minimised acyclic acceptor and the edit transducer
copies symbols, makes one edit and copies again.

The composition is cut into pieces that no task shares.  Words that differ by
one edit agree before and after it, so for words of a length class the edit lies
in one half of the longer word and the other half is the same in both: the
shared half is the piece, its first part the state in which the composition
starts.  A piece of too many words is cut again, into the halves of what is left
to the edit, until it is small; a window of one symbol holds no more words than
there are symbols.  Long windows are cut too, so the walk is never deep.  Every pair belongs to the one window that holds its first
difference, so nothing is found twice.

In a piece the words' open parts become a minimised acceptor (equal suffixes
share a state) and the composition is walked with results kept per state, or per
pair of states after the edit: states shared by many prefixes are walked once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import query, read, written

#: Runs of Latin letters; A-Z are lower-cased before.
RUN = re.compile("[a-zÀ-ÿ]+")
#: A run loses a code point where this number divides its crc.
TYPO_MOD = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words that a task counts before it hands them on.
HELD_WORDS = 1 << 19
#: A piece of more words is cut again, and so is a longer window.
PIECE_WORDS, WINDOW = 20_000, 64


def text_words(doc_id: str | None, text: str, mod: int | None = TYPO_MOD) -> Iterator[tuple[str, int]]:
    """A text's lower-cased runs with their counts; where ``mod`` divides the crc of ``<doc_id>:<run>`` the run has lost a code point."""
    found = Counter(RUN.findall(text.encode().lower().decode()))
    if mod is None:
        yield from found.items()
        return
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % mod == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, typo_mod: int | None = TYPO_MOD,
                least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """The vocabulary: ``word`` and ``n``, of words that are long and frequent enough."""
    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                if t:
                    for word, n in text_words(i, t, typo_mod):
                        if len(word) >= least_length:
                            held[word] += n
            if len(held) > HELD_WORDS:
                yield flushed(held)
        if held:
            yield flushed(held)

    def flushed(held: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    parts = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Acceptor:
    """Minimised acyclic acceptor of a sorted list of different words; state 0 accepts nothing further."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self.start = self._state(words, 0, len(words), 0)

    def _state(self, words: list[str], lo: int, hi: int, depth: int) -> int:
        """The state of the suffixes from ``depth`` on of words that agree before."""
        final = lo < hi and len(words[lo]) == depth
        arcs, at = {}, lo + final
        while at < hi:
            symbol, end = words[at][depth], at + 1
            while end < hi and words[end][depth] == symbol:
                end += 1
            arcs[symbol] = self._state(words, at, end, depth + 1)
            at = end
        key = (final, *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.next)
            self.next.append(arcs)
            self.final.append(final)
        return self._known[key]


class Composition:
    """Pairs accepted by acceptor o one edit o acceptor, walked with results kept per state."""

    def __init__(self, words: list[str], after: str = ""):
        self.a = Acceptor(words)
        self.after = after  # what follows every word
        self._language: dict[int, list[str]] = {}
        self._common: dict[tuple[int, int], list[str]] = {}
        self._pairs: dict[int, list[tuple[str, str]]] = {}

    def language(self, q: int) -> list[str]:
        found = self._language.get(q)
        if found is None:
            found = [""] if self.a.final[q] else []
            for symbol, r in self.a.next[q].items():
                found += [symbol + s for s in self.language(r)]
            self._language[q] = found
        return found

    def common(self, p: int, q: int) -> list[str]:
        """After the edit: what both states accept."""
        if p == q:
            return self.language(p)
        if p > q:
            p, q = q, p
        found = self._common.get((p, q))
        if found is None:
            found = [""] if self.a.final[p] and self.a.final[q] else []
            other = self.a.next[q]
            for symbol, r in self.a.next[p].items():
                if symbol in other:
                    found += [symbol + s for s in self.common(r, other[symbol])]
            self._common[p, q] = found
        return found

    def pairs(self, q: int | None = None) -> list[tuple[str, str]]:
        """Before the edit, both at ``q``: (longer or equal, other), each pair once, by its first difference."""
        q = self.a.start if q is None else q
        found = self._pairs.get(q)
        if found is not None:
            return found
        found = []
        arcs = list(self.a.next[q].items())
        for i, (symbol, r) in enumerate(arcs):
            for s in self.common(q, r):  # symbol inserted
                if (s + self.after)[:1] != symbol:
                    found.append((symbol + s, s))
            for other, p in arcs[:i]:  # symbol replaced
                found += [(symbol + s, other + s) for s in self.common(p, r)]
            found += [(symbol + x, symbol + y) for x, y in self.pairs(r)]
        self._pairs[q] = found
        return found


def _window(length, lo, hi):
    """Columns of a word in a window of its class: the piece's key."""
    skip = F.when(F.length("word") == length, 0).otherwise(1)  # the shorter word lacks the edit's symbol
    before = F.substring(F.col("word"), F.lit(1), lo)
    after = F.substring(F.col("word"), hi - skip + 1, F.length("word"))
    return F.concat_ws(":", length.cast("string"), lo.cast("string"), hi.cast("string"), before, after)


def _split(rows: DataFrame) -> DataFrame:
    """Every row's window cut into halves."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    cut = rows.select("word", "n", "length", F.explode(halves).alias("w")).select("word", "n", "length", "w.lo", "w.hi").filter("lo < hi")
    return cut.withColumn("key", _window(F.col("length"), F.col("lo"), F.col("hi")))


def pieces(words: DataFrame, most: int = PIECE_WORDS) -> list[DataFrame]:
    """Rows (key, word, n, length, lo, hi) of the composition's pieces; those of more than ``most`` words are cut again.

    Only pieces with a word of the class's own length and another word can hold a pair.
    """
    own = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("length"))
    rows = _split(own.withColumns({"lo": F.lit(0), "hi": F.col("length")}))
    out = []
    while True:
        rows = written(rows, "windows")
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.length("word") == F.col("length")).alias("longest"),
                                        F.max(F.col("hi") - F.col("lo")).alias("open"))
        sizes = written(sizes.filter("size > 1 and longest > 0"), "sizes")
        large = ((F.col("size") > most) | (F.col("open") > WINDOW)) & (F.col("open") > 1)
        out.append(rows.join(sizes.filter(~large).select("key"), "key", "left_semi"))
        hot = sizes.filter(large).select("key")
        if hot.isEmpty():
            return out
        rows = _split(rows.join(hot, "key", "left_semi"))


def near_pairs(group: list[tuple[str, int]], length: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """Pairs (places in ``group``) of a piece that differ by one edit whose first difference lies in the window."""
    parts: dict[tuple[bool, str], int] = {}
    for i, (word, _) in enumerate(group):
        whole = len(word) == length
        parts[whole, word[lo : hi if whole else hi - 1]] = i
    word, whole = group[0][0], len(group[0][0]) == length
    composed = Composition(sorted({part for _, part in parts}), word[hi if whole else hi - 1 :])
    size = hi - lo
    return [(parts[True, x], parts[len(y) == size, y]) for x, y in composed.pairs() if len(x) == size]


def near_words(words: DataFrame, most: int = PIECE_WORDS) -> DataFrame:
    """Per word with near words: ``word``, ``n_near``, ``best`` (struct of -n and word: the near word of largest n)."""
    def run(batches):
        key, group, shape = None, [], (0, 0, 0)
        found: list[tuple[str, int, int, str]] = []

        def close():
            if len(group) > 1:
                per: dict[int, list] = {}
                for i, j in near_pairs(group, *shape):
                    for a, b in ((i, j), (j, i)):
                        own = per.setdefault(a, [0, (-group[b][1], group[b][0])])
                        own[0] += 1
                        own[1] = min(own[1], (-group[b][1], group[b][0]))
                found.extend((group[a][0], k, *best) for a, (k, best) in per.items())

        def out():
            columns = list(zip(*found, strict=True))
            found.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "k", "less", "near"])

        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "length", "lo", "hi")), strict=True):
                if k != key:
                    close()
                    key, group, shape = k, [], tuple(row[2:])
                group.append((row[0], row[1]))
            if len(found) > 10_000:
                yield out()
        close()
        if found:
            yield out()

    parts = None
    for rows in pieces(words, most):
        part = rows.repartition("key").sortWithinPartitions("key").select("key", "word", "n", "length", "lo", "hi").mapInArrow(
            run, "word string, k long, less long, near string")
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """From (word, form): (word, root), following forms to the last.  Forms at least double the count, so chains are short."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        hop = now.select(F.col("word").alias("root"), F.col("root").alias("__further"))
        new = now.join(hop, "root", "left").select("word", F.coalesce("__further", "root").alias("root"), F.col("__further").isNotNull().alias("__moved"))
        new = written(new, "roots")
        if new.filter("__moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, typo_mod: int | None = TYPO_MOD, least_length: int = LEAST_LENGTH,
                   least_count: int = LEAST_COUNT, most: int = PIECE_WORDS) -> DataFrame:
    """Per word of the texts: ``word, form, root, n, n_near, form_n``.

    A word's form is its near word of largest count, if that is at least twice its
    own (ties: the smallest word in code-point order); the root is reached by
    following forms.  Null and empty texts have no words; a null id counts as the
    empty text in a run's crc; repeated rows count each time; other columns are
    not read; an empty table gives no rows.
    """
    words = written(word_counts(docs, id_col, text_col, typo_mod=typo_mod, least_length=least_length, least_count=least_count), "words")
    near = written(near_words(words, most), "near")
    full = words.join(near, "word", "left")
    best_n = -F.col("best.less")
    full = written(full.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                               F.when(best_n >= 2 * F.col("n"), F.col("best.near")).alias("form"), F.when(best_n >= 2 * F.col("n"), best_n).alias("form_n")), "forms")
    last = roots(full.filter("form is not null"))
    return full.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 by half bytes, low half first; pairs by their first difference from a table of all words with one symbol left out.
OP12_SQL = """
WITH RECURSIVE t0(i, v) AS (SELECT i, i::UBIGINT FROM range(16) r(i)),
t1 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END AS v FROM t0),
t2 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END AS v FROM t1),
t3 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END AS v FROM t2),
t4 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END AS v FROM t3),
tab AS (SELECT list(v ORDER BY i) AS tab FROM t4),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL),
once AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
hexed AS (SELECT run, k, hex(encode(concat(doc_id, ':', run))) AS x FROM once),
crc AS (SELECT run, k, xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(range(1, length(x), 2),
    lambda i: [(strpos('0123456789ABCDEF', x[i + 1]) - 1)::UBIGINT, (strpos('0123456789ABCDEF', x[i]) - 1)::UBIGINT]))),
    lambda c, d: xor(c >> 4, tab[1 + CAST(xor(c & 15, d) & 15 AS BIGINT)])), 4294967295::UBIGINT) AS h FROM hexed, tab),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM crc),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 200) r(i) WHERE i <= length(word)),
pairs AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
near AS (SELECT a AS word, count(*) AS n_near, min({'m': -w.n, 'w': b}) AS best FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form,
  CASE WHEN -best.m >= 2 * n THEN CAST(-best.m AS BIGINT) END AS form_n FROM words LEFT JOIN near USING (word)),
walk(word, stop) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.stop WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.stop AS root FROM walk JOIN forms f ON f.word = walk.stop WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


@query("op12_spelling_variants", OP12_SQL)
def op12_spelling_variants(spark, sf_dir):
    return group_variants(read(spark, sf_dir, "documents"))
