"""Quality rules whose cutoffs carry a guarantee on wrongly rejected documents.

Rule statistics are computed per whole text.  For every rule and stratum the
cutoffs of a fixed grid are tested from the loosest to the tightest on labelled
holdout documents: a cutoff is certified if the exact binomial probability of
seeing so few good documents rejected, were the false rejection rate above its
allowance, is at most the test level.  Testing in a fixed order and stopping at
the first failure needs no correction along the grid; the level is divided by
the number of rules and strata (Bonferroni), and the allowed rate by the number
of rules.  So with probability ``1 - error`` no stratum loses more than
``max_false`` of its good documents to the rules.  A stratum with too few
labelled documents certifies nothing and its documents are kept.

Everything here is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_mod, query, read, small, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rule name -> statistic; a document breaks a rule if its statistic reaches the cutoff.
RULES = {
    "symbols": lambda: F.try_divide("n_symbols", "word_chars"),
    "dup_lines": lambda: F.try_divide("n_dup_lines", "n_lines"),
    "repeats": lambda: F.try_divide("n_repeat_words", "n_words"),
    "capitals": lambda: F.try_divide("n_capitals", "word_chars"),
}
#: Loosest first.
GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.125, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), fn)[0]


def removed(text: Column, chars: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more, the first one included.

    Windows are compared by a 64-bit hash.  Sorting (hash, position) puts equal
    windows side by side; in position order, each repeated window then adds the
    words that the one before it has not covered.
    """
    def covered(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        at = F.filter(F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull())
        return F.aggregate(F.array_sort(at), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                           lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
                           lambda a: a["n"])

    def counted(g: Column) -> Column:
        pairs = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.array_sort(pairs), covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), counted)))


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum`` and the counts that the rules use, one row per input row."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    words = let(F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), 0),
                lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    out = raw.select("doc_id", "stratum", words.alias("w"), counts.alias("c"), (F.length(t) - removed(t, SPACES)).cast("long").alias("word_chars"),
                     removed(t, SYMBOLS).cast("long").alias("n_symbols"), removed(t, CAPITALS).cast("long").alias("n_capitals"))
    return out.select("doc_id", "stratum", "w.*", "c.*", "word_chars", "n_symbols", "n_capitals")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series eight steps up."""
    y = x + 8
    down = F.lit(0.0)
    for i in range(8):
        down = down + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - down


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n p, else 1.

    Sums the terms from k downwards; those more than 50 standard deviations
    below k are under the precision of a double.
    """
    first = F.exp(_log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p))
    terms = F.least(k, F.ceil(50 * F.sqrt(n * p)) + 50)
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), terms.cast("long")),
                        F.struct(F.lit(0.0).alias("s"), first.alias("t")),
                        lambda a, i: F.struct((a["s"] + a["t"]).alias("s"),
                                              (a["t"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("t")),
                        lambda a: a["s"])
    return F.when(k < n * p, total).otherwise(F.lit(1.0))


def certified_cutoffs(stats: DataFrame, labels: DataFrame, *, max_false: float = 0.05, error: float = 0.05,
                      label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``stratum, n_good`` and for each rule its tightest certified cutoff (null if none).

    ``stats`` are the holdout's statistics.  Good documents are those labelled 1
    that pass the base rules.  Ids with conflicting labels are not used.
    """
    good = (labels.select(F.col(label_id).alias("doc_id"), F.col(label).alias("y")).filter("doc_id is not null and y is not null")
            .groupBy("doc_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).filter("lo = 1 and hi = 1").select("doc_id"))
    own = stats.filter(~base_failed()).join(good, "doc_id", "left_semi").select("stratum", *[f().alias(r) for r, f in RULES.items()])
    hits = [F.count_if(F.col(r) >= c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(GRID)]
    counts = written(own.groupBy("stratum").agg(F.count("*").alias("n_good"), *hits), "holdout")
    level = error / (len(RULES) * max(counts.count(), 1))
    rate = max_false / len(RULES)

    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cut"), F.col(f"{r}_{i}").cast("double").alias("k"))
                                for r in RULES for i, c in enumerate(GRID)]))
    tests = counts.select("stratum", "n_good", cells.alias("c")).select("stratum", "n_good", "c.*")
    tests = tests.withColumn("ok", binomial_cdf(F.col("k"), F.col("n_good").cast("double"), rate) <= level)
    stop = F.min(F.when(~F.col("ok"), F.col("i"))).over(Window.partitionBy("stratum", "rule"))
    passed = F.coalesce(F.col("i") < F.col("stop"), F.lit(True))
    return tests.withColumn("stop", stop).groupBy("stratum", "n_good").agg(
        *[F.min(F.when((F.col("rule") == r) & passed, F.col("cut"))).alias(f"cut_{r}") for r in RULES])


def apply_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        stratum_col: str = "lang", *, max_false: float = 0.05, error: float = 0.05) -> DataFrame:
    """Per row: the counts, ``base_failed``, ``broken`` (rules broken) and ``kept``.

    The holdout is the labelled documents with an even crc32 of the id; the other
    half is left for evaluation.  Null and empty texts have zero counts and fail
    the base rules; a rule whose denominator is zero is not broken.  Null strata
    count as ''.  Rows with a null id are judged but never calibrate.  Repeated
    rows are each judged (and, labelled, each counted).  Other columns are not
    read; an empty table gives no rows, and without labels only the base rules
    reject.
    """
    stats = written(rule_statistics(docs, id_col, text_col, stratum_col), "stats")
    cuts = written(certified_cutoffs(stats.filter(crc_mod("doc_id", 2) == 0), labels, max_false=max_false, error=error), "cutoffs")
    judged = stats.join(small(cuts), "stratum", "left").withColumn("base_failed", base_failed())
    broken = F.filter(F.array(*[F.when(f() >= F.col(f"cut_{r}"), F.lit(r)) for r, f in RULES.items()]), lambda r: r.isNotNull())
    return (judged.withColumn("broken", broken).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
            .drop("n_good", *[f"cut_{r}" for r in RULES]))


def _oracle() -> str:
    cuts = ", ".join(map(str, GRID))
    return r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS gram FROM w WHERE len(w) >= 3),
c AS (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
rep AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM c WHERE n > 1) GROUP BY r),
s AS (SELECT w.r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
    FROM w LEFT JOIN rep ON rep.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
f AS (SELECT b.*, unnest(['symbols', 'dup_lines', 'repeats', 'capitals']) AS rule,
    unnest([n_symbols / nullif(word_chars, 0), n_dup_lines / nullif(n_lines, 0), n_repeat_words / nullif(n_words, 0), n_capitals / nullif(word_chars, 0)]) AS v FROM b),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
cut AS (SELECT unnest([CUTS]) AS c),
h AS (SELECT stratum, rule, c, count(*) AS n, count(*) FILTER (v >= c) AS k FROM f JOIN good USING (doc_id), cut
    WHERE NOT base_failed AND HASH_EVEN GROUP BY ALL),
p AS (SELECT stratum, rule, c, k < n * 0.0125 AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.0125) + (n - j) * ln(0.9875))))
    <= 0.05 / (4 * (SELECT count(DISTINCT stratum) FROM h)) AS ok FROM h),
best AS (SELECT stratum, rule, min(c) FILTER (ok AND NOT failed) AS c FROM (SELECT *, coalesce(bool_or(NOT ok) OVER (PARTITION BY stratum, rule ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS failed FROM p) GROUP BY ALL),
bad AS (SELECT DISTINCT r FROM f JOIN best USING (stratum, rule) WHERE v >= best.c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept
FROM b LEFT JOIN bad ON bad.r = b.r
""".replace("CUTS", cuts).replace("HASH_EVEN", f"{CRC32_SQL} % 2 = 0")


#: crc32 of the decimal text of ``doc_id``: each byte is folded in, then shifted out bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""


@query("op8_quality_rules", _oracle())
def op8_quality_rules(spark, sf_dir):
    judged = apply_quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
