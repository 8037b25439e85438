"""Text scorers (UDF-2).

A scorer is anything with ``score(df, text_col, out_col) -> DataFrame`` that
adds one struct column.  The built-in :class:`LexiconScorer` is pure Spark SQL
(count whole-word lexicon hits with one regex pass per lexicon, then label),
so it runs on the full text of every row without leaving the JVM.  User
models plug in through :class:`PandasScorer`, which runs a vectorised function over Arrow batches with
``mapInPandas`` -- the slow path, kept for models Spark cannot express.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Small general lexicons of the built-in scorer; pass others for other kinds of text.
POSITIVE_WORDS = ("good", "great", "excellent", "wonderful", "fantastic", "perfect", "best", "beautiful", "brilliant",
                  "love", "loved", "enjoy", "enjoyed", "happy", "pleased", "nice", "friendly", "helpful", "easy",
                  "reliable", "recommend")
NEGATIVE_WORDS = ("bad", "worse", "worst", "terrible", "awful", "horrible", "poor", "ugly", "hate", "hated", "sad",
                  "angry", "unhappy", "disappointing", "broken", "slow", "useless", "unreliable", "wrong", "fail",
                  "failed")


class Scorer(Protocol):
    def score(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame: ...


def lexicon_hits(text: Column, words: Sequence[str]) -> Column:
    """Number of tokens of ``lower(text)`` that are in ``words``.

    A token is a maximal run of ``a-z``; counting whole-word regex matches
    (``(?<![a-z])(?:w1|w2|...)(?![a-z])``) gives the same number as
    splitting into tokens and filtering them, in one pass over the text.
    """
    pattern = "(?<![a-z])(?:" + "|".join(re.escape(w) for w in words) + ")(?![a-z])"
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)).cast("long")


class LexiconScorer:
    """Counts positive and negative lexicon words; label by the larger count.

    Output struct: ``sentiment`` (positive, negative, mixed or neutral) and the
    ``positive`` and ``negative`` hit counts.
    """

    def __init__(self, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS):
        self.positive = tuple(positive)
        self.negative = tuple(negative)

    def expr(self, text: Column) -> Column:
        pos = lexicon_hits(text, self.positive)
        neg = lexicon_hits(text, self.negative)
        label = (F.when(pos > neg, "positive").when(neg > pos, "negative")
                 .when(pos > 0, "mixed").otherwise("neutral"))
        return F.when(text.isNotNull(), F.struct(label.alias("sentiment"), pos.alias("positive"),
                                                  neg.alias("negative")))

    def score(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        return df.withColumn(out_col, self.expr(F.col(text_col)))


class PandasScorer:
    """Wrap a vectorised ``pandas.Series -> pandas.DataFrame`` model.

    ``fn`` receives one Arrow batch of texts at a time and returns a frame with
    the fields of ``result_schema``; Spark partitions the work.
    """

    def __init__(self, fn: Callable, result_schema: T.StructType):
        self.fn = fn
        self.result_schema = result_schema

    def score(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        fn, rs = self.fn, self.result_schema
        out_schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, rs, True)])

        def run(batches):
            for pdf in batches:
                res = fn(pdf[text_col])
                pdf[out_col] = res.to_dict("records")
                yield pdf

        return df.mapInPandas(run, out_schema)
