"""A training corpus from ``documents``: five stages, each an operator of ``lakeloom.llm``.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns the documents that stay, with the columns of ``docs``; the
last adds ``ids``.  ``run`` writes each stage's result to the shared folder
and reads it back as the next one's ``docs``.  Null and empty texts are judged
like others: they are not toxic unless such texts are, group with nothing, and
contain no benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.decontaminate import without_contained_items
from lakeloom.llm.near_dup import keep_one_per_group
from lakeloom.llm.quality_net import fit_quality, score_quality
from lakeloom.llm.sentencepiece_ops import encode, load_model
from lakeloom.llm.shared import bounded_batches, read, written
from lakeloom.llm.toxicity import fit_toxicity, score_toxicity

#: Documents that score as much are toxic; documents that score less are of poor quality.
TOXIC, GOOD = 0.5, 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on these documents' labels, doesn't reject."""
    bounded_batches(spark)
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, out="__score").filter(f"__score < {TOXIC}").drop("__score")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on these documents, doesn't reject."""
    bounded_batches(spark)
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model, out="__score").filter(f"__score >= {GOOD}").drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    bounded_batches(spark)
    return keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    bounded_batches(spark)
    return without_contained_items(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    bounded_batches(spark)
    return encode(docs, model=load_model())


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the models of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
