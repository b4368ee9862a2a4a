"""The training-data pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on
all that the stage before kept. All but the last return the columns of ``documents``; the
last returns the packed pieces. ``run`` writes each stage's rows as Parquet to the shared
folder and reads them back, so a lost executor never costs more than a stage.

Defined cases: nulls and empty texts fail the quality rules; an empty table passes every
stage as an empty table; further columns pass through whatever their names, but the last
stage has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfew.llm import mixing, packing, quality, simhash, suffix
from lumenfew.llm.common import staged, table

#: Words of a repeated passage, and the bytes that so many words have at least.
PASSAGE_WORDS = 51
PASSAGE = 2 * PASSAGE_WORDS - 1


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the classifier, fitted on the labels, keeps."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    clash = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c in dict(quality.FIELDS)}
    scored = quality.apply(docs.withColumnsRenamed(clash), model).where("kept")
    return scored.drop(*dict(quality.FIELDS)).withColumnsRenamed({v: k for k, v in clash.items()}).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join: five-word Jaccard of 0.8 or more, or SimHash as in operator 8."""
    return simhash.representatives(docs, similar=True)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, or of 400 bytes, that another place has too."""
    return suffix.removed(docs, PASSAGE, PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the schedule takes them: some in part, some not at all, some twice."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths."""
    return packing.pieces(docs, keep=["doc_id", "source"])


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier and the tokenizer can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
