"""From raw documents to a mixed training corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept and, but
for the last, returns the columns of ``documents``. ``run`` writes what a stage returns as Parquet in
the shared folder and reads it again as the next one's input, so a lost executor repeats tasks of one
stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, mixing, quality, simhash, substrings
from tessella.llm.common import materialize, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: those below its threshold, and all without a
    word (null, empty and blank texts). Repeated rows and null doc_ids are judged one by one."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: that with the smallest doc_id, or any row of
    a component with null doc_ids only; of rows that repeat a doc_id inside a component one stays."""
    return simhash.deduplicate(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are cut out of the texts; n_chars follows, if there is such a
    column. A document of which nothing is left goes; null and short texts stay as they are."""
    cut = substrings.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; null and empty texts have none and stay."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: one row for each copy of a document that is taken, with its text; a copy taken in
    part has its first words. Equal rows, null and repeated doc_ids are documents of their own; a null
    text has no words and is never taken."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
]

#: Trained models and fingerprints are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i + 1}")
    return docs
