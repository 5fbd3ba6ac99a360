"""Five stages from raw documents to a training mix; each stage's Parquet is the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from quillspan.llm import decontaminate, mixing, neardup, quality, substring
from quillspan.llm.sample import remainder
from quillspan.llm.storage import drop, passing, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; its labels are those that the query may learn from.

    Null, empty and blank texts have the score of the bias alone; repeated rows are judged each;
    without any label nothing is accepted; a column ``score`` or ``label`` of the documents stays.
    """
    return quality.filtered(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8).

    The smallest doc_id stays; of rows that share it, the one whose text sorts first. Null and
    wordless texts and null ids resemble nothing and stay.
    """
    return neardup.without_copies(docs, shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 13 words and more that a smaller doc_id has too.

    No row goes, even if nothing of its text stays; null texts and null ids stay as they are.
    """
    return substring.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts and null ids stay, an empty benchmark takes nothing."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole, with size, source_size, target, copies (how often each enters the mix) and taken words.

    Null texts have size 0 and no copies; a null source is one of its own; no rows give no rows.
    """
    return mixing.mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_neardup", minhash_neardup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: The trained classifier and the entropy-balanced rates cannot be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every result is written to the shared folder and read again.

    A stage's own tables go when its result is written, and that when the next stage's is.
    """
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
