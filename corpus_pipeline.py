"""Corpus preparation in five stages, each over all that its predecessor kept.

1. quality rules: rejected documents go;
2. quality classifier: rejected documents go;
3. SimHash near-duplicates (five-word shingles, similarity of 0.8 or more): the document with the least id of each group stays;
4. substring dedup: words of passages that a document with a smaller id has are removed from the text;
5. packing: a row per span of a sequence.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelpline.llm import conv_quality, near_texts, packing, quality_rules, substring_dedup
from kelpline.llm.common import WRITTEN, cut, drop_folders, own_folders, table
from kelpline.llm.queries import TOKENIZER


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return conv_quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_texts.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    with own_folders() as written:
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            drop_folders(spark, [f for f in written[:-1] if f in WRITTEN])  # the stage's own tables, and its predecessor's rows
    return docs


QUERIES = {"pipeline": run}

#: A trained network and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
