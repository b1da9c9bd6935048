"""A training corpus from the documents table, stage by stage.

Every stage gets what the one before it kept, as Parquet that is read again, and works on all of it.

1. quality: documents that the quality rules reject go, and boilerplate lines of the others.
2. near duplicates: one document of each SimHash component stays.
3. decontamination: documents with a benchmark window go.
4. mixing: all documents are put in the order of the Pfair schedule of their sources.
5. tokens: token ids in sorted-string tables. The order of the mixed files is cut into one range for each
   table, so every table holds the sources at their target weights; inside a table documents are sorted by
   identifier for lookup, and ``start`` counts the ids before a document in this order of tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skewloom.llm import decontam, mixing, quality, simhash, sstable
from skewloom.llm.queries import vocabulary
from skewloom.session import Scratch, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sstable.read(sstable.write(docs, vocabulary(), file_order=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token tables", token_stage),
]

#: Hashing with XXH64, the schedule and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents", spread=True)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
