"""A corpus pipeline of five stages; each is written as Parquet and reread as the next one's documents.

Every stage takes null texts as empty and gives them back null; texts of any length are read whole; rows of equal
texts fare alike but for near-duplicates, of which one row stays; ties go to the smaller id; an empty table gives an
empty one; columns beyond those of ``documents``, whatever their names, stay as they are.

Cluster note: the package must be importable by Python workers (``barloom.session.ship`` sees to it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import packing, pii, quality_rules, simhash, weak_quality
from barloom.llm.common import table, written
from barloom.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table; null and empty ones have too few words and go."""
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer keeps; it is fit on what the stage gets. Without bad ones all stay."""
    return weak_quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by five-word Jaccard similarity of 0.8 or more: the one with the smallest id."""
    return simhash.one_of_each(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and disclosing terms; ``n_chars`` is counted anew. No row goes."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in pieces, each in one bin; documents without tokens are in none."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", near_duplicates),
    ("pii", privacy),
    ("best_fit_packing", packed),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
