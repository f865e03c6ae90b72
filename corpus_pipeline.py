"""From raw documents to packed sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``. All but the last give documents with
the columns they came with; the last gives the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, mixing, packing, quality_classifier, queries, simhash
from corpusloom.llm.common import id_remainder
from corpusloom.session import cut_lineage
from corpusloom.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject."""
    labels = table(spark, sf_dir, "labels")
    return quality_classifier.keep_good(docs, labels, id_remainder("doc_id", 5) != 0, queries.QUALITY_THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    return exact_dedup.deduplicate(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share four fifths of their five-word shingles: that with the smallest id."""
    return simhash.drop_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned so that their tokens match the target weights of the domains."""
    return mixing.mix(docs, queries.domain_labels(table(spark, sf_dir, "labels")), **queries.MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 token ids."""
    pieces = packing.pack(docs, queries.tokenizer_path(), end_id=0)
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mixture),
    ("packing", packed),
]

# Tokenizer, classifier and components have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each from the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
