"""From raw documents to packed training windows: quality, toxicity, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import free_names, ship_package, stored, table
from cohortlens.llm.packing import packed_pieces
from cohortlens.llm.quality import quality_columns
from cohortlens.llm.simhash import drop_near_duplicates
from cohortlens.llm.toxicity import score_documents

#: Documents with a score of at least this are rejected.
TOXIC_SCORE = 0.7


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands.

    Null, empty and short texts fail the base rule. Every row is judged on its own, so repeated
    rows share their fate; an empty table stays empty; columns may have any names.
    """
    ship_package(spark)
    (judged,) = free_names(docs, "quality")
    return _columns_of(docs, quality_columns(docs, name=judged).where(F.col(judged)["kept"]))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic by a classifier learnt from the labels of what is left.

    Null and empty texts get the score of the bias. A score of exactly ``TOXIC_SCORE`` rejects;
    repeated rows share their fate; an empty table stays empty; columns may have any names.
    """
    ship_package(spark)
    (scored,) = free_names(docs, "toxicity")
    rows = score_documents(docs, table(spark, sf_dir, "labels"), name=scored)
    return _columns_of(docs, rows.where(F.col(scored) < TOXIC_SCORE))


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints at two or fewer differing bits.

    The one with the smallest id stays; of repeated rows one, of a group without ids one. Null
    and empty texts are one group; an empty table stays empty; columns may have any names.
    """
    ship_package(spark)
    return drop_near_duplicates(docs, shingle=3, max_bits=2)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    Null and empty texts are one end id; repeated rows are packed each; a long text is cut; an
    empty table gives no rows; only ``doc_id`` and ``text`` are read.
    """
    ship_package(spark)
    return packed_pieces(docs)


def _columns_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("simhash near-dedup", simhash_near_duplicates),
    ("packing", packing),
]

#: SQL has neither zstandard, nor a trained classifier, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again for the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
