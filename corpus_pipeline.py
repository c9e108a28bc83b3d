"""A training corpus from raw documents: five of the corpus operators in a row.

Every stage takes all rows that its predecessor kept; all but the last return the columns of
``documents``. Rows are dropped whole: toxic ones, all but one of equal texts, all but one of a
near-duplicate group, and those in which a benchmark window occurs. The last stage encodes what is
left and decodes it again.

Nulls, empty texts, repeated rows and empty tables, in every stage: a null or empty text is clean, equal to
every other such text and encodes to no ids, so one of them stays; a null doc_id is a row like others and loses
ties; of repeated rows one stays; an empty table passes as an empty one; other columns pass unread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from mosaiq.llm.common import clean, made, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (packed, see bpe.unpack)."""
    return bpe.digests(bpe.encode(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_equal),
    ("simhash_near_dedup", drop_near),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL has no expression for a fitted model, graph components or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next.

    What a stage left there is deleted once its result is written; the last stage's input stays, since the
    result is read from it (``common.clean`` deletes it too, afterwards)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = len(made())
        docs = written(stage(spark, docs, sf_dir), name)
        clean(spark, made()[max(0, before - 1) if name != STAGES[0][0] else before : -1])
    return STAGES[-1][1](spark, docs, sf_dir)
