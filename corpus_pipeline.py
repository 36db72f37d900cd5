"""The corpus pipeline: four stages, each on all that the stage before kept.

Toxic documents go, one document of each group of near duplicates stays (that with the smallest doc_id), documents
that hold a benchmark item go, and what is left is encoded.  Each stage but the last returns the columns of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calorine.llm import bpe, decontaminate, ngram_join, toxicity
from calorine.llm.common import delete, delete_at_exit, read_table, scratch
from calorine.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rows that score 0.3 or more go.  The model is fitted on the stage's own documents.

    Null and empty texts are one empty sentence, which no label teaches to reject; repeated rows stay or go alike, as do
    rows without an id by their texts; very long texts are read whole; columns keep their names, whatever they are; an
    empty table gives no rows, and one without labels loses none.
    """
    return toxicity.clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, on five words and a similarity of 0.8: of each component the documents of the smallest doc_id stay.

    Rows without a doc_id stay, as do null, empty and blank texts, which link with nothing.  Repeated rows share their
    id and stay or go together.  Very long texts are compared whole; columns keep their names; an empty table gives no rows.
    """
    found = ngram_join.join_components(docs, k=5, percent=80)
    others = found.where("component_id <> doc_id").select("doc_id").distinct()
    return ngram_join.without(docs, others)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows stay or go alike; very long texts are read whole; columns keep
    their names; an empty table gives no rows, an empty benchmark rules none out.
    """
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the digests of each document's ids and of the bytes they decode to.

    A null text is encoded as the empty one; repeated rows and rows without an id each give a row; very long texts are
    encoded whole; further columns are dropped; an empty table gives no rows.
    """
    return bpe.round_trip(docs, bpe.load_ranks(tokenizer_file("byte_bpe_50k.tiktoken")))


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_duplicates), ("decontaminate", drop_contaminated), ("byte_bpe", encode)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; a stage's table goes when its successor is written, the last when the application ends."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is None:
            delete_at_exit(spark, folder)
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
