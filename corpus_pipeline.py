"""The corpus pipeline: from raw documents to token ids, one written table per stage.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents; the last returns doc_id, n_ids, ids and round_trip for every document that is left.

Cases: all other columns go through unread, whatever their names. Null and empty texts are equal texts without words: the first
stage gives them weight 0, the second keeps one of them, the next two keep it. Rows equal in doc_id and text share their fate in
the first and fourth stage; of rows with equal doc_id and equal texts one stays in the second. Ids must be integers or null
(the first stage joins them with labels), a null id comes after all others. Very long texts are read whole. An empty table stays
empty, and without labels of both classes the first stage keeps every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from invoicelake.llm import decontam, exact_dedup, jaccard_join, pieces, quality
from invoicelake.llm.words import table
from invoicelake.session import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards documents labelled good; what is not sampled goes. Ties at the last place stay."""
    return quality.sampled(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the smallest doc_id stays, one row of it."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return jaccard_join.one_per_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; items without words match nothing."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids."""
    return pieces.tokens(docs)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_duplicates", drop_near_copies), ("decontamination", drop_contaminated), ("pieces", encode)]

#: Sampling with hashed features and Viterbi search are not SQL; tests/llm/test_pipeline.py compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
