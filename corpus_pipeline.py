"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes each
stage's rows as Parquet to the shared folder and reads them again for the next.
ORACLE_SQL is None: the classifier and the token digests can't be put in SQL;
``tests/llm`` holds the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskfold.llm import bpe, exact, minhash, mixing, quality
from riskfold.llm.common import materialize, table

ORACLE_SQL = None
#: Words in a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (10): documents that it rejects go."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (6): of equal texts the row with the largest doc_id stays."""
    return exact.exact_survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (5): the smallest doc_id of each component stays."""
    return minhash.near_survivors(docs, SHINGLE_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources (1): every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE (9): token ids and the decoded text's digests, a row per document."""
    return bpe.bpe_digests(docs)


STAGES = [("quality classifier", classify), ("exact dedup", drop_copies), ("near dedup", drop_near_copies),
          ("mix sources", mix), ("bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
