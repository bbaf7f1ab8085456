"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents, in their order,
whatever further columns the documents have and however those are named. Null texts count as empty;
texts of any length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, exact_dedup, jaccard_join, mixing, quality_model
from tarn.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the classifier rejects go.

    Null and empty texts get the score of a text without words, repeated rows the same score each. A
    score at the border stays. Without labelled rows every text scores 0.5, and all documents go.
    """
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, out_col="_score").where(F.col("_score") >= quality_model.GOOD).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the one with the largest doc_id stays; of repeated rows one, of all null and empty texts one, null ids last."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of linked documents the one with the smallest doc_id stays.

    Texts without words and rows without id link with nothing and stay, as do rows that repeat an id that stays.
    """
    return jaccard_join.keep_one(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents drawn by the raked probabilities; null source and language are cells of their own, rows of one id are drawn together."""
    return mixing.mixed(docs).where("kept").select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids of what is left, and the digests of ids and decoded text; null and empty texts have no tokens, repeated rows a row each."""
    return bpe.round_trip(docs, bpe.default_path())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mixing_to_targets),
    ("BPE encoding and decoding", encoding),
]

#: A trained classifier and BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i + 1}")
    return docs
