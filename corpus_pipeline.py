"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a frame that is written as
Parquet and read again as the next one's ``docs``.  All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.llm import line_dedup, minhash, mixing, pieces, quality_rules
from specloom.llm.common import table, written

#: No SQL can encode text with the piece model; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and whose host is not rejected."""
    return quality_rules.passing_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document without the lines that a smaller doc_id holds; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the round trip through the decoder; copies of a document have coins of their own."""
    copy = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source"))
    done = pieces.encode_and_check(docs.select("doc_id", "lang", "source", "text", copy.alias("_copy")), copy="_copy")
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256", "lossless")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
