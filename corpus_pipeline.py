"""A pipeline that turns raw documents into token ids: each stage works on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. run() applies all of them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontam, exact, pieces, quality, simhash
from lamina.llm.common import materialise, read

#: Documents that score less are rejected.
QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is QUALITY or more. Scores come from the text alone."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    score = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    return quality.with_quality(docs, model, score).where(F.col(score) >= QUALITY).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest doc_id."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: less than 0.8 of each item's five-word shingles."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the hash of the text that the ids decode to, which is the text's."""
    return pieces.round_trip(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", tokens),
]

#: The first stage fits a classifier, which SQL cannot express; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage{i}")
    return docs
