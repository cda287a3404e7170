"""The corpus pipeline: rejected documents go, copies go, leaked passages go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and calls one operator of chronolake.llm.  All but the last return the columns
of ``documents``; ``run`` writes each stage's rows to the shared folder and reads them again as the next one's docs.
Rows that are null in any column, empty tables and repeated rows are handled as the operators say: a null or empty
text fails the quality rules; rows that share a null id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import decontaminate, knn_quality, ngram_join, piece_codec, quality_rules
from chronolake.llm.queries import fold, table, tokenizer_file
from chronolake.llm.workspace import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps."""
    return quality_rules.apply_rules(docs, carry=COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours call good; labels of the held-out fold are not learned from."""
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0)
    return knn_quality.score_quality(docs, labels, carry=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id, by text if ids repeat."""
    return ngram_join.keep_one(docs, COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.flag_documents(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:]).where("not contaminated").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and whether they decode to its text."""
    out = piece_codec.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), carry=("text",))
    return out.select("doc_id", "ids", "n_tokens", F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("exact"))


STAGES = [
    ("quality rules", quality),
    ("quality classifier", classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: The classifier and the encoder are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
