"""A corpus pipeline over the table of documents: rate, deduplicate, mix, encode.

STAGES names the stages in order; each takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.bpe import bpe
from barloom.llm.mixing import mix
from barloom.llm.ngram_join import BROADCAST_IDS, ngram_jaccard_join
from barloom.llm.quality import grade_texts, grades_of_labels
from barloom.llm.shared import fresh, read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier selects."""
    selected = fresh(docs, "selected")
    return grade_texts(docs, grades_of_labels(read(spark, sf_dir, "labels"))).where(F.col(selected)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked at 0.8 over five-word shingles."""
    label = ngram_jaccard_join(docs.select("doc_id", "text"), words=5, num=80, den=100)
    gone = written(label.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes 0.8 of the tokens, each document once at most, with equal weights in the tree of language and source."""
    return mix(docs, ["lang", "source"], part=0.8, epochs=1).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    import public_tokenizers

    return bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("mixing", mixing), ("byte-level BPE", encoding)]
#: The classifier's fit can't be expressed in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
