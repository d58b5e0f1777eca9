"""The corpus pipeline: each stage reads what the one before kept, and its decisions take effect.

quality    documents that the quality classifier rejects go
near       one document of each group of near duplicates stays (five-word shingles, Jaccard 0.8 or more)
mix        sources are brought to their target weights; a document appears once for each copy taken
encode     SentencePiece ids of each text
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from papyra.llm.ngram_join import deduplicated
from papyra.llm.piece_encode import encoded
from papyra.llm.quality import accepted
from papyra.llm.shared import shared_dir, table
from papyra.llm.source_mix import mixed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled documents of the table ``labels`` in ``sf_dir``; a table without labels keeps all. Null and empty
    texts are scored like others; rows that repeat stay or go together."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a Jaccard of 0.8 or more, directly or by others, that with the least doc_id
    stays. Null and empty texts link with nothing and stay, and so do documents without an id; rows with the same id are one
    document; an empty table stays empty; other columns are kept, whatever their names."""
    return deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with its columns; sources by code point, null last. Texts without words have
    no size and aren't taken; an empty table stays empty."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, intact) for each row, so once for each copy that the mix took. An empty text has no ids, a null one
    has null in their place; an empty table stays empty; columns of other names are dropped."""
    return encoded(docs)


STAGES = [("quality", quality), ("near", near), ("mix", mix), ("encode", encode)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` in ``sf_dir``; each stage but the last is a table in the shared folder, from which the next one
    reads. An empty table gives an empty result; columns that ``documents`` has besides are carried to the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
