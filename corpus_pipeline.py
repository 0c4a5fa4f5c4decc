"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

1. ``language_id`` drops documents whose language cannot be told (no letters, or a score under ``MIN_SCORE``: no learned language fits clearly best).
2. ``line_dedup`` drops lines that at least 10 documents hold; text and n_chars follow.
3. ``ngram_jaccard`` keeps one document of each group of near duplicates.
4. ``decontaminate`` drops documents that hold benchmark passages.
5. ``piece_dropout`` encodes the texts; it returns doc_id, lang, source, n_tokens and ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballastry.llm.common import shared_dir, table
from ballastry.llm.decontaminate import drop_contaminated
from ballastry.llm.language_id import keep_identified
from ballastry.llm.line_dedup import dedup_lines
from ballastry.llm.ngram_jaccard import keep_one
from ballastry.llm.piece_dropout import encode_texts

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def piece_dropout(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = encode_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontaminate", decontaminate),
    ("piece_dropout", piece_dropout),
]

#: Rank-order prediction and merge-dropout have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
