"""From raw documents to a mixed corpus in token ids, in five stages of one operator each.

Every stage takes what the one before it kept: quality rules reject documents,
line dedup takes repeated lines out of the texts (and drops documents that lose
so many that the rules would reject the rest as too short), the n-gram join keeps one document of each group of near copies, the mix
takes each document a number of times, and the last stage encodes the texts.
All but the last return the columns of documents, with ``n_chars`` brought up
to date. Nulls, empty tables and extra columns are handled as the operators
define; ids need not be unique after the mix, which repeats documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import bpe, lines, mixing, near, quality
from wayline.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mix cannot be expressed in SQL after the joins before it, nor byte-level BPE at all: tests compare with plain versions.
ORACLE_SQL: str | None = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs.select(*COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(docs.select(*COLUMNS), least_words=quality.LEAST_WORDS)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near_copies(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = bpe.public_vocabulary()
    coded = docs.select("doc_id", bpe.round_trip(spark, path, pattern)(F.col("text")).alias("c")).select("doc_id", "c.*")
    return coded.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each result but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
