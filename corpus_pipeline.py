"""A training corpus from documents in five stages; each is written as Parquet, and the next one reads it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortix.llm.common import discard, shared_dir, table
from cohortix.llm.decontamination import uncontaminated
from cohortix.llm.language_id import fit, held_out, language_id
from cohortix.llm.line_dedup import line_dedup
from cohortix.llm.near_dedup import near_dedup
from cohortix.llm.packing import packed_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected whose cosine with every language's prototype is no larger than this. Prototypes are centred on their
#: mean, so the largest cosine is practically always above 0: only texts without letters (`und`) go, junk with letters stays.
MIN_COSINE = 0.0


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; null texts and those without letters (`und`) go, and no others."""
    model = fit(docs.where(~held_out("doc_id")))
    return language_id(docs.select(COLUMNS), model).where((F.col("lang_pred") != "und") & (F.col("score") > MIN_COSINE)).select(COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those of which nothing is left go, and n_chars is counted anew."""
    out = line_dedup(docs.select(COLUMNS))
    return out.where((F.col("n_removed") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    gone = near_dedup(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of benchmark: one window is enough, however long the document is. Each row is judged by its own text."""
    return uncontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the pieces of the documents in sequences of 4096 tokens."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", keep_languages), ("line_dedup", cut_lines), ("near_dedup", one_of_each), ("decontamination", decontaminate), ("packing", pack)]

#: Language identification and MinHash can't be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's output written to and reread from the shared folder, and deleted when the next is written; the last one stays."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, f"{folder}/{before}")
        before = name
    return docs
