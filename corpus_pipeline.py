"""A corpus pipeline of five stages; each works on all that the one before it kept and is written as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, line_dedup, mixing, quality_rules, simhash
from quarry.plans.cut import work_folder

TOKENIZER = "word_bpe_49k.json"
#: Chunks that a worker of the encoding stage keeps: fewer than by itself, as workers serve the other stages, too.
KEPT_CHUNKS = 120_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more of them share; n_chars follows the text."""
    d = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        d = d.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 rows."""
    return mixing.copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER), ids=False, keep=KEPT_CHUNKS)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixing", mix), ("encoding", encode)]

#: No SQL: the fingerprints' hash and the tokenizer have no counterpart there; tests hold the
#: first three stages against plain Python, mixing against op3's SQL and the encoding against the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
