"""From documents to token records: a corpus pipeline of five stages, each one operator of ``risklattice.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but the last return the columns
of documents. Null and empty texts have no letters and go in the first stage; rows without a doc_id or source pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklattice.llm import decontaminate, language, mixing, records, widehash
from risklattice.llm.shared import fresh
from risklattice.session import materialise, scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near enough to a language that the labelled ones among them teach; an empty table stays empty."""
    return language.keep_accepted(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of texts that share 0.8 of their five-word shingles or more.

    Wide SimHash fingerprints join most of them, a pigeonring filter thins their pairs out, and texts decide; what is left apart
    meets in a join of the first columns of the shingle matrix.
    """
    return widehash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in an order in which sources alternate by the square roots of their sizes."""
    return mixing.in_order(docs, mixing.weights_by_size(docs))


def stored_order(docs: DataFrame) -> tuple[DataFrame, list[Column] | None]:
    """``docs`` and the order of its files, by their part number and name, and of their rows; None where it isn't a table of files."""
    file, row = fresh(docs, "file__"), fresh(docs, "row__")
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return docs, None
    return placed, [F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long"), F.col(file), F.col(row)]


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records in the order of the mix, which is the order of the stored rows, and what is read back from their files.

    (doc_id, start, n_tokens, ids_crc32, part). Documents that aren't stored in files are written in order of doc_id.
    """
    path = scratch_path(spark, "records")
    placed, order = stored_order(docs)
    records.write_records(placed, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1, order=order)
    return records.read_records(spark, path, ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
    ("token_records", token_records),
]

# The fitted centroids, XXH64 fingerprints and the tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
