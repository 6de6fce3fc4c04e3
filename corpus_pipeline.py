"""The corpus pipeline: quality classifier, near-duplicate removal, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.bpe import bpe_encode
from stratalog.llm.common import written
from stratalog.llm.jaccard import jaccard_dedupe
from stratalog.llm.mixing import mix_sources
from stratalog.llm.quality import keep_quality


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted to `labels`, does not reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8)."""
    return jaccard_dedupe(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the slots that their sources' weights give them: files by number, rows in them."""
    return mix_sources(docs).sort("mix_slot", "mix_pos").drop("mix_block", "mix_slot", "mix_pos")


def placed(docs: DataFrame) -> DataFrame:
    """docs with mix_file and mix_row (long), each row's place in the files that docs is read from, so that the mixed order outlives
    shuffles; a table that is not read from files has its partitions in their place."""
    try:
        return docs.withColumns({"mix_file": F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), "mix_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return docs.withColumns({"mix_file": F.spark_partition_id().cast("long"), "mix_row": F.monotonically_increasing_id()})


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document, with its place in the mixed order: by mix_file, then mix_row."""
    import public_tokenizers

    return bpe_encode(placed(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("mix_file", "mix_row"))


STAGES = [("quality classifier", drop_low_quality), ("n-gram Jaccard join", drop_near_copies), ("source mixing", mix), ("byte-level BPE", encode)]

#: The classifier and the encoder are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
