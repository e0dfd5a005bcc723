"""The training-data pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``; the last returns the shard plan of the rows that
the mixture kept (a document drawn in two passes has two rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import queries as _queries
from tillscope.llm.common import written
from tillscope.llm.fm_decontam import remove_benchmark
from tillscope.llm.label_shards import shard_documents
from tillscope.llm.mix_tree import mixed_documents
from tillscope.llm.simhash_planes import keep_one
from tillscope.llm.unigram_langid import fit, keep_identified


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return keep_identified(docs, fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest doc_id."""
    return keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; a document of which nothing is left goes."""
    return remove_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is drawn to its target; a row per document and pass."""
    return mixed_documents(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; equal texts gather in a shard."""
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", place_in_shards),
]

ORACLE_SQL = None  # the stages learn and iterate; tests/llm compares them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {**_queries.QUERIES, "pipeline": run}
ORACLES = dict(_queries.ORACLE)
if ORACLE_SQL:
    ORACLES["pipeline"] = ORACLE_SQL
