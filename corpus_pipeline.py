"""From raw documents to balanced shards of a mixed corpus, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``.

1. ``quality``: documents that fail the base counts, or whose character classes or
   common words are too far from their language's, go.
2. ``near_duplicates``: of each group of documents linked at 0.8 of their 5-word
   shingles, the one with the least id stays.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``mix``: what remains is mixed to target weights; a document comes back with the
   words taken of it, once for each round through its source that takes any.
5. ``shard``: ``doc_id, size, text_crc32, shard, slot`` of 40 shards of equal bytes.

Defined results: null and empty texts have no words and fail the base counts, so they
go in the first stage; a null id, language or source is one of its own; texts of any
length are read whole; rows equal in id and text are near duplicates of each other, of
which one stays, as of any tie the least id; benchmark rows without words match nothing;
an empty table gives an empty table; further columns go through all stages but the last
unchanged, whatever their names, but for ``n_chars``, which follows the mixed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitwise.llm.decontaminate import without_leaks
from pitwise.llm.mixing import mixed_documents
from pitwise.llm.quality import kept_documents
from pitwise.llm.scratch import cut
from pitwise.llm.setjoin import one_of_each_group
from pitwise.llm.sharding import shard_by_bytes

#: SQL cannot express the mix's permutations; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_by_bytes(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
