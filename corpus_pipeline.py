"""The training-text pipeline: each stage is one operator of agro_jobs.llm, written as Parquet and reread.

quality   documents that the quality classifier rejects go
near      one document of each near-duplicate class stays
leaks     documents that hold a benchmark passage go
mix       sources are mixed to their target weights; documents may repeat
shard     the mix is dealt into shards (doc_id, size, text_crc32, law, shard, slot, grown_shard)

All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agro_jobs.llm import icws, kd_shards, mixing, quality_pu, winnow
from agro_jobs.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.keep_good(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return icws.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(docs)


STAGES = [("quality", quality), ("near", near), ("leaks", leaks), ("mix", mix), ("shard", shard)]
ORACLE_SQL = None  # a trained classifier and sampled bands have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
