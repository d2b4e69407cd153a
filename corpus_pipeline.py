"""A training corpus from raw documents: toxic ones out, near-duplicates out, benchmark leaks out, mixed to target weights, packed into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm._store import cut
from pulselake.llm.decontam import find_leaks
from pulselake.llm.mixing import QUALITY_WEIGHTS, apply_rates, mix, quality_domain
from pulselake.llm.near import Banding, drop_near_duplicates
from pulselake.llm.sharding import pack
from pulselake.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores under 0.5. Null and empty texts, null and repeated ids and repeated rows stay as they are; without labels nothing goes; an empty table gives an empty one."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, Jaccard similarity 0.8 or more.

    The row with the smallest id stays, a null id only if its group has no other; rows are told apart by id and text, so a repeated or null id takes no other text with it. Rows without
    words all stay; rows that repeat a kept id and text count once; an empty table gives an empty one.
    """
    return drop_near_duplicates(docs, Banding(shingle=5))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered by half or more. Null and empty texts, null and repeated ids and repeated rows stay as they are; an empty benchmark takes nothing."""
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col="__leaks")
    return found.where(F.size("__leaks") == 0).drop("__leaks")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates towards the target weights say; a rate of 1 or more keeps a document.

    Rows without words, and all rows where there are no labels, stay once; null and repeated ids are matched with their text; an empty table gives an empty one.
    """
    rates = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality_domain(), QUALITY_WEIGHTS)
    return apply_rates(docs, rates)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard of 8 and its slot there; equal texts share a shard, nulls are one text. Repeated rows have a slot each; an empty table gives an empty one."""
    return pack(docs, 8).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding)]

#: A learnt lexicon, MinHash groups and fitted rates have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
