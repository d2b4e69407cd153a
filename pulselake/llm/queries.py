"""The driver's queries over the text operators, with production parameters and over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import ORACLE  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import clean_lines

    docs = _table(spark, sf_dir, "documents")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import Banding, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), Banding(shingle=2))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import CLEAN_WEIGHTS, label_domain, mix

    out = mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), label_domain(), CLEAN_WEIGHTS)
    return out.select("doc_id", "tokens", F.col("domains")[F.array_position(F.col("posterior"), F.array_max("posterior")).cast("int") - 1].alias("domain"), "posterior", "rate", "repeats", "targets", "reached")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_hits")


def op6_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import pack

    packed = pack(_table(spark, sf_dir, "documents"), 8)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op2_line_quality": op2_line_quality,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_soft_mixing": op4_soft_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_bin_packing": op6_bin_packing,
}


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), 200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _by_document(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Per document: how many units it has, how many repeat elsewhere, and the positions that go."""
    got = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("repeated").alias("r"), F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("pos")))).alias("p"))
    got = got.withColumnRenamed("doc_id", "of")
    out = docs.select("doc_id").join(got, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_units"), F.coalesce("r", F.lit(0)).alias("n_repeated"), F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("p", F.array().cast("array<int>")).alias("removed"))


def _with_passages(docs: DataFrame, units: DataFrame) -> DataFrame:
    """``units`` with n_repeated and n_repeated_words: passages of over 50 words that other documents hold word for word, wherever in a paragraph they begin; n_alike: paragraphs with one alike."""
    from .passages import shared_passages

    most = shared_passages(docs).groupBy(F.col("doc_id").alias("of")).agg(F.max("n_passages").alias("p"), F.max("n_words").alias("w"))
    out = units.withColumnRenamed("n_repeated", "n_alike").join(most, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "n_units", "n_alike", F.coalesce("p", F.lit(0)).alias("n_repeated"), F.coalesce("w", F.lit(0)).alias("n_repeated_words"), "n_removed", "removed")


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraphs import repeated_paragraphs

    docs = _table(spark, sf_dir, "documents")
    return _with_passages(docs, _by_document(docs, repeated_paragraphs(docs)))


def op8_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    out = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("leaks.item_id")))
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), items.alias("item_ids"), F.coalesce(F.array_max("leaks.coverage"), F.lit(0.0)).alias("coverage"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import fuzzy_lines

    docs = _table(spark, sf_dir, "documents")
    return _by_document(docs, fuzzy_lines(docs))


QUERIES |= {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op7_paragraph_dedup": op7_paragraph_dedup,
    "op8_benchmark_tiling": op8_benchmark_tiling,
    "op10_fuzzy_lines": op10_fuzzy_lines,
}


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_pages

    out = extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES["op9_html_main_text"] = op9_html_main_text
