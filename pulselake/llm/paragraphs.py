"""Substring dedup of paragraphs: MinHash bands, exact Jaccard confirmation, one kept paragraph per component."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import token_count
from .near import Banding, near_classes


def tuned(percent: int = 80, recall: float = 0.9995, rows: int = 3, shingle: int = 5) -> Banding:
    """The fewest bands of ``rows`` values that find a pair at ``percent`` with probability ``recall``.

    The sketch limit lets through what lies within five deviations of a pair at the threshold.
    """
    s = percent / 100
    bands = math.ceil(math.log(1 - recall) / math.log(1 - s**rows))
    k = bands * rows
    most = min(k, k * (1 - s) + 5 * math.sqrt(k * s * (1 - s)))
    return Banding(shingle, percent, bands, rows, math.ceil(128 * (1 - math.exp(-4 * most / 256)) + 6))


def paragraphs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid struct<id, pos>, text): the lines of every text by position; null texts have none."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\\n")).alias("pos", "text"))
    return lines.select(F.struct("id", "pos").alias("uid"), "text")


def repeated_paragraphs(docs: DataFrame, how: Banding | None = None, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, component struct<id, pos>, repeated, removed) for every paragraph of ``min_words`` words or more.

    A paragraph is a \\n-separated line of the whole text; ``min_words`` is one full shingle by default. Paragraphs link at Jaccard similarity 0.8 of their 5-word
    shingles; of each component the one with the smallest (id, position) stays. ``repeated``: the
    component has other members; ``removed``: this one goes. Nulls and empty texts have no
    paragraphs; rows that repeat an id count as the same paragraphs; an empty table gives an empty one;
    other columns are ignored.
    """
    units = paragraphs_of(docs, id_col, text_col).where(token_count(F.col("text")) >= min_words)
    found = near_classes(units, how or tuned(), "uid", "text")
    return found.select(F.col("uid.id").alias(id_col), F.col("uid.pos").alias("pos"), "component", (F.col("members") > 1).alias("repeated"), (~F.col("uid").eqNullSafe(F.col("component"))).alias("removed"))


def without_repeats(docs: DataFrame, how: Banding | None = None, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with removed paragraphs cut out of the text, which is null only where it was null; all other columns stay."""
    gone = repeated_paragraphs(docs, how, min_words, id_col, text_col).where("removed").groupBy(id_col).agg(F.collect_set("pos").alias("__gone"))
    gone = gone.withColumnRenamed(id_col, "__id")
    kept = F.filter(F.transform(F.split(text_col, "\n"), lambda line, i: F.when(~F.array_contains("__gone", i), line)), lambda line: line.isNotNull())
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left").withColumn(text_col, text).select(*docs.columns)
