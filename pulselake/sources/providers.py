"""What models do, behind plain callables: embedding, translation, hypothetical documents, reranking. Offline stand-ins included."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import normalized

Embed = Callable[[list[str], str], np.ndarray]


def hashed_words(texts: list[str], side: str, dim: int = 64) -> np.ndarray:
    """An offline embedding: signed hashes of words and letter triples."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for g in [*t.split(), *(t[j : j + 3] for j in range(len(t) - 2))]:
            h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1 if h >> 63 else -1
    return out


def embed(df: DataFrame, key: str, text: str, provider: Embed = hashed_words, side: str = "doc", instruction: str = "", batch: int = 256) -> DataFrame:
    """(key, embedding): vectors of length 1. ``instruction`` stands before queries only."""
    prefix = instruction if side == "query" else ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                v = provider([prefix + (t or "") for t in part[text]], side)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [x.tolist() for x in v]})

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
    return out.withColumn("embedding", normalized(F.col("embedding")).cast("array<float>"))


def cached(df: DataFrame, key: str, path: str, build: Callable[[DataFrame], DataFrame], text: str | None = None) -> DataFrame:
    """The table under ``path`` completed by ``build`` for the rows of ``df`` that it lacks.

    A row is known by its id, and with ``text`` by the hash of that column too, so a changed text is built again and its older row is not read.
    """
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    of = F.sha2(F.coalesce(F.col(text), F.lit("")), 256) if text else F.lit("")
    marked = df.withColumn("_of", of)
    by = [key, "_of"]
    missing = marked.join(spark.read.parquet(path).select(*by), by, "left_anti") if there else marked
    build(missing.drop("_of")).join(missing.select(*by).distinct(), key).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(marked.select(*by).distinct(), by, "left_semi").drop("_of")


def per_text(df: DataFrame, text: str, provider: Callable[[list[str]], list[str]], out: str, batch: int = 40) -> DataFrame:
    """(text, out): translations, hypothetical documents and the like, in batches; a short reply is padded with nulls, a long one cut."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                asked = list(pdf[text].iloc[i : i + batch])
                got = list(provider(asked))[: len(asked)]
                yield pd.DataFrame({text: asked, out: got + [None] * (len(asked) - len(got))})

    return df.select(text).distinct().mapInPandas(run, f"{text} string, {out} string")


def text_cache(df: DataFrame, key: str, text: str, path: str, provider: Callable[[list[str]], list[str]], out: str) -> DataFrame:
    """(key, out): the provider's reply to each row's text, from the JSON lines under ``path``; rows that it lacks, or has under another text, are asked for and appended.

    The cache holds every reply with the hash of its text, so a changed text finds no stale reply.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = df.select(key, text, F.sha2(text, 256).alias("_of")).where(F.col(text).isNotNull())

    def known() -> DataFrame:
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        schema = f"{key} {kind}, _of string, {out} string"
        return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)

    missing = rows.join(known().select(key, "_of"), [key, "_of"], "left_anti")
    made = missing.join(per_text(missing, text, provider, out), text).select(key, "_of", out)
    made.write.mode("append").json(path)
    return rows.join(known(), [key, "_of"]).select(key, out)


def encode_tokens(df: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[np.ndarray]], batch: int = 64) -> DataFrame:
    """(key, tokens array<array<float>>): one vector of length 1 for each token that the provider finds in a text; as many as there are, so rows differ in length."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                got = provider([t or "" for t in part[text]])
                unit = [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9) if len(m) else m for m in got]
                yield pd.DataFrame({key: part[key].to_numpy(), "tokens": [[row.tolist() for row in m] for m in unit]})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, tokens array<array<float>>")


def hashed_tokens(texts: list[str], dim: int = 32) -> list[np.ndarray]:
    """An offline token encoder: the hashed letters of each word."""
    return [hashed_words(t.lower().split(), "token", dim) if t.split() else np.zeros((0, dim), np.float32) for t in texts]


def dictionary(words: dict[str, str]) -> Callable[[list[str]], list[str]]:
    """An offline translator."""
    return lambda texts: [words.get(t, t) for t in texts]


def cross_rerank(short: DataFrame, provider: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """``short(q_id, doc_id, q_text, d_text)`` with the provider's ``score`` for each pair."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[["q_id", "doc_id"]].assign(score=[float(x) for x in provider(list(pdf["q_text"]), list(pdf["d_text"]))])

    kinds = ", ".join(f"{c} {short.schema[c].dataType.simpleString()}" for c in ("q_id", "doc_id"))
    return short.select("q_id", "doc_id", "q_text", "d_text").mapInPandas(run, f"{kinds}, score double")
