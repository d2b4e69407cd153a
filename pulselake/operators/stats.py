"""Retrieval metrics, intervals and tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def query_metrics(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(q_id, s1, s5, s10, mrr, ndcg) from ``hits(q_id, rank)``, the ranks from 0 of right answers, and ``relevant(q_id, n_relevant)``.

    Queries without a hit score 0; an ideal gain of 0 counts as 1.
    """
    first = hits.groupBy("q_id").agg(F.min("rank").alias("best"), F.sum(F.when(F.col("rank") < k, 1 / F.log2(F.col("rank") + F.lit(2.0)))).alias("dcg"))
    r = relevant.join(first, "q_id", "left")
    ideal = F.aggregate(F.when(F.least(F.col("n_relevant"), F.lit(k)) > 0, F.sequence(F.lit(0), F.least(F.col("n_relevant"), F.lit(k)).cast("int") - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(2.0)))
    return r.select("q_id", *(F.coalesce((F.col("best") < n).cast("double"), F.lit(0.0)).alias(f"s{n}") for n in (1, 5, 10)), F.coalesce(1 / (F.col("best") + 1.0), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / F.when(ideal == 0, 1.0).otherwise(ideal)).alias("ndcg"))


def means(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("s1", "s5", "s10", "mrr", "ndcg")), F.count("*").alias("n"))


def bootstrap(values: DataFrame, by: list[str], value: str, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by, mean, lo, hi): percentile bootstrap of the mean by group with a fixed generator; null values don't count, a group without values gives NaN.

    A group's values meet in one task: they are one number for each benchmark query. Draws go in blocks, so memory does not grow with n_boot.
    """
    kinds = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].dropna().to_numpy(float)
        out = pdf[by].iloc[:1].copy()
        if not len(v):
            return out.assign(mean=np.nan, lo=np.nan, hi=np.nan)
        rng = np.random.default_rng(seed)
        step = max(1, 2_000_000 // len(v))
        drawn = np.concatenate([v[rng.integers(0, len(v), (min(step, n_boot - i), len(v)))].mean(1) for i in range(0, n_boot, step)])
        return out.assign(mean=v.mean(), lo=np.quantile(drawn, alpha / 2), hi=np.quantile(drawn, 1 - alpha / 2))

    return values.groupBy(*by).applyInPandas(run, f"{kinds}, mean double, lo double, hi double")


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(only_a, only_b, p): exact two-sided test on paired outcomes; p is 1 without discordant pairs."""
    n = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    total, low = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    start = F.struct(F.lit(0.0).alias("log_c"), F.lit(0.0).alias("sum"))
    steps = F.sequence(F.lit(0).cast("long"), low)

    def step(acc: Column, i: Column) -> Column:
        log_c = F.when(i == 0, F.lit(0.0)).otherwise(acc["log_c"] + F.log((total - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double")))
        return F.struct(log_c.alias("log_c"), (acc["sum"] + F.exp(log_c - total * F.log(F.lit(2.0)))).alias("sum"))

    p = F.aggregate(steps, start, step, lambda acc: F.least(F.lit(1.0), 2 * acc["sum"]))
    return n.select("only_a", "only_b", F.when(total == 0, 1.0).otherwise(p).alias("p"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def exclusive_quartiles(df: DataFrame, value: str, splits: int = 64) -> DataFrame:
    """(q1, q2, q3) at positions i (n + 1) / 4 of the sorted values; nulls if there is none.

    Approximate quantiles only cut the values into ``splits`` ranges; the exact ranks are then counted range by range, so no
    task sorts all values.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = v.count()
    if not n:
        return df.sparkSession.createDataFrame([(None, None, None)], "q1 double, q2 double, q3 double")
    at = [min(max(i * (n + 1) / 4, 1), n) for i in (1, 2, 3)]
    ranks = sorted({int(p) for p in at} | {min(int(p) + 1, n) for p in at})
    edges = sorted(set(v.approxQuantile("v", [i / splits for i in range(1, splits)], 0.01)))
    part = sum((F.when(F.col("v") > e, 1).otherwise(0) for e in edges), F.lit(0))
    counts = v.groupBy(part.alias("part"), "v").agg(F.count("*").alias("c"))
    before = counts.groupBy("part").agg(F.sum("c").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    counts = counts.join(F.broadcast(before), "part").withColumn("hi", F.col("start") + F.sum("c").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    got = counts.select(*(F.min(F.when(F.col("hi") >= r, F.col("v"))).alias(f"r{r}") for r in ranks))
    parts = []
    for i, p in enumerate(at, 1):
        lo = int(p)
        parts.append((F.col(f"r{lo}") + (p - lo) * (F.col(f"r{min(lo + 1, n)}") - F.col(f"r{lo}"))).alias(f"q{i}"))
    return got.select(*parts)


def score_bins(df: DataFrame, score: str) -> DataFrame:
    s = F.col(score)
    return df.agg(F.count_if(s < 0.6).alias("below_60"), F.count_if((s >= 0.6) & (s < 0.75)).alias("from_60"), F.count_if(s >= 0.75).alias("from_75"))


def prediction_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(n, accuracy, precision, recall, abstained, wrong) of ``pred(name, key)`` against ``gold(name, key)``; a null prediction abstains."""
    j = gold.select("name", F.col("key").alias("truth")).join(pred.select("name", "key"), "name", "left")
    right, given = F.col("key") == F.col("truth"), F.col("key").isNotNull()
    r = j.agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(given).alias("given"), F.count_if(given & ~F.coalesce(right, F.lit(False))).alias("wrong"), F.count_if(F.col("truth").isNotNull()).alias("known"))
    return r.select("n", (F.col("right") / F.col("n")).alias("accuracy"), F.try_divide("right", "given").alias("precision"), F.try_divide("right", "known").alias("recall"), (F.col("n") - F.col("given")).alias("abstained"), "wrong")
