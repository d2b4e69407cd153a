"""Retrieval and resolution experiments put together from the operators: corpora, systems, reruns and their comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval, stats

SYSTEMS = ("dense", "sparse", "hybrid", "colbert")


def concatenated(corpora: dict[str, DataFrame]) -> DataFrame:
    """All corpora as one, with ``corpus`` for the place a row comes from and ``doc_id`` made ``<corpus>:<id>``, so ids of two corpora stay apart."""
    parts = [df.withColumn("corpus", F.lit(name)).withColumn("doc_id", F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string"))) for name, df in corpora.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def judged(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """(q_id, doc_id, rank, ok) of ``ranking``: whether the pair is in ``relevant(q_id, doc_id)``."""
    marks = relevant.select("q_id", "doc_id", F.lit(True).alias("_ok")).distinct()
    return ranking.join(marks, ["q_id", "doc_id"], "left").select("q_id", "doc_id", "rank", F.coalesce("_ok", F.lit(False)).alias("ok"))


def outcomes(ranking: DataFrame, relevant: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(q_id, s1, s5, s10, mrr, ndcg) of every query of ``asked(q_id)`` from the first ``k`` ranks."""
    counts = asked.select("q_id").distinct().join(relevant.groupBy("q_id").agg(F.countDistinct("doc_id").alias("n_relevant")), "q_id", "left")
    hits = judged(ranking.where(F.col("rank") < k), relevant).where("ok").select("q_id", "rank")
    return stats.query_metrics(hits, counts.select("q_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant")), k)


def rankings(queries: DataFrame, corpus: DataFrame, tokens: DataFrame, query_tokens: DataFrame, k: int = 10, depth: int = 100, digits: int = 6) -> DataFrame:
    """(system, q_id, doc_id, rank) of four systems over one corpus, ``k`` each.

    ``queries(q_id, q_text, qv)`` and ``corpus(doc_id, text, dv)``; ``tokens(doc_id, dv)`` and ``query_tokens(q_id, q_pos, qv)`` feed late interaction. The hybrid
    fuses the first ``depth`` ranks of the dense and the sparse system, so no ranking of a whole corpus is kept. Scores are rounded to
    ``digits`` before ranks are taken; ties go by id.
    """

    def ranked(scores: DataFrame, n: int) -> DataFrame:
        return retrieval.top(scores.withColumn("score", F.round("score", digits)), n)

    dense = retrieval.dense_top(queries.select("q_id", "qv"), corpus.select("doc_id", "dv"), depth, digits=digits)
    sparse = ranked(retrieval.bm25(queries.select("q_id", "q_text"), corpus.select("doc_id", "text")), depth)
    found = {
        "dense": dense.where(F.col("rank") < k),
        "sparse": sparse.where(F.col("rank") < k),
        "hybrid": ranked(retrieval.fuse([dense, sparse]), k),
        "colbert": retrieval.late_top(query_tokens, retrieval.ragged(tokens), k, digits=digits),
    }
    return reduce(DataFrame.union, (found[s].select(F.lit(s).alias("system"), "q_id", "doc_id", "rank") for s in SYSTEMS))


def report(by_system: dict[str, DataFrame], base: str, strata: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """(system, n, s1, s5, mrr, ndcg, better, worse, p, stars): means of each system's ``outcomes`` and its paired test against ``base``."""
    rows = []
    first = by_system[base].select("q_id", (F.col("s1") > 0).alias("base_ok"))
    for name, m in by_system.items():
        mean = m.agg(F.count("*").alias("n"), *(F.round(F.avg(c), digits).alias(c) for c in ("s1", "s5", "mrr", "ndcg")))
        test = stats.mcnemar(m.select("q_id", (F.col("s1") > 0).alias("ok")).join(first, "q_id"), "ok", "base_ok")
        rows.append(mean.crossJoin(F.broadcast(test)).select(F.lit(name).alias("system"), "n", "s1", "s5", "mrr", "ndcg", F.col("only_a").alias("better"), F.col("only_b").alias("worse"), F.round("p", digits).alias("p"), stats.stars(F.col("p")).alias("stars")))
    return reduce(DataFrame.union, rows)


def by_stratum(by_system: dict[str, DataFrame], strata: DataFrame, digits: int = 6) -> DataFrame:
    """(system, stratum, n, s1) of the systems' outcomes by ``strata(q_id, stratum)``."""
    every = reduce(DataFrame.union, (m.select(F.lit(name).alias("system"), "q_id", "s1") for name, m in by_system.items()))
    return every.join(strata.select("q_id", "stratum"), "q_id").groupBy("system", "stratum").agg(F.count("*").alias("n"), F.round(F.avg("s1"), digits).alias("s1"))


def corpus_ablation(queries: DataFrame, corpora: dict[str, DataFrame], base: str, right: Callable[[Column, Column], Column], digits: int = 6, itself: bool = True) -> DataFrame:
    """(corpus, n, s1, supplied): success of the best row with ``base`` alone and with all corpora as one; ``supplied`` counts its hits from other corpora than ``base``.

    ``queries(q_id, qv, qkey)`` and corpora of ``(doc_id, dv, dkey)``; ``right(qkey, dkey)`` judges an answer. Without ``itself`` a query does not find the rows that bear its
    own id (one in a corpus at most); they stay in the corpora for all other queries.
    """
    rows = []
    for name, parts in ((base, {base: corpora[base]}), ("combined", corpora)):
        every = concatenated(parts)
        found = retrieval.dense_top(queries.select("q_id", "qv"), every.select("doc_id", "dv"), 1 if itself else 1 + len(parts), digits=digits)
        if not itself:
            own = reduce(lambda a, b: a | b, (F.col("doc_id") == F.concat(F.lit(f"{part}:"), F.col("q_id").cast("string")) for part in parts))
            found = retrieval.top(found.where(~own).drop("rank"), 1)
        best = found.join(every.select("doc_id", "corpus", "dkey"), "doc_id").join(queries.select("q_id", "qkey"), "q_id")
        ok = right(F.col("qkey"), F.col("dkey"))
        rows.append(best.agg(F.lit(name).alias("corpus"), F.count("*").alias("n"), F.round(F.avg(ok.cast("double")), digits).alias("s1"), F.count_if(ok & (F.col("corpus") != base)).alias("supplied")))
    return reduce(DataFrame.union, rows)


def recall_at(ranking: DataFrame, relevant: DataFrame, asked: DataFrame, at: tuple[int, ...] = (1, 5, 10), digits: int = 6) -> DataFrame:
    """One row with the share of queries that have a right answer in the first ranks (``r1``, ``r5``, …) and the mean reciprocal rank within the last of them."""
    first = judged(ranking.where(F.col("rank") < max(at)), relevant).where("ok").groupBy("q_id").agg(F.min("rank").alias("best"))
    every = asked.select("q_id").distinct().join(first, "q_id", "left")
    shares = [F.round(F.avg(F.coalesce(F.col("best") < n, F.lit(False)).cast("double")), digits).alias(f"r{n}") for n in at]
    return every.agg(*shares, F.round(F.avg(F.coalesce(1.0 / (F.col("best") + 1), F.lit(0.0))), digits).alias("mrr"))


def embedder_benchmark(runs: dict[tuple[str, str], DataFrame], relevant: DataFrame, asked: DataFrame) -> DataFrame:
    """(model, query, r1, r5, r10, mrr) of each ranking by model and kind of query."""
    return reduce(DataFrame.union, (recall_at(r, relevant, asked).select(F.lit(m).alias("model"), F.lit(q).alias("query"), "*") for (m, q), r in runs.items()))


def rerank_ablation(short: DataFrame, relevant: DataFrame, rescored: dict[str, Column], digits: int = 6) -> DataFrame:
    """(step, n, r1): share of queries whose best row of ``short(q_id, doc_id, score, …)`` is right, as it stands and by each other score."""
    rows = []
    for name, score in {"bi-encoder": F.col("score"), **rescored}.items():
        best = retrieval.top(short.withColumn("_s", F.round(score, digits)).drop("score", "rank").withColumnRenamed("_s", "score"), 1)
        rows.append(judged(best, relevant).agg(F.lit(name).alias("step"), F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), digits).alias("r1")))
    return reduce(DataFrame.union, rows)


def resolver_report(predictions: dict[str, DataFrame], gold: DataFrame, digits: int = 6) -> DataFrame:
    """(resolver, n, accuracy, precision, recall, abstained, wrong) of each resolver's ``(name, key)`` against ``gold(name, key)``."""
    return reduce(DataFrame.union, (stats.prediction_scores(p, gold).select(F.lit(name).alias("resolver"), "n", *(F.round(F.coalesce(c, F.lit(0.0)), digits).alias(c) for c in ("accuracy", "precision", "recall")), "abstained", "wrong") for name, p in predictions.items()))


def disagreements(a: DataFrame, b: DataFrame, gold: DataFrame, most: int = 12) -> DataFrame:
    """(ord, name, key_a, key_b, truth): the first ``most`` names, by ``gold.ord``, to which two resolvers give different keys."""
    j = gold.select("ord", "name", F.col("key").alias("truth")).join(a.select("name", F.col("key").alias("key_a")), "name", "left").join(b.select("name", F.col("key").alias("key_b")), "name", "left")
    return j.where(~F.col("key_a").eqNullSafe(F.col("key_b"))).orderBy("ord").limit(most).select("ord", "name", "key_a", "key_b", "truth")


def novel_ablation(predictions: dict[str, DataFrame], novel: DataFrame) -> DataFrame:
    """(ord, name, expected, resolver, key, ok) of names that no alias covers; no key is right where none is expected."""
    rows = (novel.select("ord", "name", F.col("key").alias("expected")).join(p.select("name", "key"), "name", "left").select("ord", "name", "expected", F.lit(n).alias("resolver"), "key", F.col("key").eqNullSafe(F.col("expected")).alias("ok")) for n, p in predictions.items())
    return reduce(DataFrame.union, rows)
