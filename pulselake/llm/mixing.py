"""Soft-membership mixing with DataFrame functions only.

A naive Bayes classifier learnt from a labelled table gives every document a posterior over domains; projected
gradient least squares fits a nonnegative rate for every document, so that the expected tokens of each
domain (rate times tokens times posterior) meet the targets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, text_key, tidy

#: Space and 0x09-0x0D separate words.
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text) -> F.Column:
    """Words of a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _bag(picked: DataFrame) -> DataFrame:
    """(id, y, w): one row for each lower-case word of each text."""
    words = F.explode(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x20\x09-\x0D]+"))
    return picked.select("id", "y", words.alias("w")).where("w <> ''")


def fit_domains(docs: DataFrame, labels: DataFrame, domain: F.Column, id_col: str = "doc_id", text_col: str = "text", most: int = 4_000, most_words: int = 2_000) -> tuple[list[str], DataFrame, dict[str, float]]:
    """Names of the domains, (w, ll array) log-likelihood terms and log priors.

    The classifier is fit on the ``most`` labelled documents with the smallest id hashes; the ``most_words``
    words whose likelihoods differ most between domains make its vocabulary. Both bounds are parameters; the
    vocabulary (most_words rows) is what later joins broadcast. Null ids and domains, and labels without a document, have no part; of an id's
    domains the least in order counts, of its texts each; ties go by id and word; without labels or documents there are no names.
    """
    y = labels.select(F.col(id_col).alias("id"), domain.alias("y")).where("id is not null and y is not null")
    y = y.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    picked = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(y), "id"), "labelled")
    bag = _bag(picked).distinct()
    n = {r.y: r.n for r in picked.groupBy("y").agg(F.countDistinct("id").alias("n")).collect() }
    bag = bag.where(F.col("y").isin(*n)) if n else bag.limit(0)
    names = sorted(n)
    if not names:
        return [], bag.select("w", F.array().cast("array<double>").alias("ll")).limit(0), {}
    k = len(names)
    counts = bag.groupBy("w").agg(*(F.sum(F.when(F.col("y") == name, 1).otherwise(0)).alias(f"n{i}") for i, name in enumerate(names)))
    seen = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0"))
    rate = seen / F.lit(float(sum(n.values())))
    terms = [F.log((F.col(f"n{i}") + 5.0 * rate) / F.lit(n[name] + 5.0)) for i, name in enumerate(names)]
    mean = sum(terms[1:], terms[0]) / k
    gap = F.greatest(*terms) - F.least(*terms) if k > 1 else F.lit(0.0)
    vocabulary = counts.where(seen >= 5).select("w", F.array(*(t - mean for t in terms)).alias("ll"), (gap * F.sqrt(seen)).alias("gap"))
    vocabulary = cut(vocabulary.orderBy(F.desc("gap"), "w").limit(most_words).select("w", "ll"), "vocabulary")
    return names, vocabulary, {name: math.log(n[name] / sum(n.values())) for name in names}


def posteriors(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", damp: float = 0.5) -> DataFrame:
    """(id, text_key, tokens, posterior) for every row of ``docs``; the array is in the order of the model's names.

    A word counts once per document; a null or empty text has the prior; repeated rows and ids have a row each; an empty table gives an empty one. The log-likelihood is damped by ``damp``, which makes up for the
    dependence of words. One scan: a marker word keeps documents without any word of the vocabulary.
    """
    names, vocabulary, prior = model
    k = len(names)
    terms = vocabulary.select("w", *(F.col("ll")[i].alias(f"l{i}") for i in range(k)))
    terms = terms.union(docs.sparkSession.range(1).select(F.lit("\x00").alias("w"), *[F.lit(0.0)] * k))
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+")
    # everything that reads the text stands before explode: what is left in the row is copied with every word
    short = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), text_key(F.col(text_col)).alias("text_key"), token_count(F.col(text_col)).alias("tokens"), F.concat(F.array(F.lit("\x00")), F.array_distinct(words)).alias("ws"))
    bag = short.select("_row", id_col, "text_key", "tokens", F.explode("ws").alias("w")).join(F.broadcast(terms), "w")
    scores = bag.groupBy("_row", id_col, "text_key", "tokens").agg(*(F.sum(f"l{i}").alias(f"s{i}") for i in range(k)))
    raw = [F.col(f"s{i}") * damp + F.lit(prior[name]) for i, name in enumerate(names)]
    top = F.greatest(*raw) if k > 1 else raw[0]
    soft = [F.exp(x - top) for x in raw]
    total = sum(soft[1:], soft[0])
    return scores.select(id_col, "text_key", "tokens", F.array(*(x / total for x in soft)).alias("posterior"))


def fit_rates(docs: DataFrame, targets: list[float], rounds: int = 40, tolerance: float = 1e-4) -> tuple[F.Column, dict]:
    """A column expression for the rate of a row (``tokens``, ``posterior``) of ``docs``, and what it reached.

    Minimises the squared distance of the domains' expected tokens from ``targets`` (token totals) in the norm that the Gram matrix of
    the documents' contributions whitens; from rate 1 for every row, each round takes a full gradient
    step (its Lipschitz constant is 1 in that norm) and projects onto rates of 0 or more. A round
    is one aggregation to as many sums as there are domains. Rows without tokens keep rate 1; a table without rows reaches 0.
    """
    k = len(targets)
    scale = float(docs.agg(F.max("tokens")).first()[0] or 1)
    part = [f"tokens / {scale!r}D * posterior[{i}]" for i in range(k)]
    t = [x / scale for x in targets]
    sums = docs.agg(*(F.coalesce(F.sum(F.expr(f"{part[i]} * {part[j]}")), F.lit(0.0)) for i in range(k) for j in range(k))).first()
    gram = [[sums[i * k + j] + (1e-9 * (sums[0] + 1) if i == j else 0.0) for j in range(k)] for i in range(k)]
    steps: list[list[float]] = []
    reached, before = [0.0] * k, None
    for _ in range(rounds + 1):
        row = docs.agg(*(F.coalesce(F.sum(_rate(steps, part) * F.expr(p)), F.lit(0.0)) for p in part)).first()
        reached = list(row)
        gap = [x - y for x, y in zip(reached, t)]
        size = max(abs(g) for g in gap)
        # met, or settled at the nearest that nonnegative rates allow
        if size <= tolerance * max(1e-12, max(t)) or (before is not None and abs(before - size) <= 0.01 * tolerance * max(t)) or len(steps) == rounds:
            break
        before = size
        steps.append(_solved(gram, gap))
    return _rate(steps, part), {"reached": [x * scale for x in reached], "rounds": len(steps)}


def _rate(steps: list[list[float]], part: list[str]) -> F.Column:
    """Rates after these steps from 1. The steps stand in one array literal, so each round runs the same compiled code."""
    if not steps:
        return F.lit(1.0)
    rows = ", ".join("array(" + ", ".join(f"{x!r}D" for x in s) + ")" for s in steps)
    moved = " + ".join(f"s[{i}] * ({p})" for i, p in enumerate(part))
    return F.expr(f"aggregate(array({rows}), 1.0D, (acc, s) -> greatest(0.0D, acc - ({moved})))")


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with row exchange for the small dense system a x = b."""
    m = [[*row, y] for row, y in zip(a, b)]
    n = len(m)
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(n):
            if r != i and m[i][i]:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    return [m[i][n] / m[i][i] if m[i][i] else 0.0 for i in range(n)]


@tidy
def mix(docs: DataFrame, labels: DataFrame, domain: F.Column, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = 40) -> DataFrame:
    """(id, text_key, tokens, domains, posterior, rate, targets, reached, repeats) for every row of ``docs``; targets and reached are the domains' token totals, the same in every row.

    ``domain`` is an expression over ``labels`` that names a labelled row's domain. ``weights`` (share of all tokens
    by domain; missing: 0, scaled to 1; if no domain has one, the corpus stays as it is) default to equal parts of the corpus's own expected share and the uniform one. ``repeats`` is the rate
    rounded to a whole number of copies by a fixed pseudo-random draw on the id, so its expectation is the rate.
    Null texts have no tokens and rate 1; without labels there is one domain and every rate is 1; null ids and
    repeated rows get rows of their own; an empty table gives an empty one; other columns are ignored.
    """
    docs = docs.select(id_col, text_col)
    model = fit_domains(docs, labels, domain, id_col, text_col)
    names = model[0]
    if names:
        known = cut(posteriors(docs, model, id_col, text_col), "posteriors")
    else:
        names = ["all"]
        known = cut(docs.select(id_col, text_key(F.col(text_col)).alias("text_key"), token_count(F.col(text_col)).alias("tokens"), F.array(F.lit(1.0)).alias("posterior")), "posteriors")
    own = known.agg(*(F.coalesce(F.sum(F.col("tokens") * F.col("posterior")[i]), F.lit(0.0)) for i in range(len(names)))).first()
    total = sum(own)
    share = [max(0.0, (weights or {}).get(n, 0.0)) for n in names]
    if sum(share):
        targets = [total * s / sum(share) for s in share]
    elif weights:  # none of the domains that the labels know has a weight
        targets = own
    else:
        targets = [0.5 * o + 0.5 * total / len(names) for o in own]
    rate, met = fit_rates(known, targets, rounds)
    numbers = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    out = known.select(id_col, "text_key", "tokens", F.array(*map(F.lit, names)).alias("domains"), "posterior", rate.alias("rate"), numbers(targets).alias("targets"), numbers(met["reached"]).alias("reached"))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return out.withColumn("repeats", F.floor(F.col("rate") + draw).cast("int"))


def label_domain() -> F.Column:
    """Domain of a row of a labels table: its quality and toxicity marks."""
    return F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string"))


#: Shares of tokens that a cleaned corpus aims at, by the domains of ``label_domain``.
CLEAN_WEIGHTS = {"quality1_toxic0": 0.95, "quality0_toxic0": 0.05}


def quality_domain() -> F.Column:
    """Domain of a row of a labels table where toxic documents are gone already: its quality mark."""
    return F.concat(F.lit("quality"), F.col("quality").cast("string"))


#: The same shares by the domains of ``quality_domain``.
QUALITY_WEIGHTS = {"quality1": 0.95, "quality0": 0.05}


def apply_rates(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as ``repeats`` of its id and text in ``mixed`` say; its columns stay as they are.

    Null ids match null ids and null texts null texts; rows that repeat an id and text are repeated each, by the least count that ``mixed`` has for them; a row that
    ``mixed`` lacks goes; an empty table gives an empty one.
    """
    times = mixed.groupBy(F.col(id_col).alias("__id"), F.col("text_key").alias("__key")).agg(F.min("repeats").alias("__times"))
    out = docs.join(times, docs[id_col].eqNullSafe(times["__id"]) & (text_key(docs[text_col]) == times["__key"]))
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times")))).select(*docs.columns)
