"""Toxicity by a weighted lexicon: folding, Aho-Corasick matching, exception phrases, length normalisation.

The lexicon's weights, its exception phrases and the calibration are learnt from labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, tidy

#: Letters of other scripts that look like Latin ones, and digits or signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ѡ": "w", "ё": "e", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ı": "i", "ł": "l"}
_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES)
_MARKS = re.compile(r"[̀-ͯ­​-‏⁠﻿]+")
_OTHER = re.compile(r"[^a-z]+")
#: Lengths of the word stems that may enter the lexicon beside whole words.
STEMS = range(4, 9)


def folded(text: str | None) -> str:
    """Lower-case a-z words between single spaces, with one space at either end; null and empty give one space."""
    s = (text or "").lower()
    if not s.isascii():
        s = _MARKS.sub("", unicodedata.normalize("NFKD", s))
    return " " + _OTHER.sub(" ", s.translate(_FOLD)).strip() + " " if s else " "


@dataclass
class ToxicityModel:
    """weights: by pattern, " stem" or " word "; exceptions: phrases " w1 w2 " in which matches don't count."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    offset: float = -30.0
    smooth_words: int = 30

    def matcher(self):
        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (p, w))
        for p in self.exceptions:
            a.add_word(p, (p, None))
        if len(a):
            a.make_automaton()
        return a


def hits_of(s: str, matcher) -> list[tuple[int, str, float]]:
    """(start, pattern, weight) of the lexicon matches of a folded text outside of exception phrases."""
    if not len(matcher):
        return []
    found, spared = {}, []
    for end, (p, w) in matcher.iter(s):
        at = end - len(p) + 1
        if w is None:
            while spared and spared[-1][0] >= at:  # ends come in order, so what overlaps stands last
                spared.pop()
            spared.append((max(at, spared[-1][1]) if spared else at, end))
        elif at not in found or w > found[at][1]:
            found[at] = (p, w)
    out, i = [], 0
    for at, (p, w) in sorted(found.items()):
        while i < len(spared) and spared[i][1] <= at:
            i += 1
        if i == len(spared) or at < spared[i][0]:
            out.append((at, p, w))
    return out


def density(s: str, matcher, smooth: int) -> tuple[float, int]:
    """Weight of the matches to a hundred words, and the number of matches."""
    got = hits_of(s, matcher)
    return 100 * sum(w for _, _, w in got) / (s.count(" ") - 1 + smooth), len(got)


def _features(s: str) -> set[str]:
    out = set()
    for w in set(s.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in STEMS if len(w) >= k)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """(s, y): the folded texts of at most ``most`` labelled documents, those with the smallest hashes of their ids.

    Equal folded texts count once, with the largest of their labels; of more than ``most`` texts, as repeated ids can make, those with the smallest
    hashes stay. Which rows these are depends on the tables alone, not on their partitions. Ids whose crc32 (as text) is divisible by 5, null ids, labels and texts have no part.
    """
    held_in = F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0
    ids = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & held_in)
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([pa.array([folded(t) for t in part.column(0).to_pylist()], pa.string()), part.column(1)], ["s", "y"])

    every = cut(texts.join(F.broadcast(ids), "id").select("text", "y").mapInArrow(fold, "s string, y int").withColumn("h", F.unhex(F.md5(F.col("s").cast("binary")))), "folded")
    first = cut(every.groupBy("h").agg(F.max("y").alias("y")).orderBy("h").limit(most), "sample")
    return every.join(F.broadcast(first.withColumnRenamed("y", "most_y")), "h").groupBy("h").agg(F.min("s").alias("s"), F.max("most_y").alias("y")).select("s", "y")


@tidy
def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = 16_000, least_docs: int = 3, least_odds: float = 3.0) -> ToxicityModel:
    """Learn the lexicon from at most ``most`` labelled documents (the bounded sample, about 50 MB of text, stays on the executors); see ``labelled_sample`` for nulls, ties and repeats.

    Pattern counts are summed on the executors; the patterns of at least ``least_docs`` toxic documents and ``least_odds`` log odds
    reach the driver, and one pair of numbers for each document of the sample for the calibration. No labels, or none toxic, and empty tables: every score is near 0.
    """
    sample = cut(labelled_sample(docs, labels, label, id_col, text_col, most), "texts")
    total = sample.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    n_toxic, n_clean = total[0], total[1]
    if not n_toxic:
        return ToxicityModel()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in batches:
            for s, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if y > 0 else clean).update(_features(s))
        keys = list(toxic | clean)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[p] for p in part], pa.int64()), pa.array([clean[p] for p in part], pa.int64())], ["p", "t", "c"])

    counts = sample.select("s", "y").mapInArrow(count, "p string, t long, c long").groupBy("p").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    rows = counts.where(F.col("t") >= least_docs).select("p", "t", odds.alias("odds")).where(F.col("odds") >= least_odds).orderBy("p").collect()
    model = ToxicityModel(_general_patterns({r.p: (r.t, r.odds) for r in rows}))
    return _calibrated(model, sample)


def _general_patterns(odds: dict[str, tuple[int, float]]) -> dict[str, float]:
    """The longest pattern that keeps nine tenths of a stem's documents stands for it; what a kept stem covers goes."""
    best: dict[str, int] = Counter()
    for q, (t, _) in odds.items():
        for k in range(2, len(q)):
            best[q[:k]] = max(best[q[:k]], t)
    kept: dict[str, float] = {}
    for p in sorted(odds, key=lambda p: (len(p), p)):
        t, w = odds[p]
        if best.get(p, 0) < 0.9 * t and not any(p[:k] in kept for k in range(2, len(p))):
            kept[p] = w
    return kept


def _calibrated(model: ToxicityModel, sample: DataFrame) -> ToxicityModel:
    """Exception phrases (a match with its next word or the one before, seen in clean documents only) and the logistic curve."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        toxic, clean = Counter(), Counter()
        for b in batches:
            for s, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = set()
                for at, _, _ in hits_of(s, m):
                    end = s.index(" ", at + 1)
                    if (nxt := s.find(" ", end + 1)) > 0:
                        got.add(s[at : nxt + 1])
                    if (prev := s.rfind(" ", 0, at)) >= 0:
                        got.add(s[prev : end + 1])
                (toxic if y > 0 else clean).update(got)
        keys = list(toxic | clean)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[p] for p in keys], pa.int64()), pa.array([clean[p] for p in keys], pa.int64())], ["p", "t", "c"])

    seen = sample.select("s", "y").mapInArrow(phrases, "p string, t long, c long").groupBy("p").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    spared = seen.where("c >= 3 and t = 0").orderBy("p").collect()
    model.exceptions = tuple(r.p for r in spared)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for b in batches:
            x = [density(s, m, model.smooth_words)[0] for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(1)], ["x", "y"])

    points = sorted((p.x, float(p.y > 0)) for p in sample.select("s", "y").mapInArrow(measure, "x double, y int").collect())
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    if not len(x) or y.min() == y.max():
        return model
    scale = max(float(np.median(x[y > 0])), 1e-6)
    beta = np.zeros(2)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        ridge = np.array([0.02, 0.0])
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-6), design.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    model.slope, model.offset = float(beta[0] / scale), float(beta[1])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_hits, matches) for every row of ``docs``; the whole text is matched.

    ``score`` is the calibrated probability from the weight of the matches to a hundred words; null and empty
    texts have no match and take the lowest score. Repeated rows and null ids pass through; other
    columns are ignored; row by row, without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                score, n, words = [], [], []
                for t in part.column(1).to_pylist():
                    s = folded(t)
                    got = hits_of(s, m)
                    x = 100 * sum(w for _, _, w in got) / (s.count(" ") - 1 + model.smooth_words)
                    score.append(float(1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))))
                    n.append(len(got))
                    words.append(sorted({p.strip() for _, p, _ in got}))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.string()))], [id_col, "score", "n_hits", "matches"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double, n_hits long, matches array<string>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose whole text scores below ``threshold``; see ``score_toxicity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                x = np.array([density(folded(t), m, model.smooth_words)[0] for t in part.column(text_col).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
                yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
