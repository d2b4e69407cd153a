"""Passages of many words that several documents hold word for word, wherever they begin: winnowed anchors, a bitmap of the shared ones, whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, tidy
from ._text import _power_tables, bytes_of, lowered, mix, pieces, span_hashes, word_spans
from .decontam import seed_filter

#: Words of an anchor.
GRAM = 8
#: Windows that a task compares at once; all of one anchor always are.
GATHER = 1 << 20


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k values in a row."""
    p, inv = _power_tables(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * p[: len(words)])])
    return mix((total[k:] - total[:-k]) * inv[: len(words) - k + 1] + np.uint64(k))


def least_within(values: np.ndarray, k: int) -> np.ndarray:
    """The least of every k values in a row."""
    wide = 1
    while 2 * wide <= k:
        values = np.minimum(values[:-wide], values[wide:])
        wide *= 2
    return np.minimum(values[: len(values) - (k - wide)], values[k - wide :])


def anchored(column: pa.Array, words: int) -> tuple[np.ndarray, ...]:
    """Of every window of ``words`` words of one text: (row, place among the text's words, hash, place of its anchor, the anchor's hash).

    The anchor is the gram of least hash, of equal ones the first, so equal windows have equal anchors at the same place.
    """
    buf, off = bytes_of(column)
    buf = lowered(buf)
    starts, ends, rows = word_spans(buf, off)
    none = np.zeros(0, np.int64)
    if len(starts) < words:
        return none, none, none.view(np.uint64), none, none.view(np.uint64)
    h = span_hashes(buf, starts, ends)
    grams = run_hashes(h, GRAM)
    low = least_within((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), words - GRAM + 1)
    at = np.flatnonzero(rows[: len(low)] == rows[words - 1 :])
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = rows[at]
    first = np.searchsorted(rows, row)
    return row, at - first, run_hashes(h, words)[at], anchor - first, grams[anchor]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _common(t: pa.Table, words: int) -> pa.RecordBatch:
    """(id, txt, start, end): runs of windows in ``t(g, id, txt, doc, first, back, windows)`` that rows of another ``doc`` have too; ``first``: all places of such windows in the text."""
    blobs = t.column("windows").to_pylist()
    n = np.array([len(b) // 8 for b in blobs], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    g, doc, back = (t.column(c).to_numpy() for c in ("g", "doc", "back"))
    key = mix(np.frombuffer(b"".join(blobs), np.uint64) + g.view(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15) + (back[row] - nth).astype(np.uint64))
    order = np.argsort(key, kind="stable")
    edge = _edges(key[order])
    d = doc[row][order]
    several = np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)
    hit = np.zeros(len(row), bool)
    hit[order] = np.repeat(several, np.diff(np.append(edge, len(row))))
    places = t.column("first").combine_chunks()
    off, flat = places.offsets.to_numpy(), places.values.to_numpy()
    count = np.diff(off)
    r, which = row[hit], nth[hit]
    each = np.repeat(np.arange(len(r)), count[r])
    nth_place = np.arange(len(each)) - np.repeat(np.cumsum(count[r]) - count[r], count[r])
    r, at = r[each], flat[off[r[each]] + nth_place].astype(np.int64) + which[each]
    order = np.lexsort((at, r))
    r, at = r[order], at[order]
    begin = _edges(r, at - np.arange(len(at)))
    last = np.append(begin[1:], len(at))[: len(begin)] - 1
    who = pa.array(r[begin])
    return pa.RecordBatch.from_arrays([t.column(c).take(who).combine_chunks() for c in ("id", "txt")] + [pa.array(at[begin].astype(np.int32)), pa.array((at[last] + words).astype(np.int32))], ["id", "txt", "start", "end"])


@tidy
def shared_passages(docs: DataFrame, words: int = 51, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 27) -> DataFrame:
    """(id, txt, n_passages, n_words) of every text with passages of ``words`` words or more that a document of another id holds too, A-Z lower-cased.

    ``txt`` is xxhash64 of the text; n_passages counts maximal runs of such words, n_words the words in them. Any such passage is found: each of its windows of ``words`` words
    has its anchor, the least of its grams, in both texts, and windows of equal anchors are compared by 64 bits beside the anchor's. Anchors that only one document
    has do not leave the second scan but for chance hits in the bitmap (``most_bits``), which the windows drop. Nulls, empty and short texts have no rows; rows that repeat an id are one document.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("txt"), F.xxhash64(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in pieces(batches, "text"):
                row, _, _, place, g = anchored(b.column("text"), words)
                at = _edges(row, place)
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), b.column("doc").take(pa.array(row[at]))], ["g", "doc"])

    found = source.select("doc", "text").mapInArrow(anchors, "g long, doc long")
    shared = cut(found.groupBy("g").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x <> y").select("g"), "anchors")
    bitmap = docs.sparkSession.sparkContext.broadcast(seed_filter(shared.select(F.array("g").alias("seeds")), most_bits))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        shift = np.uint64(64 - (len(bits).bit_length() + 5))
        with np.errstate(over="ignore"):
            for b in pieces(batches, "text"):
                row, start, h, place, g = anchored(b.column("text"), words)
                at = _edges(row, place)
                end = np.append(at[1:], len(row))[: len(at)]
                spot = g[at] >> shift
                ok = ((bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)).astype(bool)
                at, end = at[ok], end[ok]
                begin, back, of, key = start[at].tolist(), (place - start)[at].tolist(), row[at].tolist(), g[at].view(np.int64).tolist()
                same: dict[tuple, list[int]] = {}  # what a text repeats leaves it once
                for i, (x, y) in enumerate(zip(at.tolist(), end.tolist())):
                    same.setdefault((of[i], key[i], back[i], h[x:y].tobytes()), []).append(begin[i])
                who = pa.array([k[0] for k in same], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[1] for k in same], pa.int64()), *(b.column(c).take(who) for c in ("id", "txt", "doc")), pa.array(list(same.values()), pa.list_(pa.int32())), pa.array([k[2] for k in same], pa.int32()), pa.array([k[3] for k in same], pa.binary())],
                    ["g", "id", "txt", "doc", "first", "back", "windows"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        with np.errstate(over="ignore"):
            for b in batches:
                if not b.num_rows:
                    continue
                held.append(b)
                size += b.column("windows").nbytes // 8
                if size >= GATHER:
                    t = pa.Table.from_batches(held)
                    whole = int(np.searchsorted(t.column("g").to_numpy(), t.column("g")[-1].as_py()))
                    if whole:
                        yield _common(t.slice(0, whole), words)
                        held = t.slice(whole).to_batches()
                        size = sum(x.num_rows for x in held) * words // 2
            if held:
                yield _common(pa.Table.from_batches(held), words)

    spread = source.mapInArrow(windows, f"g long, id {kind}, txt long, doc long, first array<int>, back int, windows binary")
    runs = spread.repartition("g").sortWithinPartitions("g").mapInArrow(compare, f"id {kind}, txt long, start int, end int")
    each = runs.groupBy("id", "txt").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("words"))
    total = F.aggregate("runs", zero, lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.when(x["start"] > acc["end"], 1).otherwise(0)).alias("n"),
        (acc["words"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))).alias("words")))
    out = each.select("id", "txt", total.alias("t")).select(F.col("id").alias(id_col), "txt", F.col("t.n").alias("n_passages"), F.col("t.words").alias("n_words"))
    return cut(out, "passages")
