"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import LIGHT_BYTES, cut, light_bytes, tidy
from ._text import case_folded, mix, pieces, span_hashes, word_spans

_COEF = mix(np.arange(7001, 7001 + 64, dtype=np.uint64)) | np.uint64(1)


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from every position on, len(words) - k + 1 of them."""
    acc = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        acc += words[j : j + len(acc)] * _COEF[j]
    return mix(acc)


def greedy_tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length) of greedy string tiling by running Karp-Rabin.

    Repeatedly the longest matches of unmarked tokens are marked, none shorter than ``least``; ties go by
    position in the item, then in the text. Tiles overlap in neither sequence.
    """
    mod, base = (1 << 61) - 1, 1_000_003
    marked_i, marked_t = bytearray(len(item)), bytearray(len(text))
    tiles: list[tuple[int, int, int]] = []

    def rolling(seq: list[int], marked: bytearray, s: int) -> Iterator[tuple[int, int]]:
        top = pow(base, s, mod)
        h = run = 0
        for i, x in enumerate(seq):
            if marked[i]:
                h = run = 0
                continue
            h = (h * base + x) % mod
            run += 1
            if run > s:
                h = (h - seq[i - s] * top) % mod
            if run >= s:
                yield i - s + 1, h

    s = max(least, min(len(item), len(text), 32))
    while True:
        table: dict[int, list[int]] = {}
        for j, h in rolling(text, marked_t, s):
            table.setdefault(h, []).append(j)
        found, longest = [], 0
        for i, h in rolling(item, marked_i, s):
            for j in table.get(h, ()):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not marked_i[i + n] and not marked_t[j + n]:
                    n += 1
                if n >= s:
                    found.append((n, i, j))
                    longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for n, i, j in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            if not any(marked_i[i : i + n]) and not any(marked_t[j : j + n]):
                marked_i[i : i + n] = marked_t[j : j + n] = b"\x01" * n
                tiles.append((i, j, n))
            else:
                again = True  # what a longer tile left of it may still match at this length
        if again and found and tiles and any(f[0] >= s for f in found) and _left(item, text, marked_i, marked_t, s):
            continue
        if s == least:
            return tiles
        s = max(least, s // 2)


def _left(item: list[int], text: list[int], marked_i: bytearray, marked_t: bytearray, s: int) -> bool:
    """Whether an unmarked match of length s remains."""
    have = {tuple(text[j : j + s]) for j in range(len(text) - s + 1) if not any(marked_t[j : j + s])}
    return any(tuple(item[i : i + s]) in have for i in range(len(item) - s + 1) if not any(marked_i[i : i + s]))


def _words_of(column: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """Word hashes of a text column, their k-word seeds, the n + 1 offsets of the texts' words."""
    buf, off = case_folded(column)
    starts, ends, row = word_spans(buf, off)
    words = span_hashes(buf, starts, ends)
    return words, _windows(words, k), np.searchsorted(row, np.arange(len(column) + 1))


def benchmark_items(benchmark: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, words, seeds) of every different row (id, text) of the benchmark with ``least`` words or more; the arrays hold hashes."""
    kind = benchmark.schema[id_col].dataType.simpleString()
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in pieces(batches, "text"):
                words, grams, first = _words_of(b.column("text"), least)
                spans = [(a, e) for a, e in zip(first, first[1:])]
                ok = np.array([e - a >= least for a, e in spans], bool)
                cols = [[words[a:e].view(np.int64) for a, e in spans if e - a >= least], [grams[a : e - least + 1].view(np.int64) for a, e in spans if e - a >= least]]
                yield pa.RecordBatch.from_arrays([b.column("item_id").filter(pa.array(ok)), *(pa.array(c, pa.list_(pa.int64())) for c in cols)], ["item_id", "words", "seeds"])

    return rows.mapInArrow(run, f"item_id {kind}, words array<long>, seeds array<long>").withColumn("item", F.monotonically_increasing_id())


def seed_filter(items: DataFrame, most_bits: int) -> np.ndarray:
    """Bitmap in which the top bits of every seed's hash are set: 64 bits for a seed, rounded up to a power of two, ``most_bits`` at most."""
    seeds = items.select(F.explode("seeds").alias("g"))
    n = seeds.count()
    bits = min(most_bits, max(1 << 16, 1 << (64 * n).bit_length()))
    place = f"shiftrightunsigned(g, {64 - (bits.bit_length() - 1)})"
    rows = seeds.groupBy(F.expr(f"cast(shiftright({place}, 6) as int)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({place}, 64) as int)))").alias("set")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("set").to_numpy().view(np.uint64)
    return out


def seeded_texts(docs: DataFrame, text_col: str, bitmap, k: int) -> DataFrame:
    """(key, seeds, words) of the texts with seeds that pass the bitmap: the seeds, and the words of the stretches that hold them, apart from each other by a negative number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        shift = np.uint64(64 - (len(bits).bit_length() + 5))
        with np.errstate(over="ignore"):
            for b in pieces(batches, text_col):
                words, grams, first = _words_of(b.column(text_col), k)
                place = grams >> shift
                maybe = np.flatnonzero((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                row = np.searchsorted(first, maybe, "right") - 1
                fits = maybe + k <= first[1:][row]
                maybe, row = maybe[fits], row[fits]
                out: list[tuple] = []
                for r in np.unique(row):
                    hit = maybe[row == r]
                    edge = np.flatnonzero(np.diff(hit) > k) + 1
                    parts: list[np.ndarray] = []
                    for h in np.split(hit, edge):
                        parts += [(words[h[0] : h[-1] + k] >> np.uint64(1)).view(np.int64), np.array([-1 - len(parts)])]
                    out.append((r, np.unique(grams[hit]).view(np.int64), np.concatenate(parts)))
                rows, seeds, kept = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), pa.array(seeds, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int64()))], ["key", "seeds", "words"])

    found = docs.select(F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("key"), text_col).where(F.col(text_col).isNotNull())
    return found.mapInArrow(run, "key binary, seeds array<long>, words array<long>").dropDuplicates(["key"])


@tidy
def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out_col: str = "leaks", most_bits: int = 1 << 27) -> DataFrame:
    """``docs`` with ``out_col``: the benchmark items that the whole text leaks, by item id (of the benchmark's own type).

    Case-folded words between ASCII spaces are compared, in normal form NFKC. Texts and items meet by join on their shared seeds of
    ``least`` words; greedy string tiling marks the longest matches first, so passages that were cut up and reordered
    still count; an item leaks if tiles of ``least`` words or more cover ``share`` of its words. Items of fewer than
    ``least`` words can't be told from chance and never leak. Equal texts are tiled once. The tasks get a bitmap of the seeds of ``most_bits``
    at most, which lets chance seeds pass where the benchmark is large; the join drops those. Null and empty texts have no
    leaks; repeated rows, repeated item ids and null ids pass through; an ``out_col`` that ``docs`` has already is replaced.
    """
    kind = benchmark.schema[item_col].dataType
    leak = T.StructType([T.StructField("item_id", kind), *(T.StructField(c, t) for c, t in (("covered", T.LongType()), ("words", T.LongType()), ("coverage", T.DoubleType()), ("tiles", T.LongType())))])
    docs = docs.drop(out_col)
    items = cut(benchmark_items(benchmark, least, item_col, item_text), "items")
    bitmap = docs.sparkSession.sparkContext.broadcast(seed_filter(items, most_bits))
    texts = cut(seeded_texts(docs, text_col, bitmap, least), "seeded")
    seeds = items.select("item", F.explode("seeds").alias("g")).groupBy("item", "g").agg(F.count("*").alias("c"))
    # tiles of `least` words, the shortest, have one seed each
    needed = items.select("item", F.ceil(F.size("words") * share / least).alias("needed"))
    pairs = texts.select("key", F.explode("seeds").alias("g")).join(seeds, "g").groupBy("key", "item").agg(F.sum("c").alias("c"))
    pairs = pairs.join(needed, "item").where("c >= needed").select("key", "item")
    both = pairs.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item").join(texts.select("key", "words"), "key")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows, out = [], []
                for r, (item, text) in enumerate(zip(part.column("item_words").to_pylist(), part.column("words").to_pylist())):
                    tiles = greedy_tiles([(x & 0xFFFFFFFFFFFFFFFF) >> 1 for x in item], text, least)
                    n = sum(t[2] for t in tiles)
                    if n >= share * len(item):
                        rows.append(r)
                        out.append((n, len(item), n / len(item), len(tiles)))
                cols = list(zip(*out)) or [[]] * 4
                kept = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column("key"), kept.column("item_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64())))], ["key", *leak.names])

    tiled = both.select("key", "item_id", "item_words", "words").mapInArrow(tile, T.StructType([T.StructField("key", T.BinaryType()), *leak.fields]))
    found = cut(tiled.groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_list(F.struct(*leak.names))).alias("__found")), "leaks")
    sized = found.select("__key", F.to_json("__found").alias("t"))
    if light_bytes(sized) <= LIGHT_BYTES:
        found = F.broadcast(found)
    out = docs.join(found, F.unhex(F.md5(docs[text_col].cast("binary"))) == F.col("__key"), "left")
    return out.select(*(docs[c] for c in docs.columns), F.coalesce("__found", F.array().cast(T.ArrayType(leak))).alias(out_col))
