"""Exact removal of repeated byte strings by a sparse suffix sort with bucket-pointer refinement.

Every 200-byte window has one anchor, the 50-byte gram with the least hash in it, so equal windows have equal
anchors. Only windows whose anchor occurs elsewhere are looked at. Stretches with one anchor that are equal as a
whole are settled by their hashes; the bytes of the others meet by anchor, where buckets of 25-byte grams are refined by the buckets
of later offsets to depth 50, 100 and 200.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, tidy
from ._text import _power_tables, bytes_of, mix, pieces

#: Bytes of the anchor gram.
GRAM = 50
#: An anchor with more different stretches than this, which would not fit into one sort, is settled by counting its windows' hashes instead of in one batch.
CROWDED = 4096
_SALT = np.uint64(0xA5A5A5A55A5A5A5A)


class Hasher:
    """Hashes of any spans of one buffer."""

    def __init__(self, buf: np.ndarray, second: bool = False):
        p, self.inv = _power_tables(len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, np.uint64)
        code = mix(buf.astype(np.uint64) + (_SALT if second else np.uint64(3)))
        np.cumsum(code * p[: len(buf)], out=self.total[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inv[start])


def stretches(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, first window start in buf, windows, anchor's place behind it, anchor hash, hash of the stretch)."""
    n = len(buf)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sizes = np.diff(off)
    if n < length or not (sizes >= length).any():
        return empty
    w = length - GRAM + 1
    hasher = Hasher(buf)
    at = np.arange(n - GRAM + 1)
    grams = hasher.spans(at, at + GRAM)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    blocks = -(-len(keys) // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - length + 1], before[w - 1 : n - length + w])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)[: n - length + 1]
    ok = np.arange(n - length + 1) + length <= off[1:][row]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return empty
    anchor, row = anchor[starts], row[starts]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    lo = starts[first]
    a = anchor[first]
    return row[first], lo, count, a - lo, grams[a], hasher.spans(lo, lo + count - 1 + length)


#: Bytes of the first buckets; nine bits each, so that a text's end sorts before every byte.
FIRST = 7
#: Parts of a pass; the buckets of a part are refined together, and later parts read what it has written.
PARTS = 8


def suffix_ranks(buf: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every position's suffix (to the end of its piece) among all of them, exact as far as suffixes differ within ``depth`` bytes.

    Bucket-pointer refinement: positions are put into buckets by their first FIRST bytes. A bucket of common depth d is sorted by the buckets
    that its members' d-th successors are in, whose depth adds to its own. New ranks and depths are written at once, so buckets that are refined
    later in the pass use them and gain more than twice their depth. Buckets of one, and those that are deep enough, are left alone.
    """
    n = len(buf)
    end = np.repeat(off[1:], np.diff(off))
    code = np.concatenate([buf.astype(np.uint64) + np.uint64(1), np.zeros(FIRST, np.uint64)])
    key = np.zeros(n, np.uint64)
    at = np.arange(n)
    for j in range(FIRST):
        key = (key << np.uint64(9)) | np.where(at + j < end, code[j : j + n], np.uint64(0))
    order = np.argsort(key)
    first, size = _groups(key[order])
    rank, deep = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[order] = first
    deep[order] = np.where(key[order] & np.uint64(511) == 0, n + depth, FIRST)  # with the end in it the suffix is known whole
    active = order[(size > 1) & (deep[order] < depth)]
    while len(active):
        own = rank[active]
        cuts = np.unique(np.searchsorted(own, own[np.linspace(0, len(active) - 1, PARTS + 1).astype(np.int64)[1:-1]]))
        left = []
        for part in np.split(active, cuts[cuts > 0]):
            old, to = rank[part], part + deep[part]
            inside = to < end[part]
            to = np.minimum(to, n - 1)
            pointer = np.where(inside, rank[to] + 1, 0)
            gain = np.where(inside, deep[to], n + depth)
            both = old * np.int64(n + 2) + pointer
            turn = np.argsort(both)
            part, old, both = part[turn], old[turn], both[turn]
            head, _ = _groups(old)
            start, size = _groups(both)
            rank[part] = old + start - head
            deep[part] += gain[turn]
            left.append(part[(size > 1) & (deep[part] < depth)])
        active = np.concatenate(left)
        active = active[np.argsort(rank[active])]
    return rank


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys, each one's first place and how many there are."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    count = np.diff(edge)
    return np.repeat(edge[:-1], count), np.repeat(count, count)


def refined(buf: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Starts in buf of the ``length``-byte windows, within the pieces cut by off, that occur more than once in buf: neighbours in suffix order whose bytes are equal that far."""
    n = len(buf)
    if n < length:
        return np.zeros(0, np.int64)
    rank = suffix_ranks(buf, off, length)
    at = np.flatnonzero(np.arange(n) + length <= np.repeat(off[1:], np.diff(off)))
    at = at[np.argsort(rank[at], kind="stable")]
    same = np.arange(len(at) - 1)  # places whose successor has the same bytes, as far as compared
    a, b = at[:-1], at[1:]
    for j in range(length):
        if not len(same):
            break
        same = same[buf[a[same] + j] == buf[b[same] + j]]
    hit = np.zeros(len(at), bool)
    hit[same] = hit[same + 1] = True
    return np.sort(at[hit])


def _anchors(rows: DataFrame, length: int, brief: bool) -> DataFrame:
    """Of every stretch: brief: (h, ctx, place), else (h, ctx, th, lo, n, at). ctx is the stretch's hash, place that of the text and the position; h and ctx together are 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in pieces(batches, "text"):
                buf, off = bytes_of(b.column("text"))
                row, lo, n, at, h, ctx = stretches(buf, off, length)
                lo = lo - off[:-1][row]
                if brief:
                    th = np.frombuffer(b"".join(b.column("th").to_pylist()), np.uint64)[::2][row]
                    place = mix(th + lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h, ctx, place)], ["h", "ctx", "place"])
                else:
                    cols = [pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), b.column("th").take(pa.array(row)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["h", "ctx", "th", "lo", "n", "at"])

    return rows.select("th", "text").mapInArrow(run, "h long, ctx long, place long" if brief else "h long, ctx long, th binary, lo int, n int, at int")


def repeated_intervals(rows: DataFrame, length: int = 200) -> DataFrame:
    """(th, start, end): byte intervals that repeat, for texts of ``rows(id, th, text)``; th is the text's fingerprint.

    Whole copies of a text count once here. Intervals of one text may overlap or touch.
    """
    seen = _anchors(rows, length, True).groupBy("h").agg(F.min("place").alias("x"), F.max("place").alias("y"), F.min("ctx").alias("c"), F.max("ctx").alias("d")).where("x <> y")
    # written first, so that the join reads both sides from the shuffle and a frequent anchor's rows can be split
    seen = cut(seen.select("h", (F.col("c") != F.col("d")).alias("mixed")), "seen")
    twice = cut(_anchors(rows, length, False).join(seen, "h"), "anchors")
    whole = twice.where("not mixed").select("th", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end"))

    place = F.xxhash64("th", "lo")
    kinds = twice.where("mixed").groupBy("h", "ctx").agg(F.min(place).alias("x"), F.max(place).alias("y"))
    kinds = cut(kinds.select("h", "ctx", "x", (F.col("x") != F.col("y")).alias("again")), "kinds")
    same = twice.where("mixed").join(kinds.where("again").select("h", "ctx"), ["h", "ctx"], "left_semi")
    same = same.select("th", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end"))
    members = cut(kinds.groupBy("h").agg(F.count("*").alias("c")), "members")
    one = twice.where("mixed").withColumn("x", place).join(kinds, ["h", "ctx", "x"]).join(members, "h")
    todo = one.groupBy("th").agg(F.collect_set(F.struct("h", "lo", "n", "at", "again", (F.col("c") > CROWDED).alias("crowded"))).alias("todo"))
    ids = rows.groupBy("th").agg(F.min("id").alias("id"))
    todo = todo.join(ids, "th")
    texts = rows.join(todo.withColumnRenamed("id", "rep").withColumnRenamed("th", "rep_th"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th"))).select("th", "text", "todo")

    def carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "th", "lo", "again", "crowded", "piece"]
        with np.errstate(over="ignore"):
            for b in pieces(batches, "text"):
                out: list[tuple] = []
                for th, text, todo in zip(*(b.column(c).to_pylist() for c in ("th", "text", "todo"))):
                    raw = text.encode()
                    for t in todo:
                        piece = raw[t["lo"] : t["lo"] + t["n"] - 1 + length]
                        out.append((t["h"], th, t["lo"], t["again"], t["crowded"], piece))
                cols = list(zip(*out)) or [[]] * 6
                types = [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    carved = cut(texts.mapInArrow(carve, "h long, th binary, lo int, again boolean, crowded boolean, piece binary"), "pieces")

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of whole anchors, about a quarter of a megabyte each: what is sorted then stays in a core's cache."""
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("h", "th", "lo", "again", "piece"))):
                if size > 1 << 18 and held[-1][0] != r[0]:
                    yield _settled(held, length)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        yield _settled(held, length)

    dealt = carved.where("not crowded").repartition("h").sortWithinPartitions("h")
    found = dealt.select("h", "th", "lo", "again", "piece").mapInArrow(sort_out, "th binary, start int, end int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    raw = part.column("piece").to_pylist()
                    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
                    buf = np.frombuffer(b"".join(raw), np.uint8)
                    row = np.repeat(np.arange(len(raw)), np.diff(off) - length + 1)
                    first = np.concatenate([[0], np.cumsum(np.diff(off) - length + 1)])
                    start = np.arange(len(row)) - first[row] + off[row]
                    lo = part.column("lo").to_numpy(zero_copy_only=False)[row] + (start - off[row])
                    cols = [pa.array(Hasher(buf).spans(start, start + length).view(np.int64)), pa.array(Hasher(buf, True).spans(start, start + length).view(np.int64)), part.column("th").take(pa.array(row)), pa.array(lo.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["w1", "w2", "th", "start"])

    each = carved.where("crowded").select("th", "lo", "piece").mapInArrow(windows, "w1 long, w2 long, th binary, start int")
    many = each.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    counted = each.join(many, ["w1", "w2"], "left_semi").select("th", "start", (F.col("start") + length).alias("end"))
    return whole.union(same).union(found).union(counted)


def _settled(held: list[tuple], length: int) -> pa.RecordBatch:
    """Intervals of the windows of these stretches (h, th, lo, again, bytes) that occur in another one or twice in their own."""
    with np.errstate(over="ignore"):
        off = np.concatenate([[0], np.cumsum([len(r[4]) for r in held])]).astype(np.int64)
        hit = refined(np.frombuffer(b"".join(r[4] for r in held), np.uint8), off, length)
        row = np.searchsorted(off, hit, "right") - 1
        new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1])]) if len(hit) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(hit)]]) - 1 if len(first) else first
        out = [(held[r][1], held[r][2] + int(a - off[r]), held[r][2] + int(b - off[r]) + length) for r, a, b in zip(row[first], hit[first], hit[last]) if not held[r][3]]
        cols = list(zip(*out)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["th", "start", "end"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


@tidy
def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array<struct<start, end>>, kept binary) for every row of ``docs``.

    Every byte that a ``length``-byte string covers which also starts anywhere else, in another text or the same one, is removed;
    spans are the maximal removed runs of bytes, ``kept`` the other bytes. Strings are compared as UTF-8 within texts. Null counts as
    empty; rows that repeat a text (with any id, null too) are copies of each other and lose it whole
    if it has ``length`` bytes; an empty table gives an empty one; other columns are ignored. Texts may have up to 2 GB.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("th"), text.alias("text"))
    spans = repeated_intervals(rows, length).groupBy("th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    copies = rows.where(F.octet_length("text") >= length).groupBy("th").agg(F.count("*").alias("c")).where("c > 1").select("th", F.lit(True).alias("copied"))
    about = cut(spans.join(copies, "th", "full_outer"), "spans").withColumnRenamed("th", "of")
    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(about, rows.th == about.of, "left").select("id", "text", "spans", "copied")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            n, runs, kept = [], [], []
            for text, spans, copied in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                raw = text.encode()
                own = [(0, len(raw))] if copied else merged([(s["start"], s["end"]) for s in spans or ()])
                n.append(len(raw))
                runs.append([{"start": x, "end": y} for x, y in own])
                edges = [0, *(e for s in own for e in s), len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], [id_col, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"{id_col} {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
