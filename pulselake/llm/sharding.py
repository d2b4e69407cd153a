"""Best-fit-decreasing packing of indivisible groups of equal texts into fixed-capacity shards."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import LIGHT_BYTES, cut, light_bytes, tidy


class RemainingTree:
    """Bins by (remaining capacity, bin) in an AVL tree: tightest fit, fullest room and update take O(log n) steps."""

    def __init__(self, capacities: Iterable[int] = ()):
        self.root: list | None = None  # [key, left, right, height]
        for i, c in enumerate(capacities):
            self.add(c, i)

    @staticmethod
    def _high(t: list | None) -> int:
        return t[3] if t else 0

    def _turned(self, t: list, up: int, down: int) -> list:
        """The child on side ``up`` takes the place of its parent."""
        child = t[up]
        t[up], child[down] = child[down], t
        for x in (t, child):
            x[3] = 1 + max(self._high(x[1]), self._high(x[2]))
        return child

    def _balanced(self, t: list) -> list:
        t[3] = 1 + max(self._high(t[1]), self._high(t[2]))
        for up, down in ((1, 2), (2, 1)):
            if self._high(t[up]) > self._high(t[down]) + 1:
                if self._high(t[up][down]) > self._high(t[up][up]):
                    t[up] = self._turned(t[up], down, up)
                return self._turned(t, up, down)
        return t

    def _with(self, t: list | None, key: tuple[int, int]) -> list:
        if not t:
            return [key, None, None, 1]
        side = 1 if key < t[0] else 2
        t[side] = self._with(t[side], key)
        return self._balanced(t)

    def _without(self, t: list, key: tuple[int, int]) -> list | None:
        if key == t[0]:
            if not t[1] or not t[2]:
                return t[1] or t[2]
            follower = t[2]
            while follower[1]:
                follower = follower[1]
            t[0] = follower[0]
            t[2] = self._without(t[2], follower[0])
        else:
            side = 1 if key < t[0] else 2
            t[side] = self._without(t[side], key)
        return self._balanced(t)

    def add(self, remaining: int, i: int) -> None:
        self.root = self._with(self.root, (remaining, i))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """(remaining, bin) of the fullest bin with room for ``size``, of equal ones the first; None if none has room."""
        best, t = None, self.root
        while t:
            if t[0] >= (size, -1):
                best, t = t[0], t[1]
            else:
                t = t[2]
        return best

    def emptiest(self) -> tuple[int, int] | None:
        t = self.root
        while t and t[2]:
            t = t[2]
        return t[0] if t else None

    def put(self, remaining: int, i: int, size: int) -> None:
        self.root = self._without(self.root, (remaining, i))
        self.add(remaining - size, i)


def best_fit_runs(sizes: Iterable[tuple[int, int]], capacity: int, n_bins: int | None) -> Iterator[tuple[int, int, int, int, int]]:
    """(size, first, last, each, bin) for groups that come as (size, count) in falling size: ``each`` of them go to ``bin``, ``each`` to the next one, and so on.

    Groups of one size are alike, so a whole run of them goes into the tightest bin until that is full. With ``n_bins`` a group
    that fits nowhere goes to the emptiest bin; without it new bins of ``capacity`` are opened, of which one group may fill more than a whole.
    Memory: the bins only.
    """
    tree = RemainingTree([capacity] * (n_bins or 0))
    opened = n_bins or 0
    for size, count in sizes:
        at = 0
        while at < count:
            fit = tree.tightest(size)
            if fit or n_bins:
                left, i = fit or tree.emptiest()
                n = min(count - at, max(1, left // size)) if size else count - at
                tree.put(left, i, n * size)
                yield size, at, at + n - 1, n, i
                at += n
                continue
            each = max(1, capacity // size) if size else count - at
            bins = -(-(count - at) // each)
            yield size, at, count - 1, each, opened
            for b in range(bins):
                tree.add(capacity - size * (each if b < bins - 1 else count - at - each * (bins - 1)), opened + b)
            opened += bins
            at = count


def ranks(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Adds ``out``, gapless from 0 within ``key`` in the order of the hex hash ``order``, without gathering a key.

    Rows are ranked within pieces of the hash's range, about as many as the root of the row count, and the pieces' counts are summed up.
    ``df`` is a table written by ``cut``. Rows with one hash take any order among each other.
    """
    pieces = max(1, math.isqrt(df.count()))
    df = df.withColumn("_piece", F.floor(F.conv(F.substring(order, 1, 7), 16, 10).cast("long") * pieces / (1 << 28)).cast("long"))
    within = F.row_number().over(W.partitionBy(key, "_piece").orderBy(order)) - 1
    counts = df.groupBy(key, "_piece").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(key, "_piece", before.alias("_start"))
    return df.withColumn("_rank", within).join(starts, [key, "_piece"]).withColumn(out, (F.col("_start") + F.col("_rank")).cast("long")).drop("_piece", "_rank", "_start")


@tidy
def pack(docs: DataFrame, n_shards: int | None = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, group_key, shard, slot) for every row of ``docs``.

    A group is all rows with one text; its size is the sum of its rows' UTF-8 bytes plus 1 each. Groups enter by
    falling size, of one size by the text's SHA-256, the tightest shard that has room. With ``n_shards`` each shard holds an equal part of all bytes (rounded
    up), or ``capacity``, and a group that fits nowhere goes to the emptiest one; with ``n_shards`` None as few shards of ``capacity`` bytes as best fit needs are opened, an outsized group having
    one of its own. Null counts as a text of its own without bytes; an empty table gives
    an empty one; repeated rows are packed each; other columns are ignored. Slots run without gaps from 0
    in every shard, by the SHA-256 of the group's key and the id.

    Only (size, count) lines meet in one task, one for each size that occurs, and are streamed; groups of any size are never gathered.
    """
    if n_shards is None and not capacity:
        raise ValueError("a number of shards or a capacity is needed")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    key = F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.sha2(F.lit("null"), 512).substr(1, 64))
    rows = docs.select(F.col(id_col), size.alias("size"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).alias("text_crc32"), key.alias("group_key"))
    rows = cut(rows, "sized")
    groups = cut(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")), "groups")
    groups = ranks(groups, "bytes", "group_key", "rank")
    lines = cut(groups.groupBy("bytes").agg(F.count("*").alias("n")), "lines")
    if not capacity:
        capacity = -(-lines.agg(F.coalesce(F.sum(F.col("bytes") * F.col("n")), F.lit(0))).first()[0] // n_shards)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = (line for b in batches for line in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for run in best_fit_runs(sizes, capacity, n_shards):
            out.append(run)
            if len(out) == 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["of", "first", "last", "each", "bin"])

    runs = cut(lines.coalesce(1).sortWithinPartitions(F.desc("bytes")).mapInArrow(place, "of long, first long, last long, each long, bin long"), "runs")
    if light_bytes(runs) <= LIGHT_BYTES:
        runs = F.broadcast(runs)
    placed = groups.join(runs, (groups.bytes == runs["of"]) & F.col("rank").between(F.col("first"), F.col("last")))
    placed = placed.select("group_key", F.expr("cast(bin + (rank - first) div each as int)").alias("shard"))
    order = F.sha2(F.concat_ws(" ", "group_key", F.col(id_col).cast("string")), 256)
    full = cut(rows.join(placed, "group_key").withColumn("_order", order), "placed")
    return ranks(full, "shard", "_order", "slot").drop("_order")
