"""Shared-folder tables and connected components for the text operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and all executors are in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="pulselake-")
    return _OWN[app]


#: Tables written by ``cut`` within the functions marked ``tidy`` that run now.
_MADE: list[list[str]] = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs one stage only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _MADE:
        _MADE[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(f):
    """``f``, after which the tables that it has cut and that its result (a DataFrame or any other thing) does not read are removed."""

    @functools.wraps(f)
    def run(*args, **named):
        _MADE.append([])
        try:
            out = f(*args, **named)
        finally:
            made = _MADE.pop()
        read = {file.rsplit("/", 2)[-2] for file in out.inputFiles()} if isinstance(out, DataFrame) else set()
        for path in made:
            if path.rsplit("/", 1)[-1] not in read:
                _remove(SparkSession.active(), path)
            elif _MADE:
                _MADE[-1].append(path)
        return out

    return run


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_key(text: F.Column) -> F.Column:
    """96-bit fingerprint of a text, struct<h, g>; null has one of its own. With an id it names a row, all but its exact repeats."""
    return F.struct(F.xxhash64(text).alias("h"), F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).alias("g"))


def drop_cut(df: DataFrame) -> None:
    """Remove a table made by ``cut`` that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


#: Tables of up to so many bytes, counted, may go to every task.
LIGHT_BYTES = 16 << 20


def light_bytes(df: DataFrame) -> int:
    """Bytes of all values of ``df``: 16 for each of fixed size, 16 and their length for texts and binaries, structs by their fields."""

    def size(c: F.Column, kind: T.DataType) -> F.Column:
        if isinstance(kind, T.StructType):
            return sum((size(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.lit(16) + F.coalesce(F.octet_length(c), F.lit(0))
        return F.lit(16)

    total = sum((size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


#: Up to so many links (some 40 MB as numbers of Python) one task finds the components; more are settled by rounds over all executors.
ONE_TASK_LINKS = 200_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["id", "root"])


def components(edges: DataFrame, most: int = ONE_TASK_LINKS) -> DataFrame:
    """(id, root) of every long id that has a link (a, b), root being the smallest id of its component.

    Nulls and loops are ignored; repeated links count once; no link gives no row. The number of links is counted: up to ``most`` go through union-find in one task,
    more through ``star_rounds``; the result is the same.
    """
    links = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    if links.limit(most + 1).count() <= most:
        return links.coalesce(1).mapInArrow(_union_find, "id long, root long")
    return star_rounds(links)


def star_rounds(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    As ``components``, for any number of links: nulls and loops are ignored, repeated links count once, no link gives no row. Alternates large-star and small-star
    steps, so a component that is one long chain needs about log(length) rounds and no vertex's
    neighbours are ever gathered in one row. Every round is written to the shared folder.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").distinct()

    now = cut(tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("a is not null and b is not null")), "links")
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = tidy(both.join(low, both.u == low.x).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = tidy(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", "m"))
        step = cut(tidy(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "links")
        new = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        drop_cut(now)
        now = step
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
