"""Natural keys and idempotent loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def natural_key(*cols: Column) -> Column:
    """sha1 over the fields with 0x1F between them; null counts as empty, so fields never shift."""
    return F.sha1(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)))


def group_key(prefix: str, *cols: Column) -> Column:
    """``prefix`` and the first 16 digits of the natural key."""
    return F.concat(F.lit(prefix), F.substring(natural_key(*cols), 1, 16))


def with_order(df: DataFrame) -> DataFrame:
    """``_order``: file, block and place of the row, the document order; to be taken right at the scan."""
    m = F.col("_metadata")
    return df.withColumn("_order", F.struct(m["file_path"].alias("f"), m["file_block_start"].alias("b"), F.monotonically_increasing_id().alias("i")))


def keep_first(df: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each key; Catalyst limits the window to one row per key before the shuffle too."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def new_rows(df: DataFrame, table: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """First rows of ``df`` by key that ``table`` does not have: first write wins, within the batch and against the table.

    ``order`` says which row of a batch is first; without it that is the one with the least hash of all columns, so the choice hangs on the rows alone and
    not on where they are.
    """
    by = order or [F.xxhash64(*(F.to_json(F.struct(c)) for c in df.columns))]
    return keep_first(df, [key], by).join(table.select(key), key, "left_anti")


def append_new(df: DataFrame, path: str, key: str, order: list | None = None) -> int:
    """Append what is new under ``path`` and return how many rows that were; running it again adds none. The rows are counted while they are written."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    table = spark.read.parquet(path) if there else spark.createDataFrame([], df.select(key).schema)
    seen = Observation()
    new_rows(df, table, key, order).select(*df.columns).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def backfill(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with ``column`` taken from ``values(key, column)`` where that has one."""
    v = values.select(key, F.col(column).alias("_new"))
    return df.join(v, key, "left").withColumn(column, F.coalesce("_new", column)).select(*df.columns)
