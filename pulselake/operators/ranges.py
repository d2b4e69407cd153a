"""Time-valid reference ranges: reigns of unchanged bounds, as-of lookup and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reigns(results: DataFrame, key: str = "canonical_key", day: str = "panel_date", low: str = "ref_low", high: str = "ref_high", unit: str = "canonical_unit") -> DataFrame:
    """(key, ref_low, ref_high, unit, n_panels, valid_from, last_seen, valid_to) for each run of panels with the same bounds.

    Bounds are compared null-safely; panels of one day are peers and share a reign; the last reign is open.
    """
    p = results.where(F.col(low).isNotNull() | F.col(high).isNotNull()).where(F.col(key).isNotNull())
    p = p.select(F.col(key).alias("key"), F.col(day).alias("day"), F.col(low).alias("low"), F.col(high).alias("high"), F.col(unit).alias("unit")).distinct()
    w = W.partitionBy("key").orderBy("day", "low", "high")
    changed = F.when(F.row_number().over(w) == 1, 1).when(F.lag("low").over(w).eqNullSafe(F.col("low")) & F.lag("high").over(w).eqNullSafe(F.col("high")), 0).otherwise(1)
    p = p.withColumn("changed", changed).withColumn("reign", F.sum("changed").over(W.partitionBy("key").orderBy("day")))
    r = p.groupBy("key", "reign").agg(F.min("low").alias("ref_low"), F.min("high").alias("ref_high"), F.min("unit").alias("unit"), F.count("*").alias("n_panels"), F.min("day").alias("valid_from"), F.max("day").alias("last_seen"))
    valid_to = F.date_sub(F.lead("valid_from").over(W.partitionBy("key").orderBy("valid_from")), 1)
    return r.select("key", "ref_low", "ref_high", "unit", "n_panels", "valid_from", "last_seen", valid_to.alias("valid_to"))


def verdict(value: Column, low: Column, high: Column) -> Column:
    """low, normal or high, bounds inclusive; null without a value or a lower bound."""
    return F.when(value.isNull() | low.isNull(), F.lit(None).cast("string")).when(value < low, "low").when(value > high, "high").otherwise("normal")


def ranged(results: DataFrame, eras: DataFrame, key: str = "canonical_key", day: str = "panel_date", value: str = "value_num") -> DataFrame:
    """``results`` with ``asof_low``, ``asof_high`` and ``asof_status`` from the era that held on its day.

    Eras are spread over the years in which they hold and there are results, and meet those of their key and year; the interval is a residual. So a
    result meets a year's eras and not all of its key's.
    """
    last = results.agg(F.max(F.year(day)).alias("_last"))
    e = eras.crossJoin(F.broadcast(last)).where("year(valid_from) <= _last")
    until = F.least(F.coalesce(F.year("valid_to"), F.col("_last")), F.col("_last"))
    e = e.select(F.col("key").alias("_k"), F.col("ref_low").alias("asof_low"), F.col("ref_high").alias("asof_high"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.explode(F.sequence(F.year("valid_from"), F.greatest(F.year("valid_from"), until))).alias("_y"))
    on = (F.col(key) == F.col("_k")) & (F.year(day) == F.col("_y")) & (F.col("_from") <= F.col(day)) & (F.col("_to").isNull() | (F.col(day) <= F.col("_to")))
    out = results.join(e, on, "left").drop("_k", "_from", "_to", "_y")
    return out.withColumn("asof_status", verdict(F.col(value), F.col("asof_low"), F.col("asof_high")))


def ranged_by_window(results: DataFrame, eras: DataFrame, key: str = "canonical_key", day: str = "panel_date", value: str = "value_num") -> DataFrame:
    """As ``ranged``, for keys with very many eras: eras and results are merged in day order and the last era is carried on, so no row meets all eras of its key."""
    mark = [c for c in results.columns]
    r = results.select(F.struct(*mark).alias("row"), F.col(key).alias("_k"), F.col(day).alias("_d"), F.lit(1).alias("_t"), F.lit(None).cast("struct<asof_low:double,asof_high:double,_to:date>").alias("era"))
    e = eras.select(F.lit(None).cast(r.schema["row"].dataType).alias("row"), F.col("key").alias("_k"), F.col("valid_from").alias("_d"), F.lit(0).alias("_t"), F.struct(F.col("ref_low").alias("asof_low"), F.col("ref_high").alias("asof_high"), F.col("valid_to").alias("_to")).alias("era"))
    w = W.partitionBy("_k").orderBy("_d", "_t").rowsBetween(W.unboundedPreceding, 0)
    both = r.unionByName(e).withColumn("era", F.last("era", ignorenulls=True).over(w)).where("_t = 1")
    holds = F.col("era._to").isNull() | (F.col("_d") <= F.col("era._to"))
    out = both.select("row.*", F.when(holds, F.col("era.asof_low")).alias("asof_low"), F.when(holds, F.col("era.asof_high")).alias("asof_high"))
    return out.withColumn("asof_status", verdict(F.col(value), F.col("asof_low"), F.col("asof_high")))


def as_of(eras: DataFrame, key: str, day) -> DataFrame:
    """The era of one key that holds on a day."""
    d = F.lit(day).cast("date")
    return eras.where((F.col("key") == key) & (F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (d <= F.col("valid_to"))))


def evaluate(eras: DataFrame, key: str, day, value: float) -> DataFrame:
    """(status) of one value; no row for an unknown key."""
    return as_of(eras, key, day).select(verdict(F.lit(value), F.col("ref_low"), F.col("ref_high")).alias("status"))


def flips(ranged_rows: DataFrame, eras: DataFrame, key: str = "canonical_key", value: str = "value_num") -> DataFrame:
    """Results whose verdict differs under the era that is open now: (…, now_status)."""
    now = eras.where("valid_to is null").select(F.col("key").alias("_k"), F.col("ref_low").alias("_l"), F.col("ref_high").alias("_h"))
    out = ranged_rows.join(now, F.col(key) == F.col("_k")).withColumn("now_status", verdict(F.col(value), F.col("_l"), F.col("_h"))).drop("_k", "_l", "_h")
    return out.where("asof_status is distinct from now_status")


def many_eras(eras: DataFrame) -> DataFrame:
    return eras.groupBy("key").agg(F.count("*").alias("eras")).where("eras > 1")
