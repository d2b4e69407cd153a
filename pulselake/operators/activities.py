"""Activities: workouts enriched from time windows, daily events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import LOCAL_ZONE, local_day


#: Spans are cut into bins of a power of four microseconds, 19 hours (2 ** 36) at most.
COARSEST = 36


def _micros(df: DataFrame, column: str, naive: bool) -> F.Column:
    c = F.col(column)
    if not naive:
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def window_sums(spans: DataFrame, points: DataFrame, key: str, start: str, end: str, ts: str, sums: dict[str, F.Column], same: tuple[str, ...] = ()) -> DataFrame:
    """``spans`` with sums over the points in [start, end] that agree in the columns ``same``, null where none falls.

    No span meets its points one by one: time is cut into bins that are no longer than the span, so that it is the end of one bin, the whole of those between, up to four
    (more for spans beyond COARSEST, a bin for each 19 hours), and the beginning of another. These are running sums over a bin's points, forwards or backwards, so the work grows with points and spans and not with
    their pairs. Nothing is subtracted, so sums of doubles are as good as point by point.
    """
    naive = all(df.schema[c].dataType == T.TimestampNTZType() for df, c in ((spans, start), (spans, end), (points, ts)))
    s = spans.select(key, *same, _micros(spans, start, naive).alias("_a"), _micros(spans, end, naive).alias("_b")).where("_a <= _b")
    level = F.least(F.lit(COARSEST), F.length(F.bin(F.col("_b") - F.col("_a"))) - 1)
    s = s.withColumn("_level", (level - level % 2).cast("int"))
    s = s.withColumn("_i", F.expr("shiftright(_a, _level)")).withColumn("_j", F.expr("shiftright(_b, _level)"))
    piece = lambda i, way, at: F.struct(i.alias("_bin"), F.lit(way).alias("_way"), at.alias("_at"))
    none = F.array().cast("array<struct<_bin: bigint, _way: int, _at: bigint>>")
    first = F.when(F.col("_i") < F.col("_j"), F.array(piece(F.col("_i"), -1, -F.col("_a")))).otherwise(none)
    whole = F.when(F.col("_j") - F.col("_i") > 1, F.expr("transform(sequence(_i + 1, _j - 1), x -> struct(x as _bin, 1 as _way, shiftleft(x + 1, _level) - 1 as _at))")).otherwise(none)
    cuts = F.explode(F.concat(first, whole, F.array(piece(F.col("_j"), 1, F.col("_b")))))
    parts = s.select(key, *same, "_level", cuts.alias("_cut")).select(key, *same, "_level", "_cut.*", F.lit(True).alias("_part"))

    known = F.lit(True)
    for c in (*same, "_t"):
        known = known & F.col(c).isNotNull()
    values = [f"_v{i}" for i in range(len(sums))]
    p = points.select(*same, *(c.alias(v) for v, c in zip(values, sums.values())), _micros(points, ts, naive).alias("_t")).where(known)
    p = p.crossJoin(F.broadcast(s.select("_level").distinct())).withColumn("_way", F.explode(F.array(F.lit(1), F.lit(-1))))
    p = p.select(*same, *values, "_level", F.expr("shiftright(_t, _level)").alias("_bin"), "_way", (F.col("_t") * F.col("_way")).alias("_at"), F.lit(False).alias("_part"))
    so_far = W.partitionBy(*same, "_level", "_bin", "_way").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    run = parts.unionByName(p, allowMissingColumns=True).select(key, "_part", *(F.sum(v).over(so_far).alias(v) for v in values))
    got = run.where("_part").groupBy(key).agg(*(F.sum(v).alias(n) for v, n in zip(values, sums)))
    return spans.join(got, key, "left")


def from_workouts(workouts: DataFrame, measurements: DataFrame, point_source: str = "Slopes") -> DataFrame:
    """Workouts as activities, with distance and energy from that source's samples in the workout's time."""
    m = measurements.where(F.col("source") == point_source).where(F.col("metric").isin("DistanceDownhillSnowSports", "ActiveEnergyBurned"))
    m = m.select("metric", "value_num", F.col("start_ts").alias("_ts"))
    sums = {"distance_km": F.when(F.col("metric") == "DistanceDownhillSnowSports", F.col("value_num")), "energy_kcal": F.when(F.col("metric") == "ActiveEnergyBurned", F.col("value_num"))}
    w = window_sums(workouts, m, "row_key", "start_ts", "end_ts", "_ts", sums)
    none = F.lit(None).cast("double")
    return w.select(
        F.concat(F.lit("apple-"), F.substring("row_key", 1, 16)).alias("activity_id"), F.lit("apple_workout").alias("source"),
        F.when(F.col("workout_type") == "DownhillSkiing", "ski").otherwise(F.lower("workout_type")).alias("activity_type"), F.col("workout_type").alias("name"),
        "start_ts", "end_ts", "duration_s", none.alias("moving_s"), "distance_km", none.alias("elevation_gain_m"), none.alias("avg_speed"), none.alias("max_speed"), "energy_kcal",
    )


def daily_events(activities: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    return activities.groupBy(local_day("start_ts", zone).alias("day")).agg(
        F.count("*").alias("n_activities"), (F.sum("duration_s") / 60.0).alias("active_minutes"), F.sum("distance_km").alias("distance_km"),
        F.array_join(F.array_sort(F.collect_set("activity_type")), ", ").alias("activity_types"),
    )
