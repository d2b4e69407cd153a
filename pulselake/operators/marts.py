"""Day-grain marts over the long measurement table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LOCAL_ZONE, local_day

ACTIVITY = {"StepCount": "steps", "DistanceWalkingRunning": "distance_km", "ActiveEnergyBurned": "active_energy_kcal", "BasalEnergyBurned": "basal_energy_kcal", "FlightsClimbed": "flights_climbed"}
NUTRITION = {"DietaryEnergyConsumed": "energy_kcal", "DietaryProtein": "protein_g", "DietaryCarbohydrates": "carbs_g", "DietaryFatTotal": "fat_g", "DietaryFiber": "fiber_g", "DietarySugar": "sugar_g"}


def sums(names: dict[str, str]) -> list:
    """One filtered sum for each metric; null where a day has none."""
    return [F.sum(F.when(F.col("metric") == m, F.col("value_num"))).alias(c) for m, c in names.items()]


def daily_activity(measurements: DataFrame, summary: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    a = measurements.where(F.col("metric").isin(*ACTIVITY)).groupBy(local_day("start_ts", zone).alias("a_day")).agg(*sums(ACTIVITY))
    s = summary.select(F.col("date_components").cast("date").alias("s_day"), F.col("exercise_time").alias("exercise_min"), "stand_hours", "move_time")
    return a.join(s, a.a_day == s.s_day, "full_outer").select(F.coalesce("a_day", "s_day").alias("day"), *ACTIVITY.values(), "exercise_min", "stand_hours", "move_time")


def daily_nutrition(measurements: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    m = measurements.where(F.col("metric").startswith("Dietary"))
    return m.groupBy(local_day("start_ts", zone).alias("day")).agg(*sums(NUTRITION), F.countDistinct("correlation_id").alias("meals_logged"))


def cycle_days(categorized: DataFrame, zone: str = LOCAL_ZONE, by: tuple[str, ...] = ()) -> DataFrame:
    """The signals of each day that has one."""
    metric = F.col("metric")
    m = categorized.where(metric.isin("BasalBodyTemperature", "MenstrualFlow", "CervicalMucusQuality", "IntermenstrualBleeding", "OvulationTestResult"))
    return m.groupBy(*by, local_day("start_ts", zone).alias("day")).agg(
        F.avg(F.when(metric == "BasalBodyTemperature", F.col("value_num"))).alias("bbt_c"),
        F.max(F.when(metric == "MenstrualFlow", F.col("value_ordinal"))).alias("flow_ordinal"),
        F.max(F.when(metric == "CervicalMucusQuality", F.col("value_ordinal"))).alias("mucus_ordinal"),
        F.bool_or(metric == "IntermenstrualBleeding").alias("intermenstrual_bleeding"),
        F.bool_or((metric == "OvulationTestResult") & F.col("value_label").isin("lh_surge", "positive")).alias("lh_surge"),
    )


def protein_by_activity(activity: DataFrame, nutrition: DataFrame, steps: int = 10_000) -> DataFrame:
    """Mean protein on active and quiet days."""
    both = activity.join(nutrition, "day")
    return both.groupBy((F.col("steps") >= steps).alias("active")).agg(F.avg("protein_g").alias("avg_protein_g"), F.count("*").alias("days"))
