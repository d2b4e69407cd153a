"""Enum values to labels and ordinals, and the audit of what is not mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metric, raw value, label, ordinal.
CATEGORY_VALUES = (
    ("MenstrualFlow", "HKCategoryValueVaginalBleedingUnspecified", "unspecified", None),
    ("MenstrualFlow", "HKCategoryValueMenstrualFlowUnspecified", "unspecified", None),
    ("MenstrualFlow", "HKCategoryValueVaginalBleedingNone", "none", 0),
    ("MenstrualFlow", "HKCategoryValueMenstrualFlowNone", "none", 0),
    ("MenstrualFlow", "HKCategoryValueVaginalBleedingLight", "light", 1),
    ("MenstrualFlow", "HKCategoryValueMenstrualFlowLight", "light", 1),
    ("MenstrualFlow", "HKCategoryValueVaginalBleedingMedium", "medium", 2),
    ("MenstrualFlow", "HKCategoryValueMenstrualFlowMedium", "medium", 2),
    ("MenstrualFlow", "HKCategoryValueVaginalBleedingHeavy", "heavy", 3),
    ("MenstrualFlow", "HKCategoryValueMenstrualFlowHeavy", "heavy", 3),
    ("CervicalMucusQuality", "HKCategoryValueCervicalMucusQualityDry", "dry", 1),
    ("CervicalMucusQuality", "HKCategoryValueCervicalMucusQualitySticky", "sticky", 2),
    ("CervicalMucusQuality", "HKCategoryValueCervicalMucusQualityCreamy", "creamy", 3),
    ("CervicalMucusQuality", "HKCategoryValueCervicalMucusQualityWatery", "watery", 4),
    ("CervicalMucusQuality", "HKCategoryValueCervicalMucusQualityEggWhite", "egg_white", 5),
    ("OvulationTestResult", "HKCategoryValueOvulationTestResultNegative", "negative", 0),
    ("OvulationTestResult", "HKCategoryValueOvulationTestResultIndeterminate", "indeterminate", None),
    ("OvulationTestResult", "HKCategoryValueOvulationTestResultEstrogenSurge", "estrogen_surge", 1),
    ("OvulationTestResult", "HKCategoryValueOvulationTestResultLuteinizingHormoneSurge", "lh_surge", 2),
    ("OvulationTestResult", "HKCategoryValueOvulationTestResultPositive", "positive", 2),
    ("IntermenstrualBleeding", "HKCategoryValueNotApplicable", "present", None),
    ("HeadphoneAudioExposureEvent", "HKCategoryValueHeadphoneAudioExposureEventSevenDayLimit", "seven_day_limit", None),
)


def category_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORY_VALUES, "metric string, raw_value string, label string, ordinal int")


def categorized(measurements: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """All rows with ``value_label`` and ``value_ordinal``, null where the value is not in the (small, fixed) map."""
    m = mapping if mapping is not None else category_map(measurements.sparkSession)
    m = F.broadcast(m.select(F.col("metric").alias("_m"), F.col("raw_value").alias("_v"), F.col("label").alias("value_label"), F.col("ordinal").alias("value_ordinal")))
    return measurements.join(m, (F.col("metric") == F.col("_m")) & (F.col("value_str") == F.col("_v")), "left").drop("_m", "_v")


def unmapped(measurements: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(metric, value_str, n) of the text values that the map lacks."""
    m = mapping if mapping is not None else category_map(measurements.sparkSession)
    m = F.broadcast(m.select("metric", F.col("raw_value").alias("value_str")))
    return measurements.where("value_str is not null").join(m, ["metric", "value_str"], "left_anti").groupBy("metric", "value_str").agg(F.count("*").alias("n"))
