"""Schemas of the relations and the vertex and edge tables, as DDL text; ! marks what must not be null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RELATIONS = {
    "measurements": "row_key string, metric string!, record_kind string, value_num double, value_str string, unit string, start_ts timestamp!, end_ts timestamp, creation_ts timestamp, source string!, source_version string, correlation_id string",
    "workouts": "row_key string, workout_type string!, start_ts timestamp!, end_ts timestamp, duration_s double, source string!, source_version string",
    "activity_summary": "date_components string, active_energy double, active_energy_goal double, active_energy_unit string, move_time double, move_time_goal double, exercise_time double, exercise_time_goal double, stand_hours double, stand_hours_goal double",
    "category_value_map": "metric string!, raw_value string!, label string!, ordinal int",
    "lab_results": "row_key string, panel_date date!, source_file string!, test_name string!, value_num double, value_str string, unit string, ref_low double, ref_high double, ref_text string, flag string, model string, extracted_at timestamp",
    "biomarker_registry": "key string, name_en string!, category string!, unit string, specimen string!",
    "biomarker_map": "raw_name string, canonical_key string, method string!, score double",
    "activities": "activity_id string, source string!, activity_type string!, name string, start_ts timestamp!, end_ts timestamp, duration_s double, moving_s double, distance_km double, elevation_gain_m double, avg_speed double, max_speed double, energy_kcal double",
    "food_map": "product string, en_name string, fdc_id long, description string, cosine double, macro_sim double, score double, method string",
}
KEYS = {
    "measurements": ["row_key"], "workouts": ["row_key"], "activity_summary": ["date_components"], "category_value_map": ["metric", "raw_value"],
    "lab_results": ["row_key"], "biomarker_registry": ["key"], "biomarker_map": ["raw_name"], "activities": ["activity_id"], "food_map": ["product"],
    "foods": ["fdc_id"], "off_foods": ["off_code"], "yazio_foods": ["product"], "cycle_phases": ["entity", "day"], "cycle_summary": ["entity", "cycle_number"],
}
VERTICES = {
    "Day": "date date, phase string, cycle_day int, fertility_zone string",
    "CyclePhase": "name string",
    "Biomarker": "key string, name_en string, category string, unit string",
    "LabResult": "id string, value double, unit string, flag string, panel_date date",
    "ReferenceRange": "id string, low double, high double, unit string, n_panels long, valid_from date, valid_to date",
    "Nutrient": "key string, name string, unit string, category string",
    "Food": "fdc_id long, description string, category string, data_type string, energy_kcal double, protein_g double, fat_g double, carbs_g double",
    "Meal": "id string, source string, logged_ts timestamp_ntz, meal_type string, energy_kcal double, protein_g double, fat_g double, carbs_g double",
    "Ingredient": "key string, name string",
    "Symptom": "key string, name string, category string",
    "Activity": "id string, activity_type string, start_ts timestamp, duration_s double, distance_km double, energy_kcal double",
}
#: Edge label: (from, to, properties).
EDGES = {
    "MEASURED_AS": ("LabResult", "Biomarker", ""), "RESULT_ON": ("LabResult", "Day", ""), "REF_FOR": ("ReferenceRange", "Biomarker", ""),
    "IN_PHASE": ("Day", "CyclePhase", ""), "PERFORMED_ON": ("Activity", "Day", ""), "INTAKE_ON": ("Day", "Nutrient", "amount double"),
    "LOGGED_ON": ("Meal", "Day", ""), "CONTAINS": ("Meal", "Nutrient", "amount double"), "COMPOSED_OF": ("Food", "Ingredient", "gram_weight double"),
    "EATEN": ("Meal", "Food", "grams double, portions double"), "HAS_NUTRIENT": ("Food", "Nutrient", "per_100g double"), "OBSERVED_ON": ("Symptom", "Day", "value string"),
}


def schema_of(name: str) -> StructType:
    """The relation's schema with its required columns."""
    text = (RELATIONS | VERTICES)[name]
    out = StructType()
    for part in text.split(", "):
        col, kind = part.split(" ", 1)
        out = out.add(col, kind.rstrip("!"), not kind.endswith("!"))
    return out


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(name))


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows that break the relation: (rule, n) for nulls in required columns and for keys that occur twice; empty if all hold."""
    spark = df.sparkSession
    out = spark.createDataFrame([], "rule string, n long")
    if name in RELATIONS:
        needed = [f.name for f in schema_of(name) if not f.nullable and f.name in df.columns]
        if needed:
            row = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in needed))
            out = out.union(row.select(F.explode(F.array(*(F.struct(F.lit(f"null {c}").alias("rule"), F.col(c).alias("n")) for c in needed))).alias("x")).select("x.*").where("n > 0"))
    if name in KEYS:
        twice = df.groupBy(*KEYS[name]).count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0")
        out = out.union(twice.select(F.lit("repeated key").alias("rule"), "n"))
    return out


def write(df: DataFrame, name: str, path: str, mode: str = "error") -> None:
    """Write a relation under its schema: columns in order and by type, required ones checked row by row while they are written, and keys before; a breach raises and leaves nothing."""
    broken = violations(df, name).collect()
    if broken:
        raise ValueError(f"{name}: " + ", ".join(f"{r.rule} ({r.n})" for r in broken))
    cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in schema_of(name)]
    df.select(*(c.alias(f.name) for c, f in zip(cols, schema_of(name)))).write.mode(mode).parquet(path)
