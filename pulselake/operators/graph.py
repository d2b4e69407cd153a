"""The property graph as vertex and edge tables, and traversals as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import LOCAL_ZONE, local_day
from ..schemas import EDGES, VERTICES, schema_of
from .foods import NUTRIENTS, local_time

#: Phases and observed signs.
PHASES = ("menstruation", "follicular", "ovulation", "luteal", "unknown")
SYMPTOMS = (("bbt", "Basal body temperature", "cycle"), ("cervical_mucus", "Cervical mucus", "cycle"), ("menstrual_flow", "Menstrual flow", "cycle"), ("lh_test", "LH / ovulation test", "cycle"), ("intermenstrual_bleeding", "Intermenstrual bleeding", "cycle"))
OBSERVED = {"CervicalMucusQuality": "cervical_mucus", "MenstrualFlow": "menstrual_flow", "OvulationTestResult": "lh_test", "IntermenstrualBleeding": "intermenstrual_bleeding"}
#: Logged total and the nutrient that it counts towards.
LOGGED = {"kcal_total": "energy", "protein_total": "protein", "carbs_total": "carbohydrate", "fat_total": "fat"}

#: Inputs that are kept while the graph is written.
SHARED = ("biomarker_reference_ranges", "activities", "cycle_phases", "foods")


def unpivot(df: DataFrame, ids: list[str], columns: dict[str, str], key: str, value: str) -> DataFrame:
    """(ids, key, value) with one row for each column that has a value."""
    parts = F.array(*(F.struct(F.lit(k).alias(key), F.col(c).cast("double").alias(value)) for c, k in columns.items()))
    return df.select(*ids, F.explode(parts).alias("_x")).select(*ids, f"_x.{key}", f"_x.{value}").where(F.col(value).isNotNull())


class Graph:
    """``vertices[label]`` and ``edges[label]`` with src and dst; tables that are not given count as empty.

    Inputs: lab_results_canonical, biomarker_registry, biomarker_reference_ranges, foods, ingredients, food_ingredients, yazio_log,
    food_map, activities, cycle_phases, measurements, measurements_categorized.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], zone: str = LOCAL_ZONE):
        self.spark, self.t, self.zone = spark, tables, zone
        self.vertices = {v: self._fit(v, getattr(self, f"_v_{v.lower()}")()) for v in VERTICES}
        self.edges = {e: self._edge(e) for e in EDGES}

    def _fit(self, label: str, df: DataFrame | None) -> DataFrame:
        return df if df is not None else self.spark.createDataFrame([], schema_of(label))

    def _table(self, name: str) -> DataFrame | None:
        return self.t.get(name)

    def _observations(self) -> DataFrame | None:
        m, raw = self._table("measurements_categorized"), self._table("measurements")
        parts = []
        if m is not None:
            name = F.create_map(*(F.lit(x) for kv in OBSERVED.items() for x in kv))[F.col("metric")]
            parts.append(m.where(F.col("metric").isin(*OBSERVED)).groupBy(name.alias("src"), local_day("start_ts", self.zone).alias("dst")).agg(F.min("value_label").alias("value")))
        if raw is not None:
            b = raw.where("metric = 'BasalBodyTemperature'").groupBy(local_day("start_ts", self.zone).alias("dst")).agg(F.round(F.avg("value_num"), 2).alias("v"))
            parts.append(b.select(F.lit("bbt").alias("src"), "dst", F.concat(F.col("v").cast("string"), F.lit(" °C")).alias("value")))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _days(self) -> DataFrame | None:
        """Every day that any source bears, so that edges to days always have their end."""
        days = []
        for name, col in (("cycle_phases", "day"), ("lab_results_canonical", "panel_date"), ("yazio_log", "log_date")):
            if (t := self._table(name)) is not None:
                days.append(t.select(F.col(col).alias("date")))
        if (a := self._table("activities")) is not None:
            days.append(a.select(local_day("start_ts", self.zone).alias("date")))
        if (o := self._observations()) is not None:
            days.append(o.select(F.col("dst").alias("date")))
        out = None
        for d in days:
            out = d if out is None else out.union(d)
        return None if out is None else out.where("date is not null").distinct()

    def _v_day(self):
        days, phases = self._days(), self._table("cycle_phases")
        if days is None:
            return None
        if phases is None:
            return days.select("date", F.lit(None).cast("string").alias("phase"), F.lit(None).cast("int").alias("cycle_day"), F.lit(None).cast("string").alias("fertility_zone"))
        return days.join(phases.select(F.col("day").alias("date"), "phase", "cycle_day", "fertility_zone"), "date", "left")

    def _v_cyclephase(self):
        return self.spark.range(1).select(F.explode(F.array(*map(F.lit, PHASES))).alias("name"))

    def _v_biomarker(self):
        t = self._table("biomarker_registry")
        return None if t is None else t.select("key", "name_en", "category", "unit")

    def _v_labresult(self):
        t = self._table("lab_results_canonical")
        return None if t is None else t.select(F.col("row_key").alias("id"), F.col("value_num").alias("value"), "unit", "flag", "panel_date")

    def _eras(self):
        t = self._table("biomarker_reference_ranges")
        if t is None:
            return None
        n = F.row_number().over(W.partitionBy("key").orderBy("valid_from"))
        return t.withColumn("id", F.concat("key", F.lit("_ref"), n.cast("string")))

    def _v_referencerange(self):
        t = self._eras()
        return None if t is None else t.select("id", F.col("ref_low").alias("low"), F.col("ref_high").alias("high"), "unit", "n_panels", "valid_from", "valid_to")

    def _v_nutrient(self):
        return self.spark.createDataFrame([(k, n, u, c) for _, _, k, n, u, c in NUTRIENTS], schema_of("Nutrient"))

    def _v_food(self):
        t = self._table("foods")
        return None if t is None else t.select("fdc_id", "description", "category", "data_type", "energy_kcal", "protein_g", "fat_g", "carbs_g")

    def _meal_id(self):
        return F.concat(F.col("log_date").cast("string"), F.lit("|"), F.col("meal"))

    def _v_meal(self):
        t = self._table("yazio_log")
        if t is None:
            return None
        sums = [F.sum(c).alias(n) for c, n in (("kcal_total", "energy_kcal"), ("protein_total", "protein_g"), ("fat_total", "fat_g"), ("carbs_total", "carbs_g"))]
        g = t.groupBy("log_date", "meal").agg(F.min("log_time").alias("at"), *sums)
        return g.select(self._meal_id().alias("id"), F.lit("yazio").alias("source"), local_time(F.col("log_date"), F.col("at").cast("string")).alias("logged_ts"), F.col("meal").alias("meal_type"), "energy_kcal", "protein_g", "fat_g", "carbs_g")

    def _v_ingredient(self):
        t = self._table("ingredients")
        return None if t is None else t.select("key", "name")

    def _v_symptom(self):
        return self.spark.createDataFrame(SYMPTOMS, schema_of("Symptom"))

    def _v_activity(self):
        t = self._table("activities")
        return None if t is None else t.select(F.col("activity_id").alias("id"), "activity_type", "start_ts", "duration_s", "distance_km", "energy_kcal")

    def _edge(self, label: str) -> DataFrame:
        df = getattr(self, f"_e_{label.lower()}")()
        return df if df is not None else self.spark.createDataFrame([], "src string, dst string" + (f", {EDGES[label][2]}" if EDGES[label][2] else ""))

    def _e_measured_as(self):
        t = self._table("lab_results_canonical")
        return None if t is None else t.where("canonical_key is not null").select(F.col("row_key").alias("src"), F.col("canonical_key").alias("dst"))

    def _e_result_on(self):
        t = self._table("lab_results_canonical")
        return None if t is None else t.select(F.col("row_key").alias("src"), F.col("panel_date").alias("dst"))

    def _e_ref_for(self):
        t = self._eras()
        return None if t is None else t.select(F.col("id").alias("src"), F.col("key").alias("dst"))

    def _e_in_phase(self):
        t = self._table("cycle_phases")
        return None if t is None else t.select(F.col("day").alias("src"), F.col("phase").alias("dst"))

    def _e_performed_on(self):
        t = self._table("activities")
        return None if t is None else t.select(F.col("activity_id").alias("src"), local_day("start_ts", self.zone).alias("dst"))

    def _e_intake_on(self):
        t = self._table("yazio_log")
        return None if t is None else unpivot(t.groupBy(F.col("log_date").alias("src")).agg(*(F.sum(c).alias(c) for c in LOGGED)), ["src"], LOGGED, "dst", "amount")

    def _e_logged_on(self):
        t = self._table("yazio_log")
        return None if t is None else t.select(self._meal_id().alias("src"), F.col("log_date").alias("dst")).distinct()

    def _e_contains(self):
        t = self._table("yazio_log")
        return None if t is None else unpivot(t.groupBy(self._meal_id().alias("src")).agg(*(F.sum(c).alias(c) for c in LOGGED)), ["src"], LOGGED, "dst", "amount")

    def _e_composed_of(self):
        t = self._table("food_ingredients")
        return None if t is None else t.groupBy(F.col("fdc_id").alias("src"), F.col("ingredient_key").alias("dst")).agg(F.sum("gram_weight").alias("gram_weight"))

    def _e_eaten(self):
        t, m, f = self._table("yazio_log"), self._table("food_map"), self._table("foods")
        if t is None or m is None or f is None:
            return None
        m = m.join(f.select("fdc_id"), "fdc_id", "left_semi").select("product", F.col("fdc_id").alias("dst"))
        return t.join(m, "product").groupBy(self._meal_id().alias("src"), "dst").agg(F.sum("amount").alias("grams"), F.sum("portions").alias("portions"))

    def _e_has_nutrient(self):
        t = self._table("foods")
        return None if t is None else unpivot(t.withColumnRenamed("fdc_id", "src"), ["src"], {c: k for _, c, k, *_ in NUTRIENTS if c in t.columns}, "dst", "per_100g")

    def _e_observed_on(self):
        return self._observations()

    def counts(self) -> DataFrame:
        out = None
        for name, df in (self.vertices | self.edges).items():
            one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
            out = one if out is None else out.union(one)
        return out

    def write(self, path: str) -> None:
        """One folder of Parquet for each vertex and edge table; inputs that several of them read and that are small beside their sources are computed once."""
        held = [t.persist() for n in SHARED if (t := self._table(n)) is not None and not t.is_cached]
        try:
            for name, df in (self.vertices | self.edges).items():
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        finally:
            for t in held:
                t.unpersist()

    def dangling(self) -> DataFrame:
        """(edge, side, n) of edge ends without a vertex; empty if the graph is whole."""
        out = self.spark.createDataFrame([], "edge string, side string, n long")
        for e, (a, b, _) in EDGES.items():
            for side, v in (("src", a), ("dst", b)):
                key = self.vertices[v].columns[0]
                ends = self.vertices[v].select(F.col(key).cast("string").alias("_k"))
                lost = self.edges[e].select(F.col(side).cast("string").alias("_k")).join(ends, "_k", "left_anti").agg(F.lit(e).alias("edge"), F.lit(side).alias("side"), F.count("*").alias("n"))
                out = out.union(lost.where("n > 0"))
        return out

    def hop(self, start: DataFrame, edge: str, back: bool = False) -> DataFrame:
        """``start`` (with ``at``) moved over an edge: ``at`` becomes the other end, the edge's properties are added."""
        e = self.edges[edge]
        here, there = ("dst", "src") if back else ("src", "dst")
        props = [c for c in e.columns if c not in ("src", "dst")]
        return start.join(e.select(F.col(here).alias("_h"), F.col(there).alias("_t"), *props), F.col("at") == F.col("_h")).drop("_h", "at").withColumnRenamed("_t", "at")

    def ranges_of(self, biomarker: str) -> DataFrame:
        ids = self.hop(self.vertices["Biomarker"].where(F.col("key") == biomarker).select(F.col("key").alias("at")), "REF_FOR", back=True)
        return self.vertices["ReferenceRange"].join(ids.select(F.col("at").alias("id")), "id", "left_semi")

    def results_by_phase(self, category: str) -> DataFrame:
        b = self.vertices["Biomarker"].where(F.col("category") == category).select(F.col("key").alias("at"))
        p = self.hop(self.hop(self.hop(b, "MEASURED_AS", back=True), "RESULT_ON"), "IN_PHASE")
        return p.groupBy(F.col("at").alias("phase")).agg(F.count("*").alias("n"))

    def activities_by_phase(self) -> DataFrame:
        p = self.hop(self.hop(self.vertices["Activity"].select(F.col("id").alias("at")), "PERFORMED_ON"), "IN_PHASE")
        return p.groupBy(F.col("at").alias("phase")).agg(F.count("*").alias("n"))

    def intake_by_phase(self, nutrient: str = "protein") -> DataFrame:
        d = self.hop(self.vertices["Nutrient"].where(F.col("key") == nutrient).select(F.col("key").alias("at")), "INTAKE_ON", back=True)
        return self.hop(d, "IN_PHASE").groupBy(F.col("at").alias("phase")).agg(F.avg("amount").alias("avg_amount"), F.count("*").alias("days"))

    def eaten_nutrients(self) -> DataFrame:
        """(meal, nutrient, amount): grams of each food over 100 times its content."""
        m = self.vertices["Meal"].select(F.col("id").alias("meal"), F.col("id").alias("at"))
        n = self.hop(self.hop(m, "EATEN"), "HAS_NUTRIENT")
        return n.groupBy("meal", F.col("at").alias("nutrient")).agg(F.sum(F.col("grams") / 100 * F.col("per_100g")).alias("amount"))

    def ingredients_of(self, fdc_id: int) -> DataFrame:
        i = self.hop(self.vertices["Food"].where(F.col("fdc_id") == fdc_id).select(F.col("fdc_id").alias("at")), "COMPOSED_OF")
        return self.vertices["Ingredient"].join(i.select(F.col("at").alias("key"), "gram_weight"), "key")
