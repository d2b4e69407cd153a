"""Fixtures for every operator family of the measurement engine."""

import datetime as dt
import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from pulselake import schemas
from pulselake.functions import scalars, text
from pulselake.operators import activities, analytes, cycles, foods, graph, keys, marts, normalize, ranges, reports, retrieval, stats
from pulselake.sources import exports, labs, providers
from pulselake.streaming import increments

D = dt.date


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_names_and_numbers(spark):
    assert col(spark, "HKQuantityTypeIdentifierStepCount", exports.metric_name) == "StepCount"
    assert col(spark, "HKCategoryTypeIdentifierMenstrualFlow", exports.record_kind) == "Category"
    assert col(spark, "Custom", exports.metric_name) == "Custom" and col(spark, "Custom", exports.record_kind) is None
    for raw, want in (("12.5", 12.5), ("1e3", 1000.0), ("1d", None), ("0x1p3", None), ("1_000", 1000.0), ("", None), (None, None), (" 7 ", 7.0)):
        assert col(spark, raw, scalars.number) == want
    assert col(spark, "2025-05-01 23:30:00 +0200", scalars.instant).astimezone(dt.timezone.utc).hour == 21
    assert col(spark, "nonsense", scalars.instant) is None
    assert col(spark, "Lecsó, SÓS  (x)", text.food_name) == "lecso sos x"
    assert col(spark, "Neutrofil granulocita# (A)", text.lab_name) == "neutrofil granulocita #"
    assert col(spark, "Hormon (FSH) (K)", text.abbreviations) == ["fsh", "k"]
    assert col(spark, "Hormon (FSH) x", text.base_name) == "hormon x"
    assert sorted(col(spark, "Cherries, dishes as gas é", text.stems)) == sorted(["cherry", "dish", "as", "gas"])
    assert len(text.MARKED) == len(text.PLAIN)
    line = spark.createDataFrame([("Egg", 155.5, 12.5, None, 1.1)], "n string, k double, p double, f double, c double").select(text.serialized(*(F.col(x) for x in "nkpfc")).alias("s")).first().s
    assert line == "Egg (156 kcal, 12 g protein, ? g fat, 1 g carbs per 100g)"


def test_match_and_strata(spark):
    df = spark.createDataFrame([("Cheese, goat", ["goat cheese"], True), ("Cherries, raw", ["cherry"], True), ("Green peas", ["green apple"], False), ("x", ["12"], False), (None, ["x"], False)], "d string, k array<string>, ok boolean")
    assert all(r.got == r.ok for r in df.withColumn("got", text.matches(F.col("d"), F.col("k"))).collect())
    rows = [("Lecsó konzerv", "stew", None, "regional"), ("Alpro drink", "soy drink", None, "branded"), ("x", "boiled egg", None, "prepared"), ("x", "red apple", None, "compound"), ("x", "apple", None, "simple"), ("x", "apple", "branded", "branded"), (None, None, None, "simple")]
    df = spark.createDataFrame(rows, "p string, e string, x string, ok string")
    assert all(r.got == r.ok for r in df.withColumn("got", text.stratum(F.col("p"), F.col("e"), F.col("x"))).collect())


EXPORT = """<?xml version="1.0" encoding="UTF-8"?>
<HealthData><ExportDate value="2025-01-01"/>
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Té" unit="count" startDate="2025-01-01 08:00:00 +0100" endDate="2025-01-01 08:10:00 +0100" value="120"/>
 <Record type="HKQuantityTypeIdentifierBodyMass" sourceName="Té" unit="kg" startDate="2025-01-01 08:00:00 +0100" endDate="2025-01-01 08:00:00 +0100" value="60.5"/>
 <Record type="HKCategoryTypeIdentifierMenstrualFlow" sourceName="Té" startDate="2025-01-02 08:00:00 +0100" endDate="2025-01-02 08:00:00 +0100" value="HKCategoryValueVaginalBleedingLight"/>
 <ActivitySummary dateComponents="2025-01-01" activeEnergyBurned="300" activeEnergyBurnedGoal="400" activeEnergyBurnedUnit="kcal" appleExerciseTime="20" appleStandHours="9"/>
 <Correlation type="HKCorrelationTypeIdentifierFood" sourceName="Té" startDate="2025-01-01 12:00:00 +0100" endDate="2025-01-01 12:00:00 +0100">
  <Record type="HKQuantityTypeIdentifierDietaryProtein" sourceName="Té" unit="g" startDate="2025-01-01 12:00:00 +0100" endDate="2025-01-01 12:00:00 +0100" value="10"/>
  <Record type="HKQuantityTypeIdentifierDietaryFatTotal" sourceName="Té" unit="g" startDate="2025-01-01 12:00:00 +0100" endDate="2025-01-01 12:00:00 +0100" value="5"/>
 </Correlation>
 <Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="30" durationUnit="min" sourceName="Té" startDate="2025-01-01 09:00:00 +0100" endDate="2025-01-01 09:30:00 +0100"/>
</HealthData>"""


def test_export_is_read_and_loaded_once(spark, tmp_path):
    path = tmp_path / "kivonat_é.xml"
    path.write_text(EXPORT, encoding="utf-8")
    m = exports.measurements(spark, str(path))
    rows = {r.metric: r for r in m.collect()}
    assert len(rows) == 5 and rows["StepCount"].value_num == 120 and rows["MenstrualFlow"].value_str.endswith("Light")
    linked = {r.correlation_id for r in rows.values() if r.correlation_id}
    assert len(linked) == 1 and linked.pop().startswith("corr-") and sum(r.correlation_id is None for r in rows.values()) == 3
    assert exports.workouts(spark, str(path)).first().duration_s == 1800 and exports.activity_summary(spark, str(path)).first().exercise_time == 20
    store = str(tmp_path / "m")
    assert keys.append_new(m, store, "row_key") == 5 and keys.append_new(m, store, "row_key") == 0
    assert schemas.violations(spark.read.parquet(store), "measurements").count() == 0


def days(spark, flow=(), bbt=(), mucus=(), lh=()):
    """Signals by day number from 2025-01-01 of one entity."""
    start, rows = D(2025, 1, 1), {}
    for d in flow:
        rows.setdefault(d, {})["flow_ordinal"] = 1
    for d, v in bbt:
        rows.setdefault(d, {})["bbt_c"] = v
    for d, v in mucus:
        rows.setdefault(d, {})["mucus_ordinal"] = v
    for d in lh:
        rows.setdefault(d, {})["lh_surge"] = True
    data = [("e", start + dt.timedelta(days=d), r.get("bbt_c"), r.get("flow_ordinal"), r.get("mucus_ordinal"), r.get("lh_surge")) for d, r in rows.items()]
    return spark.createDataFrame(data, "entity string, day date, bbt_c double, flow_ordinal int, mucus_ordinal int, lh_surge boolean")


LOW = [(3 + i, 36.30) for i in range(6)]


def one_cycle(df, shift=0.2):
    return cycles.summary(df, "entity", shift).orderBy("cycle_number").first()


@pytest.mark.parametrize(
    ("highs", "shift", "found", "confirm"),
    [([36.6, 36.6, 36.6], 0.2, True, 11), ([36.45] * 3, 0.1, True, 11), ([36.45] * 3, 0.2, False, None), ([36.45, 36.45, 36.45, 36.42], 0.2, True, 12), ([36.60, 36.28, 36.60], 0.2, False, None)],
)
def test_thermal_shift(spark, highs, shift, found, confirm):
    c = one_cycle(days(spark, range(3), LOW + [(9 + i, v) for i, v in enumerate(highs)]), shift)
    assert c.anovulatory is not found
    if found:
        assert c.ovulation_day == D(2025, 1, 9) and c.temp_confirm_day == D(2025, 1, 1) + dt.timedelta(days=confirm)


def test_phases_zones_and_override(spark):
    df = days(spark, range(3), LOW + [(9 + i, 36.6) for i in range(3)] + [(19, 36.6)], [(6, 1), (11, 4)], [200])
    rows = {(r.day - D(2025, 1, 1)).days: r for r in cycles.phases(df, "entity").collect()}
    assert [rows[d].phase for d in (0, 3, 8, 9)] == ["menstruation", "follicular", "ovulation", "luteal"]
    assert [rows[d].fertility_zone for d in (3, 6, 11, 19)] == ["infertile_pre", "fertile", "fertile", "infertile_post"]
    assert one_cycle(df).confirmation_day == D(2025, 1, 15)
    lone = cycles.phases(days(spark, mucus=[(0, 5)]), "entity").first()
    assert lone.fertile_window and lone.phase == "unknown" and lone.cycle_day is None
    flat = cycles.phases(days(spark, range(3), [(3 + i, 36.4) for i in range(12)]), "entity")
    assert {r.phase for r in flat.collect()} == {"menstruation", "unknown"}


def test_guard_and_lengths(spark):
    early = days(spark, [0, 1, 2, 50, 51], LOW + [(9 + i, 36.6) for i in range(3)])
    c = one_cycle(early)
    assert c.ovulation_day is None and c.suspect_ovulation and c.anovulatory and c.cycle_length_days == 50
    late = days(spark, [0, 1, 2, 50, 51], LOW + [(9 + i, 36.6) for i in range(3)] + [(20 + i, 36.3) for i in range(18)] + [(38 + i, 36.7) for i in range(3)])
    c = one_cycle(late)
    assert c.suspect_ovulation and c.luteal_days == 13 and not c.short_luteal
    c = one_cycle(days(spark, [0, 1, 2, 16], LOW + [(9 + i, 36.6) for i in range(3)]))
    assert (c.luteal_days, c.short_luteal, c.follicular_days) == (8, True, 9)
    c = one_cycle(days(spark, [0, 1, 2, 45]))
    assert c.cycle_length_flag and c.cycle_length_z > 2 and c.luteal_length_z is None


def test_coverline_equals_a_scan(spark):
    import random

    rnd = random.Random(1)
    start = D(2025, 1, 1)
    data, want = [], {}
    for e in range(60):
        n = rnd.randint(20, 70)
        read = [(d, round(36.2 + rnd.choice([0, 0.1, 0.2, 0.3, 0.5]), 2)) for d in range(1, n) if rnd.random() < 0.8]
        nxt = n if rnd.random() < 0.7 else None
        data.append((e, start, None, 1))
        data += [(e, start + dt.timedelta(days=d), v, None) for d, v in read]
        if nxt:
            data.append((e, start + dt.timedelta(days=nxt), None, 1))
        ov, confirm, suspect = None, None, False
        for i in range(6, len(read) - 2):
            cover = max(v for _, v in read[i - 6 : i])
            h = [v for _, v in read[i : i + 3]]
            if min(h) <= cover:
                continue
            c = read[i + 2][0] if h[2] >= cover + 0.2 else read[i + 3][0] if i + 3 < len(read) and read[i + 3][1] > cover else None
            if c is None:
                continue
            if nxt and nxt - read[i - 1][0] > 16:
                suspect = True
                continue
            ov, confirm = read[i - 1][0], c
            break
        want[e] = (ov, confirm, suspect)
    df = spark.createDataFrame([(e, d, v, f, None, None) for e, d, v, f in data], "entity int, day date, bbt_c double, flow_ordinal int, mucus_ordinal int, lh_surge boolean")
    got = {r.entity: r for r in cycles.summary(df, "entity").where("cycle_number = 1").collect()}
    for e, (ov, confirm, suspect) in want.items():
        as_day = lambda x: None if x is None else start + dt.timedelta(days=x)
        assert (got[e].ovulation_day, got[e].temp_confirm_day, got[e].suspect_ovulation) == (as_day(ov), as_day(confirm), suspect)


def measured(spark, rows):
    return spark.createDataFrame([(str(i), m, v, s, t, "test", c) for i, (m, v, s, t, c) in enumerate(rows)], "row_key string, metric string, value_num double, value_str string, start_ts timestamp, source string, correlation_id string")


def test_marts(spark):
    noon = dt.datetime(2025, 5, 1, 12, tzinfo=dt.timezone.utc)
    late = dt.datetime(2025, 5, 1, 21, 30, tzinfo=dt.timezone.utc)
    m = measured(spark, [("DietaryEnergyConsumed", 200.0, None, noon, "m1"), ("DietaryEnergyConsumed", 300.0, None, noon, "m2"), ("DietaryProtein", 25.0, None, noon, "m1"), ("StepCount", 50.0, None, late, None), ("BasalBodyTemperature", 36.5, None, noon, None), ("MenstrualFlow", None, "HKCategoryValueVaginalBleedingHeavy", noon, None), ("OvulationTestResult", None, "HKCategoryValueOvulationTestResultPositive", noon, None), ("Odd", None, "value", noon, None)])
    n = marts.daily_nutrition(m).first()
    assert (n.energy_kcal, n.protein_g, n.meals_logged, n.fat_g) == (500.0, 25.0, 2, None)
    s = spark.createDataFrame([("2025-05-02", 30.0, 8.0, None)], "date_components string, exercise_time double, stand_hours double, move_time double")
    a = {r.day: r for r in marts.daily_activity(m, s).collect()}
    assert a[D(2025, 5, 1)].steps == 50 and a[D(2025, 5, 2)].exercise_min == 30 and a[D(2025, 5, 2)].steps is None
    c = normalize.categorized(m)
    d = marts.cycle_days(c).first()
    assert (d.bbt_c, d.flow_ordinal, d.lh_surge, d.intermenstrual_bleeding) == (36.5, 3, True, False)
    assert [(r.metric, r.n) for r in normalize.unmapped(m).collect()] == [("Odd", 1)]
    assert normalize.category_map(spark).count() == 22 and reports.mapping_audit(c).count() == 2
    assert marts.protein_by_activity(marts.daily_activity(m, s), marts.daily_nutrition(m)).first().active is False


def labs_fixture(spark):
    rows = [("x", D(2020, 1, 1), 11.0, 10.0, 20.0), ("x", D(2021, 1, 1), 11.0, 10.0, 20.0), ("x", D(2022, 6, 1), 11.0, 12.0, 22.0), ("y", D(2020, 1, 1), 1.5, 1.0, 2.0), ("y", D(2021, 1, 1), 1.5, 3.0, 4.0), ("y", D(2022, 1, 1), 2.0, 1.0, 2.0), ("z", D(2020, 1, 1), 4.0, None, 5.0)]
    return spark.createDataFrame(rows, "canonical_key string, panel_date date, value_num double, ref_low double, ref_high double").withColumn("canonical_unit", F.lit("u"))


def test_reference_ranges(spark):
    r = labs_fixture(spark)
    eras = ranges.reigns(r).cache()
    x = eras.where("key = 'x'").orderBy("valid_from").collect()
    assert [(e.n_panels, e.valid_to) for e in x] == [(2, D(2022, 5, 31)), (1, None)] and eras.where("key = 'y'").count() == 3
    got = {(q.canonical_key, q.panel_date): q.asof_status for q in ranges.ranged(r, eras).collect()}
    assert got == {(q.canonical_key, q.panel_date): q.asof_status for q in ranges.ranged_by_window(r, eras).collect()}
    assert got[("x", D(2022, 6, 1))] == "low" and got[("y", D(2021, 1, 1))] == "low" and got[("z", D(2020, 1, 1))] is None and got[("y", D(2022, 1, 1))] == "normal"
    assert ranges.evaluate(eras, "x", D(2021, 5, 5), 11.0).first().status == "normal" and ranges.evaluate(eras, "q", D(2021, 5, 5), 1.0).count() == 0
    assert {(q.canonical_key, q.panel_date) for q in ranges.flips(ranges.ranged(r, eras), eras).collect()} >= {("x", D(2020, 1, 1)), ("x", D(2021, 1, 1))}
    assert {q.key for q in ranges.many_eras(eras).collect()} == {"x", "y"}


def test_analyte_cascade(spark):
    rows = [("TSH (A)", "mIU/L", "tsh", "exact"), ("Follikulus stimuláló hormon (FSH) (A)", "IU/L", "fsh", None), ("Valami (K) teszt", "x", "potassium", "abbrev"), ("Fehérvérsejt", "/ltr(H)", "urine_wbc", "exact"), ("Fehérvérsejtszám", "Giga/L", "wbc", "exact"),
            ("Koleszterin (mmol)", None, "cholesterol_total", "base"), ("Trigliceridekk", None, "triglycerides", "fuzzy"), ("nothing like it", None, None, "none"), ("D-vitamin (25OH)", "nmol/L", "vitamin_d", None), ("Limfocita# (A)", "Giga/L", "lymphocytes_abs", "exact")]
    got = {(r.name, r.unit): r for r in analytes.resolve(spark.createDataFrame([x[:2] for x in rows], "name string, unit string")).collect()}
    for name, unit, key, method in rows:
        assert got[(name, unit)].key == key and method in (None, got[(name, unit)].method), (name, got[(name, unit)])
    assert analytes.registry(spark).count() == 84
    res = spark.createDataFrame([("TSH", D(2020, 1, i), "mIU/L") for i in (1, 2, 3)], "test_name string, panel_date date, unit string")
    c = analytes.canonical(res, analytes.analyte_map(res))
    assert analytes.trendable(c).first().n_dates == 3 and analytes.category_rollup(c).first().category == "thyroid"
    p = analytes.resolve_with_provider(res.select(F.col("test_name").alias("name"), "unit"), lambda pairs, known: ["tsh" if i else "made_up" for i in range(len(pairs))])
    assert {r.key for r in p.collect()} <= {"tsh", None}


def test_foods(spark, tmp_path):
    files = {"food.csv": "fdc_id,data_type,description,food_category_id,publication_date\n1,sr_legacy_food,Banana,9,2020-01-01\n2,foundation_food,Bread,8,2020-01-01\n3,branded_food,Bar,8,2020-01-01\n", "food_category.csv": "id,code,description\n9,0900,Fruits\n8,0800,Baked\n",
             "food_nutrient.csv": "id,fdc_id,nutrient_id,amount\n1,1,1008,89\n2,1,1003,1.1\n3,1,1005,23\n4,2,1008,250\n5,3,1008,400\n6,1,9999,5\n", "input_food.csv": "id,fdc_id,fdc_id_of_input_food,seq_num,amount,sr_code,sr_description,unit,portion_code,portion_description,gram_weight,retention_code\n1,2,,1,1,,Flour ,g,,,50,\n2,2,,2,1,,Salt,g,,,1,\n"}
    for n, t in files.items():
        (tmp_path / n).write_text(t)
    t = exports.food_csvs(spark, str(tmp_path))
    f = foods.foods(t["food"], t["food_category"], t["food_nutrient"]).cache()
    b = f.where("fdc_id = 1").first()
    assert f.count() == 2 and (b.energy_kcal, b.protein_g, b.carbs_g, b.fat_g, b.category) == (89.0, 1.1, 23.0, None, "Fruits") and len(f.columns) == 20
    links = foods.ingredient_links(t["input_food"], f)
    assert links.count() == 2 and {r.key: r.n_foods for r in foods.ingredients(links).collect()} == {"flour": 1, "salt": 1}
    head = "\t".join(exports.PRODUCT_COLUMNS)
    rows = ["1\tLecsó\tB\tc\ten:hungary\t40\t1\tx\t5", "2\tAjvar\t\tc\ten:hungary,en:germany\t\t\t\t", "3\tPâté\t\tc\ten:france\t1\t1\t1\t1", "4\t \t\tc\ten:hungary\t1\t1\t1\t1", "5\tlecsó \tb\tc\ten:hungary\t1\t1\t1\t1", "6\tbad"]
    (tmp_path / "p.tsv.gz").write_bytes(gzip.compress("\n".join([head, *rows]).encode()))
    p = foods.open_products(exports.product_tsv(spark, str(tmp_path / "p.tsv.gz"), 3))
    assert {r.description: (r.energy_kcal, r.fat_g) for r in p.collect()} == {"Lecsó": (40.0, None), "Ajvar": (None, None)}
    assert [r.description for r in foods.open_products(exports.product_tsv(spark, str(tmp_path / "p.tsv.gz")), ("germany",)).collect()] == ["Ajvar"]
    m = {r.product: r.fdc_id for r in foods.fuzzy_match(spark.createDataFrame([("Bananas",), ("bread x",), ("zzz",)], "product string"), f).collect()}
    assert m.get("bread x") == 2 and "zzz" not in m
    assert {r.column: r.n for r in foods.coverage(f, ["energy_kcal", "fat_g"]).collect()} == {"energy_kcal": 2, "fat_g": 0}


LOG = "Date,Time,Meal,Product,Amount,Unit,Portions,Calories/g,Protein/g,Fat/g,Carbs/g,Calories total,Protein total,Fat total,Carbs total\n2025-01-01,08:00,breakfast,Apple,100,g,1,0.5,0.01,0,0.13,50,1,0,13\n2025-01-02,08:00,breakfast,Apple,100,g,1,0.54,0.01,0,0.15,54,1,0,15\n2025-01-02,12:00,lunch,Soup,200,g,2,1,0.1,0.1,0.1,200,20,20,20\n2025-01-02,12:00,lunch,,200,g,2,1,0.1,0.1,0.1,200,20,20,20\n"


def test_food_log_and_graph(spark, tmp_path):
    (tmp_path / "log.csv").write_text(LOG)
    log = exports.food_log(spark, str(tmp_path / "log.csv")).cache()
    a = foods.logged_products(log).where("product = 'Apple'").first()
    assert (a.energy_kcal, a.carbs_g, a.times_logged) == (52.0, 14.0, 2) and log.count() == 3
    f = spark.createDataFrame([(7, "Apple, raw", "d", "c", 52.0, 0.3, 14.0, 0.2), (8, "Soup", "d", "c", 11.0, None, 1.0, None)], "fdc_id long, description string, data_type string, category string, energy_kcal double, protein_g double, carbs_g double, fat_g double")
    links = spark.createDataFrame([(8, 1, "salt", "Salt", 20.0), (8, 2, "salt", "Salt", 30.0)], "fdc_id long, seq_num long, ingredient_key string, ingredient_name string, gram_weight double")
    phases = spark.createDataFrame([("e", D(2025, 1, 2), "luteal", "fertile", 3)], "entity string, day date, phase string, fertility_zone string, cycle_day int")
    lab = labs_fixture(spark).withColumn("canonical_key", F.lit("tsh"))
    res = spark.createDataFrame([("r1", D(2025, 1, 2), "tsh", 1.0, "mIU/L", None)], "row_key string, panel_date date, canonical_key string, value_num double, unit string, flag string")
    act = spark.createDataFrame([("a1", "run", dt.datetime(2025, 1, 2, 9), 60.0, 1.0, None)], "activity_id string, activity_type string, start_ts timestamp, duration_s double, distance_km double, energy_kcal double")
    g = graph.Graph(spark, {"yazio_log": log, "foods": f, "food_ingredients": links, "ingredients": foods.ingredients(links), "cycle_phases": phases, "lab_results_canonical": res, "biomarker_registry": analytes.registry(spark), "biomarker_reference_ranges": ranges.reigns(lab), "activities": act,
                            "food_map": spark.createDataFrame([("Apple", 7), ("Soup", 8), ("Gone", 9)], "product string, fdc_id long")})
    assert set(g.vertices) == set(schemas.VERTICES) and set(g.edges) == set(schemas.EDGES) and len(g.edges) == 12
    assert g.dangling().count() == 0
    assert {(r.meal, r.nutrient): round(r.amount, 6) for r in g.eaten_nutrients().collect()}[("2025-01-02|lunch", "energy")] == 22.0
    assert g.ingredients_of(8).first().gram_weight == 50.0 and g.ranges_of("tsh").count() >= 1
    assert [(r.phase, r.n) for r in g.results_by_phase("thyroid").collect()] == [("luteal", 1)] and [(r.phase, r.n) for r in g.activities_by_phase().collect()] == [("luteal", 1)]
    assert g.intake_by_phase("protein").first().avg_amount == 21.0
    assert g.vertices["Meal"].where("id = '2025-01-02|lunch'").first().logged_ts == dt.datetime(2025, 1, 2, 12)
    assert {r.table: r.n for r in g.counts().collect()}["Nutrient"] == 16


def test_activities(spark, tmp_path):
    head = ",".join(f"h{i}" for i in range(21))
    row = ["12345", '"23 jun 2026, 6:14:26"', "Morning", "Carrera"] + [""] * 11 + ["1860", "1800", "5014", "4.5", "2.7", "31"]
    other = ["6", '"1 ene 2026, 16:00:00"', "", "Curling"] + [""] * 11 + ["1", "1", "", "", "", "0"]
    (tmp_path / "a.csv").write_text("\n".join([head, ",".join(row), ",".join(other), "7,short"]))
    a = {r.activity_id: r for r in exports.activity_csv(spark, str(tmp_path / "a.csv")).collect()}
    r = a["strava-12345"]
    assert (r.activity_type, r.distance_km, r.duration_s) == ("run", 5.014, 1860.0) and a["strava-6"].activity_type == "curling" and len(a) == 2
    assert spark.createDataFrame([r], exports.activity_csv(spark, str(tmp_path / "a.csv")).schema).select(F.from_utc_timestamp("start_ts", "Europe/Budapest").cast("string").alias("t")).first().t.startswith("2026-06-23 06:14:26")
    ts = lambda h, m=0: dt.datetime(2025, 1, 1, h, m)
    w = spark.createDataFrame([("w1" * 10, "run", ts(9), ts(10), 3600.0, "s"), ("w2" * 10, "run", ts(20), ts(21), 1.0, "s")], "row_key string, workout_type string, start_ts timestamp, end_ts timestamp, duration_s double, source string")
    m = spark.createDataFrame([("Slopes", "DistanceDownhillSnowSports", 2.0, ts(9)), ("Slopes", "ActiveEnergyBurned", 7.0, ts(10)), ("Slopes", "ActiveEnergyBurned", 9.0, ts(10, 1)), ("x", "ActiveEnergyBurned", 9.0, ts(9))], "source string, metric string, value_num double, start_ts timestamp")
    got = {r.activity_id: r for r in activities.from_workouts(w, m).collect()}
    assert (got["apple-w1w1w1w1w1w1w1w1"].distance_km, got["apple-w1w1w1w1w1w1w1w1"].energy_kcal) == (2.0, 7.0) and got["apple-w2w2w2w2w2w2w2w2"].energy_kcal is None
    assert (got["apple-w1w1w1w1w1w1w1w1"].source, got["apple-w1w1w1w1w1w1w1w1"].activity_type) == ("apple_workout", "run")
    assert activities.daily_events(activities.from_workouts(w, m)).first().n_activities == 2


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_window_sums_meet_no_pairs(spark, kind):
    rng, base = random.Random(3), dt.datetime(1969, 12, 31, 22)
    at = lambda: base + dt.timedelta(microseconds=rng.choice([rng.randrange(20), rng.randrange(10**7), rng.randrange(10**11), rng.randrange(10**13)]))
    points = [(rng.choice([1, 2, None]), rng.choice([None, float(rng.randrange(9))]), rng.choice([None, at(), at(), at(), at()])) for _ in range(300)]
    spans = []
    for i in range(200):
        a = rng.choice([at(), rng.choice(points)[2]])
        b = rng.choice([a, at(), rng.choice(points)[2], None])
        spans.append((i if i % 9 else 7 if i % 2 else None, rng.choice([1, 2, None]), a, b))
    far = dt.datetime(2200, 1, 1)
    spans += [(1000, 1, dt.datetime(1900, 1, 1), far), (1001, 2, base, base + dt.timedelta(days=200)), (1002, 1, far, base)]
    s = spark.createDataFrame(spans, f"key int, user int, a {kind}, b {kind}")
    p = spark.createDataFrame(points, f"user int, v double, ts {kind}")
    sums = {"n": F.lit(1), "total": F.col("v")}
    for same in ((), ("user",)):
        hits = {}
        for k, u, a, b in spans:
            if k is not None and a is not None and b is not None:
                hits.setdefault(k, []).extend(v for w, v, t in points if t is not None and a <= t <= b and (not same or (u is not None and u == w)))
        want = sorted((k or -1, len(h) if (h := hits.get(k)) else None, sum(v for v in h if v is not None) if h and any(v is not None for v in h) else None) for k, *_ in spans)
        df = activities.window_sums(s, p if same else p.drop("user"), "key", "a", "b", "ts", sums, same)
        assert repr(sorted(((r.key or -1, r.n, r.total) for r in df.collect()), key=repr)) == repr(sorted(want, key=repr))
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert joins and not any(">=" in line or "<=" in line for line in joins)  # each point once, however many spans it falls into
    assert activities.window_sums(s.limit(0), p, "key", "a", "b", "ts", sums, ("user",)).count() == 0
    assert activities.window_sums(s, p.limit(0), "key", "a", "b", "ts", sums, ("user",)).where("n is not null").count() == 0


def test_retrieval_and_statistics(spark):
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.1, 0.9, 0.5])], "q_id int, doc_id int, score double")
    r = retrieval.top(s, None)
    assert [x.rank for x in r.orderBy("doc_id").collect()] == [2, 0, 1]
    fused = retrieval.top(retrieval.fuse([r, r]), 1).first()
    assert fused.doc_id == 1 and math.isclose(fused.score, 2 / 60)
    q = spark.createDataFrame([(1, 0, [1.0, 0.0])], "q_id int, q_pos int, qv array<double>")
    d = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 1.0])], "doc_id int, dv array<double>")
    assert {x.doc_id: x.score for x in retrieval.max_sim(q, d).collect()} == {0: 1.0, 1: 0.0}
    hits = spark.createDataFrame([(1, 0), (2, 3)], "q_id int, rank int")
    m = {x.q_id: x for x in stats.query_metrics(hits, spark.createDataFrame([(1, 1), (2, 2), (3, 0)], "q_id int, n_relevant int")).collect()}
    assert (m[1].s1, m[1].ndcg, m[2].s1, m[2].s5, m[2].mrr, m[3].ndcg) == (1.0, 1.0, 0.0, 1.0, 0.25, 0.0)
    pairs = lambda a, b: spark.createDataFrame([(True, False)] * a + [(False, True)] * b + [(True, True)] * 5, "a boolean, b boolean")
    assert round(stats.mcnemar(pairs(17, 7), "a", "b").first().p, 3) == 0.064 and round(stats.mcnemar(pairs(13, 4), "a", "b").first().p, 3) == 0.049 and stats.mcnemar(pairs(0, 0), "a", "b").first().p == 1.0
    v = spark.createDataFrame([("x", float(i < 88)) for i in range(100)], "g string, v double")
    b = stats.bootstrap(v, ["g"], "v", 2000).first()
    assert b.mean == 0.88 and 0.78 < b.lo < 0.86 < b.hi < 0.96
    rows = spark.createDataFrame([(0.9, True, False), (0.8, True, True), (0.5, False, True)], "cos_a double, ok_a boolean, ok_b boolean")
    f = {x.tau: x.accuracy for x in retrieval.frontier(rows, [0.0, 0.7]).collect()}
    assert math.isclose(f[0.7], 1.0) and math.isclose(f[0.0], 2 / 3)
    e = stats.exclusive_quartiles(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 6, 7)], "v double"), "v").first()
    assert tuple(e) == (2.0, 4.0, 6.0)
    t = spark.createDataFrame([(0.0, None, 50.0, None)], "a double, b double, c double, d double").select(retrieval.macros(*(F.col(x) for x in "abcd")).alias("m")).first().m
    assert t == [0.0, 0.0, 0.5, 0.0]
    assert retrieval.dense_top(q.select("q_id", "qv"), d, 2).count() == 2


def test_food_map_and_providers(spark, tmp_path):
    f = spark.createDataFrame([(1, "Apple raw", 52.0, 0.3, 0.2, 14.0), (2, "Apple pie", 240.0, 2.0, 11.0, 34.0), (3, "Beef", 250.0, 26.0, 15.0, 0.0)], "fdc_id long, description string, energy_kcal double, protein_g double, fat_g double, carbs_g double")
    f = f.join(providers.embed(f, "fdc_id", "description"), "fdc_id")
    p = spark.createDataFrame([("alma", 50.0, 0.2, 0.1, 13.0)], "product string, energy_kcal double, protein_g double, fat_g double, carbs_g double")
    en = providers.per_text(p, "product", providers.dictionary({"alma": "apple"}), "en_name")
    p = p.join(en, "product")
    p = p.join(providers.embed(p, "product", "en_name", side="query"), "product")
    got = foods.food_map(p, f).first()
    assert (got.product, got.fdc_id, got.en_name) == ("alma", 1, "apple") and 0 < got.score <= 1
    calls = []
    build = lambda d: (calls.append(d.count()), providers.embed(d, "fdc_id", "description"))[1]
    where = str(tmp_path / "cache")
    assert providers.cached(f.select("fdc_id", "description"), "fdc_id", where, build).count() == 3 and providers.cached(f.select("fdc_id", "description"), "fdc_id", where, build).count() == 3
    assert calls == [3, 0]
    short = providers.per_text(f, "description", lambda t: t[:-1], "y").where("y is null").count()
    assert short == 1


def test_lab_reports(spark, tmp_path):
    (tmp_path / "lelet_20240305.pdf").write_bytes(b"a" * 80 + b"\f" + b"b" * 10)
    pages = labs.read_pages(spark, str(tmp_path), lambda raw: raw.decode().split("\f"))
    assert pages.select(labs.triage(F.col("pages")).alias("k")).first().k == "mixed"
    reply = '{"results":[{"test_name":"TSH","value":"1,5","unit":"mIU/L","ref_low":0.4,"ref_high":4.0},{"test_name":"HPV","value":"negative"}]}'
    got = labs.extract(pages.select("path", labs.whole_text(F.col("pages")).alias("text")), lambda t: (reply, 10, 5))
    rows = labs.lab_rows(got, "offline")
    store = str(tmp_path / "labs")
    assert labs.load_panels(rows, store) == 2 and labs.load_panels(rows, store) == 0
    r = spark.read.parquet(store).where("test_name = 'TSH'").first()
    assert (r.value_num, r.panel_date, r.source_file) == (1.5, D(2024, 3, 5), "lelet_20240305.pdf")

    def broken(_):
        raise ValueError("no")

    assert labs.extract(pages.select("path", F.lit("x").alias("text")), broken).first().error == "ValueError: no"


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"k{i % 7}", "StepCount", float(i), dt.datetime(2025, 1, 1 + i % 3, 12)) for i in range(20)]
    df = spark.createDataFrame(rows, "row_key string, metric string, value_num double, start_ts timestamp")
    df.write.parquet(src)
    s = increments.file_stream(spark, src, df.schema)
    increments.ingest(s, out, str(tmp_path / "c1"))
    assert spark.read.parquet(out).count() == 7
    df.write.mode("append").parquet(src)
    increments.ingest(s, out, str(tmp_path / "c1"))
    assert spark.read.parquet(out).count() == 7
    q = increments.daily_totals(s).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert {r.n for r in spark.table("totals").collect()} == {12, 14}


def test_reports_and_schemas(spark):
    a = spark.createDataFrame([("a", 100), ("b", 50)], "name string, n long")
    e = spark.createDataFrame([("a", 101), ("b", 60), ("c", 0), ("d", 4)], "name string, n long")
    assert {r.name: r.state for r in reports.drift_report(a, e).collect()} == {"a": "OK", "b": "DRIFT", "c": "OK", "d": "DRIFT"}
    twice = spark.createDataFrame([("x", None), ("x", "exact")], "raw_name string, method string")
    assert {r.rule for r in schemas.violations(twice, "biomarker_map").collect()} == {"null method", "repeated key"}
    p = stats.prediction_scores(spark.createDataFrame([("a", "k"), ("b", None), ("c", "q")], "name string, key string"), spark.createDataFrame([("a", "k"), ("b", "z"), ("c", "r")], "name string, key string")).first()
    assert (p.abstained, p.wrong, round(p.accuracy, 3), p.precision) == (1, 1, 0.333, 0.5)


def test_spot_checks_and_counts(spark):
    m = spark.createDataFrame([("a",)] * 5, "metric string")
    assert {r.name: (r.actual, r.state) for r in reports.spot_checks(m, {"a": 5, "b": 0, "c": 3}).collect()} == {"a": (5, "OK"), "b": (0, "OK"), "c": (0, "DRIFT")}
    pages = spark.createDataFrame([("x", ["a" * 70, "b" * 80]), ("y", ["", "c" * 90]), ("z", [])], "path string, pages array<string>")
    assert {r.route: (r.files, r.pages) for r in labs.route_counts(pages).collect()} == {"text": (1, 2), "mixed": (1, 2), "scanned": (1, 0)}


def test_gold_names_and_resolvers(spark):
    from pulselake.operators import experiments
    from pulselake.operators.gold import GOLD, gold, novel

    assert len(GOLD) == 148
    g = gold(spark)
    got = analytes.resolve(g.select("name", F.lit(None).cast("string").alias("unit"))).select("name", "key")
    r = experiments.resolver_report({"rules": got}, g).first()
    assert (r.n, r.accuracy, r.wrong, r.abstained) == (148, 1.0, 0, 0)
    worse = got.withColumn("key", F.when(F.length("name") > 6, F.col("key")))
    d = experiments.disagreements(got, worse, g, 5).collect()
    assert len(d) == 5 and [x.ord for x in d] == sorted(x.ord for x in d) and all(x.key_b is None and x.key_a == x.truth for x in d)
    n = experiments.novel_ablation({"rules": analytes.resolve(novel(spark).select("name", "unit")).select("name", "key")}, novel(spark)).collect()
    assert {x.name for x in n if x.ok} >= {"HbA1c"} and len(n) == 4


def test_experiments_on_a_small_corpus(spark):
    from pulselake.operators import experiments

    v = {"a": [1.0, 0.0], "b": [0.6, 0.8], "c": [0.0, 1.0]}
    main = spark.createDataFrame([(1, v["a"], "x"), (2, v["b"], "y")], "doc_id long, dv array<double>, dkey string")
    more = spark.createDataFrame([(1, v["c"], "z"), (3, None, "z")], "doc_id long, dv array<double>, dkey string")
    both = experiments.concatenated({"m": main, "o": more})
    assert {(r.doc_id, r.corpus) for r in both.collect()} == {("m:1", "m"), ("m:2", "m"), ("o:1", "o"), ("o:3", "o")}
    q = spark.createDataFrame([(1, v["a"], "x"), (2, v["c"], "z")], "q_id long, qv array<double>, qkey string")
    got = {r.corpus: (r.n, r.s1, r.supplied) for r in experiments.corpus_ablation(q, {"m": main, "o": more}, "m", lambda a, b: a == b).collect()}
    assert got == {"m": (2, 0.5, 0), "combined": (2, 1.0, 1)}
    ranking = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 7, 0), (2, 8, 6)], "q_id long, doc_id long, rank int")
    right = spark.createDataFrame([(1, 6), (2, 8), (2, 8)], "q_id long, doc_id long")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "q_id long")
    r = experiments.recall_at(ranking, right, asked).first()
    assert (r.r1, round(r.r5, 4), round(r.r10, 4), round(r.mrr, 4)) == (0.0, 0.3333, 0.6667, round((1 / 2 + 1 / 7) / 3, 4))
    assert experiments.outcomes(ranking, right, asked).count() == 3


def test_first_ranks_by_words_meet_equal_texts_once(spark):
    """The same ranks as from all scores, with copies, ties, an empty and a missing text."""
    from pyspark.sql import functions as F

    from pulselake.operators import retrieval

    said = ["red bolt", "blue bolt old", "red red ring", "", None, "old ring of brass"]
    docs = spark.createDataFrame([(i, said[i * 7 % 6]) for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, "old old brass"), (4, "none such"), (5, None)], "q_id long, q_text string")
    want = retrieval.top(retrieval.bm25(asked, docs).withColumn("score", F.round("score", 6)), 8).select("q_id", "doc_id", "score", "rank")
    got = retrieval.bm25_top(asked, docs, 8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_ablation_leaves_out_a_query_s_own_row_only(spark):
    """Query 1's best row but its own is query 2's, which no other query may take out of the corpus."""
    from pulselake.operators import experiments

    main = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "x"), (3, [0.0, 1.0], "y")], "doc_id long, dv array<double>, dkey string")
    more = spark.createDataFrame([(2, [0.9, 0.1], "z"), (4, [0.0, 0.5], "z")], "doc_id long, dv array<double>, dkey string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "x")], "q_id long, qv array<double>, qkey string")
    got = {r.corpus: (r.n, r.s1, r.supplied) for r in experiments.corpus_ablation(q, {"m": main, "o": more}, "m", lambda a, b: a == b, itself=False).collect()}
    assert got == {"m": (2, 1.0, 0), "combined": (2, 1.0, 0)}


def test_late_interaction_over_ragged_documents(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    docs = [(i, rnd.normal(size=(1 + i % 4, 5)).round(3)) for i in range(40)]
    asked = [(q, p, rnd.normal(size=5).round(3)) for q in range(3) for p in range(2 + q)]
    tokens = spark.createDataFrame([(i, row.tolist()) for i, m in docs for row in m], "doc_id long, dv array<double>")
    queries = spark.createDataFrame([(q, p, v.tolist()) for q, p, v in asked], "q_id long, q_pos int, qv array<double>")
    want = {}
    for q in range(3):
        s = sorted(((-round(sum(float(np.max(m.astype(np.float32).astype(float) @ v)) for qq, _, v in asked if qq == q), 4), i) for i, m in docs))[:7]
        want[q] = [i for _, i in s]
    got = {}
    for r in retrieval.late_top(queries, retrieval.ragged(tokens), 7, block=3, digits=4).collect():
        got.setdefault(r.q_id, []).append((r["rank"], r.doc_id))
    assert {q: [d for _, d in sorted(x)] for q, x in got.items()} == want
    plain = retrieval.top(retrieval.max_sim(queries, tokens.select("doc_id", F.col("dv").cast("array<float>").alias("dv"))).withColumn("score", F.round("score", 4)), 7)
    assert {(r.q_id, r.doc_id) for r in plain.collect()} == {(q, d) for q, x in want.items() for d in x}
    assert retrieval.late_top(queries, retrieval.ragged(tokens.limit(0)), 7).count() == 0


def test_text_cache_and_token_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "one text"), (2, "other"), (3, None), (4, "")], "id long, text string")
    asked = str(tmp_path / "cache")
    first = providers.text_cache(df, "id", "text", asked, lambda t: [x + "!" for x in t], "said")
    assert {r.id: r.said for r in first.collect()} == {1: "one text!", 2: "other!", 4: "!"}
    changed = df.withColumn("text", F.when(F.col("id") == 2, "new").otherwise(F.col("text")))
    again = providers.text_cache(changed, "id", "text", asked, lambda t: [x + "?" for x in t], "said")
    assert {r.id: r.said for r in again.collect()} == {1: "one text!", 2: "new?", 4: "!"}
    sizes = {r.id: len(r.tokens) for r in providers.encode_tokens(df, "id", "text", providers.hashed_tokens).collect()}
    assert sizes == {1: 2, 2: 1, 3: 0, 4: 0}


def test_first_write_wins_wherever_the_rows_are(spark):
    rows = [("k", "b"), ("k", "a"), ("k", "c"), ("l", "z")]
    df = spark.createDataFrame(rows, "row_key string, v string")
    empty = df.limit(0)
    picks = {tuple(sorted((r.row_key, r.v) for r in keys.new_rows(df.repartition(n), empty, "row_key").collect())) for n in (1, 3, 7)}
    assert len(picks) == 1
    assert [r.v for r in keys.new_rows(df, empty, "row_key", [F.col("v")]).orderBy("row_key").collect()] == ["a", "z"]


def test_keys_and_required_columns_are_enforced_at_write(spark, tmp_path):
    good = spark.createDataFrame([("x", "exact", 1), ("y", "none", 0)], "raw_name string, method string, score int")
    schemas.write(good, "biomarker_map", str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.columns == ["raw_name", "canonical_key", "method", "score"] and dict(back.dtypes)["score"] == "double" and back.count() == 2
    for bad in (good.union(good), good.withColumn("method", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="biomarker_map"):
            schemas.write(bad, "biomarker_map", str(tmp_path / "b"))
    assert not (tmp_path / "b").exists()
