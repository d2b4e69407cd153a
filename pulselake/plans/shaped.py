"""Queries that give the library's own operators the star schema in the shape of their tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import activities, analytes, cycles, experiments, foods, graph, keys, marts, normalize, ranges, reports, retrieval, stats
from ..operators.gold import GOLD, NOVEL, gold, novel
from ..sources import exports, labs
from .registry import DAY, ZONE, exact, query, read


def quoted(x) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def sql_list(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def sql_rows(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def pick(values, at) -> F.Column:
    """The value at a column's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int") + 1)


# --- measurements: events by metric; a category value for those that have some, one of them unknown ---

METRICS = (*marts.ACTIVITY, *marts.NUTRITION, "BasalBodyTemperature", "MenstrualFlow", "CervicalMucusQuality", "OvulationTestResult", "IntermenstrualBleeding", "HeadphoneAudioExposureEvent")
UNKNOWN = "HKCategoryValueOfAnotherKind"
VALUES = {m: [v for k, v, *_ in normalize.CATEGORY_VALUES if k == m] + [UNKNOWN] for m in METRICS if any(k == m for k, *_ in normalize.CATEGORY_VALUES)}


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    metric, turn = pick(METRICS, F.col("event_id")), F.floor(F.col("event_id") / len(METRICS))
    value = F.lit(None).cast("string")
    for m, values in VALUES.items():
        value = F.when(metric == m, pick(values, turn)).otherwise(value)
    number = F.when(value.isNull(), F.round("value"))
    group = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("c"), "user_id", F.lit("-"), F.col("event_id") % 4))
    return e.select(
        F.col("event_id").cast("string").alias("row_key"), metric.alias("metric"), F.when(value.isNull(), "quantity").otherwise("category").alias("record_kind"), number.alias("value_num"), value.alias("value_str"),
        F.col("ts").alias("start_ts"), F.concat(F.lit("source "), F.col("user_id") % 3).alias("source"), group.alias("correlation_id"), F.concat(F.lit("u"), F.col("event_id") % 3).alias("unit"),
    )


_RAW = "case metric " + " ".join(f"when '{m}' then {sql_list(v)}[event_id // {len(METRICS)} % {len(v)} + 1]" for m, v in VALUES.items()) + " end"
MEASUREMENTS = f"""m as (select *, case when value_str is null then round(value) end as value_num, case when value_str is null then 'quantity' else 'category' end as record_kind from (
  select event_id, event_id::varchar as row_key, user_id, ts, value, metric, {_RAW} as value_str, {DAY} as day, 'source ' || (user_id % 3) as source, case when event_id % 5 <> 0 then 'c' || user_id || '-' || (event_id % 4) end as correlation_id,
  'u' || (event_id % 3) as unit from (select *, {sql_list(METRICS)}[event_id % {len(METRICS)} + 1] as metric from events))),
cv(metric, value_str, label, ordinal) as {sql_rows(normalize.CATEGORY_VALUES)},
mc as (select m.*, label as value_label, ordinal as value_ordinal from m left join cv using (metric, value_str))"""


def _sums(names: dict[str, str]) -> str:
    return ", ".join(f"sum(value_num) filter (where metric = '{m}') as {c}" for m, c in names.items())


ACTIVITY_SQL = f"""a as (select day as a_day, {_sums(marts.ACTIVITY)} from m where metric in ({', '.join(map(quoted, marts.ACTIVITY))}) group by 1),
su as (select o_orderdate::date as s_day, count(*)::double as exercise_min, max(o_custkey % 24)::double as stand_hours, min(o_custkey % 90)::double as move_time from orders group by 1
  union all select distinct {DAY}, 30.0, 12.0, null::double from events where user_id = 3),
da as (select coalesce(a_day, s_day) as day, {', '.join(marts.ACTIVITY.values())}, exercise_min, stand_hours, move_time from a full outer join su on a_day = s_day)"""
NUTRITION_SQL = f"dn as (select day, {_sums(marts.NUTRITION)}, count(distinct correlation_id) as meals_logged from m where metric like 'Dietary%' group by 1)"


def day_summaries(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    o = o.groupBy(F.to_date("o_orderdate").cast("string").alias("date_components")).agg(F.count("*").cast("double").alias("exercise_time"), F.max(F.col("o_custkey") % 24).cast("double").alias("stand_hours"), F.min(F.col("o_custkey") % 90).cast("double").alias("move_time"))
    e = read(spark, sf_dir, "events").where("user_id = 3").select(scalars.local_day("ts", ZONE, naive=True).cast("string").alias("date_components"), F.lit(30.0).alias("exercise_time"), F.lit(12.0).alias("stand_hours"), F.lit(None).cast("double").alias("move_time"))
    return o.union(e.distinct())


@query(f"with {MEASUREMENTS}, {ACTIVITY_SQL} select * from da")
def q_activity_mart(spark, sf_dir):
    return marts.daily_activity(measurements(spark, sf_dir), day_summaries(spark, sf_dir), ZONE)


@query(f"with {MEASUREMENTS}, {NUTRITION_SQL} select * from dn")
def q_nutrition_mart(spark, sf_dir):
    return marts.daily_nutrition(measurements(spark, sf_dir), ZONE)


@query(f"with {MEASUREMENTS}, {ACTIVITY_SQL}, {NUTRITION_SQL} select steps >= 500 as active, round(avg(protein_g), 6) as avg_protein_g, count(*) as days from da join dn using (day) group by 1")
def q_protein_by_activity(spark, sf_dir):
    m = measurements(spark, sf_dir)
    p = marts.protein_by_activity(marts.daily_activity(m, day_summaries(spark, sf_dir), ZONE), marts.daily_nutrition(m, ZONE), 500)
    return p.select("active", F.round("avg_protein_g", 6).alias("avg_protein_g"), "days")


@query(f"""with {MEASUREMENTS} select source, day, round(avg(value_num) filter (where metric = 'BasalBodyTemperature'), 6) as bbt_c, max(value_ordinal) filter (where metric = 'MenstrualFlow') as flow_ordinal,
  max(value_ordinal) filter (where metric = 'CervicalMucusQuality') as mucus_ordinal, bool_or(metric = 'IntermenstrualBleeding') as intermenstrual_bleeding, bool_or(metric = 'OvulationTestResult' and value_label in ('lh_surge', 'positive')) as lh_surge
  from mc where metric in ('BasalBodyTemperature', 'MenstrualFlow', 'CervicalMucusQuality', 'IntermenstrualBleeding', 'OvulationTestResult') group by 1, 2""")
def q_cycle_signals(spark, sf_dir):
    d = marts.cycle_days(normalize.categorized(measurements(spark, sf_dir)), ZONE, ("source",))
    return d.withColumn("bbt_c", F.round("bbt_c", 6))


@query(f"with {MEASUREMENTS} select row_key, metric, value_str, value_num, value_label, value_ordinal::int as value_ordinal from mc")
def q_categorized(spark, sf_dir):
    return normalize.categorized(measurements(spark, sf_dir)).select("row_key", "metric", "value_str", "value_num", "value_label", "value_ordinal")


@query(f"with {MEASUREMENTS} select metric, value_label as label, min(value_ordinal)::int as ordinal, count(*) as n from mc where value_label is not null group by 1, 2")
def q_mapping_audit(spark, sf_dir):
    return reports.mapping_audit(normalize.categorized(measurements(spark, sf_dir)))


@query(f"with {MEASUREMENTS} select metric, value_str, count(*) as n from mc where value_str is not null and value_label is null group by 1, 2")
def q_unmapped_values(spark, sf_dir):
    return normalize.unmapped(measurements(spark, sf_dir))


@query(f"with {MEASUREMENTS} select metric, min(record_kind) as record_kind, count(*) as n_rows, count(distinct source) as n_sources, min(ts) as first_ts, max(ts) as last_ts, string_agg(distinct unit, ', ' order by unit) as units from m group by 1")
def q_catalog_of_metrics(spark, sf_dir):
    return reports.metric_catalog(measurements(spark, sf_dir))


_SPOTS = (("StepCount", 590), ("DietaryProtein", 100), ("NoSuchMetric", 0), ("MenstrualFlow", 588))


@query(f"with {MEASUREMENTS}, x(name, expected) as {sql_rows(_SPOTS)} select name, count(row_key) as actual, any_value(expected) as expected, case when case when any_value(expected) = 0 then count(row_key) = 0 else abs(count(row_key) - any_value(expected)) <= 0.02 * any_value(expected) end then 'OK' else 'DRIFT' end as state from x left join m on metric = name group by 1")
def q_spot_checks(spark, sf_dir):
    return reports.spot_checks(measurements(spark, sf_dir), dict(_SPOTS))


@query(f"with {MEASUREMENTS} select m.row_key, m.metric from m where event_id % 3 = 0 and not exists (select 1 from m t where t.event_id % 2 = 0 and t.row_key = m.row_key)")
def q_new_rows(spark, sf_dir):
    m = measurements(spark, sf_dir)
    batch = m.where("cast(row_key as long) % 3 = 0")
    return keys.new_rows(batch.unionByName(batch), m.where("cast(row_key as long) % 2 = 0"), "row_key").select("row_key", "metric")


@query("select 'null source' as rule, count(*) as n from events where user_id % 7 = 0 union all select 'repeated key', count(*) from (select event_id // 3 as k from events group by 1 having count(*) > 1)")
def q_violations(spark, sf_dir):
    from ..schemas import violations

    m = measurements(spark, sf_dir)
    user = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("row_key"), "user_id")
    bad = m.join(user, "row_key").withColumn("source", F.when(F.col("user_id") % 7 != 0, F.col("source"))).withColumn("row_key", F.floor(F.col("row_key").cast("long") / 3).cast("string")).drop("user_id")
    return violations(bad, "measurements")



# --- laboratory results: line items as results of a day, named by the gold list ---

NAMES = tuple(GOLD)
UNITS = ("mmol/L", "g/L", "/ltr(H)", None)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name goes by part and the unit by name, so a name has one unit; a part is a panel's analyte and its bounds move with the tax."""
    l, turn = read(spark, sf_dir, "lineitem"), F.col("l_partkey") % len(NAMES)
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate"), (F.col("l_extendedprice") * 100).cast("long")).alias("row_key"), F.to_date("l_shipdate").alias("panel_date"), pick(NAMES, F.col("l_partkey")).alias("test_name"), pick(UNITS, turn).alias("unit"),
        F.col("l_quantity").alias("value_num"), F.col("l_returnflag").alias("flag"), F.floor(F.col("l_tax") * 50).cast("double").alias("ref_low"), (F.floor(F.col("l_tax") * 50) + 30).cast("double").alias("ref_high"),
    )


#: The sediment's two names mean the blood's counts unless the unit is per litre of sediment.
_TRUTH = [(n, k) for n, k in GOLD.items()]
RESULTS = f"""gold(test_name, canonical_key) as {sql_rows(_TRUTH)}, reg(canonical_key, biomarker, category, canonical_unit) as {sql_rows((r[0], r[1], r[2], r[3]) for r in analytes.REGISTRY)},
lr as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::date, trunc(l_extendedprice * 100)::bigint) as row_key, l_shipdate::date as panel_date, {sql_list(NAMES)}[l_partkey % {len(NAMES)} + 1] as test_name, {sql_list(UNITS)}[l_partkey % {len(NAMES)} % {len(UNITS)} + 1] as unit,
  l_quantity as value_num, l_returnflag as flag, floor(l_tax * 50)::double as ref_low, floor(l_tax * 50)::double + 30 as ref_high from lineitem),
rc as (select lr.*, canonical_key, biomarker, category, canonical_unit from lr left join gold using (test_name) left join reg using (canonical_key))"""


def canonical_results(spark, sf_dir, names: DataFrame | None = None) -> DataFrame:
    r = results(spark, sf_dir)
    return analytes.canonical(r, names if names is not None else analytes.analyte_map(r))


@query(f"with {RESULTS} select distinct test_name as raw_name, canonical_key from rc")
def q_analyte_map(spark, sf_dir):
    return analytes.analyte_map(results(spark, sf_dir)).select("raw_name", "canonical_key")


@query(f"with {RESULTS} select row_key, test_name, canonical_key, biomarker, category, canonical_unit from rc")
def q_canonical(spark, sf_dir):
    return canonical_results(spark, sf_dir).select("row_key", "test_name", "canonical_key", "biomarker", "category", "canonical_unit")


@query(f"with {RESULTS} select category, count(distinct canonical_key) as biomarkers, count(*) as results from rc where category is not null group by 1")
def q_category_rollup(spark, sf_dir):
    return analytes.category_rollup(canonical_results(spark, sf_dir))


@query(f"with {RESULTS} select canonical_key, count(distinct panel_date) as n_dates from rc group by 1 having count(distinct panel_date) >= 3")
def q_trendable(spark, sf_dir):
    return analytes.trendable(canonical_results(spark, sf_dir))


def _alias_keys(spark) -> DataFrame:
    """A second resolver: exact aliases only."""
    idx = analytes.alias_index(analytes.registry(spark))
    return gold(spark).withColumn("norm", text.lab_name(F.col("name"))).join(F.broadcast(idx.select("norm", F.col("key").alias("found"))), "norm", "left").select("name", F.col("found").alias("key"))


def _rule_keys(spark, names: DataFrame) -> DataFrame:
    return analytes.resolve(names).select("name", "key")


_LAB_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(strip_accents({c}))), '\s*\(a\)\s*$', ''), '([#%])', ' \1 ', 'g'), '[()\[\],/.''`´-]', ' ', 'g'), '\s+', ' ', 'g'))"
_ALIASES = [(i, j, r[0], a) for i, r in enumerate(analytes.REGISTRY) for j, a in enumerate((r[1], *r[5]), -1)]
RESOLVERS = f"""g(ord, name, key) as {sql_rows((i, n, k) for i, (n, k) in enumerate(GOLD.items()))}, al(ord, pos, key, alias) as {sql_rows(_ALIASES)},
ix as (select norm, arg_min(key, ord * 1000 + pos) as key from (select *, {_LAB_NORM.format(c='alias')} as norm from al) group by 1),
ex as (select g.ord, g.name, ix.key as key_b, g.key as truth from g left join ix on norm = {_LAB_NORM.format(c='name')})"""


@query(f"""with {RESOLVERS}, s(resolver, name, key, truth) as (select 'rules', name, truth, truth from ex union all select 'aliases', name, key_b, truth from ex)
select resolver, count(*) as n, round(count_if(key = truth) / count(*), 6) as accuracy, round(count_if(key = truth) / count(key), 6) as precision, round(count_if(key = truth) / count(truth), 6) as recall, count(*) - count(key) as abstained, count_if(key <> truth) as wrong from s group by 1""")
def q_resolver_scores(spark, sf_dir):
    g = gold(spark)
    rules = _rule_keys(spark, g.select("name", F.lit(None).cast("string").alias("unit")))
    return experiments.resolver_report({"rules": rules, "aliases": _alias_keys(spark)}, g)


@query(f"with {RESOLVERS} select ord, name, truth as key_a, key_b, truth from ex where key_b is distinct from truth order by ord limit 12")
def q_disagreements(spark, sf_dir):
    g = gold(spark)
    return experiments.disagreements(_rule_keys(spark, g.select("name", F.lit(None).cast("string").alias("unit"))), _alias_keys(spark), g)


_RULED = {n: k for n, _, k in NOVEL}


@query(f"select * from {sql_rows([(i, n, k, 'rules') for i, (n, _, k) in enumerate(NOVEL)])} t(ord, name, expected, resolver)")
def q_novel_names(spark, sf_dir):
    """Names that no alias covers; what the rules make of them stands in tests, the ratio of matching blocks has no SQL form."""
    n = novel(spark)
    return experiments.novel_ablation({"rules": _rule_keys(spark, n.select("name", "unit"))}, n).select("ord", "name", "expected", "resolver")


RANGES = f"""{RESULTS}, q as (select distinct canonical_key as key, panel_date as day, ref_low as low, ref_high as high, canonical_unit as unit from rc),
r as (select *, case when row_number() over w = 1 then 1 when lag(low) over w is not distinct from low and lag(high) over w is not distinct from high then 0 else 1 end as ch from q window w as (partition by key order by day, low, high)),
e0 as (select key, min(low) as ref_low, min(high) as ref_high, min(unit) as unit, count(*) as n_panels, min(day) as valid_from, max(day) as last_seen from (select *, sum(ch) over (partition by key order by day) as reign from r) group by key, reign),
e as (select *, (lead(valid_from) over (partition by key order by valid_from) - 1)::date as valid_to, key || '_ref' || row_number() over (partition by key order by valid_from) as id from e0)"""


@query(f"with {RANGES} select key, ref_low, ref_high, unit, n_panels, valid_from, valid_to, case when 17.0 < ref_low then 'low' when 17.0 > ref_high then 'high' else 'normal' end as status from e where key in ('tsh', 'ferritin', 'glucose_fasting') and valid_from <= date '1999-03-01' and (valid_to is null or date '1999-03-01' <= valid_to)")
def q_point_asof(spark, sf_dir):
    eras = ranges.reigns(canonical_results(spark, sf_dir))
    out = None
    for key in ("tsh", "ferritin", "glucose_fasting"):
        one = ranges.as_of(eras, key, "1999-03-01").crossJoin(F.broadcast(ranges.evaluate(eras, key, "1999-03-01", 17.0)))
        out = one if out is None else out.union(one)
    return out.select("key", "ref_low", "ref_high", "unit", "n_panels", "valid_from", "valid_to", "status")


# --- foods: parts as foods and products, line items as amounts, ingredients and the log ---

DATA_TYPES = (*foods.CURATED, "branded_food")
NUTRIENT_IDS = tuple(n[0] for n in foods.NUTRIENTS) + (9999,)
CATEGORIES = ((0, "Fruits"), (1, "Dairy"), (2, "Bakery"))


def food_tables(spark, sf_dir) -> dict[str, DataFrame]:
    p, l = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    return {
        "food": p.select(F.col("p_partkey").alias("fdc_id"), pick(DATA_TYPES, F.col("p_size")).alias("data_type"), F.col("p_name").alias("description"), (F.col("p_size") % 5).cast("long").alias("food_category_id")),
        "food_category": spark.createDataFrame(CATEGORIES, "id long, description string"),
        "food_nutrient": l.select(F.col("l_partkey").alias("fdc_id"), pick(NUTRIENT_IDS, F.col("l_suppkey")).alias("nutrient_id"), F.col("l_quantity").alias("amount")),
        "input_food": l.select(F.col("l_partkey").alias("fdc_id"), F.col("l_linenumber").alias("seq_num"), F.when(F.col("l_tax") > 0, F.concat(F.lit(" Item "), "l_returnflag", "l_linestatus", F.lit(" "))).alias("sr_description"), F.col("l_quantity").alias("gram_weight")),
    }


def food_table(spark, sf_dir) -> DataFrame:
    t = food_tables(spark, sf_dir)
    return foods.foods(t["food"], t["food_category"], t["food_nutrient"])


_NUTRIENTS = ", ".join(f"max(amount) filter (where nutrient_id = {n[0]}) as {n[1]}" for n in foods.NUTRIENTS)
FOODS = f"""fo as (select p_partkey as fdc_id, {sql_list(DATA_TYPES)}[p_size % {len(DATA_TYPES)} + 1] as data_type, p_name as description, p_size % 5 as food_category_id from part),
fn as (select l_partkey as fdc_id, {sql_list(NUTRIENT_IDS)}[l_suppkey % {len(NUTRIENT_IDS)} + 1] as nutrient_id, l_quantity as amount from lineitem), fc(food_category_id, category) as {sql_rows(CATEGORIES)},
wd as (select fdc_id, {_NUTRIENTS} from fn where nutrient_id <> 9999 group by 1),
fd as (select fdc_id, description, data_type, category, {', '.join(n[1] for n in foods.NUTRIENTS)} from fo join wd using (fdc_id) left join fc using (food_category_id) where data_type in ({', '.join(map(quoted, foods.CURATED))})),
il as (select l_partkey as fdc_id, l_linenumber as seq_num, lower(trim(' Item ' || l_returnflag || l_linestatus || ' ')) as ingredient_key, ' Item ' || l_returnflag || l_linestatus || ' ' as ingredient_name, l_quantity as gram_weight from lineitem where l_tax > 0 and l_partkey in (select fdc_id from fd))"""


@query(f"with {FOODS} select * from fd")
def q_foods(spark, sf_dir):
    return food_table(spark, sf_dir)


@query(f"with {FOODS} select ingredient_key as key, min(ingredient_name) as name, count(distinct fdc_id) as n_foods from il group by 1")
def q_ingredients(spark, sf_dir):
    return foods.ingredients(foods.ingredient_links(food_tables(spark, sf_dir)["input_food"], food_table(spark, sf_dir)))


_SOLD = ("en:france", "en:hungary,en:france", "en:germany", None, "en:austria")


@query(f"""with raw as (select p_partkey::varchar as code, case when p_size % 11 = 0 then ' ' else ' ' || p_name || ' ' end as product_name, case when p_size % 3 > 0 then p_brand end as brands, p_type as categories_tags, {sql_list(_SOLD)}[p_partkey % 5 + 1] as countries_tags, p_size::varchar as energy from part),
u as (select *, row_number() over (partition by lower(trim(product_name)), lower(coalesce(brands, '')) order by code) as rn from raw where (contains(countries_tags, 'en:hungary') or contains(countries_tags, 'en:germany') or contains(countries_tags, 'en:austria')) and length(trim(product_name)) >= 2)
select code as off_code, trim(product_name) as description, nullif(trim(brands), '') as brands, categories_tags as categories, energy::double as energy_kcal, try_cast(case when energy::int % 2 = 0 then energy || ' g' else energy || '.5' end as double) as protein_g, null::double as fat_g, (energy || 'e-1')::double as carbs_g from u where rn = 1""")
def q_open_products(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    raw = p.select(
        F.col("p_partkey").cast("string").alias("code"), F.when(F.col("p_size") % 11 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("product_name"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("brands"),
        F.col("p_type").alias("categories_tags"), pick(_SOLD, F.col("p_partkey")).alias("countries_tags"), size.alias("energy-kcal_100g"), F.concat(size, F.when(F.col("p_size") % 2 == 0, " g").otherwise(".5")).alias("proteins_100g"),
        F.lit("").alias("fat_100g"), F.concat(size, F.lit("e-1")).alias("carbohydrates_100g"),
    )
    return foods.open_products(raw)


MEALS = ("breakfast", "lunch", "dinner")


def food_log(spark, sf_dir) -> DataFrame:
    l, q = read(spark, sf_dir, "lineitem"), F.col("l_quantity")
    return l.select(
        F.to_date("l_shipdate").alias("log_date"), F.when(F.col("l_linenumber") > 2, F.concat(F.lit("1"), F.col("l_linenumber"), F.lit(":30"))).alias("log_time"), pick(MEALS, F.col("l_linenumber")).alias("meal"),
        F.concat(F.lit("product "), F.col("l_partkey") % 40).alias("product"), q.alias("amount"), F.lit("g").alias("unit"), F.lit(1.0).alias("portions"), (q / 2).alias("kcal_total"), (q / 4).alias("protein_total"), F.when(F.col("l_tax") > 0, q / 8).alias("carbs_total"), (q / 16).alias("fat_total"),
        F.floor(q / 10).alias("kcal_per_g"), F.floor(q / 20).alias("protein_per_g"), F.floor(q / 30).alias("fat_per_g"), F.floor(q / 40).alias("carbs_per_g"),
    )


LOG = f"""yl as (select l_shipdate::date as log_date, case when l_linenumber > 2 then '1' || l_linenumber || ':30' end as log_time, {sql_list(MEALS)}[l_linenumber % 3 + 1] as meal, 'product ' || (l_partkey % 40) as product, l_quantity as amount, 1.0 as portions,
  l_quantity / 2 as kcal_total, l_quantity / 4 as protein_total, case when l_tax > 0 then l_quantity / 8 end as carbs_total, l_quantity / 16 as fat_total, l_shipdate::date::varchar || '|' || {sql_list(MEALS)}[l_linenumber % 3 + 1] as meal_id, l_quantity as q from lineitem)"""


@query(f"with {LOG} select product, round(avg(floor(q / 10)) * 100, 1) as energy_kcal, round(avg(floor(q / 20)) * 100, 2) as protein_g, round(avg(floor(q / 30)) * 100, 2) as fat_g, round(avg(floor(q / 40)) * 100, 2) as carbs_g, count(*) as times_logged from yl group by 1")
def q_logged_products(spark, sf_dir):
    return foods.logged_products(food_log(spark, sf_dir))


# --- activities ---

SPORTS = ("DownhillSkiing", "Running", "Cycling")


def workouts(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(
        F.sha1(F.col("event_id").cast("string")).alias("row_key"), pick(SPORTS, F.col("event_id")).alias("workout_type"), F.col("ts").alias("start_ts"), F.expr("ts + interval 5 hours").alias("end_ts"),
        scalars.seconds(F.round("value"), F.when(F.col("user_id") % 2 == 0, "MIN").otherwise("s")).alias("duration_s"), F.concat(F.lit("w"), "user_id").alias("source"),
    )


def points(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type <> 'purchase'")
    return e.select(F.lit("Slopes").alias("source"), F.when(F.col("event_type") == "view", "DistanceDownhillSnowSports").when(F.col("event_type") == "click", "ActiveEnergyBurned").otherwise("StepCount").alias("metric"), F.round("value").alias("value_num"), F.col("ts").alias("start_ts"))


ACTIVITIES = f"""wo as (select sha1(event_id::varchar) as row_key, {sql_list(SPORTS)}[event_id % 3 + 1] as workout_type, ts, ts + interval 5 hour as end_ts, case when user_id % 2 = 0 then round(value) * 60 else round(value) end as duration_s, {DAY} as day from events where event_type = 'purchase'),
pt as (select ts as p_ts, event_type, round(value) as v from events where event_type in ('view', 'click')),
hi as (select row_key, sum(v) filter (where event_type = 'view') as distance_km, sum(v) filter (where event_type = 'click') as energy_kcal from wo join pt on p_ts between ts and end_ts group by 1),
ac as (select 'apple-' || row_key[1:16] as activity_id, case workout_type when 'DownhillSkiing' then 'ski' else lower(workout_type) end as activity_type, ts, duration_s, distance_km, energy_kcal, day from wo left join hi using (row_key))"""


def activity_table(spark, sf_dir) -> DataFrame:
    return activities.from_workouts(workouts(spark, sf_dir), points(spark, sf_dir))


@query(f"with {ACTIVITIES} select activity_id, activity_type, duration_s, distance_km, energy_kcal from ac")
def q_workouts(spark, sf_dir):
    return activity_table(spark, sf_dir).select("activity_id", "activity_type", "duration_s", "distance_km", "energy_kcal")


@query(f"with {ACTIVITIES} select day, count(*) as n_activities, round(sum(duration_s) / 60.0, 6) as active_minutes, sum(distance_km) as distance_km, string_agg(distinct activity_type, ', ' order by activity_type) as activity_types from ac group by 1")
def q_daily_activities(spark, sf_dir):
    return activities.daily_events(activity_table(spark, sf_dir), ZONE).withColumn("active_minutes", F.round("active_minutes", 6))


# --- the property graph over all of these ---


def phase_days(spark, sf_dir, acts: DataFrame) -> DataFrame:
    """A phase for every day with line items or activities, dealt by the day's number."""
    days = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).union(acts.select(scalars.local_day("start_ts", ZONE).alias("day"))).distinct()
    n = F.datediff("day", F.lit("1990-01-01").cast("date"))
    return days.select("day", pick(graph.PHASES, n).alias("phase"), (n % 28 + 1).cast("int").alias("cycle_day"), F.lit("unknown").alias("fertility_zone"))


def food_mapping(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_partkey < 40").select(F.concat(F.lit("product "), "p_partkey").alias("product"), F.col("p_partkey").alias("fdc_id"))


def whole_graph(spark, sf_dir, names: DataFrame | None = None) -> graph.Graph:
    c = canonical_results(spark, sf_dir, names)
    food, acts = food_table(spark, sf_dir), activity_table(spark, sf_dir)
    links = foods.ingredient_links(food_tables(spark, sf_dir)["input_food"], food)
    m = measurements(spark, sf_dir)
    tables = {
        "lab_results_canonical": c, "biomarker_registry": analytes.registry(spark), "biomarker_reference_ranges": ranges.reigns(c), "foods": food, "ingredients": foods.ingredients(links), "food_ingredients": links,
        "yazio_log": food_log(spark, sf_dir), "food_map": food_mapping(spark, sf_dir), "activities": acts, "cycle_phases": phase_days(spark, sf_dir, acts), "measurements": m, "measurements_categorized": normalize.categorized(m),
    }
    return graph.Graph(spark, tables, ZONE)


_OBSERVED = ", ".join(map(quoted, graph.OBSERVED))
GRAPH = f"""{RANGES}, {FOODS}, {LOG}, {ACTIVITIES}, {MEASUREMENTS},
ph as (select day, {sql_list(graph.PHASES)}[(day - date '1990-01-01') % 5 + 1] as phase from (select l_shipdate::date as day from lineitem union select day from ac)),
ob as (select metric, day from mc where metric in ({_OBSERVED}) group by 1, 2 union all select metric, day from mc where metric = 'BasalBodyTemperature' group by 1, 2),
dy as (select day from ph union select panel_date from rc union select log_date from yl union select day from ac union select day from ob),
fm as (select 'product ' || p_partkey as product, p_partkey as fdc_id from part where p_partkey < 40 and p_partkey in (select fdc_id from fd)),
ea as (select meal_id, fdc_id, sum(amount) as grams, sum(portions) as portions from yl join fm using (product) group by 1, 2),
hn as (select fdc_id, key, per_100g from (select fdc_id, {', '.join(f'{c}::double as {k}' for _, c, k, *_ in foods.NUTRIENTS)} from fd) unpivot (per_100g for key in ({', '.join(n[2] for n in foods.NUTRIENTS)}))),
it as (select day, key, amount from (select log_date as day, sum(kcal_total) as energy, sum(protein_total) as protein, sum(carbs_total) as carbohydrate, sum(fat_total) as fat from yl group by 1) unpivot (amount for key in (energy, protein, carbohydrate, fat))),
co as (select meal_id, key, amount from (select meal_id, sum(kcal_total) as energy, sum(protein_total) as protein, sum(carbs_total) as carbohydrate, sum(fat_total) as fat from yl group by 1) unpivot (amount for key in (energy, protein, carbohydrate, fat)))"""


@query(f"""with {GRAPH}, n as (select 'Day' as "table", count(*) as n from dy union all select 'CyclePhase', {len(graph.PHASES)} union all select 'Biomarker', count(*) from reg union all select 'LabResult', count(*) from rc union all select 'ReferenceRange', count(*) from e
  union all select 'Nutrient', {len(foods.NUTRIENTS)} union all select 'Food', count(*) from fd union all select 'Meal', count(distinct meal_id) from yl union all select 'Ingredient', count(distinct ingredient_key) from il union all select 'Symptom', {len(graph.SYMPTOMS)} union all select 'Activity', count(*) from ac
  union all select 'MEASURED_AS', count(canonical_key) from rc union all select 'RESULT_ON', count(*) from rc union all select 'REF_FOR', count(*) from e union all select 'IN_PHASE', count(*) from ph union all select 'PERFORMED_ON', count(*) from ac union all select 'INTAKE_ON', count(*) from it
  union all select 'LOGGED_ON', count(distinct meal_id) from yl union all select 'CONTAINS', count(*) from co union all select 'COMPOSED_OF', count(*) from (select distinct fdc_id, ingredient_key from il) union all select 'EATEN', count(*) from ea union all select 'HAS_NUTRIENT', count(*) from hn union all select 'OBSERVED_ON', count(*) from ob) select * from n""")
def q_graph_counts(spark, sf_dir):
    return whole_graph(spark, sf_dir).counts()


@query(f"with {RANGES} select 'MEASURED_AS' as edge, 'dst' as side, count(*) as n from rc where category <> 'thyroid' union all select 'REF_FOR', 'dst', count(*) from e where key not in (select canonical_key from reg where category = 'thyroid')")
def q_graph_dangling(spark, sf_dir):
    """A graph that knows the thyroid's analytes only: the ends of all other results and ranges hang in the air."""
    c = canonical_results(spark, sf_dir)
    return graph.Graph(spark, {"lab_results_canonical": c, "biomarker_registry": analytes.registry(spark).where("category = 'thyroid'"), "biomarker_reference_ranges": ranges.reigns(c)}, ZONE).dangling()


@query(f"with {RANGES} select id, ref_low as low, ref_high as high, unit, n_panels, valid_from, valid_to from e where key = 'tsh'")
def q_ranges_of(spark, sf_dir):
    return whole_graph(spark, sf_dir).ranges_of("tsh")


@query(f"with {GRAPH} select phase, count(*) as n from rc join ph on panel_date = day where category = 'thyroid' group by 1")
def q_results_by_phase(spark, sf_dir):
    return whole_graph(spark, sf_dir).results_by_phase("thyroid")


@query(f"with {GRAPH} select phase, count(*) as n from ac join ph using (day) group by 1")
def q_activities_by_phase(spark, sf_dir):
    return whole_graph(spark, sf_dir).activities_by_phase()


@query(f"with {GRAPH} select phase, round(avg(amount), 6) as avg_amount, count(*) as days from it join ph using (day) where key = 'protein' group by 1")
def q_intake_by_phase(spark, sf_dir):
    return whole_graph(spark, sf_dir).intake_by_phase().withColumn("avg_amount", F.round("avg_amount", 6))


@query(f"with {GRAPH} select meal_id as meal, key as nutrient, round(sum(grams / 100 * per_100g), 4) as amount from ea join hn using (fdc_id) group by 1, 2")
def q_eaten_nutrients(spark, sf_dir):
    return whole_graph(spark, sf_dir).eaten_nutrients().withColumn("amount", F.round("amount", 4))


@query(f"with {GRAPH} select ingredient_key as key, min(ingredient_name) as name, sum(gram_weight) filter (where fdc_id = 6) as gram_weight from il group by 1 having count(*) filter (where fdc_id = 6) > 0")
def q_ingredients_of(spark, sf_dir):
    return whole_graph(spark, sf_dir).ingredients_of(6)


@query(f"""with {MEASUREMENTS} select case metric {' '.join(f"when '{m}' then '{s}'" for m, s in graph.OBSERVED.items())} end as src, day as dst, min(value_label) as value from mc where metric in ({_OBSERVED}) group by 1, 2
  union all select 'bbt', day, case when round(avg(value_num), 2) = floor(round(avg(value_num), 2)) then (round(avg(value_num), 2)::bigint)::varchar || '.0' else round(avg(value_num), 2)::varchar end || ' °C' from mc where metric = 'BasalBodyTemperature' group by 2""")
def q_observed_on(spark, sf_dir):
    return whole_graph(spark, sf_dir).edges["OBSERVED_ON"]


@query(f"with {LOG} select meal_id as id, 'yazio' as source, (min(log_date)::varchar || ' ' || coalesce(min(log_time), '00:00'))::timestamp as logged_ts, any_value(meal) as meal_type, sum(kcal_total) as energy_kcal, sum(protein_total) as protein_g, sum(fat_total) as fat_g, sum(carbs_total) as carbs_g from yl group by 1")
def q_meals(spark, sf_dir):
    return whole_graph(spark, sf_dir).vertices["Meal"]


# --- scalar functions over columns of the star schema ---

_NUMERALS = ("12", " 3.5 ", "-1e3", "1_000", "0x1F", "1d", "", "nan", None, ".5", "7.")
_READ_AS = (12.0, 3.5, -1000.0, 1000.0, None, None, None, float("nan"), None, 0.5, 7.0)


@query(f"select p_partkey, {sql_list(_NUMERALS)}[p_partkey % {len(_NUMERALS)} + 1] as raw, [{', '.join('null' if v is None else repr(v) if v == v else chr(39) + 'nan' + chr(39) + '::double' for v in _READ_AS)}][p_partkey % {len(_NUMERALS)} + 1]::double as value from part")
def q_numbers(spark, sf_dir):
    raw = pick(_NUMERALS, F.col("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), scalars.number(raw).alias("value"))


@query("select event_id, floor(epoch(ts))::bigint - 3600 * (user_id % 3) as at from events")
def q_instants(spark, sf_dir):
    zone = F.concat(F.lit(" +0"), F.col("user_id") % 3, F.lit("00"))
    said = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), zone)
    return read(spark, sf_dir, "events").select("event_id", F.unix_timestamp(scalars.instant(said)).alias("at"))


_MONTHS = tuple(exports.MONTHS)


@query("select o_orderkey, o_orderdate::date + interval 1 second * (o_orderkey % 86400) as at from orders")
def q_spanish_times(spark, sf_dir):
    second, d = F.col("o_orderkey") % 86400, F.col("o_orderdate")
    clock = F.concat(F.floor(second / 3600), F.lit(":"), F.lpad(F.floor(second / 60 % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((second % 60).cast("string"), 2, "0"))
    said = F.concat(F.dayofmonth(d), F.lit(" "), pick(_MONTHS, F.month(d) - 1), F.lit(" "), F.year(d), F.lit(", "), clock)
    return read(spark, sf_dir, "orders").select("o_orderkey", exports.spanish_time(said).alias("at"))


_LABS = ("{n} (A)", "{n} (SHBG) (a)", "#{n}, %", "{n}-x/y.'z'", "()", "{n} [ab] (c d) (E)")


@query(f"""with s as (select c_custkey, replace({sql_list(_LABS)}[c_custkey % {len(_LABS)} + 1], '{{n}}', c_mktsegment || ' É') as n from customer)
select c_custkey, {_LAB_NORM.format(c='n')} as norm, {_LAB_NORM.format(c="regexp_replace(n, '[(][^)]*[)]', ' ', 'g')")} as base, array_to_string(list_transform(list_filter(regexp_extract_all(regexp_replace(n, '\\s*[(]a[)]\\s*$', ''), '[(]([^)]*)[)]', 1), lambda x: trim(x) <> ''), lambda x: {_LAB_NORM.format(c='x')}), '|') as abbrs from s""")
def q_lab_names(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    n = F.replace(pick(_LABS, F.col("c_custkey")), F.lit("{n}"), F.concat("c_mktsegment", F.lit(" É")))
    return c.select("c_custkey", text.lab_name(n).alias("norm"), text.base_name(n).alias("base"), F.array_join(text.abbreviations(n), "|").alias("abbrs"))


@query("""select p_partkey, p_name || ' (' || coalesce(round_even(case when p_size % 5 > 0 then p_size * 2.5 end, 0)::bigint::varchar, '?') || ' kcal, ' || p_size || ' g protein, ' || round_even(p_size / 2.0, 0)::bigint || ' g fat, ? g carbs per 100g)' as said,
  coalesce(case when p_size % 5 > 0 then p_size * 2.5 end, 0)::double / 900 as macro0, p_size::double / 100 as macro1, p_size / 2.0::double / 100 as macro2, 0.0::double as macro3, 1000 * p_size / 1e6 * 1.0 + p_size / 1e6 * 5.0 as cost from part""")
def q_serialized(spark, sf_dir):
    size = F.col("p_size").cast("double")
    kcal, none = F.when(F.col("p_size") % 5 > 0, size * 2.5), F.lit(None).cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", text.serialized(F.col("p_name"), kcal, size, size / 2, none).alias("said"), *(retrieval.macros(kcal, size, size / 2, none)[i].alias(f"macro{i}") for i in range(4)), scalars.cost(1000 * size, size, 1.0, 5.0).alias("cost"))


# --- laboratory reports: conversations as reports of pages, their replies as the model's ---


def report_pages(spark, sf_dir) -> DataFrame:
    """A conversation is a file, its turns its pages."""
    c = read(spark, sf_dir, "conversations").where("conv_id is not null")
    path = F.concat(F.lit("/labs/report_"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("conv_id") % 900).cast("int")), "yyyyMMdd"), F.lit("_"), F.col("conv_id"), F.lit(".pdf"))
    pages = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return pages.select("conv_id", path.alias("path"), F.col("p.text").alias("pages"))


_PAGES = "pg as (select conv_id, list(coalesce(text, '') order by turn, coalesce(text, '')) as pages from conversations where conv_id is not null group by 1)"


@query(f"with {_PAGES}, t as (select conv_id, len(pages) as n, len(list_filter(pages, lambda p: length(trim(p, ' ')) >= 60)) as good, length(array_to_string(pages, chr(10))) as chars from pg) select case when n > 0 and good = n then 'text' when good = 0 then 'scanned' else 'mixed' end as route, count(*) as files, sum(n)::bigint as pages, sum(chars)::bigint as chars from t group by 1")
def q_triage_routes(spark, sf_dir):
    return labs.route_counts(report_pages(spark, sf_dir))


@query(f"with {_PAGES} select date '2020-01-01' + (conv_id % 900)::int as panel_date, conv_id, md5(array_to_string(pages, chr(10))) as text_md5 from pg")
def q_report_texts(spark, sf_dir):
    p = report_pages(spark, sf_dir)
    return p.select(labs.file_day(F.col("path")).alias("panel_date"), "conv_id", F.md5(labs.whole_text(F.col("pages"))).alias("text_md5"))


def replies(spark, sf_dir) -> DataFrame:
    """What a model would have returned for an order: its lines as results; nothing readable for some."""
    l = read(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_tax") > 0.01, F.regexp_replace(F.col("l_quantity").cast("string"), r"\\.", ",")).otherwise("positive")
    one = F.struct(F.concat(F.lit("analyte "), F.col("l_linenumber")).alias("test_name"), value.alias("value"), F.lit("g/L").alias("unit"), F.col("l_discount").alias("ref_low"), F.col("l_returnflag").alias("flag"))
    panel = l.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("reply"))
    path = F.concat(F.lit("/labs/20240229_"), "l_orderkey", F.lit(".pdf"))
    bad = F.col("l_orderkey") % 10 == 0
    return panel.select(path.alias("path"), F.when(~bad, F.col("reply")).otherwise("no panel").alias("reply"), F.col("l_orderkey").alias("tokens_in"), F.lit(7).cast("long").alias("tokens_out"), F.when(bad, "ValueError: no panel").alias("error"))


_LAB_ROWS = "la as (select '20240229_' || l_orderkey || '.pdf' as source_file, 'analyte ' || l_linenumber as test_name, case when l_tax > 0.01 then l_quantity end as value_num, case when l_tax <= 0.01 then 'positive' end as value_str, 'g/L' as unit, l_discount as ref_low, l_returnflag as flag, l_orderkey from lineitem where l_orderkey % 10 <> 0)"


@query(f"with {_LAB_ROWS} select sha1(source_file || chr(31) || test_name || chr(31) || '2024-02-29') as row_key, source_file, test_name, value_num, value_str, unit, ref_low, flag from la")
def q_lab_rows(spark, sf_dir):
    return labs.lab_rows(replies(spark, sf_dir), "stand-in").select("row_key", "source_file", "test_name", "value_num", "value_str", "unit", "ref_low", "flag")


@query(f"with {_LAB_ROWS}, f as (select distinct l_orderkey, '20240229_' || l_orderkey || '.pdf' as source_file from lineitem) select f.source_file, count(la.test_name) as results, count(la.value_num) as numeric, any_value(case when f.l_orderkey % 10 = 0 then 'ERROR ValueError: no panel' else 'ok' end) as status, f.l_orderkey::bigint as tokens_in, 7::bigint as tokens_out from f left join la using (l_orderkey) group by 1, f.l_orderkey")
def q_file_counts(spark, sf_dir):
    r = replies(spark, sf_dir)
    return labs.file_counts(r, labs.lab_rows(r, "stand-in"))


# --- retrieval experiments: vectors and documents of one id as the corpus, every fiftieth vector with a benchmark text as a query ---


def experiment(spark, sf_dir) -> dict[str, DataFrame]:
    e, d, b = (read(spark, sf_dir, t) for t in ("embeddings", "documents", "benchmark"))
    corpus = e.join(d.select(F.col("doc_id").alias("vec_id"), "text", "lang"), "vec_id").select(F.col("vec_id").alias("doc_id"), "text", "lang", F.col("embedding").alias("dv"), "label")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv"), F.col("label").alias("ql"), F.col("vec_id").alias("_v"))
    queries = asked.join(b.select((F.col("item_id") * 50).alias("q_id"), F.col("text").alias("q_text")), "q_id").select("q_id", "qv", "ql", "q_text")
    relevant = queries.select("q_id", F.col("ql").alias("label")).join(corpus.select("doc_id", "label"), "label").select("q_id", "doc_id")
    second = e.select((F.col("vec_id") - 1).alias("at"), F.col("embedding").alias("other"))
    tokens = corpus.select("doc_id", "dv").union(corpus.select("doc_id").join(second, F.col("doc_id") == F.col("at")).select("doc_id", "other"))
    query_tokens = queries.select("q_id", F.lit(0).alias("q_pos"), "qv").union(queries.select("q_id").join(second, F.col("q_id") == F.col("at")).select("q_id", F.lit(1), "other"))
    return {"queries": queries, "corpus": corpus, "relevant": relevant, "tokens": tokens, "query_tokens": query_tokens}


_DOT = "round(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double)), 6)"
_WORDS = "regexp_extract_all(lower({c}), '([a-z0-9]+)', 1)"
EXPERIMENT = f"""co as (select vec_id as doc_id, text, lang, embedding as dv, label from embeddings join documents on doc_id = vec_id),
qs as (select vec_id as q_id, embedding as qv, label as ql, text as q_text from embeddings join benchmark on item_id * 50 = vec_id),
rv as (select q_id, doc_id from qs join co on label = ql), ask as (select q_id, (select count(*) from rv where rv.q_id = qs.q_id) as nr from qs),
ds as (select q_id, doc_id, {_DOT.format(a='qv', b='dv')} as score from qs, co), dr as (select *, row_number() over (partition by q_id order by score desc, doc_id) - 1 as rank from ds),
tk as (select doc_id, unnest({_WORDS.format(c='text')}) as w from co), tf as (select doc_id, w, count(*) as tf from tk group by 1, 2), sz as (select doc_id, len({_WORDS.format(c='text')}) as dl from co),
tot as (select count(*) as n, avg(dl) as avgdl from sz), i0 as (select w, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as idf from tf, tot group by w, n), ix as (select w, case when idf < 0 then 0.25 * (select avg(idf) from i0) else idf end as idf from i0),
qw as (select q_id, w, count(*) as qf from (select q_id, unnest({_WORDS.format(c='q_text')}) as w from qs) group by 1, 2),
ss as (select q_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from qw join ix using (w) join tf using (w) join sz using (doc_id), tot group by 1, 2), sr as (select *, row_number() over (partition by q_id order by score desc, doc_id) - 1 as rank from ss),
hs as (select q_id, doc_id, round(sum(1.0 / (60 + rank)), 6) as score from (select q_id, doc_id, rank from dr where rank < 100 union all select q_id, doc_id, rank from sr where rank < 100) group by 1, 2), hr as (select *, row_number() over (partition by q_id order by score desc, doc_id) - 1 as rank from hs),
dt as (select doc_id, dv from co union all select co.doc_id, embedding from co join embeddings on vec_id = co.doc_id + 1), qt as (select q_id, 0 as q_pos, qv from qs union all select q_id, 1, embedding from qs join embeddings on vec_id = q_id + 1),
ms as (select q_id, doc_id, round(sum(s), 6) as score from (select q_id, q_pos, doc_id, max(list_sum(list_transform(list_zip(qv, dv), lambda z: z[1]::double * z[2]::double))) as s from qt, dt group by 1, 2, 3) group by 1, 2), mr as (select *, row_number() over (partition by q_id order by score desc, doc_id) - 1 as rank from ms),
rk as (select 'dense' as system, q_id, doc_id, rank from dr where rank < 10 union all select 'sparse', q_id, doc_id, rank from sr where rank < 10 union all select 'hybrid', q_id, doc_id, rank from hr where rank < 10 union all select 'colbert', q_id, doc_id, rank from mr where rank < 10)"""
#: Outcomes of each system of rk(system, q_id, doc_id, rank) for ask(q_id, nr) and rv(q_id, doc_id).
_OUTCOMES = """gi as (select n as m, sum(1 / log2(g + 1)) over (order by n) as idcg from (select unnest(range(1, 11)) as n, unnest(range(1, 11)) as g)),
hit as (select system, q_id, rank from rk join rv using (q_id, doc_id)), sy as (select distinct system from rk),
oc as (select sy.system, ask.q_id, coalesce(min(rank) < 1, false)::int::double as s1, coalesce(min(rank) < 5, false)::int::double as s5, coalesce(1 / (min(rank) + 1.0), 0) as mrr, coalesce(sum(1 / log2(rank + 2)), 0) / coalesce(any_value(idcg), 1) as ndcg
  from sy, ask left join hit on hit.system = sy.system and hit.q_id = ask.q_id left join gi on m = least(nr, 10) group by 1, 2)"""
_BINOM = "(select sum(exp(lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0) - m * ln(2.0))) from (select unnest(range(0, (k + 1)::bigint)) as i))"
_REPORT = f"""pt as (select a.system, count_if(a.s1 > 0 and b.s1 = 0) as better, count_if(a.s1 = 0 and b.s1 > 0) as worse from oc a join oc b on a.q_id = b.q_id and b.system = '{{base}}' group by 1),
pv as (select system, better, worse, round(case when better + worse = 0 then 1.0 else least(1.0, 2 * {_BINOM}) end, 6) as p from (select *, (better + worse)::double as m, least(better, worse) as k from pt))
select system, count(*) as n, round(avg(s1), 6) as s1, round(avg(s5), 6) as s5, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg, better, worse, p, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'ns' end as stars from oc join pv using (system) group by all"""


def system_outcomes(spark, sf_dir) -> dict[str, DataFrame]:
    x = experiment(spark, sf_dir)
    r = experiments.rankings(x["queries"], x["corpus"], x["tokens"], x["query_tokens"])
    return {s: experiments.outcomes(r.where(F.col("system") == s), x["relevant"], x["queries"]) for s in experiments.SYSTEMS}


@query(f"with {EXPERIMENT} select system, q_id, doc_id, rank::int as rank from rk")
def q_system_rankings(spark, sf_dir):
    x = experiment(spark, sf_dir)
    return experiments.rankings(x["queries"], x["corpus"], x["tokens"], x["query_tokens"])


@query(f"with {EXPERIMENT}, {_OUTCOMES}, {_REPORT.format(base='dense')}")
def q_retrieval_matrix(spark, sf_dir):
    return experiments.report(system_outcomes(spark, sf_dir), "dense")


@query(f"with {EXPERIMENT}, {_OUTCOMES} select system, 'label ' || (ql % 3) as stratum, count(*) as n, round(avg(s1), 6) as s1 from oc join qs using (q_id) group by 1, 2")
def q_success_by_stratum(spark, sf_dir):
    strata = experiment(spark, sf_dir)["queries"].select("q_id", F.concat(F.lit("label "), F.col("ql") % 3).alias("stratum"))
    return experiments.by_stratum(system_outcomes(spark, sf_dir), strata)


@query(f"""with {EXPERIMENT}, two as (select *, case when lang in ('en', 'de') then 'main' else 'more' end as corpus from co), b as (select 'main' as name, 'main' as part union all select 'combined', 'main' union all select 'combined', 'more'),
r as (select name, q_id, corpus, label = ql as ok, row_number() over (partition by name, q_id order by score desc, corpus || ':' || doc_id) as k from ds join two using (doc_id) join b on part = corpus join qs using (q_id) where doc_id <> q_id)
select name as corpus, count(*) as n, round(avg(ok::int), 6) as s1, count_if(ok and corpus <> 'main') as supplied from r where k = 1 group by 1""")
def q_corpus_ablation(spark, sf_dir):
    x = experiment(spark, sf_dir)
    pick_ = lambda main: x["corpus"].where(F.col("lang").isin("en", "de") == main).select("doc_id", "dv", F.col("label").alias("dkey"))
    return experiments.corpus_ablation(x["queries"].select("q_id", "qv", F.col("ql").alias("qkey")), {"main": pick_(True), "more": pick_(False)}, "main", lambda q, d: q == d, itself=False)


@query(f"""with {EXPERIMENT}, f as (select model, query, q_id, min(rank) as best from (select 'vectors' as model, 'dense' as query, q_id, doc_id, rank from dr union all select 'words', 'sparse', q_id, doc_id, rank from sr) join rv using (q_id, doc_id) where rank < 10 group by 1, 2, 3),
a as (select model, query, q_id, best from ((select 'vectors' as model, 'dense' as query union all select 'words', 'sparse') cross join ask) left join f using (model, query, q_id))
select model, query, round(avg((coalesce(best < 1, false))::int), 6) as r1, round(avg((coalesce(best < 5, false))::int), 6) as r5, round(avg((coalesce(best < 10, false))::int), 6) as r10, round(avg(coalesce(1.0 / (best + 1), 0)), 6) as mrr from a group by 1, 2""")
def q_embedder_benchmark(spark, sf_dir):
    x = experiment(spark, sf_dir)
    r = experiments.rankings(x["queries"], x["corpus"], x["tokens"], x["query_tokens"])
    return experiments.embedder_benchmark({("vectors", "dense"): r.where("system = 'dense'"), ("words", "sparse"): r.where("system = 'sparse'")}, x["relevant"], x["queries"])


_FOUR = "list_value(abs({v}[1])::double, abs({v}[2])::double, abs({v}[3])::double, abs({v}[4])::double)"


@query(f"""with {EXPERIMENT}, t as (select dr.q_id, dr.doc_id, dr.score, sqrt(list_sum(list_transform(list_zip({_FOUR.format(v='qv')}, {_FOUR.format(v='dv')}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as gap, ql = label as ok from dr join qs using (q_id) join co using (doc_id) where rank < 20),
v as (select *, unnest([{{'step': 'bi-encoder', 's': round(score, 6)}}, {{'step': 'macro', 's': round(0.5 * score + 0.5 / (1 + gap), 6)}}, {{'step': 'cross', 's': round(score * (1 + doc_id % 3), 6)}}]) as x from t),
b as (select x.step as step, ok, row_number() over (partition by x.step, q_id order by x.s desc, doc_id) as k from v) select step, count(*) as n, round(avg(ok::int), 6) as r1 from b where k = 1 group by 1""")
def q_rerank_ablation(spark, sf_dir):
    """The first twenty by vectors, reordered by macros and by a second model's score (a stand-in by formula)."""
    x = experiment(spark, sf_dir)
    four = lambda c: F.transform(F.slice(c, 1, 4), lambda v: F.abs(v).cast("double"))
    short = retrieval.dense_top(x["queries"].select("q_id", "qv"), x["corpus"].select("doc_id", "dv"), 20)
    short = short.join(x["queries"].select("q_id", four("qv").alias("qm")), "q_id").join(x["corpus"].select("doc_id", four("dv").alias("dm")), "doc_id")
    scores = {"macro": 0.5 * F.col("score") + 0.5 * retrieval.macro_similarity("qm", "dm"), "cross": F.col("score") * (1 + F.col("doc_id") % 3)}
    return experiments.rerank_ablation(short, x["relevant"], scores)


_PLAIN, _RICH = "lower(p_name)", "lower(p_name || ' (' || p_size || ' kcal, ' || (p_size % 7) || ' g protein, ? g fat, 0 g carbs per 100g)')"


def _serialized_sql(name: str, c: str) -> str:
    w = _WORDS.format(c=c)
    return f"""{name}_tk as (select p_partkey as doc_id, unnest({w}) as w from part), {name}_tf as (select doc_id, w, count(*) as tf from {name}_tk group by 1, 2), {name}_sz as (select p_partkey as doc_id, len({w}) as dl from part),
{name}_to as (select count(*) as n, avg(dl) as avgdl from {name}_sz), {name}_i0 as (select w, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as idf from {name}_tf, {name}_to group by w, n), {name}_ix as (select w, case when idf < 0 then 0.25 * (select avg(idf) from {name}_i0) else idf end as idf from {name}_i0),
{name}_qw as (select doc_id as q_id, w, tf as qf from {name}_tf where doc_id % 50 = 0), {name}_sc as (select q_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from {name}_qw join {name}_ix using (w) join {name}_tf using (w) join {name}_sz using (doc_id), {name}_to group by 1, 2),
{name}_rk as (select '{name}' as system, q_id, doc_id, row_number() over (partition by q_id order by score desc, doc_id) - 1 as rank from {name}_sc)"""


@query(f"""with {_serialized_sql('plain', _PLAIN)}, {_serialized_sql('serialized', _RICH)}, rk as (select * from plain_rk where rank < 10 union all select * from serialized_rk where rank < 10),
rv as (select q.p_partkey as q_id, d.p_partkey as doc_id from part q join part d on q.p_partkey % 50 = 0 and d.p_name = q.p_name and d.p_size = q.p_size), ask as (select q_id, count(*) as nr from rv group by 1), {_OUTCOMES}, {_REPORT.format(base='plain')}""")
def q_serialized_retrieval(spark, sf_dir):
    """Names alone against names with their attributes written out: who finds the part of the same name and size."""
    p = read(spark, sf_dir, "part")
    size, none = F.col("p_size").cast("double"), F.lit(None).cast("double")
    said = {"plain": F.col("p_name"), "serialized": text.serialized(F.col("p_name"), size, size % 7, none, F.lit(0.0))}
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("q_id"), "p_name", "p_size")
    relevant = q.join(p.select(F.col("p_partkey").alias("doc_id"), "p_name", "p_size"), ["p_name", "p_size"]).select("q_id", "doc_id")
    out = {}
    for name, c in said.items():
        docs = p.select(F.col("p_partkey").alias("doc_id"), c.alias("text"))
        asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("q_id"), F.col("text").alias("q_text"))
        out[name] = experiments.outcomes(retrieval.bm25_top(asked, docs, 10), relevant, q).cache()
    return experiments.report(out, "plain")


@query(f"""with {FOODS}, pe as (select 'product ' || vec_id as product, embedding as qv, abs(embedding[1])::double * 900 as kcal, abs(embedding[2])::double * 100 as protein, vec_id from embeddings where vec_id % 50 = 0),
fe as (select fdc_id, description, embedding as dv, coalesce(energy_kcal, 0) / 900 as e, coalesce(protein_g, 0) / 100 as p, coalesce(fat_g, 0) / 100 as f, coalesce(carbs_g, 0) / 100 as c from fd join embeddings on vec_id = fdc_id),
s as (select product, kcal, protein, fdc_id, description, {_DOT.format(a='qv', b='dv')} as cosine, e, p, f, c from pe, fe), t as (select *, row_number() over (partition by product order by cosine desc, fdc_id) as rn from s),
m as (select *, 1 / (1 + sqrt((kcal / 900 - e) ** 2 + (protein / 100 - p) ** 2 + f ** 2 + c ** 2)) as macro_sim from t where rn <= 25), b as (select *, row_number() over (partition by product order by 0.5 * cosine + 0.5 * macro_sim desc, fdc_id) as k from m)
select product, upper(product) as en_name, fdc_id, description, cosine, round(macro_sim, 6) as macro_sim, round(0.5 * cosine + 0.5 * macro_sim, 6) as score, 'translate+embed+macro' as method from b where k = 1""")
def q_food_map(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("product "), F.col("vec_id"))
    v = lambda i: F.abs(F.col("embedding")[i]).cast("double")
    none = F.lit(None).cast("double")
    products = e.where("vec_id % 50 = 0").select(name.alias("product"), F.upper(name).alias("en_name"), "embedding", (v(0) * 900).alias("energy_kcal"), (v(1) * 100).alias("protein_g"), none.alias("fat_g"), none.alias("carbs_g"))
    table = food_table(spark, sf_dir).join(e.select(F.col("vec_id").alias("fdc_id"), "embedding"), "fdc_id")
    return foods.food_map(products, table).withColumns({c: F.round(c, 6) for c in ("macro_sim", "score")})


# --- sources and sinks: exports written from the star schema to a scratch folder and read back ---


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: under spark.checkpoint.dir, or one of this machine's if all executors are in this process."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        top = tempfile.mkdtemp(prefix="pulselake-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _attributes(**values) -> F.Column:
    """XML attributes of the columns that have a value."""
    return F.concat_ws(" ", *(F.when(c.isNotNull(), F.concat(F.lit(f'{n}="'), c.cast("string"), F.lit('"'))) for n, c in values.items()))


def _said_at(seconds: int = 0) -> F.Column:
    return F.concat(F.date_format(F.col("ts") + F.expr(f"interval {seconds} seconds"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0100"))


def export_path(spark, sf_dir) -> str:
    """An export of all events: records, every fifth of them in a correlation of its own and in the open as well, workouts and summaries."""
    e = read(spark, sf_dir, "events")
    kind = pick(("HKQuantityTypeIdentifierStepCount", "HKCategoryTypeIdentifierMenstrualFlow", "SomeOtherType"), F.col("event_id"))
    value = F.when(F.col("event_id") % 3 == 1, "HKCategoryValueVaginalBleedingLight").otherwise(F.round("value").cast("int").cast("string"))
    record = F.concat(F.lit("<Record "), _attributes(type=kind, sourceName=F.concat(F.lit("s"), F.col("user_id")), unit=F.when(F.col("event_id") % 3 == 0, "count"), startDate=_said_at(), endDate=_said_at(60), value=value), F.lit("/>"))
    inside = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("\n<Correlation "), _attributes(type=F.lit("HKCorrelationTypeIdentifierFood"), sourceName=F.lit("c"), startDate=_said_at(), endDate=F.col("event_id")), F.lit(">"), record, F.lit("</Correlation>"))).otherwise("")
    workout = F.when(F.col("event_type") == "purchase", F.concat(F.lit("\n<Workout "), _attributes(workoutActivityType=F.lit("HKWorkoutActivityTypeRunning"), duration=F.col("event_id"), durationUnit=pick(("min", "s"), F.col("event_id")), sourceName=F.lit("w"), startDate=_said_at(), endDate=_said_at(90)), F.lit("/>"))).otherwise("")
    day = F.date_format("ts", "yyyy-MM-dd")
    summary = F.concat(F.lit("\n<ActivitySummary "), _attributes(dateComponents=day, activeEnergyBurned=F.lit("7.5"), appleExerciseTime=F.lit("x"), appleStandHours=F.lit(9)), F.lit("/>"))
    path = scratch(spark, "export")
    lines = e.select(F.concat(record, inside, workout, F.when(F.col("user_id") == 8, summary).otherwise("")).alias("value"))
    line = lambda x: spark.createDataFrame([(x,)], "value string")
    line("<HealthData>").union(lines).union(line("</HealthData>")).coalesce(1).write.text(path)
    return path


_STAMP = "strftime(ts + interval {s} second, '%Y-%m-%d %H:%M:%S') || ' +0100'"
_RECORDS = f"""x as (select *, ['HKQuantityTypeIdentifierStepCount', 'HKCategoryTypeIdentifierMenstrualFlow', 'SomeOtherType'][event_id % 3 + 1] as kind, case when event_id % 3 = 1 then 'HKCategoryValueVaginalBleedingLight' else round(value)::int::varchar end as v, {_STAMP.format(s=0)} as t0, {_STAMP.format(s=60)} as t1, {_STAMP.format(s=90)} as t2 from events),
y as (select *, case when event_id % 3 < 2 then regexp_replace(kind, '^HK(Quantity|Category)TypeIdentifier', '') else kind end as metric from x),
z as (select *, sha1(concat_ws(chr(31), metric, 's' || user_id, t0, t1, v)) as row_key from y)"""


@query(f"""with {_RECORDS} select row_key, metric, case event_id % 3 when 0 then 'Quantity' when 1 then 'Category' end as record_kind, try_cast(v as double) as value_num, case when try_cast(v as double) is null then v end as value_str, case when event_id % 3 = 0 then 'count' end as unit,
  floor(epoch(ts - interval 1 hour))::bigint as start_s, 's' || user_id as source, case when event_id % 5 = 0 then 'corr-' || sha1(concat_ws(chr(31), 'Food', 'c', t0, event_id::varchar))[1:16] end as correlation_id from z qualify row_number() over (partition by row_key order by event_id) = 1""")
def q_export_records(spark, sf_dir):
    m = exports.measurements(spark, export_path(spark, sf_dir))
    return m.select("row_key", "metric", "record_kind", "value_num", "value_str", "unit", F.unix_timestamp("start_ts").alias("start_s"), "source", "correlation_id")


@query(f"""with {_RECORDS} select sha1(concat_ws(chr(31), 'Running', 'w', t0, t2, case when event_id <> 0 then event_id::double::varchar else '' end)) as row_key, 'Running' as workout_type, case when event_id % 2 = 0 then event_id * 60.0 else event_id end::double as duration_s, 'w' as source from z where event_type = 'purchase'""")
def q_export_workouts(spark, sf_dir):
    return exports.workouts(spark, export_path(spark, sf_dir)).select("row_key", "workout_type", "duration_s", "source")


@query("select distinct strftime(ts, '%Y-%m-%d') as date_components, 7.5::double as active_energy, null::double as exercise_time, 9.0::double as stand_hours, null::double as move_time from events where user_id = 8")
def q_export_summaries(spark, sf_dir):
    return exports.activity_summary(spark, export_path(spark, sf_dir)).select("date_components", "active_energy", "exercise_time", "stand_hours", "move_time")


_SPORT = ("Carrera", "Bicicleta", "Senderismo", "Esquí alpino", "", "Padel")
_SPORT_AS = ("run", "ride", "hike", "ski", "other", "padel")


@query(f"""select 'strava-' || o_orderkey as activity_id, {sql_list(_SPORT_AS)}[o_orderkey % 6 + 1] as activity_type, case when o_orderkey % 2 = 0 then 'name ' || o_orderkey end as name, o_totalprice / 1000 as distance_km, o_custkey::double as duration_s,
  strftime(((o_orderdate::timestamp + interval 6 hour) at time zone 'Europe/Budapest') at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as started from orders where o_orderkey % 9 <> 0""")
def q_activity_csv(spark, sf_dir):
    """A positional export of 21 fields; every ninth row is cut short and skipped."""
    o = read(spark, sf_dir, "orders")
    date = F.concat(F.lit('"'), F.dayofmonth("o_orderdate"), F.lit(" "), pick(_MONTHS, F.month("o_orderdate") - 1), F.lit(" "), F.year("o_orderdate"), F.lit(', 6:00:00"'))
    fields = [F.col("o_orderkey"), date, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("name "), "o_orderkey")).otherwise(""), pick(_SPORT, F.col("o_orderkey"))] + [F.lit("")] * 11 + [F.col("o_custkey"), F.lit("1"), F.col("o_totalprice"), F.lit("x"), F.lit("2.5"), F.lit("100")]
    short = F.concat_ws(",", *(f.cast("string") for f in fields[:5]))
    path = scratch(spark, "activities")
    lines = o.select(F.when(F.col("o_orderkey") % 9 == 0, short).otherwise(F.concat_ws(",", *(f.cast("string") for f in fields))).alias("value"))
    head = spark.createDataFrame([(",".join(f"h{i}" for i in range(21)),)], "value string")
    head.union(lines).coalesce(1).write.text(path)
    a = exports.activity_csv(spark, path, ZONE)
    return a.select("activity_id", "activity_type", "name", "distance_km", "duration_s", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("started"))


@query(f"with {FOODS} select * from fd")
def q_foods_from_csv(spark, sf_dir):
    """The food folder as CSV files, read by name and with its types."""
    path, t = scratch(spark, "foods"), food_tables(spark, sf_dir)
    t["food"].withColumn("publication_date", F.lit("2020-01-01")).select("fdc_id", "data_type", "description", "food_category_id", "publication_date").write.csv(f"{path}/food.csv", header=True)
    t["food_category"].select("id", F.lit("c").alias("code"), "description").write.csv(f"{path}/food_category.csv", header=True)
    t["food_nutrient"].select(F.lit(1).alias("id"), "fdc_id", "nutrient_id", "amount").write.csv(f"{path}/food_nutrient.csv", header=True)
    columns = ("id", "fdc_id", "fdc_id_of_input_food", "seq_num", "amount", "sr_code", "sr_description", "unit", "portion_code", "portion_description", "gram_weight", "retention_code")
    i = t["input_food"]
    i.select(*(F.col(c) if c in i.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.csv(f"{path}/input_food.csv", header=True)
    got = exports.food_csvs(spark, path)
    return foods.foods(got["food"], got["food_category"], got["food_nutrient"])


@query("select p_partkey::varchar as code, p_name || ' \"x' as product_name, p_brand as brands, p_size::varchar as energy from part")
def q_product_tsv(spark, sf_dir):
    """A gzipped dump of tab-separated text with bare quotes."""
    p = read(spark, sf_dir, "part")
    path = scratch(spark, "products")
    cells = {"code": F.col("p_partkey"), "product_name": F.concat("p_name", F.lit(' "x')), "brands": F.col("p_brand"), "energy-kcal_100g": F.col("p_size")}
    line = F.concat_ws("\t", *(F.coalesce(cells[c].cast("string"), F.lit("")) if c in cells else F.lit("z") for c in exports.PRODUCT_COLUMNS))
    head = spark.createDataFrame([("\t".join(exports.PRODUCT_COLUMNS),)], "value string")
    head.union(p.select(line.alias("value"))).coalesce(1).write.option("compression", "gzip").text(path)
    t = exports.product_tsv(spark, path, 4)
    return t.select("code", "product_name", "brands", F.col("`energy-kcal_100g`").alias("energy"))


@query(f"with {LOG} select log_date, log_time, meal, product, amount, kcal_total, carbs_total from yl")
def q_food_log(spark, sf_dir):
    path, back = scratch(spark, "log"), {n: c for c, (n, _) in exports.LOG_COLUMNS.items()}
    food_log(spark, sf_dir).withColumnsRenamed(back).select(*exports.LOG_COLUMNS).write.csv(path, header=True)
    return exports.food_log(spark, path).select("log_date", "log_time", "meal", "product", "amount", "kcal_total", "carbs_total")


@query("select 'p' || n_nationkey as product, n_name || '|kw' as keywords, case when n_nationkey % 2 = 0 then 'simple' end as explicit from nation")
def q_gold_json(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    words = F.concat(F.lit('["'), "n_name", F.lit('", "kw"]'))
    entry = F.concat(F.lit('"p'), "n_nationkey", F.lit('": '), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('{"kw": '), words, F.lit(', "class": "simple"}'))).otherwise(words))
    path = scratch(spark, "gold")
    n.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value")).coalesce(1).write.text(path)
    g = exports.gold_labels(spark, path)
    return g.select("product", F.array_join("keywords", "|").alias("keywords"), "explicit")


@query(f"with {GRAPH} select 'Food' as \"table\", count(*) as n, sum(fdc_id)::bigint as ids from fd union all select 'HAS_NUTRIENT', count(*), sum(fdc_id)::bigint from hn union all select 'EATEN', count(*), sum(fdc_id)::bigint from ea")
def q_graph_files(spark, sf_dir):
    """The graph written as Parquet, table by table, and read back."""
    path = scratch(spark, "graph")
    names = analytes.analyte_map(results(spark, sf_dir)).persist()  # a row for each name, read with every result
    try:
        whole_graph(spark, sf_dir, names).write(path)
    finally:
        names.unpersist()
    out = None
    for name, c in (("Food", "fdc_id"), ("HAS_NUTRIENT", "src"), ("EATEN", "dst")):
        one = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.sum(c).alias("ids"))
        out = one if out is None else out.union(one)
    return out


@query(f"with {MEASUREMENTS} select row_key, metric, value_num, source from m")
def q_ingested(spark, sf_dir):
    """Two overlapping exports streamed into one table, the second twice."""
    from ..streaming import increments

    m = measurements(spark, sf_dir)
    path = scratch(spark, "ingest")
    first, second = m.where("cast(row_key as long) % 3 < 2"), m.where("cast(row_key as long) % 3 > 0")
    for part in (first, second, second):
        part.write.mode("append").parquet(f"{path}/in")
        increments.ingest(increments.file_stream(spark, f"{path}/in", m.schema), f"{path}/table", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/table").select("row_key", "metric", "value_num", "source")


@query(f"with {MEASUREMENTS} select day, metric, count(*) as n, sum(value_num) as total from m group by 1, 2")
def q_streamed_totals(spark, sf_dir):
    from ..streaming import increments

    m = measurements(spark, sf_dir).withColumn("start_ts", F.col("start_ts").cast("timestamp"))
    path = scratch(spark, "totals")
    m.write.parquet(f"{path}/in")
    name = "totals_" + path.rsplit("-", 1)[-1]
    q = increments.daily_totals(increments.file_stream(spark, f"{path}/in", m.schema), zone=ZONE).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start()
    q.awaitTermination()
    return spark.table(name)


@query("select p_partkey as id, upper(p_name) as said, case when p_size % 2 = 0 then 'again' else 'new' end as state from part")
def q_text_cache(spark, sf_dir):
    """Hypothetical documents from a JSON cache: what is there under the same text is kept, what is new or has another text is made again."""
    from ..sources import providers

    p = read(spark, sf_dir, "part")
    path = scratch(spark, "hyde")
    texts = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    old = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("older text").alias("text"))
    providers.text_cache(old, "id", "text", path, lambda t: ["stale"] * len(t), "said").count()
    got = providers.text_cache(texts, "id", "text", path, lambda t: [x.upper() for x in t], "said")
    return got.join(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "again").otherwise("new").alias("state")), "id").select("id", "said", "state")


@query("select p_partkey as id, round(1.0, 4) as length, p_name as said from part")
def q_embedded(spark, sf_dir):
    """Vectors of length 1 of every name, and what the translator (a stand-in) made of it."""
    from ..sources import providers

    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    v = providers.embed(p, "id", "text")
    said = providers.per_text(p, "text", lambda t: [x for x in t], "said")
    return v.join(p, "id").join(said, "text").select("id", F.round(F.sqrt(retrieval.dot("embedding", "embedding")), 4).alias("length"), "said")


# --- more sinks, and models behind providers (stand-ins by formula) ---


@query(f"with {_LAB_ROWS} select date '2024-02-29' as panel_date, source_file, test_name, value_num, value_str, ref_low, flag from la")
def q_review_csv(spark, sf_dir):
    """The review file, in its order, read back."""
    path = scratch(spark, "review")
    labs.review_csv(labs.lab_rows(replies(spark, sf_dir), "stand-in").drop("extracted_at"), path)
    back = spark.read.csv(path, header=True, schema="row_key string, panel_date date, source_file string, test_name string, value_num double, value_str string, unit string, ref_low double, ref_high double, ref_text string, flag string, model string", enforceSchema=True)
    return back.select("panel_date", "source_file", "test_name", "value_num", "value_str", "ref_low", "flag")


@query(f"with {_PAGES} select conv_id, len(pages) as n_pages, case when len(list_filter(pages, lambda p: length(trim(p, ' ')) >= 60)) = len(pages) then 'text' when len(list_filter(pages, lambda p: length(trim(p, ' ')) >= 60)) = 0 then 'scanned' else 'mixed' end as kind from pg")
def q_manifest(spark, sf_dir):
    path = scratch(spark, "manifest")
    labs.manifest(report_pages(spark, sf_dir), path)
    back = spark.read.schema("path string, n_pages long, kind string").json(path)
    return back.select(F.regexp_extract("path", r"_(\d+)\.pdf$", 1).cast("long").alias("conv_id"), "n_pages", "kind")


@query(f"with {_LAB_ROWS} select distinct source_file, test_name, sha1(source_file || chr(31) || test_name || chr(31) || '2024-02-29') as row_key from la")
def q_loaded_panels(spark, sf_dir):
    """Two loads, the second of everything again: the first result of each key stays."""
    path, rows = scratch(spark, "panels"), labs.lab_rows(replies(spark, sf_dir), "stand-in")
    labs.load_panels(rows.where("flag = 'A'"), path)
    labs.load_panels(rows, path)
    assert labs.load_panels(rows, path) == 0
    return spark.read.parquet(path).select("source_file", "test_name", "row_key")


@query("select n_name as first_page, 2 as n_pages, n_name || chr(10) || 'second page of ' || n_name as whole from nation")
def q_pages_of_files(spark, sf_dir):
    """One file for each nation, read as bytes by a reader that knows the page mark."""
    path = scratch(spark, "files")
    n = read(spark, sf_dir, "nation")
    n.select(F.concat("n_name", F.lit("\f"), F.lit("second page of "), "n_name").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    pages = labs.read_pages(spark, path, lambda raw: raw.decode().rstrip("\n").split("\f"))
    return pages.select(F.col("pages")[0].alias("first_page"), F.size("pages").alias("n_pages"), labs.whole_text(F.col("pages")).alias("whole"))


@query("select 'f' || n_nationkey as path, case when n_nationkey % 4 > 0 then '{\"n\": ' || length(n_name) || '}' end as reply, case when n_nationkey % 4 > 0 then length(n_name) else 0 end::bigint as tokens_in, case when n_nationkey % 4 > 0 then 1 else 0 end::bigint as tokens_out, case when n_nationkey % 4 = 0 then 'ValueError: unreadable' end as error from nation")
def q_extracted(spark, sf_dir):
    """Replies and token counts of a model; a file that it cannot read has its error and stops nothing."""

    def model(text: str) -> tuple[str, int, int]:
        if text.endswith("!"):
            raise ValueError("unreadable")
        return '{"n": %d}' % len(text), len(text), 1

    n = read(spark, sf_dir, "nation")
    texts = n.select(F.concat(F.lit("f"), "n_nationkey").alias("path"), F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")).alias("text"))
    return labs.extract(texts, model)


@query(f"with {RESULTS} select n.n_name as name, case when n_nationkey % 3 > 0 then {sql_list(r[0] for r in analytes.REGISTRY)}[length(n_name) % {len(analytes.REGISTRY)} + 1] end as key from nation n")
def q_provider_keys(spark, sf_dir):
    """Keys by a model that invents some: those that the registry lacks become null."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "invent").otherwise("know").alias("unit"))
    return analytes.resolve_with_provider(n, lambda pairs, keys: [keys[len(name) % len(keys)] if unit == "know" else "made_up" for name, unit in pairs]).select("name", "key")


@query(f"""with {EXPERIMENT}, t as (select q_id, doc_id, -abs(length(q_text) - length(text))::double as score from dr join qs using (q_id) join co using (doc_id) where rank < 20)
select q_id, doc_id, score, (row_number() over (partition by q_id order by score desc, doc_id) - 1)::int as rank from t""")
def q_cross_rerank(spark, sf_dir):
    """The first twenty by vectors in the order of a model that reads query and document together."""
    from ..sources import providers

    x = experiment(spark, sf_dir)
    short = retrieval.dense_top(x["queries"].select("q_id", "qv"), x["corpus"].select("doc_id", "dv"), 20)
    short = short.join(x["queries"].select("q_id", "q_text"), "q_id").join(x["corpus"].select("doc_id", F.col("text").alias("d_text")), "doc_id")
    return retrieval.top(providers.cross_rerank(short, lambda q, d: [-abs(len(a) - len(b)) for a, b in zip(q, d)]), 20)


@query("select r_regionkey, r_name || ' again' as r_name from region")
def q_replaced(spark, sf_dir):
    """A table written, replaced and read."""
    r, path = read(spark, sf_dir, "region"), scratch(spark, "region")
    reports.save(r, path)
    reports.save(r.withColumn("r_name", F.concat("r_name", F.lit(" again"))), path)
    return spark.read.parquet(path).select("r_regionkey", "r_name")


@query("select vec_id as id, label + 1 as label, case when vec_id % 2 = 0 then 'changed' else 'kept' end as state from embeddings")
def q_vector_cache(spark, sf_dir):
    """A cache of vectors by id and text: rows whose text has changed are made again, and no stale row is read."""
    from ..sources import providers

    e, path = read(spark, sf_dir, "embeddings"), scratch(spark, "vectors")
    old = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("text "), "label").alias("text"), "label")
    new = old.withColumn("text", F.when(F.col("id") % 2 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))

    def build(state: str):
        return lambda df: df.select("id", (F.col("label") + 1).alias("label"), F.lit(state).alias("state"))

    providers.cached(old, "id", path, build("kept"), "text").count()
    return providers.cached(new, "id", path, build("changed"), "text").select("id", "label", "state")


@query()
def q_hyde(spark, sf_dir):
    """Queries as they stand, in another language (a stand-in) and as hypothetical documents, over hashed vectors of all documents; hashes have no SQL form, so rows only."""
    from ..sources import providers

    x = experiment(spark, sf_dir)
    docs = providers.embed(x["corpus"].select("doc_id", "text"), "doc_id", "text").withColumnRenamed("embedding", "dv")
    said = {"plain": lambda t: t, "translated": lambda t: [" ".join(s.split()[::-1]) for s in t], "hypothetical": lambda t: [s + " " + s for s in t]}
    out = {}
    for name, f in said.items():
        made = providers.text_cache(x["queries"].select("q_id", "q_text"), "q_id", "q_text", scratch(spark, name), f, "said")
        q = providers.embed(made, "q_id", "said", side="query").withColumnRenamed("embedding", "qv")
        out[name] = experiments.outcomes(retrieval.dense_top(q, docs, 10), x["relevant"], x["queries"])
    return experiments.report(out, "plain")
