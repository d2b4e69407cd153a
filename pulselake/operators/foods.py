"""Food tables: nutrient pivot, ingredients, open products, food log, reconciliation."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import number
from ..functions.text import food_name
from . import retrieval
from .keys import keep_first

CURATED = ("sr_legacy_food", "foundation_food", "survey_fndds_food")
#: Nutrient id, column, key in the graph, display name, unit, category.
NUTRIENTS = (
    (1008, "energy_kcal", "energy", "Energy", "kcal", "energy"), (1003, "protein_g", "protein", "Protein", "g", "macro"),
    (1005, "carbs_g", "carbohydrate", "Carbohydrate", "g", "macro"), (1004, "fat_g", "fat", "Fat", "g", "macro"),
    (1258, "saturated_fat_g", "saturated_fat", "Saturated fat", "g", "macro"), (1079, "fiber_g", "fiber", "Fiber", "g", "macro"),
    (2000, "sugars_g", "sugars", "Sugars", "g", "macro"), (1253, "cholesterol_mg", "cholesterol", "Cholesterol", "mg", "micro"),
    (1093, "sodium_mg", "sodium", "Sodium", "mg", "micro"), (1092, "potassium_mg", "potassium", "Potassium", "mg", "micro"),
    (1087, "calcium_mg", "calcium", "Calcium", "mg", "micro"), (1089, "iron_mg", "iron", "Iron", "mg", "micro"),
    (1090, "magnesium_mg", "magnesium", "Magnesium", "mg", "micro"), (1114, "vitamin_d_ug", "vitamin_d", "Vitamin D", "ug", "micro"),
    (1178, "vitamin_b12_ug", "vitamin_b12", "Vitamin B12", "ug", "micro"), (1177, "folate_ug", "folate", "Folate", "ug", "micro"),
)
COUNTRIES = ("hungary", "germany", "austria")


def foods(food: DataFrame, category: DataFrame, food_nutrient: DataFrame) -> DataFrame:
    """Curated foods with one column for each nutrient; the filters reach the big amounts table before the join."""
    curated = food.where(F.col("data_type").isin(*CURATED)).select("fdc_id", F.col("description"), "data_type", "food_category_id")
    amounts = food_nutrient.where(F.col("nutrient_id").isin(*[n[0] for n in NUTRIENTS])).select("fdc_id", "nutrient_id", "amount")
    wide = amounts.join(curated.select("fdc_id"), "fdc_id", "left_semi").groupBy("fdc_id").agg(*(F.max(F.when(F.col("nutrient_id") == n[0], F.col("amount"))).alias(n[1]) for n in NUTRIENTS))
    names = F.broadcast(category.select(F.col("id").alias("food_category_id"), F.col("description").alias("category")))
    return curated.join(wide, "fdc_id").join(names, "food_category_id", "left").select("fdc_id", "description", "data_type", "category", *(n[1] for n in NUTRIENTS))


def ingredient_links(input_food: DataFrame, foods_table: DataFrame) -> DataFrame:
    """(fdc_id, seq_num, ingredient_key, ingredient_name, gram_weight) of the curated foods."""
    named = input_food.where(F.col("sr_description").isNotNull()).join(foods_table.select("fdc_id"), "fdc_id", "left_semi")
    return named.select("fdc_id", "seq_num", F.lower(F.trim("sr_description")).alias("ingredient_key"), F.col("sr_description").alias("ingredient_name"), "gram_weight")


def ingredients(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("ingredient_key").alias("key")).agg(F.min("ingredient_name").alias("name"), F.countDistinct("fdc_id").alias("n_foods"))


def open_products(raw: DataFrame, countries: tuple[str, ...] = COUNTRIES) -> DataFrame:
    """Products sold in any of the countries with a usable name, the first by code of each name and brand."""
    sold = F.lit(False)
    for c in countries:
        sold = sold | F.contains("countries_tags", F.lit(f"en:{c}"))
    r = raw.where(sold & F.col("product_name").isNotNull() & (F.length(F.trim("product_name")) >= 2))
    r = r.withColumn("_name", F.lower(F.trim("product_name"))).withColumn("_brand", F.lower(F.coalesce("brands", F.lit(""))))
    r = keep_first(r, ["_name", "_brand"], ["code"])
    return r.select(
        F.col("code").alias("off_code"), F.trim("product_name").alias("description"), F.nullif(F.trim("brands"), F.lit("")).alias("brands"), F.col("categories_tags").alias("categories"),
        *(number(F.col(f"`{c}`")).alias(n) for c, n in (("energy-kcal_100g", "energy_kcal"), ("proteins_100g", "protein_g"), ("fat_100g", "fat_g"), ("carbohydrates_100g", "carbs_g"))),
    )


def logged_products(log: DataFrame) -> DataFrame:
    """Mean values for 100 g of each product and how often it was logged."""
    per = {"energy_kcal": ("kcal_per_g", 1), "protein_g": ("protein_per_g", 2), "fat_g": ("fat_per_g", 2), "carbs_g": ("carbs_per_g", 2)}
    return log.groupBy("product").agg(*(F.round(F.avg(c) * 100, d).alias(n) for n, (c, d) in per.items()), F.count("*").alias("times_logged"))


def fuzzy_match(products: DataFrame, foods_table: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(product, fdc_id, score): the food whose normal form is closest by ratio, for candidates that share a word; of equal normal forms the largest id counts."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)], dtype=float)

    f = foods_table.select("fdc_id", food_name(F.col("description")).alias("d_norm")).where("d_norm <> ''").groupBy("d_norm").agg(F.max("fdc_id").alias("fdc_id"))
    p = products.select("product", food_name(F.col("product")).alias("p_norm")).where("p_norm <> ''").distinct()
    pairs = p.select("product", "p_norm", F.explode(F.array_distinct(F.split("p_norm", " "))).alias("w")).join(f.select("fdc_id", "d_norm", F.explode(F.array_distinct(F.split("d_norm", " "))).alias("w")), "w")
    scored = pairs.select("product", "p_norm", "fdc_id", "d_norm").distinct().withColumn("score", ratio("p_norm", "d_norm")).where(F.col("score") >= cutoff)
    w = W.partitionBy("product").orderBy(F.desc("score"), "d_norm")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("product", "fdc_id", "score")


def food_map(products: DataFrame, foods_table: DataFrame, shortlist: int = 25, method: str = "translate+embed+macro") -> DataFrame:
    """(product, en_name, fdc_id, description, cosine, macro_sim, score, method): best of the cosine shortlist after the macro rerank.

    ``products`` and ``foods_table`` carry ``embedding`` beside their macros; products are the stated query set.
    """
    four = ("energy_kcal", "protein_g", "fat_g", "carbs_g")
    q = products.select(F.col("product").alias("q_id"), F.col("embedding").alias("qv"), retrieval.macros(*map(F.col, four)).alias("qm"), "en_name")
    d = foods_table.select(F.col("fdc_id").alias("doc_id"), F.col("embedding").alias("dv"), retrieval.macros(*map(F.col, four)).alias("dm"), "description")
    short = retrieval.dense_top(q.select("q_id", "qv"), d.select("doc_id", "dv"), shortlist).drop("rank")
    short = short.join(d.select("doc_id", "dm", "description"), "doc_id").join(q.select("q_id", "qm", "en_name"), "q_id")
    best = retrieval.macro_rerank(short.select("q_id", "doc_id", "score", "qm", "dm"), shortlist)
    return best.join(short.select("q_id", "doc_id", "description", "en_name"), ["q_id", "doc_id"]).select(F.col("q_id").alias("product"), "en_name", F.col("doc_id").alias("fdc_id"), "description", "cosine", "macro_sim", "score", F.lit(method).alias("method"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, share): how many rows have a value, in one pass."""
    row = df.agg(F.count("*").alias("_all"), *(F.count(c).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n"), F.try_divide(c, "_all").alias("share")) for c in columns))).alias("x")).select("x.*")


def local_time(day: Column, time: Column) -> Column:
    """Wall-clock timestamp of a log day and an `HH:mm` time (midnight if there is none)."""
    return F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), F.coalesce(time, F.lit("00:00"))), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
