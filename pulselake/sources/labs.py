"""Laboratory reports: files, triage, extraction through a provider, idempotent loading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import append_new, natural_key

TEXT_PAGE_CHARS = 60
RESULT = "struct<test_name:string,value:string,unit:string,ref_low:double,ref_high:double,ref_text:string,flag:string>"
PANEL = f"struct<results:array<{RESULT}>>"


def read_pages(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, pages): the text of every page of each file; ``reader`` turns one file's bytes into page texts."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "pages": [reader(bytes(c)) for c in pdf["content"]]})

    return files.mapInPandas(run, "path string, pages array<string>")


def whole_text(pages: Column) -> Column:
    return F.array_join(pages, "\n")


def triage(pages: Column) -> Column:
    """text if every page has enough characters, scanned if none has, else mixed; a file without pages is scanned."""
    good = F.size(F.filter(pages, lambda p: F.length(F.trim(p)) >= TEXT_PAGE_CHARS))
    return F.when((F.size(pages) > 0) & (good == F.size(pages)), "text").when(good == 0, "scanned").otherwise("mixed")


def file_day(path: Column) -> Column:
    """The day from eight digits in the file's name; a name without them raises."""
    digits = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{8})", 1)
    return F.when(digits != "", F.to_date(digits, "yyyyMMdd")).otherwise(F.raise_error(F.concat(F.lit("no date in "), path)).cast("date"))


def extract(texts: DataFrame, provider: Callable[[str], tuple[str | None, int, int]]) -> DataFrame:
    """(path, reply, tokens_in, tokens_out, error) of ``texts(path, text)``; the provider returns JSON text and token counts, an exception becomes the row's error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    out.append((path, *provider(text), None))
                except Exception as e:  # noqa: BLE001  one file's failure is that file's result
                    out.append((path, None, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "reply", "tokens_in", "tokens_out", "error"])

    return texts.select("path", "text").mapInPandas(run, "path string, reply string, tokens_in long, tokens_out long, error string")


def lab_rows(replies: DataFrame, model: str) -> DataFrame:
    """Result rows of the replies that hold the panel's schema."""
    p = replies.select(file_day(F.col("path")).alias("panel_date"), F.element_at(F.split("path", "/"), -1).alias("source_file"), F.from_json("reply", PANEL, {"mode": "PERMISSIVE"}).alias("p"))
    r = p.select("panel_date", "source_file", F.explode("p.results").alias("r")).where("r.test_name is not null")
    value = F.regexp_replace("r.value", ",", ".").try_cast("double")
    return r.select(
        natural_key(F.col("source_file"), F.col("r.test_name"), F.col("panel_date")).alias("row_key"), "panel_date", "source_file", "r.test_name", value.alias("value_num"), F.when(value.isNull(), F.col("r.value")).alias("value_str"),
        "r.unit", "r.ref_low", "r.ref_high", "r.ref_text", "r.flag", F.lit(model).alias("model"), F.current_timestamp().alias("extracted_at"),
    )


def load_panels(rows: DataFrame, path: str) -> int:
    """Append the results that the table under ``path`` lacks; the first extraction of a result stays."""
    return append_new(rows, path, "row_key")


def review_csv(rows: DataFrame, path: str) -> None:
    rows.orderBy("panel_date", "test_name").coalesce(1).write.mode("overwrite").csv(path, header=True)


def route_counts(pages: DataFrame) -> DataFrame:
    """(route, files, pages, chars) of ``pages(path, pages)`` by triage."""
    p = pages.select(triage(F.col("pages")).alias("route"), F.size("pages").alias("n"), F.length(whole_text(F.col("pages"))).alias("c"))
    return p.groupBy("route").agg(F.count("*").alias("files"), F.sum("n").alias("pages"), F.sum("c").alias("chars"))


def file_counts(replies: DataFrame, rows: DataFrame) -> DataFrame:
    """(source_file, results, numeric, status, tokens_in, tokens_out) of every file of an extraction: what ``lab_rows`` made of its reply, or its error."""
    per = rows.groupBy("source_file").agg(F.count("*").alias("results"), F.count("value_num").alias("numeric"))
    r = replies.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.coalesce(F.concat(F.lit("ERROR "), "error"), F.lit("ok")).alias("status"), "tokens_in", "tokens_out")
    return r.join(per, "source_file", "left").select("source_file", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("numeric", F.lit(0)).alias("numeric"), "status", "tokens_in", "tokens_out")


def manifest(pages: DataFrame, path: str) -> None:
    pages.select("path", F.size("pages").alias("n_pages"), triage(F.col("pages")).alias("kind")).write.mode("overwrite").json(path)
