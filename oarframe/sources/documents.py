"""Reading and writing race documents and domain tables (SRC-1 to SRC-4, SRC-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RACE_DOCUMENT, schema_of


def read_race_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One JSON document in each file, or in each line; `names` holds the heterogeneous name pairs as (name, edition).

    Files of lines can be split among tasks; a file of one document cannot.
    """
    docs = spark.read.schema(RACE_DOCUMENT).json(path, multiLine=not lines)
    pair = lambda p: F.struct(F.try_element_at(p, F.lit(1)).alias("name"), F.try_element_at(p, F.lit(2)).try_cast("int").alias("edition"))
    return docs.withColumn("names", F.transform("normalized_names", pair))


def write_race_documents(docs: DataFrame, path: str, partition_by: tuple = ("datasource",)) -> None:
    """Documents as JSON lines, in folders by source."""
    docs.drop("names").write.partitionBy(*partition_by).json(path)


def quarantine(docs: DataFrame, valid: Column, path: str) -> DataFrame:
    """Writes the documents that are not valid (null counts as not) aside and returns the others."""
    ok = F.coalesce(valid, F.lit(False))
    docs.filter(~ok).drop("names").write.mode("append").json(path)
    return docs.filter(ok)


def read_table(spark: SparkSession, name: str, path: str, form: str = "parquet") -> DataFrame:
    """A domain table with its full schema; arrays and metadata may be JSON strings, missing columns are null.

    Lap times written as text become milliseconds.
    """
    raw = spark.read.format(form).load(path)
    out = []
    for field in schema_of(name):
        source = "laps" if name == "participant" and field.name == "laps_ms" and "laps_ms" not in raw.columns else field.name
        if source not in raw.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value, have = F.col(source), raw.schema[source].dataType
        if source == "laps" and name == "participant":
            texts = F.from_json(value, "array<string>") if isinstance(have, T.StringType) else value
            value = F.transform(texts, _time_ms)
        elif isinstance(have, T.StringType) and isinstance(field.dataType, (T.ArrayType, T.StructType)):
            value = F.from_json(value, field.dataType)
        else:
            value = value.cast(field.dataType)
        out.append(value.alias(field.name))
    return raw.select(*out)


def _time_ms(text: Column) -> Column:
    """Milliseconds of `HH:MM:SS[.ffffff]`."""
    part = lambda i: F.split_part(text, F.lit(":"), F.lit(i))
    return ((part(1).cast("decimal(20,6)") * 3600 + part(2).cast("decimal(20,6)") * 60 + part(3).cast("decimal(20,6)")) * 1000).cast("long")


HEADING = r"(?is)<h2[^>]*>(.*?)</h2>"
PARTS = r"^(.*?) - (\d{2}-\d{2}-\d{4}) \((\d{2}:\d{2})\) - (\d+) metros(?: - (.*))?$"


def explode_multi_table_pages(pages: DataFrame, heading: str = HEADING) -> DataFrame:
    """(page_id, table, heading, place, date, time, distance, tag): a row for each headed table of a page, from 1.

    A heading of another form keeps its text and has null parts; a page without headings gives no row.
    """
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(heading), F.lit(1))).alias("n", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]+>", " "), r"\s+", " "))
    rows = found.select("page_id", (F.col("n") + 1).alias("table"), text.alias("heading"))
    shaped = F.col("heading").rlike(PARTS)
    part = lambda i: F.when(shaped, F.regexp_extract("heading", PARTS, i))
    date = F.try_to_timestamp(part(2), F.lit("dd-MM-yyyy")).cast("date")
    return rows.withColumns({"place": part(1), "date": date, "time": part(3), "distance": part(4).cast("int"), "tag": F.nullif(part(5), F.lit(""))})
