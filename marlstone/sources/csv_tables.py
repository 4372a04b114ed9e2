"""CSV with repeated header names, and the small configuration readers."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .storage import exists, first_line


def unique_names(names: list[str]) -> list[str]:
    """The second x becomes x__2, the third x__3."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}__{seen[n]}")
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns under unique names; short rows are null at the end, surplus cells go; an empty file has no columns."""
    line = first_line(spark, path)  # a header of several lines isn't read
    header = next(csv.reader([line])) if line else None
    if not header:
        return spark.createDataFrame([], StructType([]))
    schema = StructType([StructField(n, StringType()) for n in unique_names(header)])
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(category, term) of a JSON object {category: [terms]}; anything else is an error."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    t = t.select(F.when(F.col("m").isNull(), F.raise_error(F.lit("no object of term lists")).cast("map<string,array<string>>")).otherwise(F.col("m")).alias("m"))
    return t.select(F.explode("m").alias("category", "terms")).select("category", F.explode("terms").alias("term"))


def read_progress(spark: SparkSession, path: str, site: str) -> DataFrame:
    """(site, term) of a checkpoint file; its flat old form belongs to ``site``; a missing or unreadable file has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "site string, term string")
    j = F.from_json("value", "markets map<string,array<string>>, completed_terms array<string>")
    t = spark.read.text(path, wholetext=True).select(j.alias("j")).filter("j is not null")
    new = t.select(F.explode("j.markets").alias("site", "terms"))
    old = t.filter("j.markets is null").select(F.lit(site).alias("site"), F.col("j.completed_terms").alias("terms"))
    return new.unionByName(old).select("site", F.explode("terms").alias("term"))


def read_existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty under the schema if it isn't there yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
