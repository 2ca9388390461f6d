"""Readers of term, name, allow and registry files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_words


def read_terms(spark: SparkSession, path: str, category: str = "sensitive_term") -> DataFrame:
    """Distinct (term, category), one term a line; blank lines and those that begin with ``#`` don't count."""
    term = F.trim("value")
    return spark.read.text(path).select(term.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#")).distinct().withColumn("category", F.lit(category))


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalised word sequences of a term file."""
    return read_terms(spark, path).select(F.array_join(normalize_words(F.col("term")), " ").alias("sequence")).filter("sequence <> ''").distinct()


def read_names_text(spark: SparkSession, path: str, kind: str = "person") -> DataFrame:
    """(name, kind), one name a line; ``#`` marks a comment only as the very first character."""
    return spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.trim("value").alias("name"), F.lit(kind).alias("kind")).filter("name <> ''")


def read_names_records(spark: SparkSession, path: str, field: str, kind: str = "company") -> DataFrame:
    """(name, kind) from exported records: the field's value in ``cellValuesByFieldId``, or in ``fields`` where that is missing or empty. Only texts count."""
    schema = "records array<struct<cellValuesByFieldId:map<string,variant>, fields:map<string,variant>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("records").alias("r"))
    values = F.when(F.size("r.cellValuesByFieldId") > 0, F.col("r.cellValuesByFieldId")).otherwise(F.col("r.fields"))
    rows = rows.select(F.element_at(values, field).alias("v")).filter(F.schema_of_variant("v") == "STRING")
    return rows.select(F.trim(F.col("v").cast("string")).alias("name"), F.lit(kind).alias("kind")).filter("name <> ''")


def read_synthetic_registry(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) from a JSON object of paths and hashes; ``\\`` becomes ``/``."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "sha256"))
    return rows.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
