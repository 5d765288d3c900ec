"""The catalogue of questions: a JSON object of label -> retrieval text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_catalog(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def explode_catalog(df: DataFrame, json: str) -> DataFrame:
    """query_ord (from 0, in the order of the file), question, query."""
    return df.select(F.posexplode(parse_catalog(F.col(json))).alias("query_ord", "question", "query"))


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file; a missing file is an error."""
    return explode_catalog(spark.read.text(path, wholetext=True), "value")
