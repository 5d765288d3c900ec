"""The feedback log and the three project tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cahier import schemas


def append_feedback(df: DataFrame, path: str) -> None:
    """One JSON line per row."""
    df.select("question", "response", "score").write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Fixed schema; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schemas.FEEDBACK).option("mode", "FAILFAST").json(path)


def write_tables(path: str, projects: DataFrame | None = None, queries: DataFrame | None = None, answers: DataFrame | None = None, mode: str = "append") -> None:
    for name, df in (("projects", projects), ("queries", queries), ("answers", answers)):
        if df is not None:
            df.write.mode(mode).parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("projects", schemas.PROJECTS), ("queries", schemas.QUERIES), ("answers", schemas.ANSWERS)))
