"""Which documents are new, which are known already, and which requests are for unknown ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_docs(incoming: DataFrame, index: DataFrame, arrival: str | None = None) -> DataFrame:
    """Rows whose doc_id is not in the index; of several with one id in the batch the first to arrive."""
    fresh = incoming.join(index.select("doc_id"), "doc_id", "left_anti")
    if arrival is None:
        return fresh
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(arrival))
    return fresh.withColumn("_first", first).where("_first = 1").drop("_first")


def dup_docs(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """The rejected ones, with the reason."""
    return incoming.join(index.select("doc_id"), "doc_id", "left_semi").withColumn("error", F.lit("document already indexed"))


def require_doc(requests: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests for known documents, the others with an error)."""
    ids = index.select("doc_id")
    return requests.join(ids, "doc_id", "left_semi"), requests.join(ids, "doc_id", "left_anti").withColumn("error", F.lit("unknown document"))
