"""The two append-shaped inputs as streams: the feedback log, and documents as their pages arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cahier import schemas
from cahier.operators.feedback import MINIMUM
from cahier.session import cut_lineage

#: Batches that a document of unknown length waits for further pages.
PATIENCE = 1


def read_if_there(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at ``path``, or none of its rows where there is no table yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def feedback_counts(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A streaming DataFrame: question, n, total score. Its state is one row per question."""
    reader = spark.readStream.schema(schemas.FEEDBACK)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.json(path).groupBy("question").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


GATE = "status string, count bigint, batch_id bigint"


def run_counts(counts: DataFrame, out: str, checkpoint: str, gate: str | None = None, minimum: int = MINIMUM, on_open: Callable[[int], None] | None = None) -> StreamingQuery:
    """Takes what is there; each batch replaces the table at ``out`` as a whole, so a repeated batch does no harm.

    With ``gate``, a folder, the lines of all questions are counted over the whole log: ``gate/status`` has one row for
    the latest batch (not_enough_feedback or ok, the count, the batch), and ``gate/opened`` the row of the batch that
    reached ``minimum`` first. ``on_open`` is called with the count in that batch alone, also after a restart; again only
    if that very batch is run again because it did not end.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(batch)
        rows.write.mode("overwrite").parquet(out)
        if gate is None:
            return
        status = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")).select(F.when(F.col("count") < minimum, "not_enough_feedback").otherwise("ok").alias("status"), "count", F.lit(batch_id).cast("bigint").alias("batch_id"))
        now = status.first()
        opened = read_if_there(spark, f"{gate}/opened", GATE).first()
        if now["status"] == "ok" and (opened is None or opened["batch_id"] == batch_id):
            if on_open is not None:
                on_open(now["count"])
            status.coalesce(1).write.mode("overwrite").parquet(f"{gate}/opened")
        status.coalesce(1).write.mode("overwrite").parquet(f"{gate}/status")

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_schema(pages: StructType) -> StructType:
    return StructType([*pages.fields]).add("_latest", "long")


def run_ingest(pages: DataFrame, folder: str, job: Callable[[DataFrame], DataFrame], checkpoint: str, length: str | None = None, patience: int = PATIENCE) -> StreamingQuery:
    """Each micro-batch of a stream of pages is added to the documents that wait, and those that are complete go through
    ``job`` to the index. ``read_index(folder)`` reads what came out.

    A document is complete when it has as many different pages as its column ``length`` says; without that column, or
    where it is null, when ``patience`` batches have brought no page of it. Pages of one document in several batches thus
    give the same index as in one. The tables below ``folder`` are written per batch: ``index/batch_id=n`` (the job's
    rows), ``done/batch_id=n`` (the documents in it), ``late/batch_id=n`` (pages of documents that are in the index
    already, kept and not lost) and ``pending/batch_id=n`` (all that wait after batch n). A batch that is run again
    replaces its own, so it adds nothing. Pages that wait are kept in the shared folder, not in a task's memory; equal pages
    count once. Batches are numbered by the checkpoint, so a folder belongs to one checkpoint.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        at = lambda name: f"{folder}/{name}/batch_id={n}"
        waiting = pending_schema(batch.schema)
        done = read_if_there(spark, f"{folder}/done", "doc_id " + batch.schema["doc_id"].dataType.simpleString() + ", batch_id bigint").where(F.col("batch_id") < n).select("doc_id")
        fresh = batch.join(done, "doc_id", "left_anti").withColumn("_latest", F.lit(n).cast("bigint"))
        batch.join(done, "doc_id", "left_semi").write.mode("overwrite").parquet(at("late"))
        held = read_if_there(spark, f"{folder}/pending/batch_id={n - 1}", waiting)
        every = cut_lineage(held.select(*waiting.names).unionByName(fresh.select(*waiting.names)).dropDuplicates(["doc_id", "page_number", "text"]))
        _settle(every, waiting, at, job, n, length, patience)
        # Only batch n can be run again, from what waited after the one before it.
        spark.createDataFrame([], waiting).write.mode("overwrite").parquet(f"{folder}/pending/batch_id={n - 2}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _settle(every: DataFrame, waiting: StructType, at: Callable[[str], str], job: Callable[[DataFrame], DataFrame], n: int, length: str | None, patience: int) -> None:
    """Complete documents to the index, the others to those that wait."""
    stated = (F.max(length) if length else F.max(F.lit(None).cast("int"))).alias("_length")
    state = every.groupBy("doc_id").agg(stated, F.count_distinct(F.coalesce("page_number", F.lit(-1))).alias("_pages"), F.max("_latest").alias("_newest"))
    complete = F.when(F.col("_length").isNotNull(), F.col("_pages") >= F.col("_length")).otherwise(F.col("_newest") + patience <= n)
    ready = cut_lineage(state.where(complete).select("doc_id"))
    own = [c for c in waiting.names if c != "_latest"]
    job(every.join(ready, "doc_id", "left_semi").select(*own)).write.mode("overwrite").parquet(at("index"))
    every.join(ready, "doc_id", "left_anti").write.mode("overwrite").parquet(at("pending"))
    # Last, since it is what makes a document known to later batches.
    ready.write.mode("overwrite").parquet(at("done"))


def finish_ingest(spark: SparkSession, folder: str, pages: StructType, job: Callable[[DataFrame], DataFrame]) -> None:
    """The stream has ended: documents that still wait are taken as complete."""
    waiting = pending_schema(pages)
    table = read_if_there(spark, f"{folder}/pending", waiting.add("batch_id", "long"))
    last = table.agg(F.max("batch_id")).first()[0]
    if last is None:
        return
    waiting = StructType([f for f in waiting.fields if f.name != "batch_id"])
    every = cut_lineage(table.where(F.col("batch_id") == last).select(*waiting.names))
    _settle(every, waiting, lambda name: f"{folder}/{name}/batch_id={last + 1}", job, last + 1, None, 0)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """All that the stream's batches have put into the index, with their batch_id."""
    return spark.read.parquet(f"{folder}/index")
