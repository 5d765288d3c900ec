"""User scores as training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cahier.session import cut_lineage

MINIMUM = 100
BATCH = 8


def in_domain(score: str = "score") -> Column:
    return F.col(score).between(0, 1)


def feedback_gate(feedback: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """One row: status and count."""
    n = F.count("*")
    return feedback.agg(F.when(n < minimum, "not_enough_feedback").otherwise("ok").alias("status"), n.alias("count"))


def no_feedback(spark: SparkSession) -> DataFrame:
    """The gate's row where there is no log yet."""
    return spark.range(1).select(F.lit("no_feedback_file").alias("status"), F.lit(0).cast("bigint").alias("count"))


def training_pairs(feedback: DataFrame, valid_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """texts, label, and the columns named in ``keep``: one row per line of feedback."""
    rows = feedback.where(in_domain()) if valid_only else feedback
    return rows.select(*keep, F.array("question", "response").alias("texts"), F.col("score").alias("label"))


def shuffle_key(*cols: str, seed: int = 0) -> Column:
    """A number from the row's content and the seed, the same in every engine: 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])), 1, 15), 16, 10).cast("bigint")


def training_batches(rows: DataFrame, keys: tuple[str, ...], batch: int = BATCH, seed: int = 0, rows_per_task: int = 1_000_000) -> DataFrame:
    """rows + batch, at: one epoch, shuffled by hash and cut into batches of ``batch`` rows, all full but the last.

    Rows are dealt by ranges of the hash, as many as their number asks for, and sorted in their range; a row's place in
    the epoch is its place in the range and the sizes of those before, so no task orders more than a range.
    """
    keyed = rows.withColumn("_k", shuffle_key(*keys, seed=seed))
    parts = max(-(-keyed.count() // rows_per_task), rows.sparkSession.sparkContext.defaultParallelism)
    ranged = keyed.repartitionByRange(parts, "_k", *keys).sortWithinPartitions("_k", *keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", place))  # places must not be worked out again
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    at = F.col("_start") + F.col("_row")
    placed = ranged.join(F.broadcast(starts), "_part").withColumn("batch", F.floor(at / batch)).withColumn("at", (at % batch).cast("int"))
    return placed.drop("_k", "_part", "_row", "_start")
