"""Session helpers: a local session for tests and benchmarks, and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library assumes (UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cahier")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows of long texts that go to Python at once; Spark's own default of 10,000 would be tens of MB in every copy.
TEXT_ROWS_PER_BATCH = 1000


#: Bytes that go to Python at once.
BYTES_PER_BATCH = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers on tables of long texts, by rows and by bytes; a smaller bound is kept."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= TEXT_ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; where it is unset, a temporary one in local runs only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder there that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cahier-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder, where it outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, as Parquet: rows that repeat themselves take a part of the room."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
