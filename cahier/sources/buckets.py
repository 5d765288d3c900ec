"""Tables that are kept by document: hash buckets for joins without an exchange, and shards that are rewritten alone.

A table is partitioned by SHARDS shards of the key's hash and bucketed by the key inside each, one file per shard and
bucket. Documents are replaced by rewriting the shards that hold them; a scan joins by key on the buckets as they lie.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cahier.session import keep

SHARDS, BUCKETS = 16, 16


def name_of(path: str) -> str:
    """The table's name in a session's catalogue."""
    return f"cahier_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:16]}"


def shard_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """All rows of a shard's bucket in one task, so that they become one file."""
    bucket = F.pmod(F.hash(key), F.lit(BUCKETS))
    return df.withColumn("shard", shard_of(F.col(key))).repartition(SHARDS * BUCKETS, "shard", bucket)


def open_table(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame | None:
    """The table at ``path`` with its buckets, also one that another session wrote; None where there is none."""
    name = name_of(path)
    if not spark.catalog.tableExists(name):
        try:
            schema = spark.read.parquet(path).schema
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (shard) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {BUCKETS} BUCKETS LOCATION '{path}'")
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def replace_documents(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """``rows`` take the place of all rows of their documents. Only the shards that hold these are read and rewritten;
    other documents of those shards are kept, other shards are not touched. ``rows`` must not be without its documents'
    other rows: what is not in it is gone."""
    spark = rows.sparkSession
    table = open_table(spark, path, key)
    if table is None:
        _dealt(rows, key).write.partitionBy("shard").bucketBy(BUCKETS, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name_of(path))
        return
    rows = keep(rows)
    touched = [r[0] for r in rows.select(shard_of(F.col(key))).distinct().collect()]
    kept = table.where(F.col("shard").isin(touched)).join(rows.select(key).distinct(), key, "left_anti")
    every = keep(kept.drop("shard").select(*rows.columns).unionByName(rows))
    columns = [c for c in table.columns if c != "shard"]
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")  # the writer's own option does not reach tables
    try:
        _dealt(every.select(*columns), key).select(*columns, "shard").write.mode("overwrite").insertInto(name_of(path))
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
