"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

Everything is DataFrame operations, the tree included: a level is a table of its nodes (dimension, cut). To find the cuts
of a level, Spark sums bytes into a fixed number of bins per node and narrows the bin that holds the median until it is a
single row or too light to matter. Tables of nodes meet the rows by a join on the node, broadcast up to BROADCAST_ROWS
rows and by shuffle beyond; the driver sees counts only, so hundreds of thousands of leaves are no more work for it than
twenty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cahier.session import cut_lineage

BINS = 4096
#: A cut may be off by this share of a leaf's bytes (or by half a document, if that is more).
TOLERANCE = 0.0005
ROWS_PER_BUCKET = 20_000
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _few(df: DataFrame, n: int) -> DataFrame:
    """A table of about ``n`` nodes in at most ``n`` tasks, whatever the number of shuffle partitions."""
    return df.coalesce(max(1, n))


def _ordered(value: Column, tie: Column) -> Column:
    """A 48-bit key: 16 bits of value over 32 bits that break ties, so that a hot value can be cut too."""
    return F.shiftleft(value.cast("long"), 32).bitwiseOR(tie)


def _hashed(col: Column) -> Column:
    return F.when(col.isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(col), 48))


def _narrow(points: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """One round for the open nodes: sums per bin of [lo, hi], then the bin with the target weight becomes [lo, hi]."""
    step = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("hi") - F.col("lo") + 1) / BINS))
    at = points.select("leaf", "bytes", "keys").join(_small(nodes.select("leaf", "dim", "lo", "hi", step.alias("step")), n), "leaf")
    at = at.withColumn("k", F.get("keys", F.col("dim"))).where("k between lo and hi").selectExpr("leaf", "bytes", "(k - lo) div step as bin")
    bins = at.groupBy("leaf", "bin").agg(F.sum("bytes").alias("w"), F.count("*").alias("c"))
    bins = bins.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("bin", "w", "c"))).alias("bins")).join(_small(nodes.withColumn("step", step), n), "leaf")  # at most BINS each
    # Along the bins until the target is reached; the last one, if it is not.
    def go(at: Column, to: Column) -> Column:
        return F.when(at["below"] + at["w"] >= F.col("target"), at).otherwise(F.struct(to["bin"].alias("bin"), to["w"].alias("w"), to["c"].alias("c"), (at["below"] + at["w"]).alias("below")))

    found = bins.withColumn("at", F.aggregate(F.slice("bins", 2, BINS), F.struct(F.col("bins")[0]["bin"].alias("bin"), F.col("bins")[0]["w"].alias("w"), F.col("bins")[0]["c"].alias("c"), F.col("below").alias("below")), go))
    lo = F.col("lo") + F.col("at.bin") * F.col("step")
    return found.select("leaf", "dim", F.col("at.below").alias("below"), "target", "slack", lo.alias("lo"), F.least(F.col("hi"), lo + F.col("step") - 1).alias("hi"), F.col("at.w").alias("weight"), F.col("at.c").alias("rows"))


def _go_down(points: DataFrame, level: DataFrame, n: int) -> DataFrame:
    """The rows in the nodes of the next level. Columns: leaf (the node's first leaf), room (its number of leaves), keys."""
    right = F.get("keys", F.col("dim")) >= F.col("cut")
    half = F.floor(F.col("room") / 2).cast("int")
    joined = points.join(_small(level, n), "leaf", "left")
    leaf = F.when(right, F.col("leaf") + half).otherwise(F.col("leaf"))
    room = F.when(F.col("room") <= 1, F.col("room")).when(right, F.col("room") - half).otherwise(half)
    return joined.select(leaf.alias("leaf"), room.alias("room"), *[c for c in points.columns if c not in ("leaf", "room")])


def build_tree(points: DataFrame, leaves: int) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """``points``: bytes and keys, an array of one 48-bit number per dimension. The rows with their ``leaf``, and the levels of
    the tree (leaf, dim, cut: rows of node ``leaf`` with at least ``cut`` go right) with the number of nodes in each."""
    points = points.select(F.lit(0).alias("leaf"), F.lit(leaves).alias("room"), *points.columns)
    size = points.select(F.size("keys")).limit(1).first()
    dims, levels = range(size[0] if size else 0), []
    ends = [f(F.get("keys", F.lit(i))).alias(f"{n}{i}") for i in dims for n, f in (("lo", F.min), ("hi", F.max))]
    span = points.agg(*ends).first() if size else None
    room = leaves if size else 1
    while room > 1:
        stats = points.where("room > 1").groupBy("leaf").agg(F.sum("bytes").alias("bytes"), F.first("room").alias("room"), *ends)
        wide = [(F.col(f"hi{i}") - F.col(f"lo{i}")) / F.lit(float(max(1, span[f"hi{i}"] - span[f"lo{i}"]))) for i in dims]
        widest = F.array_position(F.array(*wide), F.greatest(*wide) if len(wide) > 1 else wide[0]).cast("int") - 1  # the first of the widest
        of = lambda n: F.get(F.array(*[F.col(f"{n}{i}") for i in dims]), F.col("dim"))
        target = F.col("bytes") * F.floor(F.col("room") / 2) / F.col("room")
        nodes = stats.withColumn("dim", widest).select("leaf", "dim", F.lit(0).cast("long").alias("below"), target.alias("target"), (TOLERANCE * F.col("bytes") / F.col("room")).alias("slack"), of("lo").alias("lo"), of("hi").alias("hi"))
        nodes, done = cut_lineage(_few(nodes, 1 << len(levels))), []  # a level has at most twice the nodes of the one above
        n = n_nodes = nodes.count()
        while n:
            nodes = cut_lineage(_few(_narrow(points, nodes, n), n))
            on = (F.col("rows") > 1) & (F.col("weight") > F.col("slack")) & (F.col("lo") < F.col("hi"))
            done.append(nodes.where(~on))
            nodes = nodes.where(on).drop("weight", "rows")
            n = nodes.count()
        level = done[0]
        for more in done[1:]:
            level = level.unionByName(more)
        over = F.col("below") + F.col("weight") - F.col("target")
        level = cut_lineage(_few(level, n_nodes).select("leaf", "dim", F.when(over <= F.col("target") - F.col("below"), F.col("hi") + 1).otherwise(F.col("lo")).alias("cut")))
        levels.append((level, n_nodes))
        points = cut_lineage(_go_down(points, level, n_nodes))
        room -= room // 2
    return points, levels


def slots(df: DataFrame, group: str, tie: str, order: list[str], rows: int, groups: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each group: a window per hashed bucket, moved by the counts of the buckets before.

    Rows of one tie are dealt to the buckets by the input partition they lie in, so repeated rows never meet in one window;
    ``df`` must be a checkpointed table. The table of counts has ``groups x buckets`` rows, about one per ROWS_PER_BUCKET rows of input; it is broadcast up
    to BROADCAST_ROWS rows and joined by shuffle beyond.
    """
    buckets = max(1, -(-rows // (groups * ROWS_PER_BUCKET)), min(64, rows // (groups * 32)))
    df = df.withColumn("_bucket", F.pmod(F.col(tie) + F.spark_partition_id(), F.lit(buckets)).cast("int"))
    counts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    df = df.withColumn("_rank", F.row_number().over(inside)).join(_small(counts, groups * buckets), [group, "_bucket"])
    return df.withColumn("slot", (F.col("_offset") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_offset", "_rank")


def _points(docs: DataFrame, id_col: str, text_col: str, categories: tuple[str, ...], *others: Column) -> DataFrame:
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")
    tie = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 32)
    slim = docs.select(size.alias("bytes"), tie.alias("tie"), F.array(*[F.col(c).cast("string") for c in categories]).cast("array<string>").alias("c"), *others)
    values = [F.floor(F.log2(F.col("bytes").cast("double")) * (1 << 11)), *[_hashed(F.get("c", F.lit(i))) for i in range(len(categories))]]
    return slim.withColumn("keys", F.array(*[_ordered(v, F.col("tie")) for v in values])).drop("c")


def _shards(points: DataFrame, shards: int | None, target_bytes: int | None) -> tuple[int, int]:
    """Number of shards and of rows."""
    total, rows = points.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    return shards or max(1, -(-total // (target_bytes or 256 << 20))), rows


def with_shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` with their shard (a column of that name is replaced); columns may have any names.

    Nulls, repeated rows and empty tables are as for ``kd_shards``. No row is shuffled while the levels of the tree are
    small enough to be broadcast.
    """
    points = cut_lineage(_points(docs, id_col, text_col, categories).drop("tie"))
    shards, _ = _shards(points, shards, target_bytes)
    _, levels = build_tree(points, shards)
    rest = [c for c in docs.columns if c != "shard"]
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in rest] or [F.lit(0).alias("_")]).alias("row")
    placed = _points(docs, id_col, text_col, categories, row).select(F.lit(0).alias("leaf"), F.lit(shards).alias("room"), "keys", "row")
    for level, n in levels:
        placed = _go_down(placed, level, n)
    return placed.select(*[F.col("row")[c].alias(c) for c in rest], F.col("leaf").alias("shard"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot.

    Give the number of shards, or the target bytes of a leaf. Dimensions: size (log scale) and the categories (laid
    out by hash). A null text has no bytes (size 8, checksum 0); a null category is a value of its own; repeated rows
    and equal ids are kept as they are; ties are broken by a hash of id and text, so only rows equal in both cannot be
    parted; an empty table gives no rows; with fewer rows than shards some shards are empty; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    points = cut_lineage(_points(docs, id_col, text_col, categories, F.col(id_col).alias("doc_id"), F.crc32(text).alias("text_crc32")))
    shards, rows = _shards(points, shards, target_bytes)
    placed = build_tree(points, shards)[0].select("doc_id", F.col("bytes").alias("size"), "text_crc32", "tie", F.col("leaf").alias("shard"))
    return slots(placed, "shard", "tie", ["doc_id", "tie", "text_crc32"], rows, shards).drop("tie")
