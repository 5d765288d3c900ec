"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame operations. The fractional repetition of a source goes to the documents with the smallest seeded keys
until its words are filled. Where that prefix ends is found by sums over key ranges, twice refined, and then over the
keys of one narrow range, so that no task ever holds the rows of a source. Rows that are equal in id and text share a key;
if the cut falls among them, they are numbered where they lie, input partition by input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cahier.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BREAKS = r"[\x20\x09-\x0D]+"
KEY_BITS = 60
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, BREAKS), "")), F.lit(0)).cast("long")


def seeded_key(id_: Column, text: Column, seed: int) -> Column:
    """A number of 60 bits from the id's decimal text, the text and the seed, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), id_.cast("string"), F.md5(text))), 1, KEY_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, cap: float, budget: float | None = None) -> DataFrame:
    """``sources``: source, size, weight. Adds ``target``: shares of the budget (the sum of sizes, if not given) by
    weight, none above ``cap x size``, the excess reshared by weight among the others until none is above.

    Each round is one aggregate over the table of sources; the level of the water is the only state.
    """
    top = F.col("size") * F.lit(float(cap))
    total = sources.agg(F.sum("size")).first()[0] or 0
    budget = float(total) if budget is None else float(budget)
    level, clamped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > top if clamped >= 0 else F.lit(False)
        r = sources.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("free")).first()
        if r["n"] == clamped or not r["free"]:
            break
        clamped, level = r["n"], (budget - r["held"]) / r["free"]
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level) > top, top).otherwise(F.col("weight") * F.lit(level)) if r["free"] else top)


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (words), source_size, target, epochs (times it is taken), taken (words).

    ``weights``: source, weight; by default the sources in code-point order (null last) weigh 1, 2, 3, repeating.
    A source with target t and size s is repeated floor(t / s) times whole; of the rest, each document in the order
    of its seeded key (of id and text) is taken once more while its middle word is inside the rest, so a source misses
    its target by half a document at most. Null texts have size 0 and are taken 0 words; a null source is a source of
    its own; rows with one id or none are told apart by their texts, and of rows equal in both it is open which are
    taken once more, not how many; an empty table gives no rows; other columns are not read.
    """
    slim, table, n = _cuts(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    rows = slim.join(_small(table.withColumnRenamed("source", "_s"), n), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = _epochs(rows, F.col("size"), _in_doubt(table))
    return rows.select("doc_id", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).cast("long").alias("taken"))


def repeat(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, columns unchanged, with any names.

    What is decided is one key per source, up to which documents are taken once more; it meets the documents by a
    join of the table of sources, so no text is shuffled while that is small. Nulls, repeated rows and empty tables are
    as for ``mix``.
    """
    _, table, n = _cuts(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in names]).alias("row")
    own = docs.select(row, F.col(source_col).alias("source"), F.col(text_col).alias("text"), seeded_key(F.col(id_col), F.col(text_col), seed).alias("k"))
    rows = own.join(_small(table.withColumnRenamed("source", "_s"), n), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    size = F.when(F.col("k") == F.col("cut.k"), word_count(F.col("text")))  # only there it matters
    rows = _epochs(rows.withColumn("size", size).drop("text"), F.col("size"), _in_doubt(table)).where("epochs > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("copy")).select(*[F.col("row")[c].alias(c) for c in names])


def _in_doubt(table: DataFrame) -> bool:
    """Whether some source's cut is among rows with one key and size."""
    return not table.where("cut.m < cut.n").isEmpty()


def _epochs(rows: DataFrame, size: Column, in_doubt: bool) -> DataFrame:
    """``rows``: k and a source's no, whole, rest, cut (k, size, m of n rows). Adds ``epochs``."""
    at_cut = (F.col("k") == F.col("cut.k")) & (size == F.col("cut.size"))
    before = (F.col("k") < F.col("cut.k")) | ((F.col("k") == F.col("cut.k")) & (size < F.col("cut.size")))
    epochs = lambda extra: (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("int")
    if not in_doubt:
        return rows.withColumn("epochs", epochs(before | at_cut))
    doubt = F.coalesce(at_cut & (F.col("cut.m") < F.col("cut.n")), F.lit(False))
    equal = cut_lineage(rows.where(doubt).withColumn("part", F.spark_partition_id()))
    counts = equal.groupBy("no", "part").agg(F.count("*").alias("c"))
    offset = F.coalesce(F.sum("c").over(Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("no", "part", offset.alias("offset"))
    rank = F.row_number().over(Window.partitionBy("no", "part").orderBy("k"))
    equal = equal.withColumn("rank", rank).join(counts, ["no", "part"]).withColumn("epochs", epochs(F.col("offset") + F.col("rank") <= F.col("cut.m")))
    rest = rows.where(~doubt).withColumn("epochs", epochs(before | at_cut))
    return rest.unionByName(equal.select(*rest.columns))


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``no``, from 1 in code-point order, null last: sorted by ranges, numbered inside each and moved by those before."""
    order = [F.col("source").isNull(), "source"]
    ranged = cut_lineage(cut_lineage(sources).orderBy(*order)).withColumn("part", F.spark_partition_id())
    counts = ranged.groupBy("part").agg(F.count("*").alias("c"))  # as many rows as there are partitions
    offset = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("part", offset.alias("offset")))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("rank", rank).join(counts, "part").withColumn("no", F.col("offset") + F.col("rank")).drop("part", "offset", "rank")


def _cuts(docs: DataFrame, weights: DataFrame | None, max_epochs: int, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, int]:
    """doc_id, size, source, k of all rows; the table of sources with no, source_size, target, whole and ``cut``, the last key
    and size of which rows are taken once more (m of n rows); and the number of sources."""
    text = F.col(text_col)
    slim = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), word_count(text).alias("size"), F.col(source_col).alias("source"), seeded_key(F.col(id_col), text, seed).alias("k")))
    numbered = _numbered(slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    if weights is None:
        numbered = numbered.withColumn("weight", (F.col("no") - 1) % 3 + 1)
    else:
        w = weights.select(F.col("source").alias("_s"), "weight")
        numbered = numbered.join(w, numbered["source"].eqNullSafe(w["_s"]), "left").drop("_s").withColumn("weight", F.coalesce("weight", F.lit(0)))
    table = water_fill(cut_lineage(numbered), max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0))
    table = cut_lineage(table.select("source", "no", F.col("size").alias("source_size"), "n", "target", whole.alias("whole"), F.when(F.col("size") > 0, F.col("target") - whole * F.col("size")).otherwise(F.lit(0.0)).alias("rest")))
    n_sources, largest = table.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
    rows = slim.join(_small(table.select(F.col("source").alias("_s"), "no"), n_sources), slim["source"].eqNullSafe(F.col("_s"))).select("no", "k", "size")

    # Two rounds of ranges: the first splits the keys in 2**b, the second the range with the cut in 2**b again.
    bits = max(4, min(14, (largest.bit_length() - 8) // 2 + 1))
    cut = table.select("no", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for round_ in (1, 2):
        shift = KEY_BITS - bits * round_
        wide = F.shiftright("k", shift + bits)
        inside = rows.join(_small(cut.select("no", "prefix"), n_sources), "no").where(wide == F.col("prefix")).groupBy("no", F.shiftright("k", shift).alias("part")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = inside.join(_small(cut, n_sources), "no").withColumn("start", F.col("below") + F.coalesce(F.sum("words").over(running), F.lit(0)))
        last = sums.where(F.col("start") <= F.col("rest")).groupBy("no").agg(F.max_by("part", "part").alias("prefix"), F.max_by("start", "part").alias("below"), F.first("rest").alias("rest"))
        cut = cut_lineage(last.select("no", "rest", "prefix", "below"))
    # The keys of the range that holds the cut: of each (and size) the rows whose middle is inside the rest.
    keys = rows.join(_small(cut, n_sources), "no").where(F.shiftright("k", KEY_BITS - bits * 2) == F.col("prefix")).groupBy("no", "k", "size").agg(F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("below").alias("below"))
    running = Window.partitionBy("no").orderBy("k", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("below") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(running), F.lit(0))
    room = 2 * (F.col("rest") - F.col("start")) - F.col("size")
    m = F.when((room < 0) | (F.col("rest") <= 0), F.lit(0)).when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.floor(room / (2 * F.col("size"))) + 1, F.col("n")))
    keys = keys.withColumn("start", start).withColumn("m", m).where("m > 0")
    last = keys.groupBy("no").agg(F.max(F.struct("k", "size", "m", "n")).alias("cut"))
    # No key of the range may be taken: then all before it are.
    table = table.drop("n").join(cut.select("no", F.when(F.col("rest") > 0, F.shiftleft("prefix", KEY_BITS - bits * 2)).alias("from")), "no", "left").join(last, "no", "left")
    none = F.struct(F.coalesce("from", F.lit(0)).cast("long").alias("k"), F.lit(-1).cast("long").alias("size"), F.lit(1).cast("long").alias("m"), F.lit(1).cast("long").alias("n"))
    return slim, cut_lineage(table.select("source", "no", "source_size", "target", "whole", F.coalesce("cut", none).alias("cut"))), n_sources


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(concat_ws(':', '17', doc_id::VARCHAR, md5(text))), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
fill(i, level, clamped) AS (
  SELECT 0, (sum(source_size) / sum(weight))::DOUBLE, 0::BIGINT FROM s
  UNION ALL
  SELECT i + 1, n.level, n.clamped FROM fill f, LATERAL (
    SELECT (sum(source_size) - sum(CASE WHEN weight * f.level > 3.0::DOUBLE * source_size THEN 3.0::DOUBLE * source_size ELSE 0 END))
           / sum(CASE WHEN weight * f.level > 3.0::DOUBLE * source_size THEN 0 ELSE weight END) AS level,
           count(*) FILTER (weight * f.level > 3.0::DOUBLE * source_size) AS clamped FROM s) n
  WHERE n.clamped > f.clamped),
water AS (SELECT arg_max(level, i) AS level FROM fill),
t AS (
  SELECT source, source_size, least(weight * level, 3.0::DOUBLE * source_size) AS target FROM s, water),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS rest FROM t),
o AS (
  SELECT doc_id, size, source_size, target, whole, rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
e AS (
  SELECT *, (whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END)::INT AS epochs FROM o)
SELECT doc_id, size, source_size, target, epochs, (size * epochs)::BIGINT AS taken FROM e
"""
