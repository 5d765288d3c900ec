"""Cosine similarity of dense and sparse vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items and queries that meet in one task: items pass in batches, queries (8 MB at 256 numbers) are held.
GROUP_ITEMS, BLOCK_QUERIES = 16384, 4096
#: Rows of a ball, the unit that a bound speaks of.
BALL = 64
#: Pairs that leave a task in one batch where all are asked for.
PAIRS = 100_000
#: Cosines are trusted to this much.
SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays of numbers; 0 where one is the zero vector."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return dot(a, b) / (norm(a) * norm(b))


def usable(vector: str) -> Column:
    """Not null, and no number in it null or not finite: a vector that has a score."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def _units(column: pa.Array) -> np.ndarray:
    """A list column as rows of length 1 (zero vectors as they are); shorter vectors end in zeros."""
    n = np.asarray(pc.list_value_length(column))
    m = np.zeros((len(n), int(n.max(initial=0))))
    m[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(column.flatten(), float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])
    return a[:, :width] @ b[:, :width].T


def balls(m: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(rows, unit centre, angle of the farthest row) of groups of at most BALL rows: larger ones are split between two
    rows that lie far apart, or in the middle where that would leave one side with little."""
    todo = [rows]
    while todo:
        at = todo.pop()
        if len(at) > BALL:
            one = m[at[(m[at] @ m[at[0]]).argmin()]]
            side = m[at] @ (one - m[at[(m[at] @ one).argmin()]])
            order = np.argsort(side, kind="stable")
            cut = int((side < 0).sum())
            cut = cut if len(at) // 16 <= cut <= len(at) - len(at) // 16 and 0 < cut < len(at) else len(at) // 2
            todo += [at[order[:cut]], at[order[cut:]]]
            continue
        centre = m[at].sum(0)
        length = np.linalg.norm(centre)
        centre = centre / length if length > 1e-9 else m[at[0]]
        # A zero vector has no direction; its score is 0, which is in any ball's range only if the ball is the whole sphere.
        whole = not m[at].any(axis=1).all()
        yield at, centre, np.pi if whole else float(np.arccos(np.clip(m[at] @ centre, -1, 1)).max())


class _Owner:
    """The k best items of one owner for every query of a task; -inf where there are fewer so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.scores, self.ids = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)
        self.pairs = self.pruned = 0

    def see(self, m: np.ndarray, ids: np.ndarray) -> None:
        """Every query meets its nearest ball first, which gives it a bound for all others."""
        every = list(balls(m, np.arange(len(m))))
        self.pairs += len(self.queries) * len(every)
        away = np.arccos(np.clip(_product(self.queries, np.array([centre for _, centre, _ in every])), -1, 1))
        most = np.cos(np.maximum(away - np.array([radius for *_, radius in every]), 0)) + SLACK
        nearest = away.argmin(1)
        for j, (at, *_) in enumerate(every):
            self.add(np.flatnonzero(nearest == j), m[at], ids[at])
        for j, (at, *_) in enumerate(every):
            asking = (nearest != j) & (most[:, j] >= self.scores[:, -1] - SLACK)
            self.pruned += int(((nearest != j) & ~asking).sum())
            self.add(np.flatnonzero(asking), m[at], ids[at])

    def add(self, asking: np.ndarray, m: np.ndarray, ids: np.ndarray) -> None:
        if not len(asking):
            return
        scores = np.concatenate([self.scores[asking], _product(self.queries[asking], m)], 1)
        ids = np.concatenate([self.ids[asking], np.broadcast_to(ids, (len(asking), len(ids)))], 1)
        best = np.lexsort((ids, -np.round(scores, 9)), axis=1)[:, : self.k]
        self.scores[asking], self.ids[asking] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def dense_topk(items: DataFrame, queries: DataFrame, k: int | None, owner: str, item: str, query: str, vector: str, pruned: Accumulator | None = None, pairs: Accumulator | None = None) -> DataFrame:
    """owner, query, item, score: the k best items of each owner for each query, of every group of items; all with
    ``k=None``. The caller ranks the groups' results again.

    Items are dealt in groups, queries in blocks; each group meets each block in one task, which holds the block and what
    it has found, while the items pass. Items of one owner are packed into balls; a ball whose nearest possible row is
    farther from a query than the query's k-th best so far is passed over for it. Rows without a usable vector take no
    part. Accumulators, if given, count (ball, query) pairs and those passed over.
    """
    spark = items.sparkSession
    items = items.select(F.col(owner).alias("o"), F.col(item).alias("i"), F.col(vector).cast("array<double>").alias("v")).where(usable("v"))
    queries = queries.select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v")).where(usable("v"))
    n_items, n_queries = items.count(), queries.count()
    groups = max(1, -(-n_items // GROUP_ITEMS), min(spark.sparkContext.defaultParallelism, -(-n_items // 256)))
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    # An owner's items stay together up to a group's size: by owner, and by item where an owner has more.
    large = items.groupBy("o").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ITEMS // 4).select("o", F.lit(True).alias("_large"))
    keyed = items.join(large, "o", "left")
    group = F.pmod(F.when(F.col("_large"), F.xxhash64("o", "i")).otherwise(F.xxhash64("o")), F.lit(groups))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks))

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    types = {f.name: f.dataType for f in items.schema} | {"q": queries.schema["q"].dataType}
    left = queries.select(copies(groups).alias("g"), block.alias("b"), F.lit(0).alias("side"), "q", F.lit(None).cast(types["o"]).alias("o"), F.lit(None).cast(types["i"]).alias("i"), "v")
    right = keyed.select(group.alias("g"), copies(blocks).alias("b"), F.lit(1).alias("side"), F.lit(None).cast(types["q"]).alias("q"), "o", "i", "v")
    cells = left.unionByName(right).withColumn("cell", F.col("g") * blocks + F.col("b"))
    dealt = cells.repartitionByRange(groups * blocks, "cell").sortWithinPartitions("cell", "side", "o").select("cell", "side", "q", "o", "i", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[pa.Array] = []
        vectors: list[np.ndarray] = []
        cell = who = held = None
        at: _Owner | None = None
        id_type = owner_type = None

        def matrix() -> tuple[pa.Array, np.ndarray]:
            width = max(v.shape[1] for v in vectors)
            return pa.concat_arrays(names), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors])

        def emit(o, scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            row, col = np.nonzero(scores > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array([o], owner_type).take(pa.array(np.zeros(len(row), int))), held[0].take(pa.array(row)), pa.array(ids[row, col]).cast(id_type), pa.array(scores[row, col])], [owner, query, item, "score"])

        def every(o, m: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
            """All pairs of some items with the queries held, at most PAIRS (or one item's) at a time."""
            for i in range(0, len(held[1]), PAIRS):
                scores = _product(held[1][i : i + PAIRS], m).T
                n, queries_ = len(scores), held[0].slice(i, PAIRS)
                at_item = pa.array(np.repeat(np.arange(n, dtype=np.int32), scores.shape[1]))
                at_query = pa.array(np.tile(np.arange(scores.shape[1], dtype=np.int32), n))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(o, owner_type), scores.size), queries_.take(at_query), ids.take(at_item), pa.array(scores.ravel())], [owner, query, item, "score"])

        def close() -> Iterator[pa.RecordBatch]:
            if at is not None:
                if pairs is not None:
                    pairs.add(at.pairs)
                if pruned is not None:
                    pruned.add(at.pruned)
                yield emit(who, at.scores, at.ids)

        for b in batches:
            id_type, owner_type = b.schema.field("i").type, b.schema.field("o").type
            cells_, sides = b.column(0).to_numpy(), b.column(1).to_numpy()
            owners = np.asarray(b.column(3).dictionary_encode(null_encoding="encode").indices)
            key = np.stack([cells_, sides, owners])
            cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])) if len(cells_) else []
            for i, z in zip(cuts, np.append(cuts[1:], len(cells_))):
                part = b.slice(i, z - i)
                if cells_[i] != cell:
                    yield from close()
                    cell, names, vectors, held, at, who = cells_[i], [], [], None, None, None
                if sides[i] == 0:
                    names.append(part.column(2))
                    vectors.append(_units(part.column(5)))
                    continue
                if not names:
                    continue
                held = held or matrix()
                ids, m = part.column(4).to_numpy(), _units(part.column(5))
                if k is None:
                    step = max(1, PAIRS // len(held[1]))
                    for j in range(0, len(m), step):
                        yield from every(part.column(3)[0].as_py(), m[j : j + step], part.column(4).slice(j, step))
                    continue
                o = part.column(3)[0].as_py()
                if at is None or o != who:
                    yield from close()
                    at, who = _Owner(held[1], k), o
                at.see(m, ids)
        yield from close()

    shape = f"`{owner}` {types['o'].simpleString()}, `{query}` {types['q'].simpleString()}, `{item}` {types['i'].simpleString()}, score double"
    return dealt.mapInArrow(run, shape)
