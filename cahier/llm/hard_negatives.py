"""Hard-negative mining by angular triangle filtering.

Every vector's angles to a few reference directions are computed once and stored. Two vectors that make the angles s and
t with one direction make an angle of |s - t| to s + t with each other, so every direction gives an interval for their
cosine. Rows are held in windows, runs of at most WINDOW rows of one label in the order of their angles; from a window's
ranges of angles and norms come bounds of the score of each anchor with any of its rows, widened by SLACK for rounding.
Only where these overlap the scores that an anchor still looks for are inner products computed, in exact integers.

Rows and anchors meet in cells, a group of rows with a block of anchors: cells are dealt by Spark, a cell holds its anchors
and what they have found so far, and its rows pass in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cahier.session import cut_lineage

WINDOW = 64
#: Cosines are trusted to this much, a hundred times what the arc cosine loses.
SLACK = 1e-6
#: Rows of a cell, and its anchors (2 MB at 64 numbers each).
GROUP_ROWS, BLOCK_ANCHORS = 8192, 4096
EXACT = 2**53


def matrix(col: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    n = np.asarray(pc.list_value_length(col))
    flat = np.asarray(col.flatten(), float)
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), n[0])
    out = np.zeros((len(n), n.max() if len(n) else 0))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def norms(m: np.ndarray) -> np.ndarray:
    """Lengths, also of rows whose squares would be too large."""
    top = np.abs(m).max(1, initial=0)
    return top * np.sqrt(((m / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1))


def angles(m: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The angle of every row to every reference (unit rows); a right angle for the zero vector, of which all scores are 0."""
    length = norms(m)
    width = min(m.shape[1], references.shape[1])
    unit = m[:, :width] / np.where(length > 0, length, 1)[:, None]
    return np.arccos(np.clip(unit @ references[:, :width].T, -1, 1))


def references(rows: DataFrame, vector_col: str, id_col: str, count: int, sample: int) -> np.ndarray:
    """Unit directions fitted to at most ``sample`` rows, chosen by hash: spherical means begun at far-apart rows."""
    got = rows.orderBy(F.xxhash64(id_col), id_col).select(vector_col).limit(sample).toArrow()
    m = matrix(got.column(0).combine_chunks()) if got.num_rows else np.zeros((0, 1))
    length = norms(m)
    m = (m / np.where(length > 0, length, 1)[:, None])[length > 0]
    if not len(m):
        return np.zeros((0, 1))
    centres = [m[0]]
    while len(centres) < min(count, len(m)):
        centres.append(m[np.argmin((m @ np.array(centres).T).max(1))])
    c = np.array(centres)
    for _ in range(8):
        near = (m @ c.T).argmax(1)
        for i in range(len(c)):
            total = m[near == i].sum(0)
            if np.linalg.norm(total) > 0:
                c[i] = total / np.linalg.norm(total)
    return c


def score_bounds(anchor_angles: np.ndarray, anchor_norms: np.ndarray, low: np.ndarray, high: np.ndarray, norm_low: float, norm_high: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) score of each anchor with any row whose angles lie between ``low`` and ``high`` and whose norm
    lies between the last two."""
    apart = np.maximum(np.maximum(anchor_angles - high, low - anchor_angles), 0)
    wide = np.minimum(anchor_angles + high, np.pi)
    # Beyond a half turn the sum of the angles counts back.
    wide = np.where((anchor_angles + low <= np.pi) & (anchor_angles + high >= np.pi), np.pi, np.where(anchor_angles + low > np.pi, 2 * np.pi - (anchor_angles + low), wide))
    top = np.cos(apart).min(1, initial=1) + SLACK
    least = np.cos(wide).max(1, initial=-1) - SLACK
    with np.errstate(over="ignore", invalid="ignore"):
        ends = anchor_norms[:, None] * np.array([norm_low, norm_high])
        up = np.where(top >= 0, top * ends[:, 1], top * ends[:, 0])
        down = np.where(least >= 0, least * ends[:, 0], least * ends[:, 1])
    return np.nan_to_num(np.floor(down) - 1, nan=-np.inf), np.nan_to_num(np.ceil(up) + 1, nan=np.inf)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-numbered rows: float64 where no sum can lose a unit, else Python's integers,
    cut to the range of a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1) < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The best rows of each slot so far, by score and then by id: slot, score, id, sorted, at most ``k`` a slot."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = self.merges = 0
        #: Per slot the score that a row must reach.
        self.least = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """New rows wait until there are as many as are held."""
        self.new.append((slot, score, ids))
        self.waiting += len(slot)
        if self.waiting > 1000 + len(self.slot):
            self.merge()

    def merge(self) -> None:
        slot, score, ids = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *self.new))
        order = np.lexsort((ids, ~score, slot))  # ~ turns the order round without leaving the range
        slot = slot[order]
        keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.k
        self.slot, self.score, self.id = slot[keep], score[order[keep]], ids[order[keep]]
        full = np.flatnonzero(np.bincount(self.slot, minlength=self.slots) >= self.k)
        self.least[full] = self.score[np.searchsorted(self.slot, full, "right") - 1]
        self.new, self.waiting, self.merges = [], 0, self.merges + 1


class Cell:
    """Anchors of one cell, and what they have found. Without ``targets`` the best ``k`` other rows of an anchor's label
    are looked for; with them (anchor, positive id, positive score) the best ``k`` rows of other labels inside each
    target's window of scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norm: np.ndarray, angle: np.ndarray, k: int, targets: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, low: int = 30, high: int = 90):
        self.ids, self.labels, self.vectors, self.norm, self.angle, self.low, self.high = ids, labels, vectors, norm, angle, low, high
        self.targets = targets
        self.best = Best(len(ids) if targets is None else len(targets[0]), k)
        #: Anchor-row pairs met, and those whose inner product was computed.
        self.met = self.scored = 0
        self.known: tuple[int, tuple[np.ndarray, np.ndarray]] = (-1, ())
        if targets is not None:
            self.floor = self.wanted(low, np.floor)
            self.ceiling = self.wanted(high, np.ceil)

    def wanted(self, percent: int, round_) -> np.ndarray:
        """A bound of the window of scores, a little wider."""
        x = self.targets[2].astype(float) * percent / 100
        return round_(x - np.abs(x) * 1e-12 - 1 if round_ is np.floor else x + np.abs(x) * 1e-12 + 1)

    def needs(self) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) score that each anchor still looks for."""
        if self.targets is None:
            return self.best.least, np.full(len(self.ids), np.inf)
        if self.known[0] == self.best.merges:
            return self.known[1]
        least, most = np.full(len(self.ids), np.inf), np.full(len(self.ids), -np.inf)
        np.minimum.at(least, self.targets[0], np.maximum(self.floor, self.best.least))
        np.maximum.at(most, self.targets[0], self.ceiling)
        self.known = self.best.merges, (least, most)
        return least, most

    def see(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norm: np.ndarray, angle: np.ndarray) -> None:
        """Rows of one or more windows, in their order."""
        cuts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
        for a, z in zip(cuts, np.append(cuts[1:], len(ids))):
            for i in range(a, z, WINDOW):
                self.window(slice(i, min(z, i + WINDOW)), ids, labels[a], vectors, norm, angle)

    def window(self, at: slice, ids: np.ndarray, label: int, vectors: np.ndarray, norm: np.ndarray, angle: np.ndarray) -> None:
        mine = np.flatnonzero((self.labels == label) == (self.targets is None))
        self.met += len(mine) * (at.stop - at.start)
        if not len(mine):
            return
        down, up = score_bounds(self.angle[mine], self.norm[mine], angle[at].min(0), angle[at].max(0), norm[at].min(), norm[at].max())
        least, most = self.needs()
        mine = mine[(up >= least[mine]) & (down <= most[mine])]
        self.scored += len(mine) * (at.stop - at.start)
        if not len(mine):
            return
        scores, who = inner(self.vectors[mine], vectors[at]), ids[at]
        if self.targets is None:
            a, j = np.nonzero((scores >= self.best.least[mine, None]) & (self.ids[mine, None] != who))
            self.best.add(mine[a], scores[a, j], who[j])
            return
        row = np.full(len(self.ids), -1)
        row[mine] = np.arange(len(mine))
        t = np.flatnonzero(row[self.targets[0]] >= 0)
        s, p = scores[row[self.targets[0][t]]], self.targets[2][t, None]
        if max(int(np.abs(s).max(initial=0)), int(np.abs(p).max(initial=0))) < EXACT:
            inside = (self.low * p <= 100 * s) & (100 * s <= self.high * p)
        else:
            big, wide = s.astype(object), p.astype(object)
            inside = ((self.low * wide <= 100 * big) & (100 * big <= self.high * wide)).astype(bool)
        a, j = np.nonzero(inside & (s >= self.best.least[t, None]))
        self.best.add(t[a], s[a, j], who[j])

    def rows(self) -> pa.RecordBatch:
        b = self.best
        b.merge()
        if self.targets is None:
            return pa.RecordBatch.from_arrays([pa.array(self.ids[b.slot]), pa.array(b.id), pa.array(b.score)], ["anchor_id", "positive_id", "positive_score"])
        a, p, s = self.targets
        cols = [self.ids[a[b.slot]], p[b.slot], s[b.slot], b.id, b.score]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def prepare(rows: DataFrame, scale: int = 256, count: int = 16, sample: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v (whole numbers), norm, angles, near: the rows that take part, with their stored angles."""
    v = F.transform(vector_col, lambda x: x.cast("double") * scale)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    slim = slim.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    one = slim.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    one = cut_lineage(one)
    refs = references(one, "v", "id", count, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.floor(matrix(b.column(2)))
            turn = angles(m, refs)
            near = turn.argmin(1) if turn.shape[1] else np.zeros(len(m), int)
            first = turn.min(1, initial=np.pi)
            lists = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel())
            turns = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * turn.shape[1], turn.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(norms(m)), turns, pa.array(near.astype(np.int32)), pa.array(first)], ["id", "label", "v", "norm", "angles", "near", "angle"])

    return cut_lineage(one.mapInArrow(run, "id long, label long, v array<double>, norm double, angles array<double>, near int, angle double"))


def _meet(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int, low: int, high: int, targets: bool) -> DataFrame:
    """What every cell finds, at most ``k`` rows a cell and slot."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-n_rows // GROUP_ROWS), min(cores, -(-n_rows // 1024)), 1)
    blocks = max(-(-n_anchors // BLOCK_ANCHORS), 1)
    group, block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks))

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    no_targets = F.array().cast("array<struct<id:long,score:long>>")
    left = anchors.select(copies(groups).alias("g"), block.alias("b"), F.lit(0).alias("side"), "id", "label", "v", "norm", "angles", "near", "angle", F.col("targets") if targets else no_targets.alias("targets"))
    right = rows.select(group.alias("g"), copies(blocks).alias("b"), F.lit(1).alias("side"), "id", "label", "v", "norm", "angles", "near", "angle", no_targets.alias("targets"))
    cells = left.unionByName(right).withColumn("cell", F.col("g") * blocks + F.col("b")).drop("g", "b")
    dealt = cells.repartitionByRange(groups * blocks, "cell").sortWithinPartitions("cell", "side", "label", "near", "angle")
    dealt = dealt.select("cell", "side", "id", "label", "v", "norm", "angles", "targets")

    def begin(parts: list[pa.RecordBatch]) -> Cell:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        found = None
        if targets:
            lists = t.column(7)
            flat = lists.flatten()
            found = (np.repeat(np.arange(t.num_rows), np.asarray(pc.list_value_length(lists))), flat.field("id").to_numpy(), flat.field("score").to_numpy())
        return Cell(t.column(2).to_numpy(), t.column(3).to_numpy(), matrix(t.column(4)), t.column(5).to_numpy(), matrix(t.column(6)), k, found, low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, cell = None, [], None
        for b in batches:
            key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            for i, z in zip(cuts, np.append(cuts[1:], len(key))):
                part, now, side = b.slice(i, z - i), int(key[i]) // 2, int(key[i]) % 2
                if now != at:
                    if cell is not None:
                        yield cell.rows()
                    at, held, cell = now, [], None
                if side == 0:
                    held.append(part)
                    continue
                if cell is None and held:
                    cell, held = begin(held), []
                if cell is not None:
                    cell.see(part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4)), part.column(5).to_numpy(), matrix(part.column(6)))
        if cell is not None:
            yield cell.rows()

    shape = "anchor_id long, positive_id long, positive_score long" + (", negative_id long, negative_score long" if targets else "")
    return dealt.mapInArrow(run, shape)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, count: int = 16, sample: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``anchor`` (an expression of ``id``) holds. A score is the integer inner product of two
    rows' vectors, each number times ``scale`` and rounded down; higher comes first, then the smaller id. An anchor's
    positives are its first ``positives`` other rows of the same label; for each the first ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` hundredths of the positive's are returned.

    Rows with a null id, label or vector, or with a number that is null or not finite, take no part; of rows with one id
    the one with the smallest label and vector does. Shorter vectors are taken to end in zeros, an empty vector is all
    zeros. Scores outside the range of a long are cut to it. Anchors without positives or negatives give no rows, and
    neither does an empty table. Other columns are not read. The reference directions are fitted to at most ``sample``
    rows; all rows are indexed, and results are exact whatever the directions.
    """
    ready = prepare(rows, scale, count, sample, id_col, vector_col, label_col)
    n = ready.count()
    anchors = ready.where(anchor)
    n_anchors = anchors.count()
    by = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    found = _meet(ready, anchors, n, n_anchors, positives, low, high, False)
    first = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= positives)
    lists = first.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("targets"))
    aimed = cut_lineage(anchors.join(lists, "id"))
    each = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    met = _meet(ready, aimed, n, n_anchors, negatives, low, high, True)
    ranked = met.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""
