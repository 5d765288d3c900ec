"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features of a text: its words (A-Z in lower case), word pairs, the shapes of the words (letter, capital and digit runs;
other marks as they are), pairs of shapes, and pairs of equal neighbours; each hashed into one of 2**BITS places, with
the square root of its count, scaled to length 1. A score is one sparse dot product with the broadcast weights
(2**BITS floats, 1 MB).

Training takes a documented, bounded sample of the labelled rows (``max_labelled``, chosen by hash), dealt by hash to
tasks of about ``shard_rows`` rows that each run FTRL-proximal and whose weights are averaged (parameter mixing), so
that no task holds more than its rows' features and the driver no more than a few weight vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cahier.llm.words import LOWER, NOT_SPACE, U64, Words, mix, spans, text_blocks

BITS = 18
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every feature occurrence."""
    w = Words(data, offsets, NOT_SPACE)
    doc = w.doc()
    word = spans(LOWER[data], w.start, w.end)
    # Shapes: runs of a class collapse to one byte; words are then shorter spans of the bytes that are left.
    kind = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[w.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = spans(kind[keep], at[w.start], at[w.end])
    pair = doc[1:] == doc[:-1]
    two = mix(word[:-1] * U64(3) + word[1:])[pair]
    shapes = mix(shape[:-1] * U64(7) + shape[1:] + U64(11))[pair]
    same = (word[1:] == word[:-1]) & pair
    repeat = np.full(int(same.sum()), 0x5A5A5A5A5A5A5A5A, np.uint64)
    after = doc[1:]
    return np.concatenate([doc, doc, after[pair], after[pair], after[same]]), np.concatenate([word, mix(shape + U64(5)), two, shapes, repeat])


def featurize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (text, place, value), sorted by text and place. A text without words has none."""
    doc, h = _hashes(data, offsets)
    key, n = np.unique((doc.astype(np.int64) << BITS) | (h >> U64(64 - BITS)).astype(np.int64), return_counts=True)
    doc, place, value = key >> BITS, key & ((1 << BITS) - 1), np.sqrt(n)
    norm = np.sqrt(np.bincount(doc, value * value, len(offsets) - 1))
    return doc, place, value / norm[doc]


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int, alpha: float, beta: float, l1: float, l2: float, balance: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Weights, the bias last, after FTRL-proximal over (places, values, label) in the given order; ``balance``: weights of labels 0 and 1."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * balance[int(y)] * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(len(z)))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, label_col: str = "quality", max_labelled: int = 16384, shard_rows: int = 4096, updates: int = 20000, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.0001, l2: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights from the labelled rows for which ``use`` (an expression of ``doc_id``) holds.

    At most about ``max_labelled`` labelled ids are taken, by hash, so reruns agree. An id labelled twice has its
    highest label; null ids and labels are left out; without labelled rows all weights are 0 (every score 0.5).
    Both labels weigh the same in sum. A task repeats its rows until it has made about ``updates`` updates.
    """
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    y = y.where(use if use is not None else F.lit(True)).groupBy("doc_id").agg(F.max("y").alias("y"))
    total, ones = y.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = min(1.0, max_labelled / max(1, total))
    shards = max(1, -(-min(total, max_labelled) // shard_rows))
    balance = (total / (2 * max(1.0, total - ones)), total / (2 * max(1.0, ones)))
    y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 62)) < int(share * (1 << 62)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(y), "doc_id")  # at most max_labelled rows
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(shards)).cast("int").alias("shard"), "text", F.xxhash64("doc_id", F.lit(5)).alias("order"), "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in text_blocks(batches, 1 << 20):
            doc, place, value = featurize(data, off)
            cut = np.searchsorted(doc, np.arange(len(off)))
            lists = [pa.LargeListArray.from_arrays(pa.array(cut), pa.array(v)).cast(pa.list_(v_type)) for v, v_type in ((place.astype(np.int32), pa.int32()), (value.astype(np.float32), pa.float32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *lists], ["shard", "order", "y", "place", "value"])

    def fit(table: pa.Table) -> pa.Table:
        t = table.sort_by([("order", "ascending"), ("y", "ascending")])
        bias = np.array([1 << BITS])
        data = [(np.concatenate([i.values.to_numpy(), bias]), np.concatenate([x.values.to_numpy().astype(float), [1.0]]), y) for i, x, y in zip(t["place"], t["value"], t["y"].to_pylist())]
        w = _ftrl(data, min(30, max(4, updates // len(data))), alpha, beta, l1, l2, balance)
        return pa.table({"n": pa.array([len(data)], pa.int64()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    fitted = rows.mapInArrow(features, "shard int, order long, y double, place array<int>, value array<float>").groupBy("shard").applyInArrow(fit, "n long, w binary").collect()
    used = sum(r["n"] for r in fitted)
    weights = np.zeros((1 << BITS) + 1)
    for r in fitted:
        weights += np.frombuffer(r["w"], np.float32) * (r["n"] / used)
    return weights.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and the columns in ``keep``), score: the probability of label 1, one row per row of ``docs``.

    Null and empty texts get the score of the bias alone; long texts are scored whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b, data, off in text_blocks(batches, 1 << 20):
            doc, place, value = featurize(data, off)
            total = np.bincount(doc, value * w[place], len(off) - 1) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            cols = [b.column(0), *[b.column(i) for i in range(2, b.num_columns)], pa.array(p)]
            yield pa.RecordBatch.from_arrays(cols, [*[x for i, x in enumerate(b.schema.names) if i != 1], "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    return slim.mapInArrow(run, f"{schema}, score double")


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, columns unchanged.

    Rows are filtered where they are scored, so there is no join and repeated ids and rows are each judged by their
    own text; nulls and empty texts get the score of the bias alone.
    """
    names = docs.columns
    weights = train(docs, labels, fold(id_col) != 0, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b, data, off in text_blocks(batches, 1 << 20, at):
            doc, place, value = featurize(data, off)
            total = np.bincount(doc, value * w[place], len(off) - 1) + w[-1]
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
