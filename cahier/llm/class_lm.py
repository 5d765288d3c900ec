"""Language-model scoring by a Brown class-based bigram model.

Exchange clustering assigns every word of the training texts to a class: a word moves to the class that raises the
likelihood of the class bigrams most. The model is

    P(w | v) = mix * P(class w | class v) * P(w | class w) + (1 - mix) * (c(w) + 1) / (N + V + 1)
    P(w | class) = (c(w) + d) / (c(class) + d * (words of the class + 1))

with c(w) the exact count of each word in all training texts.

1. Units are exchanged first: the ``core`` most frequent words, and the endings of all others (a fixed number). A unit's row
   says how often it stands before and after each class.
2. Every other word starts in its ending's class and then has two turns to move by its own contexts. The pairs of the
   ``often`` most frequent words (a fixed number, broadcast) are dealt by word, so a round is one pass over them inside
   their parts. The rows of the rarer words (classes of the words beside them) are summed per word by shuffle, and pairs
   of two rare words are joined with the classes of both.

A round counts only if the likelihood rose with it; after one that does not, since too many moved at once, half as many may
move in the next. Words that are not in the training texts get a class by their endings. Classes and counts of rare words are a table that is joined to the tokens that need it, so nothing on the driver
or in a broadcast grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cahier.llm.words import NOT_SPACE, U64, Words, mix, spans, text_blocks
from cahier.session import cut_lineage

#: Stands for the end of a text, and for its beginning as the first word's history.
END = U64(0x0123456789ABCDEF)
#: Added to each count in a class, an unknown word's included.
ADDED = 1.0
#: Pairs that a part of the words has, about.
PART_PAIRS = 1 << 20
#: Parts of the units, whose number is fixed.
UNIT_PARTS = 32
#: Classes next to words that are weighed at once.
STEP_ROWS = 1 << 14


class Lookup:
    """Index of 64-bit hashes among a fixed set of them, -1 for others; open addressing, all queries at once."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.bits = max(4, int(8 * len(keys)).bit_length())
        self.slots, self.at, self.probes = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 1
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several for one slot the last stays
            self.slots[slot[free]] = keys[left[free]]
            left = left[self.at[slot] != left]
            step += 1
        self.probes = max(1, step)

    def _slot(self, h: np.ndarray, step: int) -> np.ndarray:
        return ((h >> U64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = self._slot(h, 0)
        out = np.where(self.slots[slot] == h, self.at[slot], -1)
        for step in range(1, self.probes):
            open_ = np.flatnonzero(out < 0)
            slot = self._slot(h[open_], step)
            out[open_] = np.where((self.slots[slot] == h[open_]) & (self.at[slot] >= 0), self.at[slot], -1)
        return out


def ending(w: Words, ends: int) -> np.ndarray:
    """The last three bytes of each word as one of ``ends`` numbers."""
    return (spans(w.data, np.maximum(w.start, w.end - 3), w.end) % U64(ends)).astype(np.int64)


def _sequence(per_word: np.ndarray, first: np.ndarray, end: int | np.uint64) -> np.ndarray:
    """The words' values with ``end`` after each text and before the first."""
    out = np.full(len(per_word) + len(first), end, per_word.dtype)
    out[1:][np.arange(len(per_word)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = per_word
    return out


def _count_words(docs: DataFrame, ends: int) -> DataFrame:
    """h, c, e: the count of every word (by hash) and of the ends of texts, and the word's ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            h, n, e = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(h)
            at = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
            return h[by][at], np.add.reduceat(n[by], at), e[by][at]

        def batch(h: np.ndarray, n: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(e.astype(np.int32))], ["h", "c", "e"])

        for _, data, off in text_blocks(batches):
            w = Words(data, off, NOT_SPACE, lower=True)
            h = np.append(w.hash, np.full(len(off) - 1, END))
            by = np.argsort(h)  # any place of a word will do for its ending
            at = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1])[: len(h)])
            held.append((h[by][at], np.diff(np.append(at, len(h))), np.append(ending(w, ends), np.full(len(off) - 1, -1))[by[at]]))
            if sum(len(x[0]) for x in held) > 1_200_000:  # what a task holds is bounded
                held = [merged()]
                if len(held[0][0]) > 600_000:
                    yield batch(*held.pop())
        if held:
            yield batch(*merged())

    return docs.mapInArrow(run, "h long, c long, e int").groupBy("h").agg(F.sum("c").alias("c"), F.first("e").alias("e"))


def _blob(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _array(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


#: Words of a part (in order), how many rows each has, what each row is about (in order, as differences) and its count.
PACKED = "part int, w binary, size binary, x binary, n binary"


def _packed(part: int, w: np.ndarray, x: np.ndarray, n: np.ndarray) -> dict:
    """``w``, ``x``: in order, each pair once."""
    at = np.flatnonzero(np.append(True, w[1:] != w[:-1])[: len(w)])
    return {"part": part, "w": _blob(w[at]), "size": _blob(np.diff(np.append(at, len(w))).astype(np.int32)), "x": _blob(np.diff(x, prepend=x.dtype.type(0)).astype(x.dtype)), "n": _blob(n.astype(np.int64))}


def _unpack(row: dict, w: type, x: type) -> tuple[np.ndarray, ...]:
    """Words, and per row the number of its word, what it is about and its count."""
    size = _array(row["size"], np.int32)
    return _array(row["w"], w), np.repeat(np.arange(len(size)), size), np.cumsum(_array(row["x"], x), dtype=x), _array(row["n"], np.int64)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("w", "size", "x", "n")]]))


def _order(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Order by ``w``, then ``x`` (neither negative); equal rows in any order. Two short numbers are one."""
    return np.argsort(w.astype(np.int64) << 32 | x) if w.dtype == np.int32 else np.lexsort((x, w))


def _dealt(part: np.ndarray, w: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    by = _order(x, w)
    by = by[np.argsort(part[by], kind="stable")]
    part, w, x, n = part[by], w[by], x[by], n[by]
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
    return _batch([_packed(int(part[i]), w[i:j], x[i:j], n[i:j]) for i, j in zip(cut[:-1], cut[1:])])


def _adder(w: type, x: type):
    """Adds up the packed rows of a part."""

    def add(table: pa.Table) -> pa.Table:
        ws, xs, ns = [], [], []
        for row in table.to_pylist():
            words, at, about, n = _unpack(row, w, x)
            ws.append(words[at])
            xs.append(about)
            ns.append(n)
        ws, xs, ns = np.concatenate(ws), np.concatenate(xs), np.concatenate(ns)
        by = _order(xs, ws)
        ws, xs, ns = ws[by], xs[by], ns[by]
        cut = np.flatnonzero(np.append(True, (ws[1:] != ws[:-1]) | (xs[1:] != xs[:-1]))[: len(ws)])
        return pa.Table.from_batches([_batch([_packed(table["part"][0].as_py(), ws[cut], xs[cut], np.add.reduceat(ns, cut) if len(cut) else ns)])])

    return add


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) with each key once."""
    key, n = (np.concatenate(x) for x in zip(*held))
    by = np.argsort(key)
    at = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1])[: len(key)])
    return key[by][at], np.add.reduceat(n[by], at) if len(at) else n


def _count_pairs(docs: DataFrame, top: Broadcast, ends: int, parts: int) -> DataFrame:
    """The pairs of words, by part of the word: x is the other word's index if it stands after, and the number of indices
    more if it stands before. Rarer words are their endings, with the indices after those of the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, held = top.value[0], []
        width = often.n + ends

        def deal() -> pa.RecordBatch:
            key, n = held.pop()
            u, v = np.divmod(key, width)
            w, x = np.concatenate([u, v]).astype(np.int32), np.concatenate([v, u + width]).astype(np.int32)
            return _dealt(w % parts, w, x, np.concatenate([n, n]))

        for _, data, off in text_blocks(batches):
            words = Words(data, off, NOT_SPACE, lower=True)
            i = often(_sequence(words.hash, words.first, END)).astype(np.int64)
            index = np.where(i < 0, often.n + _sequence(ending(words, ends), words.first, 0), i)
            held.append(np.unique(index[:-1] * width + index[1:], return_counts=True))
            if sum(len(k) for k, _ in held) > 1_200_000:
                held[:] = [_merged(held)]
                if len(held[0][0]) > 600_000:
                    yield deal()
        if held:
            held[:] = [_merged(held)]
            yield deal()

    return cut_lineage(docs.mapInArrow(run, PACKED).groupBy("part").applyInArrow(_adder(np.int32, np.int32), PACKED))


def _unit_pairs(pairs: DataFrame, unit: np.ndarray, width: int) -> DataFrame:
    """The same of units, from the words' pairs; ``unit``: that of each index."""
    shared = pairs.sparkSession.sparkContext.broadcast(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = shared.value, []

        def deal() -> pa.RecordBatch:
            key, n = _merged(held)
            held.clear()
            w, x = (k.astype(np.int32) for k in np.divmod(key, 2 * width))
            return _dealt(w % UNIT_PARTS, w, x, n)

        for b in batches:
            for row in b.to_pylist():
                w, at, x, n = _unpack(row, np.int32, np.int32)
                other = np.where(x < len(of), 0, width) + of[x % len(of)]
                held.append(_merged([(of[w][at] * 2 * width + other, n)]))
                if sum(len(k) for k, _ in held) > 1_200_000:
                    yield deal()
        if held:
            yield deal()

    added = pairs.mapInArrow(run, PACKED).groupBy("part").applyInArrow(_adder(np.int32, np.int32), PACKED)
    return cut_lineage(added.repartition(UNIT_PARTS, "part"))  # few and small: a round has a task for each


def likelihood(m: np.ndarray) -> float:
    """What the classes add to the log likelihood of the training texts."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def _gains(o: np.ndarray, n: np.ndarray, own: np.ndarray, a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What the likelihood gains for each word (row) in each class. ``o`` and ``n``: how often the word stands before and
    after each class; ``own``: before itself, which ``o`` and ``n`` count in its class ``a``."""
    k = np.arange(len(a))
    so, sn = o.sum(1), n.sum(1)
    rest_o, rest_n = o.copy(), n.copy()
    rest_o[k, a] -= own
    rest_n[k, a] -= own
    gain = np.zeros(o.shape)
    for rest, this, that, t in ((rest_o, o, n, m), (rest_n, n, o, m.T)):
        r, j = np.nonzero(rest)
        v, mine = rest[r, j][:, None], a[r] == j
        now = t.T[j]  # the classes' pairs with j, without the word's
        now[mine] -= that[r[mine]]
        now[np.arange(len(r)), a[r]] -= this[r, j] - np.where(mine, own[r], 0)
        cut = np.flatnonzero(np.append(True, r[1:] != r[:-1])[: len(r)])
        if len(cut):
            gain[r[cut]] += np.add.reduceat(_xlogx(now + v) - _xlogx(now), cut, 0)
    d = np.repeat(m.diagonal()[None], len(a), 0)
    d[k, a] -= o[k, a] + n[k, a] - own
    both = rest_o + rest_n + own[:, None]
    gain += _xlogx(d + both) + _xlogx(d) - _xlogx(d + rest_o) - _xlogx(d + rest_n)
    rows, cols = np.repeat(m.sum(1)[None], len(a), 0), np.repeat(m.sum(0)[None], len(a), 0)
    rows[k, a] -= so
    cols[k, a] -= sn
    gain -= _xlogx(rows + so[:, None]) - _xlogx(rows) + _xlogx(cols + sn[:, None]) - _xlogx(cols)
    gain[:, -1] = -np.inf  # the class of the end
    return gain


def _step(o: np.ndarray, n: np.ndarray, own: np.ndarray, a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The words' classes after an exchange step; ``m`` is changed with them. A word moves for more than what naming one of
    the classes costs (ln of their number), so the few contexts of a rare word are not fitted by chance."""
    gain, k = _gains(o, n, own, a, m), np.arange(len(a))
    b = gain.argmax(1)
    b = np.where(gain[k, b] <= gain[k, a] + np.log(len(m)), a, b)
    go = np.flatnonzero(b != a)
    o, n, own, a, to = o[go].copy(), n[go].copy(), own[go], a[go], b[go]
    k = np.arange(len(go))
    o[k, a] -= own
    n[k, a] -= own
    for c, sign in ((a, -1), (to, 1)):
        np.add.at(m, c, sign * o)
        np.add.at(m.T, c, sign * n)
        np.add.at(m, (c, c), sign * own)
    return b


def _summed_matrix(rows: DataFrame, run, width: int) -> np.ndarray:
    """The sum of the ``width`` x ``width`` matrices that ``run`` makes of the batches of each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((width, width))
        for b in batches:
            run(b, m)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["row", "m"])

    out = np.zeros((width, width))
    for r in rows.mapInArrow(each, "row int, m array<double>").select("row", F.posexplode("m").alias("col", "n")).groupBy("row", "col").agg(F.sum("n").alias("n")).collect():  # width x width
        out[r["row"], r["col"]] = r["n"]
    return out


def _matrix(pairs: DataFrame, cls: np.ndarray, width: int) -> np.ndarray:
    """Class bigrams of ``pairs``, by the class of each index."""
    now = pairs.sparkSession.sparkContext.broadcast(cls)

    def run(b: pa.RecordBatch, m: np.ndarray) -> None:
        c = now.value
        for row in b.to_pylist():
            w, at, x, n = _unpack(row, np.int32, np.int32)
            after = x < len(c)
            m += np.bincount(c[w][at[after]] * len(m) + c[x[after]], n[after], m.size).reshape(m.shape)

    return _summed_matrix(pairs, run, width)


def _joined(m: np.ndarray) -> np.ndarray:
    """The matrix in which rarer words had classes of their own, numbered alike, with both in one."""
    k = len(m) // 2
    return m.reshape(2, k, 2, k).sum((0, 2))


def _in_steps(words: np.ndarray, alone: np.ndarray, at: np.ndarray, side: np.ndarray, n: np.ndarray, own: np.ndarray, cls: np.ndarray, m: np.ndarray) -> None:
    """Exchange steps for ``words`` (numbers of rows), those that are ``alone`` one after the other, the rest a few at once.
    ``at``, ``side``, ``n``: entries in order of ``at``; side: a class after the word, or classes + a class before it. ``cls``
    and ``m`` change."""
    classes = len(m)
    first = np.searchsorted(at, np.arange(len(cls) + 1))
    group = np.where(alone, np.arange(len(words)), len(words) + np.cumsum(np.diff(first)[words]) // STEP_ROWS)
    for some in np.split(words, np.flatnonzero(group[1:] != group[:-1]) + 1) if len(words) else ():
        size = first[some + 1] - first[some]
        take = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        full = np.bincount(np.repeat(np.arange(len(some)), size) * 2 * classes + side[take], n[take], len(some) * 2 * classes).reshape(len(some), 2 * classes)
        cls[some] = _step(full[:, :classes], full[:, classes:], own[some].astype(float), cls[some], m)


def _exchange(pairs: DataFrame, cls: np.ndarray, m: np.ndarray, alone: int, movable: int, r: int, share: int) -> np.ndarray:
    """The classes of the indices after round ``r``, in which one of ``share`` below ``movable`` may move: those below
    ``alone`` one after the other, all others a few at once; each part on its own copy of ``m``. Index 0 is the end."""
    shared = pairs.sparkSession.sparkContext.broadcast((cls, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, before = shared.value
        classes = len(before)
        for b in batches:
            for row in b.to_pylist():
                w, at, x, n = _unpack(row, np.int32, np.int32)
                side = np.where(x < len(c), c[x % len(c)], classes + c[x % len(c)])
                own = np.bincount(at, np.where(x == w[at], n, 0), len(w))
                turn = np.flatnonzero(((mix(w.astype(np.uint64)) + U64(r)) % U64(share) == 0) & (w > 0) & (w < movable))
                now = c[w]
                _in_steps(turn, w[turn] < alone, at, side, n, own, now, before.copy())
                moved = np.flatnonzero(now != c[w])
                yield pa.RecordBatch.from_arrays([pa.array(w[moved], pa.int32()), pa.array(now[moved], pa.int32())], ["w", "cls"])

    out = cls.copy()
    t = pairs.mapInArrow(run, "w int, cls int").toArrow()  # at most ``movable`` rows
    out[t["w"].to_numpy()] = t["cls"].to_numpy()
    return out


def _rare_rows(docs: DataFrame, top: Broadcast, cls: np.ndarray, classes: int, ends: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the words that are not frequent, packed by part of the word: x is the class of a frequent word after it,
    classes + that of one before it, 2 * classes + whether a rare word stands after or before it, or, with n = 0, from
    2 * classes + 2 on its ending. And u, v, n: the pairs of two rare words."""
    now = docs.sparkSession.sparkContext.broadcast(cls)

    def sequences(batches):
        often = top.value[0]
        for _, data, off in text_blocks(batches):
            w = Words(data, off, NOT_SPACE, lower=True)
            h = _sequence(w.hash, w.first, END)
            i = often(h)
            yield h, i, np.flatnonzero(i < 0), _sequence(ending(w, ends), w.first, 0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, held = now.value, []

        def deal() -> pa.RecordBatch:
            w, x, n = (np.concatenate(v) for v in zip(*held))
            held.clear()
            by = np.lexsort((x, w))
            w, x, n = w[by], x[by], n[by]
            cut = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (x[1:] != x[:-1])))
            w, x, n = w[cut], x[cut], np.add.reduceat(n, cut)
            return _dealt((mix(w) % U64(parts)).astype(np.int64), w, x, n)

        for h, i, far, e in sequences(batches):
            if len(far):  # neither the first nor the last of a sequence
                x = [np.where(i[far + d] < 0, 2 * classes + k, k * classes + (c[i[far + d]] if len(c) else 0)) for k, d in ((0, 1), (1, -1))]
                held.append((np.tile(h[far], 3), np.concatenate([*x, 2 * classes + 2 + e[far]]).astype(np.int32), np.repeat([1, 1, 0], len(far))))
                if sum(len(x[0]) for x in held) > 1_500_000:
                    yield deal()
        if held:
            yield deal()

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, i, far, _ in sequences(batches):
            far = far[i[far + 1] < 0] if len(far) else far
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h[far], h[far + 1])], ["u", "v"])

    packed = cut_lineage(docs.mapInArrow(rows, PACKED).groupBy("part").applyInArrow(_adder(np.uint64, np.int32), PACKED))
    return packed, cut_lineage(docs.mapInArrow(beside, "u long, v long").groupBy("u", "v").agg(F.count("*").alias("n")))


def _exchange_rare(rows: DataFrame, beside: DataFrame, words: DataFrame, m: np.ndarray, parts: int, r: int, share: int) -> DataFrame:
    """h, c, e, cls of each rare word: its count, ending and, for one of ``share``, its best class, given those in ``words``."""
    shared, classes = rows.sparkSession.sparkContext.broadcast(m), len(m)

    def of(w: str, x: str, before: int) -> DataFrame:
        pairs = beside.select(F.col(w).alias("w"), F.col(x).alias("h"), "n")
        return pairs.join(words.select("h", "cls"), "h").select("w", (F.col("cls") + before * classes).alias("x"), "n", (F.col("w") == F.col("h")).alias("own"))

    # The part of a word is a hash that the packed rows know, too; here it comes from a small helper on the pairs.
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((mix(w) % U64(parts)).astype(np.int32)), *b.columns], ["part", *b.schema.names])

    near = of("u", "v", 0).unionByName(of("v", "u", 1)).mapInArrow(number, "part int, w long, x int, n long, own boolean")
    held = words.select(F.col("h").alias("w"), F.col("cls").alias("x"), F.lit(-1).cast("long").alias("n"), F.lit(False).alias("own"))
    near = near.unionByName(held.mapInArrow(number, "part int, w long, x int, n long, own boolean"))

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        w, at, x, n = _unpack(left.to_pylist()[0], np.uint64, np.int32)
        more, code, k = right["w"].to_numpy().view(np.uint64), right["x"].to_numpy().astype(np.int64), right["n"].to_numpy()
        own_pair = right["own"].to_numpy(zero_copy_only=False).astype(bool)
        place = np.searchsorted(w, more)
        cls = np.zeros(len(w), np.int64)
        cls[place[k < 0]] = code[k < 0]
        count = np.bincount(at, np.where((x < classes) | (x == 2 * classes), n, 0), len(w)).astype(np.int64)
        last = x >= 2 * classes + 2
        e = np.zeros(len(w), np.int64)
        e[at[last]] = x[last] - 2 * classes - 2
        pairs, direct = k > 0, x < 2 * classes
        own = np.bincount(place[pairs & own_pair & (code < classes)], k[pairs & own_pair & (code < classes)], len(w))
        at, x, n = np.concatenate([at[direct], place[pairs]]), np.concatenate([x[direct], code[pairs]]), np.concatenate([n[direct], k[pairs]])
        by = np.argsort(at, kind="stable")
        turn = np.flatnonzero((mix(mix(w)) + U64(r)) % U64(share) == 0)
        _in_steps(turn, np.zeros(len(turn), bool), at[by], x[by], n[by], own, cls, shared.value.copy())
        return pa.table({"h": pa.array(w.view(np.int64)), "c": pa.array(count), "e": pa.array(e.astype(np.int32)), "cls": pa.array(cls.astype(np.int32))})

    return cut_lineage(rows.groupBy("part").cogroup(near.groupBy("part")).applyInArrow(step, "h long, c long, e int, cls int"))


def _rare_matrix(rows: DataFrame, beside: DataFrame, words: DataFrame, classes: int, parts: int) -> np.ndarray:
    """Class bigrams of the pairs with a rare word."""

    def part(h: pa.ChunkedArray) -> np.ndarray:
        return (mix(h.to_numpy().view(np.uint64)) % U64(parts)).astype(np.int32)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part(b.column(0))), *b.columns], ["part", "h", "cls"])

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        w, at, x, n = _unpack(left.to_pylist()[0], np.uint64, np.int32)
        cls = np.zeros(len(w), np.int64)
        cls[np.searchsorted(w, right["h"].to_numpy().view(np.uint64))] = right["cls"].to_numpy()
        use = x < 2 * classes
        at, x, n = at[use], x[use].astype(np.int64), n[use]
        key = np.where(x < classes, cls[at] * classes + x, (x - classes) * classes + cls[at])
        m = np.bincount(key, n, classes * classes)
        full = np.flatnonzero(m)
        return pa.table({"key": pa.array(full, pa.int64()), "n": pa.array(m[full].astype(np.int64))})

    with_cls = words.select("h", "cls").mapInArrow(number, "part int, h long, cls int")
    near = rows.groupBy("part").cogroup(with_cls.groupBy("part")).applyInArrow(counted, "key long, n long")
    of = lambda c, name: words.select(F.col("h").alias(c), F.col("cls").alias(name))
    far = beside.join(of("u", "cu"), "u").join(of("v", "cv"), "v").select((F.col("cu") * classes + F.col("cv")).cast("long").alias("key"), "n")
    m = np.zeros(classes * classes)
    for r in near.unionByName(far).groupBy("key").agg(F.sum("n").alias("n")).collect():  # classes x classes
        m[r["key"]] = r["n"]
    return m.reshape(classes, classes)


@dataclass
class ClassModel:
    """The bounded part of the model, broadcast for scoring, and the table of the rarer words with counts and classes."""

    often: Lookup
    often_counts: np.ndarray
    cls: np.ndarray  # class of each of the most frequent words
    end_cls: np.ndarray  # class of unknown words by their endings
    step: np.ndarray  # P(class | class before)
    size: np.ndarray  # tokens in each class, with what is added to the counts
    tokens: int
    vocabulary: int
    mix: float
    words: DataFrame | None = None
    moved: float = 0.0  # share of the words beyond the core that left their ending's class


def _most_frequent(counts: DataFrame, most: int) -> tuple[dict[str, np.ndarray], DataFrame]:
    """h, c, e of the end and at most ``most`` words, by count: those above a limit that is found from the sizes of a few
    hundred classes of counts (eight to a doubling), so no task or driver sorts the vocabulary; and the table of the rest."""
    size = F.floor(F.log2(F.col("c").cast("double")) * 8)
    limit, held = 1 << 30, 0
    for r in counts.groupBy(size.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():
        held += r["n"]
        if held > most:
            break
        limit = r["s"]
    often = (size >= limit) | (F.col("h") == int(END.view(np.int64)))
    t = counts.where(often).toArrow()
    h, c, e = (t[x].to_numpy() for x in ("h", "c", "e"))
    by = np.lexsort((h, -c, h != END.view(np.int64)))
    return {"h": h[by], "c": c[by], "e": e[by]}, counts.where(~often)


def fit(docs: DataFrame, use: Column | None = None, classes: int = 48, core: int = 2000, ends: int = 512, rounds: int = 8, turns: int = 2, often: int = 1 << 18, mixed: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> ClassModel:
    """Learns from the rows of ``docs`` for which ``use`` (an expression of doc_id) holds. A null text is empty;
    repeated rows count each; other columns are not read; without any row all words are unknown. ``rounds`` for the units,
    then ``turns`` of every other word, frequent or rare."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if use is not None:
        slim = slim.where(use)
    slim = slim.select("doc_id", "text")
    counts = cut_lineage(_count_words(slim, ends))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    most, rest = _most_frequent(counts, often)
    h, e = most["h"].view(np.uint64), most["e"]
    top = slim.sparkSession.sparkContext.broadcast((Lookup(h), most["c"]))
    parts = max(32, 2 * int(n) // PART_PAIRS)
    pairs = _count_pairs(slim, top, ends, parts)
    few = min(core, len(h))
    # All words but the ``core`` most frequent ones are their endings as units.
    units = _unit_pairs(pairs, np.concatenate([np.arange(few), few + e[few:].astype(np.int64), np.arange(few, few + ends)]), few + ends)
    unit = np.append(np.arange(few), np.arange(ends)) % (classes - 1)
    if few:
        unit[0] = classes - 1  # the end
    m = _matrix(units, unit, classes)
    share = 2
    for r in range(rounds):
        tried = _exchange(units, unit, m, len(unit), len(unit), r, share)
        found = _matrix(units, tried, classes)
        if likelihood(found) > likelihood(m):
            unit, m = tried, found
        else:
            share *= 2
    start = unit[few:]
    cls = np.where(np.arange(len(h)) < few, np.resize(unit[:few], len(h)), start[e])
    apart, share = _matrix(pairs, np.append(cls, classes + start), 2 * classes), 2
    for r in range(2 * turns):
        tried = _exchange(pairs, np.append(cls, start), _joined(apart), core, len(h), r, share)[: len(h)]
        found = _matrix(pairs, np.append(tried, classes + start), 2 * classes)
        if likelihood(_joined(found)) > likelihood(_joined(apart)):
            cls, apart = tried, found
        else:
            share *= 2
    words, m, share = None, _joined(apart), 1
    if v > len(h):
        rows, beside = _rare_rows(slim, top, cls, classes, ends, parts)
        words = rest.withColumn("cls", F.get(F.array(*[F.lit(int(x)) for x in start]), F.col("e")))
        for r in range(turns):
            tried = _exchange_rare(rows, beside, words, m, parts, r, share)
            found = apart[:classes, :classes] + _rare_matrix(rows, beside, tried, classes, parts)
            if likelihood(found) > likelihood(m):
                words, m = tried, found
            else:
                share *= 2
    types = np.zeros((ends, classes))  # words of each ending and class
    for r in words.groupBy("e", "cls").agg(F.count("*").alias("n")).collect() if words else ():  # at most ends x classes rows
        types[r["e"], r["cls"]] = r["n"]
    beyond = np.arange(len(h)) >= few
    np.add.at(types, (e[beyond], cls[beyond]), 1)
    moved = 1 - types[np.arange(ends), start].sum() / max(1, types.sum())
    some = ~beyond & (e >= 0)
    np.add.at(types, (e[some], cls[some]), 1)
    of_class = types.sum(0)
    of_class[-1] += v > 0  # the end
    end_cls = np.where(types.any(1), types.argmax(1), types.sum(0)[:-1].argmax())
    smooth = m + 0.5
    size = m.sum(0) + ADDED * (of_class + 1)  # every token ends one pair
    return ClassModel(Lookup(h), most["c"], cls, end_cls, smooth / smooth.sum(1, keepdims=True), size, int(n), int(v), mixed, words, moved)


def score(docs: DataFrame, model: ClassModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities of the whole text with its end; perplexity is 10 ** (-score / n_tokens). Null and
    empty texts are their end alone; repeated rows are scored each; an empty table gives no rows, and without any
    training text all words are unknown; other columns are not read.

    Frequent words are scored where they stand. Each other word is a row that meets the table of rare words once; two
    of them beside each other are two more rows, which meet again when the rows of a text are summed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, words=None))
    classes, unit = len(model.size), float(model.tokens + model.vocabulary + 1)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for b, data, off in text_blocks(batches):
            m = shared.value
            w = Words(data, off, NOT_SPACE, lower=True)
            texts = len(off) - 1
            h = _sequence(w.hash, w.first, END)
            at = m.often(h)
            near = at >= 0
            ends = _sequence(m.end_cls[ending(w, len(m.end_cls))], w.first, classes - 1)  # classes of words that are not known
            cls, count = np.where(near, 0, ends), np.zeros(len(h), np.int64)
            if len(m.cls):
                cls[near], count[near] = m.cls[at[near]], m.often_counts[at[near]]
            elif not m.tokens:
                near |= h == END
            row = np.repeat(np.arange(texts), w.counts + 1)
            own, both = near[1:], near[:-1] & near[1:]
            base = np.log10((count[1:] + 1) / unit)
            pair = np.log10((count[1:] + ADDED) * m.mix * m.step[cls[:-1], cls[1:]] / m.size[cls[1:]] + (1 - m.mix) * (count[1:] + 1) / unit)
            sums = [np.bincount(row[x], y[x], texts) for x, y in ((own, base), (both, pair), (own & (count[1:] > 0), np.ones(len(row))))]
            key = (np.int64(task) << 33) + done + np.arange(texts)
            done += texts
            far = np.flatnonzero(~near)  # in h; never its first
            two = far[~near[far - 1]]
            last = far + 1 >= len(h)
            after = np.minimum(far + 1, len(h) - 1)
            after_near = near[after] & ~last
            # x: one more than the class before, one more than that after (0: none or rare), and the class by the ending.
            x = (np.where(near[far - 1], cls[far - 1] + 1, 0) * 4096 + np.where(after_near, cls[after] + 1, 0)) * 4096 + ends[far]
            n = len(far) + 2 * len(two)
            pad = lambda v, t: pa.concat_arrays([pa.array(v, t), pa.nulls(n, t)])
            more = lambda v, t: pa.concat_arrays([pa.nulls(texts, t), pa.array(v, t)])
            spread = mix(key.astype(np.uint64))  # rows that need no join, evenly in it
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key, key[row[far - 1]], key[row[two - 1]], key[row[two - 1]]])),
                    pa.array(np.concatenate([spread, h[far], h[two - 1], h[two]]).view(np.int64)),
                    more(np.concatenate([np.full(len(far), -1), 2 * two, 2 * two + 1]), pa.int64()),
                    more(np.concatenate([x, ends[two - 1], ends[two]]), pa.int64()),
                    more(np.concatenate([np.where(after_near, count[after], 0), np.zeros(2 * len(two), np.int64)]), pa.int64()),
                    pa.concat_arrays([b.column(0), pa.nulls(n, b.column(0).type)]),
                    pad(w.counts + 1, pa.int64()),
                    *[pad(v, pa.float64()) for v in sums],
                ],
                ["key", "h", "pair", "x", "n", "doc_id", "n_tokens", "base", "model", "known"],
            )

    rows = slim.mapInArrow(run, f"key long, h long, pair long, x long, n long, doc_id {kind}, n_tokens long, base double, model double, known double")
    held = rows.withColumns({"cls": F.lit(None).cast("int"), "c": F.lit(None).cast("long")}) if model.words is None else rows.join(model.words.select("h", "cls", "c"), "h", "left")
    step = F.array(*[F.lit(float(x)) for x in (model.mix * model.step / model.size).ravel()])

    def log_p(before: Column, cls: Column, count: Column) -> Column:
        return F.log10((count + F.lit(ADDED)) * F.get(step, (before * classes + cls).cast("int")) + F.lit(1 - model.mix) * (count + 1) / F.lit(unit))

    x, word = F.col("x"), F.col("pair") == -1
    ends = F.when(F.col("pair").isNotNull(), x % 4096)
    c, cls = F.coalesce("c", F.lit(0)), F.coalesce(F.col("cls").cast("long"), ends)
    before, after = F.floor(x / (4096 * 4096)) - 1, F.floor(x / 4096) % 4096 - 1
    own = F.when(before >= 0, log_p(before, cls, c)).otherwise(0.0) + F.when(after >= 0, log_p(cls, after, F.col("n"))).otherwise(0.0)
    second = F.col("pair") % 2 == 1
    each = held.select(
        "key",
        F.when(~word, F.shiftright("pair", 1)).alias("pair"),
        "doc_id",
        "n_tokens",
        F.when(word, F.log10((c + 1) / F.lit(unit))).otherwise(F.col("base")).alias("base"),
        F.when(word, own).otherwise(F.col("model")).alias("model"),
        F.when(word, (c > 0).cast("double")).otherwise(F.col("known")).alias("known"),
        F.when(~word & ~second, cls).alias("p"),
        F.when(~word & second, cls).alias("q"),
        F.when(~word & second, c).alias("n"),
    )
    each = each.repartition("key")  # both sums are inside a text, so its rows meet once
    sums = lambda: [F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), *[F.sum(s).alias(s) for s in ("base", "model", "known")]]
    pairs = each.groupBy("key", "pair").agg(*sums(), F.max("p").alias("p"), F.max("q").alias("q"), F.max("n").alias("n"))
    pairs = pairs.withColumn("model", F.when(F.col("pair").isNull(), F.col("model")).otherwise(log_p(F.col("p"), F.col("q"), F.col("n"))))
    out = pairs.groupBy("key").agg(*sums())
    return out.select("doc_id", "n_tokens", F.col("known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"), F.pow(F.lit(10.0), -F.col("model") / F.col("n_tokens")).alias("perplexity"))
