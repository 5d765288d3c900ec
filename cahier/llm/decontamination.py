"""Benchmark decontamination with suffix arrays of the training texts.

Spark deals the documents in shards of bounded size; each shard's words become numbers and its suffix array is built
by sorting packed word tuples and refining ties (ranks of k words give ranks of 3k words) down to the window, deeper
than which no search looks. Every suffix of every test item is binary-searched, all at once; the ranges found are the
places of its first ``window`` words. Equal windows have equal ranges, so each place is looked at once for the words
that are hit, and once per item that has the window; places that follow each other join to the longest verbatim matches,
a bounded number of pairs (suffix, place) at a time.

Test items are dealt by hash into blocks of at most about BLOCK_BYTES of text, counted by Spark. One block at a time comes
to the driver and is broadcast; with several blocks the documents are searched for each, and what was found for a document
is put together by one aggregation. So neither the driver nor a worker holds more than one block.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cahier.llm.words import ALNUM, Words, grams, mix, text_blocks
from cahier.session import cut_lineage

BLOCK_BYTES = 8 << 20
#: Pairs (suffix of an item, place in a text) that are joined to runs at once.
RUN_PAIRS = 1 << 20
SHARD_BYTES = 5 << 19
_END = np.int32(-1)  # below every word: a suffix sorts behind its own prefix
_TOP = np.int32((1 << 31) - 1)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``ids`` (numbers from 0), sorted by their first ``depth`` numbers at least."""
    n = len(ids)
    bits = max(int(ids.max() + 1).bit_length(), (n + 1).bit_length()) if n else 1
    per = 63 // bits

    def packed(rank: np.ndarray, at: np.ndarray | slice, k: int) -> np.ndarray:
        long = np.concatenate([rank, np.zeros(per * k, np.int64)])
        key = long[at].copy() if isinstance(at, np.ndarray) else long[:n].copy()
        for j in range(1, per):
            key <<= bits
            key |= long[at + j * k] if isinstance(at, np.ndarray) else long[j * k : j * k + n]
        return key

    key = packed(ids.astype(np.int64) + 1, slice(None), 1)  # 0 is what follows the end
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    k = per
    while k < depth:
        alone = new & np.append(new[1:], True)
        pos = np.flatnonzero(~alone)
        if not len(pos):
            break
        t = order[pos]
        key = packed(rank, t, k)
        by = np.argsort(key)
        t, key = t[by], key[by]
        first = np.ones(len(pos), bool)
        first[1:] = key[1:] != key[:-1]
        order[pos] = t
        new[pos] = first
        rank[t] = np.maximum.accumulate(np.where(first, pos, 0)) + 1
        k *= per
    return order


def _bound(ids: np.ndarray, order: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each row of ``queries`` the number of suffixes below it. ``ids`` is padded by the queries' width."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
    cols, rows = np.arange(queries.shape[1]), np.arange(len(queries))
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        a = ids[order[np.minimum(mid, len(order) - 1)][:, None] + cols]
        at = (a != queries).argmax(1)
        less = (a[rows, at] < queries[rows, at]) & open_
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


class Items:
    """Test items as one array of word hashes, with their starts."""

    def __init__(self, names: list, texts: list[str]):
        raw = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        w = Words(np.frombuffer(b"".join(raw), np.uint8), off, ALNUM, lower=True)
        full = w.counts > 0
        self.names = [n for n, f in zip(names, full) if f]
        self.hash = w.hash
        self.first = np.append(w.first[:-1][full], len(w))
        self.item = np.repeat(np.arange(len(self.names)), np.diff(self.first))

    def windows(self, window: int) -> Windows:
        """Worked out once per worker, not sent along."""
        if getattr(self, "_windows", None) is None or self._windows.size != window:
            self._windows = Windows(self, window)
        return self._windows

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_windows"}


class Windows:
    """The different windows of a block of items: for each one suffix that begins with it (``suffix``), and the number of
    the set of ids of all items that have it (``set``). However many items share a window, it is searched once, and their
    ids are held once (``ids``, from ``first[i]`` to ``first[i + 1]`` for set i, as places in ``names``, which are sorted)."""

    def __init__(self, items: Items, window: int):
        self.size = window
        need = np.minimum(window, np.diff(items.first))[items.item]
        suffix = np.flatnonzero(items.first[1:][items.item] - np.arange(len(items.hash)) >= need)
        key = np.zeros(len(suffix), np.uint64)
        for n in np.unique(need):
            mine = need[suffix] == n
            key[mine] = mix(grams(items.hash, int(n))[suffix[mine]] + np.uint64(n))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        self.suffix = suffix[first]
        self.names, name = np.unique(np.array([str(n) for n in items.names], object), return_inverse=True) if items.names else (np.zeros(0, object), np.zeros(0, int))
        pair = np.unique(of * max(len(self.names), 1) + name[items.item[suffix]])
        window_of, ids = pair // max(len(self.names), 1), pair % max(len(self.names), 1)
        begin = np.searchsorted(window_of, np.arange(len(first)))
        # Equal sets by a sum of hashes of their ids and by their size.
        total = np.add.reduceat(mix(ids.astype(np.uint64) + np.uint64(1)), begin) if len(begin) else np.zeros(0, np.uint64)
        size = np.diff(np.append(begin, len(pair)))
        _, one, self.set = np.unique(mix(total) + size.astype(np.uint64), return_index=True, return_inverse=True)
        self.first = np.concatenate([[0], np.cumsum(size[one])]).astype(np.int64)
        self.ids = np.concatenate([ids[begin[i] : begin[i] + size[i]] for i in one]) if len(one) else np.zeros(0, np.int64)
        self.known: dict[bytes, tuple[int, str]] = {}

    def digest(self, sets: np.ndarray) -> tuple[int, str]:
        """(number of ids in the union of these sets, SHA-256 of them, sorted and joined by commas); once per union."""
        at = sets.astype(np.int64).tobytes()
        if at not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            every = np.unique(np.concatenate([self.ids[self.first[i] : self.first[i + 1]] for i in sets])) if len(sets) else np.zeros(0, np.int64)
            self.known[at] = (len(every), hashlib.sha256(",".join(self.names[every]).encode()).hexdigest())
        return self.known[at]


def _ranges(order: np.ndarray, ids: np.ndarray, known: np.ndarray, items: Items, window: int, suffix: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Suffixes of items (places in ``items.hash``; those given, or all) whose window occurs: suffix, words of the window,
    its range in ``order``."""
    lengths = np.diff(items.first)
    q = np.searchsorted(known, items.hash)
    q = np.where((q < len(known)) & (known[np.minimum(q, len(known) - 1)] == items.hash), q + 1, _END).astype(np.int32)
    padded = np.append(q, np.full(window, _END, np.int32))
    need = np.minimum(window, lengths)[items.item]
    suffix = np.flatnonzero(items.first[1:][items.item] - np.arange(len(q)) >= need) if suffix is None else suffix
    # A window with a word that no document of the shard has is not looked for.
    unknown = np.concatenate([[0], np.cumsum(q == _END)])
    suffix = suffix[unknown[suffix + need[suffix]] == unknown[suffix]]
    out = []
    deep = np.append(ids, np.zeros(window, np.int32))
    step = max(1, RUN_PAIRS // window)
    for some in np.split(suffix, range(step, len(suffix), step)):
        table = padded[some[:, None] + np.arange(window)]
        table[np.arange(window) >= need[some][:, None]] = _END
        lo = _bound(deep, order, table)
        above = table.copy()  # the least row above all suffixes that begin with the query
        above[table[:, -1] != _END, -1] += 1
        hi = _bound(deep, order, np.where(above == _END, _TOP, above))
        out.append((some[hi > lo], need[some][hi > lo], lo[hi > lo], hi[hi > lo]))
    return tuple(np.concatenate(x) for x in zip(*out))


def find_sets(order: np.ndarray, ids: np.ndarray, known: np.ndarray, items: Items, window: int, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words of the shard are hit by any item; and (text, set of ``items.windows``) pairs, sorted, for the texts that
    begin at ``begins``. A place has one window of each length, so there are no more pairs than places and lengths."""
    w = items.windows(window)
    suffix, need, lo, hi = _ranges(order, ids, known, items, window, w.suffix)
    back = np.argsort(w.suffix)
    number = w.set[back[np.searchsorted(w.suffix, suffix, sorter=back)]]
    edge, pairs, sets = np.zeros(len(ids) + 1, np.int64), np.zeros(0, np.int64), len(w.first)
    for some in _pieces(hi - lo):
        which, pos = _places(order, lo[some], (hi - lo)[some])
        np.add.at(edge, pos, 1)
        np.subtract.at(edge, pos + need[some][which], 1)
        pairs = np.unique(np.append(pairs, (np.searchsorted(begins, pos, "right") - 1) * sets + number[some][which]))
    return np.cumsum(edge)[:-1] > 0, pairs // sets, pairs % sets


def _union(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches that intervals cover, in order; intervals that touch are one."""
    by = np.argsort(first)
    first, reach = first[by], np.maximum.accumulate(end[by]) if len(end) else end
    new = np.append(True, first[1:] > reach[:-1])[: len(first)]
    return first[new], reach[np.append(new[1:], True)[: len(first)]]


def _pieces(many: np.ndarray) -> list[np.ndarray]:
    """Numbers of ranges, in order, in groups of about RUN_PAIRS places (or one larger range)."""
    return np.split(np.arange(len(many)), np.flatnonzero(np.diff(np.cumsum(many) // RUN_PAIRS)) + 1)


def _places(order: np.ndarray, lo: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges in ``order``: the number of the range and the place, for each place."""
    which = np.repeat(np.arange(len(lo)), many)
    return which, order[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(len(which))]


def find(order: np.ndarray, ids: np.ndarray, known: np.ndarray, items: Items, window: int) -> tuple[np.ndarray, Iterator[tuple]]:
    """Which words of the shard are hit by any item; and, for a few items at a time, the stretches of the shard that an
    item's windows cover: item, first word, words, words of the longest match that begins there, its first word in the item."""
    suffix, need, lo, hi = _ranges(order, ids, known, items, window)
    edge = np.zeros(len(ids) + 1, np.int64)
    once = np.unique(np.stack([lo, hi, need]), axis=1)
    for some in _pieces(once[1] - once[0]):
        which, pos = _places(order, once[0][some], (once[1] - once[0])[some])
        np.add.at(edge, pos, 1)
        np.subtract.at(edge, pos + once[2][some][which], 1)

    def stretches() -> Iterator[tuple]:
        # Items with few places go together; each has its own copy of the shard's places, ``width`` behind that of the item before.
        item, many, width = items.item[suffix], hi - lo, len(ids) + 1
        total = np.cumsum(np.bincount(item, many, len(items.names)).astype(np.int64))[item] // RUN_PAIRS
        for own in np.split(np.arange(len(suffix)), np.flatnonzero(total[1:] != total[:-1]) + 1) if len(suffix) else ():
            first, end = np.zeros(0, np.int64), np.zeros(0, np.int64)

            def places(some: np.ndarray) -> tuple[np.ndarray, ...]:
                which, pos = _places(order, lo[own][some], many[own][some])
                which = own[some][which]
                return pos + item[which] * width, suffix[which], need[which]

            pieces = _pieces(many[own])
            for some in pieces:
                pos, _, size = places(some)
                first, end = _union(np.append(first, pos), np.append(end, pos + size))
            longest, at = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            carry = tuple(np.zeros(0, np.int64) for _ in range(4))  # runs that end at the last suffix: its place, the run's first, its word in the item, words of a window
            last = -2
            for some in pieces:
                pos, s, size = places(some)
                # Runs are along diagonals; those that go on from the piece before begin with its end.
                before = carry if last == s.min() - 1 else tuple(x[:0] for x in carry)
                d = np.concatenate([pos - s, before[0] - last])
                p, q, size = np.concatenate([pos, before[0]]), np.concatenate([s, np.full(len(before[0]), last)]), np.concatenate([size, before[3]])
                by = np.lexsort((p, d))
                d, p, q, size = d[by], p[by], q[by], size[by]
                head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)))
                tail = np.append(head[1:], len(d)) - 1
                origin, word = p[head], q[head] - items.first[p[head] // width]
                if len(before[0]):
                    was = np.searchsorted(before[0], p[head])
                    same = (q[head] == last) & (was < len(before[0]))
                    same[same] = before[0][was[same]] == p[head][same]
                    origin[same], word[same] = before[1][was[same]], before[2][was[same]]
                length = p[tail] - origin + size[tail]
                stretch = np.searchsorted(first, origin, "right") - 1
                by = np.lexsort((-word, length, stretch))  # the last of a stretch is its longest, the first in the item of these
                best = by[np.append(stretch[by][1:] != stretch[by][:-1], True)]
                to = stretch[best]
                better = best[(length[best] > longest[to]) | ((length[best] == longest[to]) & (word[best] < at[to]))]
                longest[stretch[better]], at[stretch[better]] = length[better], word[better]
                last = int(s.max())
                on = np.flatnonzero(q[tail] == last)
                on = on[np.argsort(p[tail][on])]
                carry = (p[tail][on], origin[on], word[on], size[tail][on])
            yield first // width, first % width, end - first, longest, at

    return np.cumsum(edge)[:-1] > 0, stretches()


def _shards(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Shards of about SHARD_BYTES of whole texts; ends of texts are no words, so no match crosses them."""
    for b, data, off in text_blocks(batches, SHARD_BYTES, text):
        yield b, Words(data, off, ALNUM, lower=True)


def _apart(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different hashes, numbers of the words with 0 between texts, where each word stands there, where each text begins)."""
    known, number = np.unique(words.hash, return_inverse=True)
    # Word j of text i stands at j + i.
    ids = np.zeros(len(words) + len(words.first) - 1, np.int32)
    apart = np.arange(len(words)) + words.doc()
    ids[apart] = number + 1
    return known, ids, apart, words.first + np.arange(len(words.first))


def _search(words: Words, items: Items, window: int) -> tuple[np.ndarray, list[tuple]]:
    """Which words are hit, and (text, name of the item, word in text, words, longest, word in item) for each stretch."""
    known, ids, apart, first = _apart(words)
    hit, stretches = find(suffix_array(ids, window), ids, known, items, window)
    out = []
    for it, at, size, longest, word in stretches:
        d = np.searchsorted(first, at, "right") - 1
        out += [(x[0], items.names[x[1]], *x[2:]) for x in zip(d.tolist(), it.tolist(), (at - first[d]).tolist(), size.tolist(), longest.tolist(), word.tolist())]
    return hit[apart], out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items with words in blocks of about BLOCK_BYTES, one after the other; at least one block, maybe empty."""
    slim = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    size = slim.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for b in range(blocks):
        rows = slim.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect() if blocks > 1 else slim.collect()  # about BLOCK_BYTES
        yield Items([r["i"] for r in rows], [r["t"] for r in rows])


SPAN = pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("n_words", pa.int32()), ("longest", pa.int32()), ("item_word", pa.int32())])


#: What is found in a text.
FOUND = "n_words long, n_hit long, spans array<struct<item_id:string,doc_word:int,n_words:int,longest:int,item_word:int>>"


def _judge(words: Words, items: Items, window: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple]]]:
    """Of each text of a shard: where its words begin in the marks of hit words, these marks, and its spans."""
    n = len(words.first) - 1
    hit, found = np.zeros(len(words), bool), [[] for _ in range(n)]
    if items.names and len(words):
        hit, spans = _search(words, items, window)
        for d, name, p, size, longest, j in spans:
            found[d].append((str(name), p, size, longest, j))
    return np.concatenate([[0], np.cumsum(hit)])[words.first], hit, found


def _sets(words: Words, items: Items, window: int) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Of each text of a shard: how many of its words are hit, and (number, digest) of the items whose windows it has."""
    n = len(words.first) - 1
    w = items.windows(window)
    if not items.names or not len(words):
        return np.zeros(n, np.int64), [w.digest(np.zeros(0, np.int64))] * n
    known, ids, apart, begins = _apart(words)
    hit, text, number = find_sets(suffix_array(ids, window), ids, known, items, window, begins)
    at = np.searchsorted(text, np.arange(n + 1))
    upto = np.concatenate([[0], np.cumsum(hit[apart])])[words.first]
    return np.diff(upto), [w.digest(number[a:z]) for a, z in zip(at[:-1], at[1:])]


def _spans(found: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("item_id", "doc_word", "n_words", "longest", "item_word"), s)) for s in sorted(set(x))] for x in found], pa.list_(SPAN))


def _each(docs: DataFrame, items: Items, window: int, marks: bool) -> DataFrame:
    """``docs``: key, text. key, n_words, n_hit, spans and, if ``marks``, the words hit as bits."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in _shards(batches, 1):
            upto, hit, found = _judge(words, shared.value, window)
            bits = [np.packbits(hit[x:y]).tobytes() if marks and upto[i + 1] > upto[i] else None for i, (x, y) in enumerate(zip(words.first[:-1], words.first[1:]))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.counts, pa.int64()), pa.array(np.diff(upto), pa.int64()), _spans(found), pa.array(bits, pa.binary())], ["key", "n_words", "n_hit", "spans", "bits"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, {FOUND}, bits binary")


def _merge(table: pa.Table) -> pa.Table:
    """What the blocks of items found in one text."""
    n = table["n_words"][0].as_py()
    hit = np.zeros(n, bool)
    for bits in table["bits"].to_pylist():
        if bits:
            hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    spans = [tuple(s.values()) for x in table["spans"].to_pylist() for s in x]
    return pa.table({"key": table["key"][:1], "n_words": pa.array([n], pa.int64()), "n_hit": pa.array([int(hit.sum())], pa.int64()), "spans": _spans([spans])})


def _key(text: Column) -> Column:
    """Equal texts have equal matches, so the text is the key under which its matches meet."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _in_blocks(docs: DataFrame, blocks: Iterator[Items], window: int, text_col: str) -> DataFrame:
    """key, n_words, n_hit, spans of each different text, searched for one block of items after another."""
    texts = docs.select(_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    parts = [cut_lineage(_each(texts, items, window, True).dropDuplicates(["key"])) for items in blocks]
    return cut_lineage(functools.reduce(DataFrame.unionByName, parts).groupBy("key").applyInArrow(_merge, f"key string, {FOUND}"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, spans (item_id, doc_word, n_words, longest, item_word), contaminated.

    A span is a stretch of the text that is covered by windows of an item (``window`` words of it, or all, if it has
    fewer): its first word, its words, and of the longest verbatim match that begins in it the words and the place in
    the item. n_hit is the number of the document's words in any span. Null texts have no words; items without words
    match nothing; an item given twice counts once in ``spans`` by id; repeated documents each get a row; empty tables
    are fine on either side; other columns are not read. No shuffle, unless the benchmark has several blocks.
    """
    blocks = _blocks(benchmark, item_col, text_col)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = _each(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), first, window, False).withColumnRenamed("key", "doc_id")
    else:
        every = _in_blocks(docs, itertools.chain((first, second), blocks), window, text_col)
        found = docs.select(F.col(id_col).alias("doc_id"), _key(F.col(text_col)).alias("key")).join(every, "key")
    item = benchmark.schema[item_col].dataType.simpleString()
    out = found.select("doc_id", "n_words", "n_hit", F.col("spans").cast(f"array<struct<item_id:{item},doc_word:int,n_words:int,longest:int,item_word:int>>").alias("spans"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def matched_items(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated: as of ``matches``, with the
    ids of the items that match a text counted and digested (sorted as strings, joined by commas) in place of their spans.

    Every different window of the items is searched once, and texts refer to sets of items by number, so memory does not
    grow with the number of (text, item) pairs, however many items share a window.
    """
    blocks = _blocks(benchmark, item_col, text_col)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        found = matches(docs, benchmark, window, id_col, text_col, item_col)
        items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"].cast("string"))))
        return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")
    slim, shared = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in _shards(batches, 1):
            n_hit, items = _sets(words, shared.value, window)
            count, digest = zip(*items)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    found = slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` of which less than a twentieth of the words is in a span; columns unchanged, with any names.

    Null and empty texts stay; repeated rows are judged each; an empty table stays empty, and without items all rows stay.
    """
    blocks = _blocks(benchmark, item_col, text_col)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        bad = _in_blocks(docs, itertools.chain((first, second), blocks), window, text_col).where("n_hit > 0 and 20 * n_hit >= n_words").select("key")
        row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row")
        kept = docs.select(row, _key(F.col(text_col)).alias("key")).join(bad, "key", "left_anti")
        return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in _shards(batches, at):
            n_hit = _sets(words, shared.value, window)[0]
            yield b.filter(pa.array((n_hit == 0) | (20 * n_hit < words.counts)))

    return docs.mapInArrow(run, docs.schema)
