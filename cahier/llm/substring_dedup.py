"""Substring dedup with repeated-phrase automata.

1. Every window of ``window`` words holds the phrase (``phrase`` words) with the smallest hash in it; equal windows hold
   equal ones. A first pass gives these phrases; those of two or more documents are confirmed as recurring.
2. All documents are dealt into shards of bounded size. Each shard compiles the confirmed phrases of its own documents,
   which come to it as texts, into one Aho-Corasick automaton (so automata grow with a shard, never with the corpus) and
   streams every document of the shard through it, which locates every occurrence of every phrase, nothing else does.
3. The windows around these places are verified: per shard each different one goes out once (as a 64-bit hash of its
   words), with the smallest id, and comes back with the smallest id of the corpus. A window whose first document is a
   smaller one covers words, which are removed.

What very many documents share is one row per shard with map-side sums before; the rows of a window meet in groups of
shards first, so no task gets them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cahier.llm.words import NOT_SPACE, U64, Words, grams, text_blocks
from cahier.session import cut_lineage

PART_ENTRIES = 1 << 19
SHARD_BYTES = 4 << 20
#: Shards whose windows meet first.
SHARD_GROUP = 4096
#: Stands for a null id: it comes last.
_LAST = np.iinfo(np.int64).max


def _sliding(x: np.ndarray, n: int, take) -> np.ndarray:
    """take (minimum or maximum) over each n consecutive numbers."""
    size = 1
    while size * 2 <= n:
        x = take(x[: len(x) - size], x[size:])
        size *= 2
    return x if size == n else take(x[: len(x) - (n - size)], x[n - size :])


def anchors(w: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (index of the first word) and hashes of the phrases that are the smallest of some window."""
    if len(w) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(w.hash, phrase)
    span = window - phrase + 1
    least = _sliding(g, span, np.minimum)  # one per window start
    least = np.where(w.room()[: len(least)] >= window, least, U64(0))
    # g[i] is the smallest of a window around it if and only if the largest of these windows' minima is g[i].
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, span, np.maximum)[: len(g)] == g)
    return at, g[at]


def _read(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table[column].to_pylist() if x is not None), kind)


def _phrase(raw: bytes, w: Words, i: int, phrase: int) -> str:
    return b" ".join(raw[a:b] for a, b in zip(w.start[i : i + phrase].tolist(), w.end[i : i + phrase].tolist())).decode()


def _phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """shard, phrase: the chosen phrases of each shard that two or more documents of the corpus have. ``docs``: id, text, shard."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in text_blocks(batches, 3 << 20):
            w = Words(data, off, NOT_SPACE)
            at, h = anchors(w, window, phrase)
            d = b.column(0).to_numpy()[np.searchsorted(w.first, at, "right") - 1]
            by = np.lexsort((d, h))
            h, d = h[by], d[by]
            cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            last = d[np.append(cut[1:], len(h)) - 1] if len(cut) else d
            yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), pa.array(d[cut]), pa.array(last)], ["h", "lo", "hi"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in text_blocks(batches, 3 << 20):
            w = Words(data, off, NOT_SPACE)
            at, h = anchors(w, window, phrase)
            shard = b.column(2).to_numpy()[np.searchsorted(w.first, at, "right") - 1]
            new = np.unique(np.stack([h.view(np.int64), shard.astype(np.int64)]), axis=1, return_index=True)[1]
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(shard[new], pa.int32()), pa.array([_phrase(raw, w, i, phrase) for i in at[new].tolist()], pa.string())], ["h", "shard", "phrase"])

    seen = docs.select("id", "text").mapInArrow(met, "h long, lo long, hi long").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    confirmed = cut_lineage(seen.where("lo < hi").select("h"))
    return cut_lineage(docs.select("id", "text", "shard").mapInArrow(texts, "h long, shard int, phrase string").join(confirmed, "h").select("shard", "phrase").distinct())


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a shard."""
    table = table.combine_chunks()
    blocks = [(data, off) for _, data, off in text_blocks([b.select(["id", "text"]) for b in table.to_batches()], 1 << 60)]
    if not blocks:
        return table["id"].to_numpy(), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    sizes = np.concatenate([np.diff(off) for _, off in blocks])
    return table["id"].to_numpy(), np.concatenate([d for d, _ in blocks]), np.concatenate([[0], np.cumsum(sizes)])


def _locate(raw: bytes, off: np.ndarray, w: Words, phrases: list[str], phrase: int) -> np.ndarray:
    """Marks the words at which an occurrence of one of the phrases starts."""
    import ahocorasick

    found = np.zeros(len(w) + 1, bool)
    if not phrases:
        return found
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word(f" {p} ")
    automaton.make_automaton()
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        text = " " + b" ".join(raw[a:b].split()).decode() + " "  # bytes.split() parts at \x20 and \x09-\x0D only
        ends = [e for e, _ in automaton.iter(text)]
        if ends:
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            found[w.first[i] + np.searchsorted(spaces, ends) - phrase] = True
    return found


def _windows(w: Words, found: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Starts of the windows that hold a found phrase."""
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(found)])
    start = np.arange(n)
    return np.flatnonzero((w.room()[:n] >= window) & (upto[start + window - phrase + 1] > upto[start]))


def repeated_passages(docs: DataFrame, window: int = 50, phrase: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, removed (start and n_words of spans), kept_text.

    A word is removed when a window of ``window`` words around it also starts in a document with a smaller id, by the
    texts as they came in. Kept words are joined by one space. Null and empty texts have no words; shorter texts lose
    nothing; equal rows with one id keep what only they repeat; a null id counts as the largest; an empty table gives
    no rows; other columns are not read. Ids are whole numbers.
    """
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(64, total // SHARD_BYTES)
    bits = max(6, (total // 12 // PART_ENTRIES).bit_length())
    texts = docs.select(id_.alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_, F.col(text_col)), F.lit(shards)).cast("int").alias("shard"))
    phrases = _phrases(texts, window, phrase)

    def located(left: pa.Table, right: pa.Table) -> tuple:
        """ids, bytes, offsets and words of a shard, the starts and hashes of the windows around the places found."""
        ids, data, off = _texts(left)
        w, raw = Words(data, off, NOT_SPACE), data.tobytes()
        start = _windows(w, _locate(raw, off, w, [p for p in right["phrase"].to_pylist() if p is not None], phrase), window, phrase)
        return ids, raw, off, w, start, grams(w.hash, window)[start], ids[np.searchsorted(w.first, start, "right") - 1]

    def packed(rows: list[tuple], names: dict) -> pa.Table:
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(names.items(), cols)})

    asked = {"part": pa.int32(), "meet": pa.int32(), "shard": pa.int32(), "h": pa.binary(), "d": pa.binary(), "many": pa.binary()}
    ASKED = "part int, meet int, shard int, h binary, d binary, many binary"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each window found, with the smallest id and whether a later document of the shard has it."""
        *_, h, d = located(left, right)
        by = np.lexsort((d, h))
        h, d = h[by], d[by]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        many = (d[np.append(at[1:], len(h)) - 1] > d[at]).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
        h, d = h[at], d[at]
        part = (h >> U64(64 - bits)).astype(np.int64)
        cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(h))
        shard = left["shard"][0].as_py() if len(left) else 0
        return packed([(int(part[x]), shard // SHARD_GROUP, shard, h[x:y].tobytes(), d[x:y].tobytes(), many[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:])], asked)

    def least(table: pa.Table) -> tuple[np.ndarray, ...]:
        h, d, many = _read(table, "h", np.uint64), _read(table, "d", np.int64), _read(table, "many", np.uint8)
        by = np.lexsort((d, h))
        h, d, many = h[by], d[by], many[by]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        later = np.maximum.reduceat(many, at) | (d[np.append(at[1:], len(h)) - 1] > d[at])
        return h[at], d[at], later.astype(np.uint8)

    def together(table: pa.Table) -> pa.Table:
        """The windows of a group of shards, as one shard would have them."""
        h, d, many = least(table)
        meet = table["meet"][0].as_py()
        return packed([(table["part"][0].as_py(), meet, -1, h.tobytes(), d.tobytes(), many.tobytes())], asked)

    def first(table: pa.Table) -> pa.Table:
        """To each group of shards its windows that a document with a larger id than the smallest has, with that one."""
        h, d, later = least(table)
        rows = []
        for one in table.to_pylist():
            own = np.frombuffer(one["h"], np.uint64)
            at = np.searchsorted(h, own)
            use = later[at] > 0
            rows.append((one["part"], one["meet"], own[use].tobytes(), d[at[use]].tobytes()))
        return packed(rows, {"part": pa.int32(), "meet": pa.int32(), "h": pa.binary(), "first": pa.binary()})

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        """To each shard what it needs: windows that it has for an id larger than the first."""
        h, least_id = _read(right, "h", np.uint64), _read(right, "first", np.int64)
        by = np.argsort(h)
        h, least_id = h[by], least_id[by]
        rows = []
        for one in left.to_pylist():
            own, d, many = (np.frombuffer(one[c], t) for c, t in (("h", np.uint64), ("d", np.int64), ("many", np.uint8)))
            at = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
            use = np.flatnonzero(h[at] == own) if len(h) else np.zeros(0, np.int64)
            use = use[(many[use] > 0) | (d[use] > least_id[at[use]])]
            rows.append((one["shard"], None, own[use].tobytes(), least_id[at[use]].tobytes()))
        return packed([r for r in rows if r[2]], {"shard": pa.int32(), "phrase": pa.string(), "h": pa.binary(), "first": pa.binary()})

    span = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32())]))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, raw, off, w, start, g, own = located(left, right)
        h, first_id = _read(right, "h", np.uint64), _read(right, "first", np.int64)
        by = np.argsort(h)
        h, first_id = h[by], first_id[by]
        cover = np.zeros(len(w) + 1, np.int64)
        if len(h) and len(start):
            p = np.minimum(np.searchsorted(h, g), len(h) - 1)
            start = start[(h[p] == g) & (first_id[p] < own)]
            np.add.at(cover, start, 1)
            np.subtract.at(cover, start + window, 1)
        gone = np.cumsum(cover)[:-1] > 0
        removed, spans, kept = [], [], []
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            words = raw[off[i] : off[i + 1]].split()
            x = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]])))
            spans.append([{"start": s, "n_words": e - s} for s, e in edge.reshape(-1, 2).tolist()])
            removed.append(int(x.sum()))
            kept.append(b" ".join([words[j] for j in np.flatnonzero(~x).tolist()] if removed[-1] else words).decode())
        back = [None if i == _LAST else i for i in ids.tolist()]
        return pa.table({"doc_id": pa.array(back, pa.int64()), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, span), "kept_text": pa.array(kept, pa.string())})

    # One plan: texts and windows are shuffled once each and read twice.
    seen = texts.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(search, ASKED)
    met = seen.groupBy("part", "meet").applyInArrow(together, ASKED).groupBy("part").applyInArrow(first, "part int, meet int, h binary, first binary")
    answers = seen.groupBy("part", "meet").cogroup(met.groupBy("part", "meet")).applyInArrow(back, "shard int, phrase string, h binary, first binary")
    told = phrases.select("shard", "phrase", F.lit(None).cast("binary").alias("h"), F.lit(None).cast("binary").alias("first")).unionByName(answers)
    return texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, removed array<struct<start:int,n_words:int>>, kept_text string")
