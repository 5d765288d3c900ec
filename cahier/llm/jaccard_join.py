"""Near-duplicate components by an exact n-gram Jaccard join with signature trees.

1. One pass over the texts: per text the size and a digest of its shingle set, and a sketch of bounded width with the
   shingles' frequencies. Texts with equal sets are one from here on.
2. Shingles have a common order, rare ones first (by the sketch, then by hash; any common order is exact, this one keeps
   frequent passages out). Two similar sets share at least l of the first |x| - ceil(t |x|) + l shingles, for every l.
   A second pass takes a fifth of the set as l and counts per set the shingles that a set of fitting size shares; sets
   with too few can have no link and are done.
3. Of the others the same prefixes are dealt again. A shingle that few sets have gives the pairs of these, and a pair
   counts only if it shares as many as two similar sets must: sets that share a few words by chance, which in a large
   collection each does with many, stay apart. Sets that share a shingle that more have are joined by it; frequent ones
   are left to the shortest prefixes (l = 1). What is connected forms clusters.
4. A cluster's sets are dealt into chunks of bounded size by a min-hash, so that like sets meet. Each chunk gets a
   signature tree: nodes hold the OR of their sets' bitmaps, the range of sizes and the most bits that any of the sets
   lost to collisions. A traversal of pairs of nodes prunes by sizes and by the maximum possible overlap, and skips pairs
   whose sets are already connected; what is left is verified exactly. Most clusters are one chunk and are done.
5. The sets of clusters with more chunks are dealt once more by another min-hash, which connects nearly all that is
   alike. Where sets of different components are left, those outside the largest are compared with it and each other by
   pairs of chunks, in order of sizes: of the whole cluster, or, where that would be more to ship, of those sets that
   share a shingle that many have, besides the pairs of step 3. Both ways are exact.
6. Links (at most one fewer than a tree has sets) become components by alternating large-star and small-star.

Shingles so frequent that their sets would burden one task are dealt to several, whose smallest sets meet once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cahier.llm.words import NOT_SPACE, U64, Words, grams, mix, text_blocks
from cahier.session import cut_lineage

PART_ENTRIES = 1 << 21
#: Sets with one shingle that go to one task, about; more are dealt to several.
HOT_ENTRIES = 1 << 18
#: Sets that share a shingle and are met pair by pair; more are joined by the smallest of them.
PAIR_SETS = 16
#: Sets that one task compares with each other.
CHUNK = 1500
CHUNK_SHINGLES = 1 << 20
TASK_BYTES = 16 << 20
FAN_OUT = 8
#: Tables of ids up to this many rows are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A member of a chunk is as long as so many ids.
MEMBER_IDS = 3
#: Edges of a task when components are found.
TASK_EDGES = 200_000
SKETCH_BLOCKS = 64
#: Stands for a row without an id: it comes last.
NO_ID = (1 << 63) - 1


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles; fewer words are one shingle, no words none."""
    w = Words(data, off, NOT_SPACE, lower=True)
    g = grams(w.hash, k)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        n = b - a
        if n >= k:
            s = np.sort(g[a : b - k + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif n:
            yield mix(grams(w.hash[a:b], n) + U64(n))
        else:
            yield np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> int:
    """One number for a set, the same in every order; 64 bits."""
    return int(mix(np.array([mix(s).sum() + U64(len(s))], np.uint64)).view(np.int64)[0])


def _prefix_length(n: int, percent: int, shared: int) -> int:
    """Of two similar sets, one of size n, the prefixes of this length share so many shingles."""
    return n - -(-percent * n // 100) + shared


def _fewest_shared(n: Column, percent: int) -> Column:
    """Shared prefix shingles of a set of n with any similar set, which has at least ``percent`` of n."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) / 5))


def _scan(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """kind 0: id, t, n, digest of every text. kind 1: block n of the sketch's counts, one row per task and block."""
    names = ["kind", "id", "t", "n", "digest", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b, data, off in text_blocks(batches, 1 << 20):
            counts = np.zeros(1 << bits, np.uint32) if counts is None else counts
            sets = list(shingle_sets(data, off, k))
            np.add.at(counts, (np.concatenate(sets) >> U64(64 - bits)).astype(np.int64), np.uint32(1))
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([_digest(s) for s in sets], pa.int64()), pa.nulls(len(n), pa.binary())], names)
        if counts is not None:
            small = np.minimum(counts, 255).astype(np.uint8).reshape(SKETCH_BLOCKS, -1)
            none = pa.nulls(SKETCH_BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * SKETCH_BLOCKS, pa.int32()), none, none, pa.array(range(SKETCH_BLOCKS), pa.int64()), none, pa.array([zlib.compress(x.tobytes(), 1) for x in small], pa.binary())], names)

    return docs.mapInArrow(run, "kind int, id long, t long, n long, digest long, counts binary")


def _usual(total: int, bits: int) -> float:
    """Shingles of a sketch cell that is not frequent."""
    return 4 * total / (1 << bits) + 8


def _levels(scan: DataFrame, bits: int, total: int) -> np.ndarray:
    """How frequent the shingles of each sketch cell are: 0 for cells near the mean, else 1 + log2 of the excess."""
    limit = _usual(total, bits)

    def add(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(zlib.decompress(x), np.uint8).astype(np.int64) for x in table["counts"].to_pylist())
        level = np.where(counts <= limit, 0, 1 + np.log2(np.maximum(counts / limit, 1))).astype(np.uint8)
        return pa.table({"n": table["n"][:1], "level": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros((SKETCH_BLOCKS, (1 << bits) // SKETCH_BLOCKS), np.uint8)
    for r in scan.where("kind = 1").select("n", "counts").groupBy("n").applyInArrow(add, "n long, level binary").collect():  # 2**bits bytes
        out[r["n"]] = np.frombuffer(r["level"], np.uint8)
    return out.ravel()


def _meet(docs: DataFrame, k: int, percent: int, shared: Broadcast, bits: int, usual: float, total: int, what: str) -> DataFrame:
    """The prefix shingles that at least two different sets of fitting sizes have, as

    - counts: digest, n, c: how many of its longer prefix each set has; very frequent ones are taken as shared,
    - edges: a, b: the pairs that share enough, and each set with the smallest of those that share one of many with it,
    - rows: a, b: the pairs that share enough, or bucket, digest, n: the sets that share one of many; very frequent ones
      whether shared or not.

    Counts ship half of each hash: shingles of a part that look alike raise a count, which no link is lost by, and what is
    left over is compared exactly later.

    A shingle is one of many if it is frequent (a level over 0) or more than PAIR_SETS sets have it. Of the frequent ones
    only those of the shortest prefixes are dealt; a set knows how many it left out, and a pair may lack so many. So two
    similar sets share one of many, or enough of the others: were their only ones frequent, the shortest prefixes would
    share one of these.

    ``total``: shingles of all sets of ``docs``; ``usual``: what a sketch cell of level 0 has at most.
    """
    part_bits = max(5 if what == "counts" else 6, (total * (120 - percent) // 100 // PART_ENTRIES).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in text_blocks(batches, 2 << 20):
            seen, prefixes, digests, sizes, frequent = set(), [], [], [], []
            for s in shingle_sets(data, off, k):
                if not len(s) or (d := _digest(s)) in seen:
                    continue
                seen.add(d)
                level = shared.value[(s >> U64(64 - bits)).astype(np.int64)]
                p = _prefix_length(len(s), percent, max(1, len(s) // 5))
                if not level.any():
                    prefixes.append(s[:p])
                    frequent.append(0)
                else:
                    by = np.argsort(level, kind="stable")[:p]
                    often = level[by] > 0
                    frequent.append(int(often.sum()))
                    prefixes.append(s[by if what == "counts" else by[~often | (np.arange(len(by)) < _prefix_length(len(s), percent, 1))]])
                digests.append(d)
                sizes.append(len(s))
            if not prefixes:
                continue
            h = np.concatenate(prefixes)
            owner = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
            digests, sizes, frequent = np.array(digests, np.int64), np.array(sizes, np.int32), np.array(frequent, np.int32)
            level = shared.value[(h >> U64(64 - bits)).astype(np.int64)].astype(float)
            shares = np.where(level > 0, np.ceil(usual * 2.0**level / HOT_ENTRIES), 1).astype(np.uint64)
            hot = (level > 0) if what == "counts" else (shares > 1)
            key = np.where(hot, mix(digests[owner].view(np.uint64)) if what == "counts" else mix(h) + mix(digests[owner].view(np.uint64)) % shares * U64(0x9E3779B97F4A7C15), mix(h))
            part = (mix(key) >> U64(64 - part_bits)).astype(np.int64) * 2 + hot
            by = np.lexsort((owner, part))
            h, owner, part = h[by], owner[by], part[by]
            cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(h))
            rows = []
            for a, b in zip(cut[:-1], cut[1:]):
                own, n = np.unique(owner[a:b], return_counts=True)
                kept = h[a:b] if what != "counts" else h[a:b].astype(np.uint32) if part[a] % 2 == 0 else h[:0]
                rows.append((int(part[a]), kept.tobytes(), digests[own].tobytes(), sizes[own].tobytes(), n.astype(np.int32).tobytes(), frequent[own].tobytes() if what != "counts" else b""))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["part", "h", "digest", "size", "n", "frequent"])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()])
        n, digest, size, hot = read("n", np.int32), read("digest", np.int64), read("size", np.int32), table["part"][0].as_py() % 2
        if what == "counts" and hot:
            digest, at = np.unique(digest, return_index=True)  # equal sets have equal numbers
            return pa.table({"digest": pa.array(digest), "n": pa.array(size[at].astype(np.int64)), "c": pa.array(n[at].astype(np.int64))})
        h, d, size = read("h", np.uint32 if what == "counts" else np.uint64), np.repeat(digest, n), np.repeat(size, n).astype(np.int64)
        if what == "counts":  # equal sets are one, by their first rows: their shingles may look alike
            one = np.zeros(len(digest), bool)
            one[np.unique(digest, return_index=True)[1]] = True
            one = np.repeat(one, n)
            h, d, size = h[one], d[one], size[one]
        often = np.repeat(read("frequent", np.int32), n).astype(np.int64) if what != "counts" else np.zeros(len(h), np.int64)
        by = np.lexsort((d, size, h))
        h, d, size, often = h[by], d[by], size[by], often[by]
        if what != "counts":
            new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]  # equal sets are one
            h, d, size, often = h[new], d[new], size[new], often[new]
        if not hot:
            fits = np.append(False, (h[1:] == h[:-1]) & (100 * size[:-1] >= percent * size[1:]))[: len(h)]
            fits |= np.append(fits[1:], False)[: len(h)]
            h, d, size, often = h[fits], d[fits], size[fits], often[fits]
        if what == "counts":
            d, at, c = np.unique(d, return_index=True, return_counts=True)
            return pa.table({"digest": pa.array(d), "n": pa.array(size[at]), "c": pa.array(c.astype(np.int64))})
        run = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (100 * size[:-1] < percent * size[1:]))[: len(h)])
        length = np.diff(np.append(run, len(h)))
        many = np.repeat((length > PAIR_SETS) | (shared.value[(h[run] >> U64(64 - bits)).astype(np.int64)] > 0) | bool(hot), length)
        x, y, c = _pairs(h[~many], d[~many], size[~many], percent)
        few, left_out = size[~many], often[~many]
        least = np.minimum(few[x], few[y])
        need = np.maximum(1, np.minimum(least // 5, -(-percent * least // 100)) - np.minimum(left_out[x], left_out[y]))
        pairs = {"a": d[~many][x], "b": d[~many][y], "c": c, "need": need}
        h, d, size = h[many], d[many], size[many]
        if what == "rows":
            return _union(pairs, {"bucket": h.view(np.int64), "digest": d, "n": size})
        run = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (100 * size[:-1] < percent * size[1:]))[: len(h)])
        last = (np.append(run[1:], len(h)) - 1)[: len(run)]
        least = np.minimum.reduceat(d, run) if len(d) else d
        hub = np.repeat(least, np.diff(np.append(run, len(d)))) if len(d) else d
        stars = np.unique(np.stack([d, hub], 1)[d != hub], axis=0)
        again = len(run) if hot else 0  # the hubs of a shingle that several tasks have meet once more
        return _union(pairs, {"a": stars[:, 0], "b": stars[:, 1]}, {"a": least[:again], "h": h[run][:again].view(np.int64), "lo": size[run][:again], "hi": size[last][:again]})

    pair = "a long, b long, c long, need long"
    schema = {"counts": "digest long, n long, c long", "edges": f"{pair}, h long, lo long, hi long", "rows": f"{pair}, bucket long, digest long, n long"}[what]

    def _union(*parts: dict) -> pa.Table:
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.concat_tables([pa.table({k: pa.array(p[k], pa.int64()) if k in p else pa.nulls(len(p["a" if "a" in p else "bucket"]), pa.int64()) for k in names}) for p in parts])

    dealt = docs.mapInArrow(deal, "part int, h binary, digest binary, size binary, n binary, frequent binary")
    found = dealt.groupBy("part").applyInArrow(meet, schema)
    if what == "counts":
        return found
    found = cut_lineage(found)
    pairs = found.where("need is not null").groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("need").alias("need")).where("c >= need").select("a", "b")
    if what == "rows":
        none = F.lit(None).cast("long")
        return found.where("bucket is not null").select("a", "b", "bucket", "digest", "n").unionByName(pairs.withColumns({c: none for c in ("bucket", "digest", "n")}))
    # Hubs of one shingle in order of sizes: one that fits to any before it is joined to the one with the largest of these.
    by = Window.partitionBy("h").orderBy("lo", "hi", "a").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.struct("hi", "a")).over(by)
    hubs = found.where("h is not null").select("a", "lo", top.alias("top"))
    hubs = hubs.where((100 * F.col("top.hi") >= percent * F.col("lo")) & (F.col("a") != F.col("top.a"))).select("a", F.col("top.a").alias("b"))
    return found.where("h is null and need is null").select("a", "b").unionByName(hubs).unionByName(pairs)


def _pairs(h: np.ndarray, d: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places x and y of each pair of sets ``d`` of fitting sizes that share a shingle, the smaller number first; how many
    they share), from rows in order of ``h`` and ``size``."""
    x, y = [], []
    for step in range(1, len(h)):
        at = np.flatnonzero(h[step:] == h[:-step])
        if not len(at):
            break
        at = at[100 * size[at] >= percent * size[at + step]]
        x.append(at)
        y.append(at + step)
    if not x:
        return (np.zeros(0, np.int64),) * 3
    x, y = np.concatenate(x), np.concatenate(y)
    first, second = np.minimum(d[x], d[y]), np.maximum(d[x], d[y])
    x, y = np.where(d[x] == first, x, y), np.where(d[x] == first, y, x)
    by = np.lexsort((second, first))
    start = np.flatnonzero(np.append(True, (first[by][1:] != first[by][:-1]) | (second[by][1:] != second[by][:-1]))[: len(by)])
    return x[by][start], y[by][start], np.diff(np.append(start, len(by)))


class _Bucket:
    """The sets of one bucket (or chunk of one), their signature tree and what is connected so far."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int):
        n = np.array([len(s) for s in sets], np.int64)
        by = np.lexsort((label, n))
        self.sets, self.n, self.side, self.at, self.percent = [sets[i] for i in by], n[by], side[by], by, percent
        self.label = np.unique(label[by], return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def verify(self, i: int, j: int) -> None:
        if self.label[i] == self.label[j] or 0 < self.side[i] == self.side[j]:
            return
        a, b = self.sets[i], self.sets[j]
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        p = np.searchsorted(b, a)
        both = int((b[np.minimum(p, len(b) - 1)] == a).sum())
        if 100 * both >= self.percent * (len(a) + len(b) - both):
            self.links.append((int(self.at[i]), int(self.at[j])))
            self.label[self.label == self.label[j]] = self.label[i]

    def link(self) -> list[tuple[int, int]]:
        m = len(self.sets)
        if m <= 3:
            for i in range(m):
                for j in range(i):
                    self.verify(i, j)
            return self.links
        width = min(1 << 15, max(64, 1 << int(4 * self.n.max() - 1).bit_length()))
        maps = np.zeros((m, width // 64), np.uint64)
        row = np.zeros(width, bool)
        for i, s in enumerate(self.sets):
            at = (s & U64(width - 1)).astype(np.int64)
            row[at] = True
            maps[i] = np.packbits(row).view(np.uint64)
            row[at] = False
        lost = self.n - np.bitwise_count(maps).sum(1, dtype=np.int64)
        # levels[0]: nodes of FAN_OUT sets; each level above: nodes of FAN_OUT nodes.
        levels, parts = [], (maps, self.n, self.n, lost)
        while True:
            cut = np.arange(0, len(parts[0]), FAN_OUT)
            parts = (np.bitwise_or.reduceat(parts[0], cut, 0), np.minimum.reduceat(parts[1], cut), np.maximum.reduceat(parts[2], cut), np.maximum.reduceat(parts[3], cut))
            levels.append(parts)
            if len(cut) == 1:
                break
        need = lambda a, b: -(-self.percent * (a + b) // (100 + self.percent))  # noqa: E731  least overlap of sizes a and b
        stack = [(len(levels) - 1, 0, 0)]
        while stack:
            depth, x, y = stack.pop()
            span = FAN_OUT ** (depth + 1)
            lx, ly = self.label[x * span : (x + 1) * span], self.label[y * span : (y + 1) * span]
            if (lx == lx[0]).all() and (ly == lx[0]).all():
                continue
            or_, lo, hi, gone = levels[depth]
            if x != y:
                if 100 * hi[min(x, y)] < self.percent * lo[max(x, y)]:
                    continue
                if np.bitwise_count(or_[x] & or_[y]).sum(dtype=np.int64) + min(gone[x], gone[y]) < need(lo[x], lo[y]):
                    continue
            if depth:
                inside = lambda p: range(p * FAN_OUT, min((p + 1) * FAN_OUT, len(levels[depth - 1][0])))
                below = [(depth - 1, a, b) for a in inside(x) for b in inside(y) if x != y or a >= b]
                stack += sorted(below, key=lambda t: t[1] == t[2])  # a node with itself comes first
                continue
            i, j = np.arange(x * FAN_OUT, min((x + 1) * FAN_OUT, m)), np.arange(y * FAN_OUT, min((y + 1) * FAN_OUT, m))
            most = np.bitwise_count(maps[i][:, None] & maps[j][None]).sum(2, dtype=np.int64) + np.minimum(lost[i][:, None], lost[j][None])
            ok = ((self.side[i][:, None] != self.side[j][None]) | (self.side[i] == 0)[:, None]) & (most >= need(self.n[i][:, None], self.n[j][None])) & (self.label[i][:, None] != self.label[j][None])
            if x == y:
                ok &= i[:, None] > j[None]
            for a, b in zip(*np.nonzero(ok)):
                self.verify(int(i[a]), int(j[b]))
        return self.links


def _links(members: DataFrame, sets: DataFrame | None, percent: int) -> DataFrame:
    """``members``: bucket, chunk, digest, n, label, side. Verified links (a, b) between digests that meet in a chunk of a
    bucket; sets on the same side other than 0 are not compared.

    ``sets``: digest, shingles, or None if members hold their shingles. Sets are long and members short: below a checked
    number of members only those sets are shuffled that are compared, once."""
    count, entries = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(64, 8 * entries // TASK_BYTES)

    def run(table: pa.Table) -> pa.Table:
        bucket, chunk, digest, label, side = (table[c].to_numpy() for c in ("bucket", "chunk", "digest", "label", "side"))
        sets = table["shingles"].to_pylist()
        by = np.lexsort((digest, chunk, bucket))
        cut = np.flatnonzero(np.append(True, (bucket[by][1:] != bucket[by][:-1]) | (chunk[by][1:] != chunk[by][:-1])))
        a, b = [], []
        for ids in np.split(by, cut[1:]):
            ids = ids[np.append(True, digest[ids[1:]] != digest[ids[:-1]])]
            if len(ids) > 1:
                for i, j in _Bucket([np.frombuffer(sets[x], np.uint64) for x in ids], label[ids], side[ids], percent).link():
                    a.append(digest[ids[i]])
                    b.append(digest[ids[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = (members if sets is None else sets.join(_small(members, MEMBER_IDS * count), "digest")).withColumn("task", F.pmod(F.xxhash64("bucket", "chunk"), F.lit(tasks)).cast("int"))
    return dealt.select("task", "bucket", "chunk", "digest", "label", "side", "shingles").groupBy("task").applyInArrow(run, "a long, b long")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes but the smallest of each component. ``edges``: a, b.

    The smallest neighbours are a table of their own, which is broadcast up to BROADCAST_IDS rows and else joined by
    shuffles of plain rows, so that Spark can split a node with very many edges.
    """
    e = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, n = None, e.count()
    tasks = 1 + n // TASK_EDGES  # few edges need few tasks, whatever the number of shuffle partitions
    e = e.coalesce(tasks)

    def least(rows: DataFrame, m: Column) -> DataFrame:
        found = rows.groupBy("u").agg(m.alias("m")).coalesce(tasks)
        return F.broadcast(found) if 2 * n <= BROADCAST_IDS else cut_lineage(found)

    while n:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(least(both, F.least(F.first("u"), F.min("v"))), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        large = large if 2 * n <= BROADCAST_IDS else cut_lineage(large)
        lowest = least(large, F.min("v"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.distinct().coalesce(tasks))
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before, n = now, now[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _chunks(n: str, words: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / CHUNK), F.ceil(F.col(words) / CHUNK_SHINGLES)).cast("int")


def _by_minhash(sets_: DataFrame, m: str, made: DataFrame | None = None) -> DataFrame:
    """members: the sets of each cluster in chunks, those with equal min-hash together where they fit in one.
    ``sets_``: cluster, chunks, digest, n, label and the min-hash; ``made``: the same with shingles, which members have then.
    Groups that do not fit have more than CHUNK sets or CHUNK_SHINGLES shingles each, so they are few."""
    groups = sets_.where("chunks > 1").groupBy("cluster", m).agg(F.count("*").alias("c"), F.sum("n").alias("words"))
    large = groups.where((F.col("c") > CHUNK) | (F.col("words") > CHUNK_SHINGLES)).select("cluster", m, _chunks("c", "words").alias("pieces"))
    dealt = (sets_ if made is None else made).join(F.broadcast(large), ["cluster", m], "left")
    own = F.pmod(F.xxhash64("digest", F.lit(m)), F.col("pieces"))
    chunk = F.when(F.col("chunks") == 1, F.lit(0).cast("long")).when(F.col("pieces").isNotNull(), F.xxhash64(m, own)).otherwise(F.pmod(F.col(m), F.col("chunks")).cast("long"))
    return dealt.select(F.col("cluster").alias("bucket"), chunk.alias("chunk"), "digest", "n", "label", F.lit(0).alias("side"), *(["shingles"] if made is not None else []))


def _labelled(rows: DataFrame, label: DataFrame, n: int) -> DataFrame:
    """The rows of sets with their component as ``label``."""
    known = label.select(F.col("node").alias("digest"), "component")
    return rows.join(_small(known, n), "digest", "left").withColumn("label", F.coalesce("component", "digest")).drop("component")


def _mixed(rest: DataFrame) -> DataFrame:
    """bucket, digest, n, label, other, chunks: the buckets in which different components meet; ``other``: 0 for the sets of
    the largest of them, and into how many chunks the bucket has to be split."""
    groups = rest.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("words"))
    mixed = groups.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("c"), F.sum("words").alias("words"), F.count("*").alias("labels")).where("labels > 1")
    mixed = cut_lineage(mixed.select("bucket", "main", _chunks("c", "words").alias("chunks")))
    found = rest.join(_small(mixed, mixed.count()), "bucket")
    return found.select("bucket", "digest", "n", "label", (F.col("label") != F.col("main")).cast("int").alias("other"), "chunks")


def _bucket_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """members of pairs of chunks of buckets of any size whose sizes fit: the sets outside the bucket's main component
    (``other`` = 1) with each other and with those of it; a set whose size fits to none of the other chunk is left out of
    the pair. ``rest``: bucket, digest, n, label, other."""
    group, room = ["bucket", "other"], F.greatest(F.lit(1.0 / CHUNK), F.col("n") / CHUNK_SHINGLES)
    sizes = rest.groupBy(*group, "n").agg((F.count("*") * F.first(room)).alias("room"))
    before = Window.partitionBy(*group).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_lineage(sizes.withColumn("at", F.coalesce(F.sum("room").over(before), F.lit(0.0))))
    inside = F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) / F.lit(1 << 20)  # sets of one size lie in the order of a hash
    own = cut_lineage(rest.join(sizes, [*group, "n"]).withColumn("own", F.floor(F.col("at") + F.col("room") * inside).cast("long")).drop("room", "at"))
    range_ = own.groupBy(*group, "own").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    second = range_.where("other = 1").select("bucket", F.col("own").alias("own2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    fit = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
    pairs = range_.join(second, "bucket").where(((F.col("other") == 0) | (F.col("own") <= F.col("own2"))) & fit)
    pairs = pairs.withColumn("chunk", (F.col("own") * (1 << 31) + F.col("own2")) * 2 + F.col("other"))
    same = (F.col("other") == 1) & (F.col("own") == F.col("own2"))
    first = pairs.select("bucket", "other", "own", "chunk", F.when(same, 0).otherwise(1).alias("side"), F.col("lo2").alias("least"), F.col("hi2").alias("most"))
    last = pairs.where(~same).select("bucket", F.lit(1).alias("other"), F.col("own2").alias("own"), "chunk", F.lit(2).alias("side"), F.col("lo").alias("least"), F.col("hi").alias("most"))
    members = own.join(first.unionByName(last), [*group, "own"])
    members = members.where((100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least")))
    return members.select("bucket", "chunk", "digest", "n", "label", "side")


def _shipped(rest: DataFrame) -> DataFrame:
    """bucket, words, and how many shingles pairs of chunks of the whole cluster ship."""
    room = F.greatest(F.lit(1.0 / CHUNK), F.col("n") / CHUNK_SHINGLES)
    others = F.ceil(F.sum(F.when(F.col("other") == 1, room).otherwise(0.0)))
    return rest.groupBy("bucket").agg(others.alias("others"), F.sum("n").alias("words")).select("bucket", "words", (2 * F.col("others") * F.col("words")).alias("by_chunks"))


def _cheap(rest: DataFrame, percent: int) -> DataFrame:
    """bucket: the clusters in which pairs of chunks of the whole cluster are less to ship than the sets' prefix shingles
    (rows of three numbers, shuffled three times)."""
    return _shipped(rest).where(F.col("by_chunks") <= 9 * F.col("words") * (120 - percent) / 100).select("bucket")


def _couples(pairs: DataFrame, labelled: DataFrame, n: int) -> DataFrame:
    """members: each of ``pairs`` (a, b) whose components differ by itself. ``labelled``: digest, n, label of ``n`` sets."""
    of = lambda c: _small(labelled.select(F.col("digest").alias(c), F.struct("digest", "n", "label").alias(f"{c}_")), MEMBER_IDS * n)
    both = pairs.join(of("a"), "a").join(of("b"), "b").where("a_.label != b_.label")
    return both.select(F.col("a").alias("bucket"), F.col("b").alias("chunk"), F.explode(F.array("a_", "b_")).alias("m")).select("bucket", "chunk", "m.*", F.lit(0).alias("side"))


def _classes(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id, t (a hash of the text), n, digest of every row (a row without an id has NO_ID), and digest, component (the smallest
    digest that links reach) of the sets that have a link."""
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("t"))
    bits = min(24, max(16, (16 * slim.count()).bit_length()))
    scan = cut_lineage(_scan(slim, words, bits))
    summary = scan.where("kind = 0").select("id", "t", "n", "digest")
    total = summary.agg(F.sum("n")).first()[0] or 0
    levels, usual = slim.sparkSession.sparkContext.broadcast(_levels(scan, bits, total)), _usual(total, bits)  # 2**bits bytes

    counts = _meet(slim, words, percent, levels, bits, usual, total, "counts").groupBy("digest").agg(F.sum("c").alias("c"), F.first("n").alias("n"))
    wanted = counts.where(F.col("c") >= _fewest_shared(F.col("n"), percent)).select("digest", "n")
    first = summary.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "t")).alias("row"))  # the row that stands for the set
    wanted = cut_lineage(wanted.join(first, "digest").select("digest", "n", "row.id", "row.t"))

    def rows_of(some: DataFrame) -> tuple[DataFrame, int]:
        count, n = some.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        return slim.join(_small(some.select("id", "t"), count), ["id", "t"], "left_semi").select("id", "text"), n

    chosen, total_wanted = rows_of(wanted)
    cluster = components(_meet(chosen, words, percent, levels, bits, usual, total_wanted, "edges"))
    cluster = cluster.unionByName(cluster.select(F.col("component").alias("node"), "component").distinct())
    sets_ = cut_lineage(wanted.join(cluster.select(F.col("node").alias("digest"), F.col("component").alias("cluster")), "digest"))

    sizes = sets_.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("words")).select("cluster", _chunks("c", "words").alias("chunks"))
    placed = cut_lineage(sets_.join(sizes, "cluster").select("id", "t", "cluster", "chunks"))
    texts = slim.join(_small(placed, placed.count()), ["id", "t"]).select("id", "text", "t", "cluster", "chunks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows with one id and text are one; those of different tasks meet in one chunk
        for b, data, off in text_blocks(batches, 1 << 20):
            found, at, digests = [], [], []
            for i, s in enumerate(shingle_sets(data, off, words)):
                if len(s) and (d := _digest(s)) not in seen:
                    seen.add(d)
                    found.append(s)
                    at.append(i)
                    digests.append(d)
            least = [[int(mix(mix(s + U64(i + 1)).min()[None]).view(np.int64)[0]) for s in found] for i in range(2)]
            given = b.select(["id", "t", "cluster", "chunks"]).take(pa.array(at, pa.int64()))
            new = [pa.array(digests, pa.int64()), pa.array([len(s) for s in found], pa.int64()), *[pa.array(m, pa.int64()) for m in least], pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*given.columns, *new], [*given.schema.names, "digest", "n", "m0", "m1", "shingles"])

    made = cut_lineage(texts.mapInArrow(sets, "id long, t long, cluster long, chunks int, digest long, n long, m0 long, m1 long, shingles binary"))
    made = made.withColumn("label", F.col("digest"))
    sets_ = cut_lineage(made.drop("shingles").dropDuplicates(["digest"]))
    links = cut_lineage(_links(_by_minhash(sets_, "m0", made), None, percent))
    made = made.where("chunks > 1").select("digest", "shingles")
    label = components(links)
    large = sets_.where("chunks > 1").drop("label")
    if not large.isEmpty():
        again = _by_minhash(_labelled(large, label, label.count()), "m1")
        links = links.unionByName(cut_lineage(_links(again, made, percent)))
        label = components(links)
        now = _labelled(large, label, label.count()).select(F.col("cluster").alias("bucket"), "digest", "n", "label")
        rest = cut_lineage(_mixed(now))
        cheap = cut_lineage(_cheap(rest, percent))
        count = cheap.count()
        pairs = cut_lineage(_bucket_pairs(rest.join(_small(cheap, count), "bucket", "left_semi"), percent))
        links = links.unionByName(cut_lineage(_links(pairs, made, percent)))
        dear = rest.join(_small(cheap, count), "bucket", "left_anti")
        chosen, total_open = rows_of(cut_lineage(large.join(dear.select("digest"), "digest", "left_semi")))
        if total_open:
            shared = cut_lineage(_meet(chosen, words, percent, levels, bits, usual, total_open, "rows"))
            open_ = cut_lineage(dear.select(F.col("bucket").alias("cluster"), "digest", "n", "label"))
            couples = cut_lineage(_couples(shared.where("a is not null").select("a", "b"), open_.drop("cluster"), open_.count()))
            links = links.unionByName(cut_lineage(_links(couples, made, percent)))
            label = components(links)
            rest = cut_lineage(_mixed(_labelled(shared.where("bucket is not null").select("bucket", "digest", "n"), label, label.count())))
            # Only now it is known what sets that share a shingle of many are to ship, and where the cluster is less.
            by_rows = rest.join(open_.select("digest", "cluster"), "digest").groupBy(F.col("cluster").alias("bucket")).agg(F.sum("n").alias("by_rows"))
            less = cut_lineage(_shipped(dear).join(by_rows, "bucket").where("by_chunks < by_rows").select("bucket"))
            count = less.count()
            inside = open_.join(_small(less.withColumnRenamed("bucket", "cluster"), count), "cluster", "left_semi").select("digest")
            rest = cut_lineage(rest.join(_small(inside, open_.count()), "digest", "left_anti"))
            whole = rest.where("chunks = 1").select("bucket", F.lit(0).cast("long").alias("chunk"), "digest", "n", "label", F.lit(0).alias("side"))
            pairs = whole.unionByName(_bucket_pairs(rest.where("chunks > 1"), percent))
            pairs = cut_lineage(pairs.unionByName(_bucket_pairs(dear.join(_small(less, count), "bucket", "left_semi"), percent)))
            links = links.unionByName(_links(pairs, made, percent))
        label = components(links)
    label = label.unionByName(label.select(F.col("component").alias("node"), "component").distinct())
    return summary, label.withColumnRenamed("node", "digest")


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, the smallest id reachable by links.

    Texts are linked when the Jaccard index of their sets of ``words``-word shingles is at least percent / 100; A-Z
    count as a-z. Null texts and texts without words have an empty set and are linked with nothing; a text with fewer
    words is one shingle; equal texts are linked; repeated rows and ids each get a row, by its own text; an empty table
    gives no rows; other columns are not read. Ids are whole numbers; a row without one is linked like any other, and its
    component has null only if no row of it has an id.
    """
    summary, label = _classes(docs, percent, words, id_col, text_col)
    ids = summary.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"))
    linked = cut_lineage(label.join(ids, "digest"))
    count = linked.count()
    of_component = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(_small(of_component, count), "component").select("digest", "component_id")
    every = cut_lineage(ids.join(_small(named, count), "digest", "left").select("digest", F.coalesce("component_id", "least").alias("component_id")))
    full = summary.where("n > 0").join(every, "digest").select("id", "n", "component_id")
    full = full.unionByName(summary.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return full.select(known("id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near duplicates the row with the smallest id, columns unchanged.

    Rows are judged by their own texts: of rows that share an id, each stays or goes with its text's component, so no
    text is lost that nothing kept is like. Ties of ids go by a hash of the text; of rows equal in id and text one
    stays (which one is open if other columns differ). Rows without an id come last in their component; rows without
    words all stay; an empty table stays empty; columns may have any names.
    """
    summary, label = _classes(docs, percent, words, id_col, text_col)
    count = label.count()
    own = summary.where("n > 0").join(_small(label, count), "digest", "left").select("id", "t", F.coalesce("component", "digest").alias("component"))
    own = cut_lineage(own.groupBy("component", "id", "t").agg(F.count("*").alias("n")))
    kept = cut_lineage(own.groupBy("component").agg(F.min(F.struct("id", "t")).alias("row"), F.count("*").alias("rows")).where("rows > 1"))
    gone = own.join(_small(kept, kept.count()), "component").where(F.struct("id", "t") != F.col("row")).select("id", "t")
    twice = own.where("n > 1").select("id", "t")
    gone, twice = cut_lineage(gone), cut_lineage(twice)
    n_gone, n_twice = gone.count(), twice.count()
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("t"))
    left = keyed.join(_small(gone, n_gone), ["id", "t"], "left_anti")
    if n_twice:
        left = left.join(_small(twice, n_twice), ["id", "t"], "left_anti").unionByName(left.join(_small(twice, n_twice), ["id", "t"], "left_semi").dropDuplicates(["id", "t"]))
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
