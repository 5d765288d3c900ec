"""Language identification by language-bitmask n-gram filters.

N-grams are those of 1 to ORDERS letters in lower case, with one blank for whatever stands between two words, and none
across a word. Training counts them per language over all training texts. An n-gram is of a language where its rate
(share of the language's n-grams of that order) reaches ``least`` and ``share`` of its highest rate in any language; so
at most 1 / ``least`` n-grams per order and language are kept, whatever the corpus.

The kept n-grams fill one bit-sliced Bloom filter: a row of bits per place, one bit per language. The AND of an n-gram's
rows is the bitmask of all languages that contain it. A text's bits are counted per language, the count that the
language's fill of the filter yields by chance is taken off, and the language with the largest corrected share of the
text's n-grams is predicted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cahier.llm.words import U64, text_blocks
from cahier.session import cut_lineage

ORDERS = 4
HASHES = 2
#: Places per kept n-gram, and the largest filter: 2**24 rows of a byte per eight languages, beyond which the correction
#: has more chance hits to take off.
PLACES, MOST_PLACES = 16, 1 << 24
#: (language, n-gram) counts that a training task holds before it passes them on.
HELD = 2_000_000
BLANK = 32
UNKNOWN = "und"
#: Rows of the filter that one task packs.
ROWS = 1 << 16


@cache
def _fold() -> np.ndarray:
    """Code point -> its letter in lower case, or BLANK where it is no letter."""
    out = np.full(0x110000, BLANK, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text) of texts in UTF-8: letters in lower case, each run of others one blank, and a blank around
    every text."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    n = len(offsets) - 1
    c, d = np.full(len(points) + n, BLANK, np.uint32), np.zeros(len(points) + n, np.int64)
    at = np.arange(len(points)) + doc
    c[at], d[at] = _fold()[points], doc
    ends = begins[1:] + np.arange(n)
    d[ends] = np.arange(n)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != BLANK) | (c[:-1] != BLANK)
    c, d = c[keep], d[keep]
    return (np.concatenate([[BLANK], c]), np.concatenate([d[:1], d])) if len(c) and c[0] != BLANK else (c, d)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order (n, text, hash) of all n-grams, in the order of the texts. A hash's lowest three bits are n - 1."""
    c, doc = letters(data, offsets)
    if not len(c):
        return
    letter, wide = c != BLANK, c.astype(np.uint64) + U64(1)
    h, inner = wide, np.ones(len(c), bool)
    for n in range(1, ORDERS + 1):
        if n > 1:
            h = h[:-1] * U64(0x9E3779B97F4A7C15) + wide[n - 1 :]
            # All between the first and the last are letters; one of two is, since blanks never meet.
            inner = inner[:-1] & letter[n - 2 : -1] if n > 2 else inner[:-1]
        good = np.flatnonzero(inner if n > 1 else letter)
        # A blank between two texts belongs to the earlier one; it opens the later one's first word all the same.
        owner = doc[good + 1] if n > 1 else doc[good]
        yield n, owner, (_spread(h[good]) & ~U64(7)) | U64(n - 1)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


@dataclass
class Model:
    """``rows``: the filter, a row of ceil(languages / 8) bytes per place. ``chance``: per language the share of n-grams
    of other languages that its bits take for its own."""

    languages: list[str]
    rows: np.ndarray
    chance: np.ndarray


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> lang, gram, n: counts summed over up to HELD entries before they leave the task."""
    held: dict[str, list[pa.Table]] = {}
    size = 0

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("gram").aggregate([("n", "sum")]).select(["gram", "n_sum"]).rename_columns(["gram", "n"])

    def emit():
        for lang, parts in held.items():
            for b in summed(parts).combine_chunks().to_batches(max_chunksize=100_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * b.num_rows, pa.string()), b.column(0), b.column(1)], ["lang", "gram", "n"])

    for b, data, off in text_blocks(batches):
        langs = b.column(0).to_pylist()
        names = sorted(set(langs))
        of = np.array([names.index(x) for x in langs])
        for _, doc, h in ngrams(data, off):
            for i, lang in enumerate(names):
                mine = h[of[doc] == i] if len(names) > 1 else h
                if len(mine):
                    vc = pa.array(mine.view(np.int64)).value_counts()
                    t = pa.table({"gram": vc.field("values"), "n": vc.field("counts")})
                    held.setdefault(lang, []).append(t)
                    size += t.num_rows
        if size > HELD:
            held = {lang: [summed(parts)] for lang, parts in held.items()}
            size = sum(p[0].num_rows for p in held.values())
            if size > HELD // 2:
                yield from emit()
                held, size = {}, 0
    yield from emit()


def gram_counts(docs: DataFrame, use: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """gram, lang, n over all rows for which ``use`` holds and text and language are given."""
    known = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return known.mapInArrow(_counts, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def _place(j: int, places: int) -> Column:
    return F.shiftrightunsigned("gram", 8 + 28 * j).bitwiseAND(F.lit(places - 1)).cast("int")


def train(docs: DataFrame, use: Column, least: float = 1e-5, share: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The filter of all languages in the rows of ``docs`` for which ``use`` holds.

    Rows without text or language teach nothing; repeated rows count each; texts are read whole. Other columns are not
    read. What comes to the driver is the list of languages, a sum per order and language, and the filter, which
    MOST_PLACES bounds. Without a training row there is no language, and every prediction is UNKNOWN.
    """
    counts = cut_lineage(gram_counts(docs, use, text_col, lang_col))
    order = F.col("gram").bitwiseAND(F.lit(7)).cast("int").alias("order")
    sums = counts.groupBy("lang", order).agg(F.sum("n").alias("total"))
    totals = sums.collect()
    heard = {}
    for r in totals:
        heard[r["lang"]] = heard.get(r["lang"], 0) + r["total"]
    languages = sorted(heard, key=lambda x: (-heard[x], x))  # the most frequent first: it wins ties
    if not languages:
        return Model([], np.zeros((2, 1), np.uint8), np.zeros(0))
    spark = docs.sparkSession
    known = spark.createDataFrame([(r["lang"], r["order"], float(r["total"]), languages.index(r["lang"])) for r in totals], "lang string, order int, total double, bit int")
    rate = counts.withColumn("order", order).join(F.broadcast(known), ["lang", "order"]).select("gram", "bit", (F.col("n") / F.col("total")).alias("rate"))
    top = rate.where(F.col("rate") >= least * share).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate")).alias("all"))
    mine = F.filter("all", lambda x: (x["rate"] >= least) & (x["rate"] >= share * F.col("top")))
    kept = cut_lineage(top.select("gram", F.transform(mine, lambda x: x["bit"]).alias("bits")).where(F.size("bits") > 0))
    places = min(MOST_PLACES, 1 << max(10, (PLACES * kept.count() - 1).bit_length()))
    width = -(-len(languages) // 8)
    spots = kept.select(F.explode(F.array(*[_place(j, places) for j in range(HASHES)])).alias("place"), "bits").select("place", F.explode("bits").alias("bit")).distinct()
    block = F.shiftright("place", ROWS.bit_length() - 1).alias("block")

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = np.zeros((ROWS, width), np.uint8)
        place, bit = table["place"].to_numpy() & (ROWS - 1), table["bit"].to_numpy()
        np.bitwise_or.at(rows, (place, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([rows.tobytes()], pa.binary())})

    rows = np.zeros((places, width), np.uint8)
    for r in spots.select(block, "place", "bit").groupBy("block").applyInArrow(pack, "block int, rows binary").collect():
        at = r["block"] * ROWS
        got = np.frombuffer(bytes(r["rows"]), np.uint8).reshape(ROWS, width)
        rows[at : at + ROWS] = got[: places - at]
    fill = np.array([((rows[:, i >> 3] >> (i & 7)) & 1).mean() for i in range(len(languages))])
    return Model(languages, rows, fill**HASHES)


#: The bits of every byte, the lowest first.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shares(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each text, corrected share of each text's n-grams per language)."""
    n, places = len(offsets) - 1, len(model.rows)
    total, hits = np.zeros(n), np.zeros((n, len(model.languages)))
    for _, doc, h in ngrams(data, offsets):
        at = [((h >> U64(8 + 28 * j)) & U64(places - 1)).view(np.int64) for j in range(HASHES)]
        for byte in range(model.rows.shape[1]):
            mask = model.rows[at[0], byte]
            for a in at[1:]:
                mask &= model.rows[a, byte]
            held = np.bincount(doc * 256 + mask, minlength=n * 256).reshape(n, 256)
            here = hits[:, 8 * byte : 8 * byte + 8]
            here += (held @ _BITS)[:, : here.shape[1]]
        total += held.sum(1)
    seen = np.maximum(total, 1)[:, None]
    return total, np.clip((hits / seen - model.chance) / np.maximum(1 - model.chance, 1e-9), 0, 1)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, and the columns ``keep`` (expressions of ``docs``).

    Texts are read whole; only the text is used. Null texts and texts without a letter are UNKNOWN with score 0, and so
    is every text if the model has no language. The score is the best language's share of the sum of the two best
    corrected shares (1: no other language has any; 0.5: two are level). Level languages go to the one with more
    training n-grams, and so do texts of which no language knows an n-gram, with score 0. Repeated rows are rated each;
    an empty table gives no rows. No shuffle; the filter is broadcast.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for b, data, off in text_blocks(batches):
            n = b.num_rows
            best, score = np.full(n, len(m.languages)), np.zeros(n)
            if m.languages:
                total, got = shares(m, data, off)
                first = got.argmax(1)
                top = got[np.arange(n), first]
                got[np.arange(n), first] = 0
                second = got.max(1)
                best = np.where(total > 0, first, best)
                score = np.where((total > 0) & (top > 0), top / np.maximum(top + second, 1e-300), 0.0)
            rest = [b.column(i) for i in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), *rest, pa.array(names[best], pa.string()), pa.array(score)], [b.schema.names[0], *b.schema.names[2:], "lang_pred", "score"])

    fields = [f for f in slim.schema.fields if f.name != "text"]
    return slim.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double")
