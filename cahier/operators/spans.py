"""Where a chunk stands on its page: all places of its text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Spans of a page that are looked for together; more go in further parts.
SPANS = 1024


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PageHashes:
    """A page's rolling hashes: of any span length, the hash at every place in one subtraction of running sums."""

    def __init__(self, text: str):
        self.text = text
        x = _points(text).astype(np.uint64) + np.uint64(1)
        self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(x), _BASE)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.powers[:-1], dtype=np.uint64)])

    def windows(self, n: int) -> np.ndarray:
        """A hash for each place, as if it stood at the end of the page."""
        return (self.sums[n:] - self.sums[:-n]) * self.powers[len(self.text) - n :: -1]

    def find(self, spans: list[str]) -> list[list[int]]:
        """Places (from 1) of each span, overlapping ones too; each hit is compared."""
        out: list[list[int]] = [[] for _ in spans]
        by_length: dict[int, dict[str, list[int]]] = {}
        for i, s in enumerate(spans):
            if s and len(s) <= len(self.text):
                by_length.setdefault(len(s), {}).setdefault(s, []).append(i)
        for n, same in by_length.items():
            each = list(same)
            wanted = np.array([((_points(s).astype(np.uint64) + np.uint64(1)) * self.powers[:n]).sum(dtype=np.uint64) for s in each], np.uint64) * self.powers[len(self.text) - n]
            at = self.windows(n)
            order = np.argsort(wanted)
            place = np.minimum(np.searchsorted(wanted, at, sorter=order), len(each) - 1)
            for j in np.flatnonzero(wanted[order[place]] == at):
                s = each[order[place[j]]]
                if self.text.startswith(s, int(j)):
                    for i in same[s]:
                        out[i].append(int(j) + 1)
        return out


def find_spans(asked: DataFrame) -> DataFrame:
    """page columns' keys and spans (key..., raw, spans: array<string>) + places: for each span all its places on the page,
    from 1 and overlapping ones too, in one pass over the page for all spans of one length."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name != "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [i for i, f in enumerate(b.schema) if f.name != "raw"]
            raw, spans = b.column(b.schema.get_field_index("raw")), b.column(b.schema.get_field_index("spans"))
            for i in range(b.num_rows):
                found = PageHashes(raw[i].as_py() or "").find(spans[i].as_py() or [])
                cols = [b.column(j).slice(i, 1) for j in at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([found], pa.list_(pa.list_(pa.int32())))], [*(b.schema.field(j).name for j in at), "places"])

    return asked.mapInArrow(run, f"{kinds}, places array<array<int>>")


def locate_span(requests: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, chunk_id, page_number, span_text, occurrences, places (from 1), first_at, error.

    ``requests``: doc_id, chunk_id. The span is the raw page between the chunk's offsets; ``places`` are all places on the
    page where it stands, overlapping ones too, and ``occurrences`` their number. Unknown documents, chunks and pages and
    spans that are not on the page (an empty span is nowhere) are named in ``error``. Requests are answered each, also the
    same one twice. A page is read once for up to SPANS different spans asked of it; requests meet pages by keys and
    offsets, and only the pages that are asked for are searched.
    """
    ids = pages.select(F.col("doc_id").alias("_doc")).distinct().withColumn("_known", F.lit(True))
    c = chunks.select("doc_id", "chunk_id", "page_number", "start_char", "end_char").withColumn("_chunk", F.lit(True))
    joined = requests.join(c, ["doc_id", "chunk_id"], "left")
    joined = joined.join(ids, joined["doc_id"] == ids["_doc"], "left").drop("_doc").withColumn("_p", F.coalesce(F.col("page_number").cast("string"), F.lit("")))
    spot = ["doc_id", "_p", "start_char", "end_char"]
    spots = joined.where("_chunk").select(*spot).distinct()
    part = F.pmod(F.xxhash64("start_char", "end_char"), F.greatest(F.lit(1), F.ceil(F.col("_n") / SPANS))).alias("_part")
    counted = spots.join(spots.groupBy("doc_id", "_p").agg(F.count("*").alias("_n")), ["doc_id", "_p"])
    grouped = counted.groupBy("doc_id", "_p", part).agg(F.collect_list(F.struct("start_char", "end_char")).alias("at"))
    p = pages.select(F.col("doc_id").alias("_d"), F.coalesce(F.col("page_number").cast("string"), F.lit("")).alias("_q"), F.col("text").alias("raw"))
    met = grouped.join(p, (grouped["doc_id"] == p["_d"]) & (grouped["_p"] == p["_q"]))
    text = F.transform("at", lambda s: F.when(s["start_char"] >= 0, F.substring(F.col("raw"), s["start_char"] + 1, s["end_char"] - s["start_char"])))
    found = find_spans(met.where("raw is not null").select("doc_id", "_p", "at", "raw", text.alias("spans")))
    each = found.select("doc_id", "_p", F.explode(F.arrays_zip("at", "spans", "places")).alias("x"))
    each = each.select("doc_id", "_p", F.col("x.at.start_char").alias("start_char"), F.col("x.at.end_char").alias("end_char"), F.col("x.spans").alias("span_text"), F.col("x.places").alias("places"), F.lit(True).alias("_page"))
    out = joined.join(each, spot, "left")
    count = F.when(F.col("_page"), F.size("places"))
    error = F.when(F.col("_known").isNull(), "unknown document").when(F.col("_chunk").isNull(), "unknown chunk").when(F.col("_page").isNull(), "unknown page").when(count == 0, "not found")
    return out.select("doc_id", "chunk_id", "page_number", "span_text", count.alias("occurrences"), "places", F.coalesce(F.get("places", F.lit(0)), F.when(F.col("_page"), F.lit(0))).alias("first_at"), error.alias("error"))
