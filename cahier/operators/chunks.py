"""Sentence-aligned chunks of pages, with offsets into the raw page and ids that run through a document."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cahier.session import small_batches

MAX_CHARS = 3000
CHUNK = "array<struct<text:string,start_char:int,end_char:int>>"
_BREAK = re.compile(r"(?<=[.?!])\s+")


def _groups(lengths: list[int], limit: int) -> list[int]:
    """Sizes of the groups of sentences: each takes on sentences while its length so far, with a blank for every
    sentence, plus the next stays below the limit. A first sentence that does not fit leaves an empty group before it."""
    sizes, used = [0], 0
    for n in lengths:
        if used + n < limit:
            sizes[-1] += 1
            used += n + 1
        else:
            sizes.append(1)
            used = n + 1
    return sizes


def cut_page(page: str, limit: int, keep_empty_lead: bool = True) -> list[tuple[str, int, int]]:
    """(text, start, end) of each chunk. The search for a chunk's first sentence starts where the chunk before ended;
    the end counts the stripped chunk, in which each sentence break is one blank. A blank last chunk is dropped."""
    parts, chunks, taken, end = _BREAK.split(page), [], 0, 0
    sizes = _groups([len(p) for p in parts], limit)
    for i, size in enumerate(sizes):
        text = " ".join(parts[taken : taken + size]).strip()
        start = page.find(parts[taken], end) if size else 0
        taken, end = taken + size, start + len(text)
        if text or (i < len(sizes) - 1 and (size or keep_empty_lead)):
            chunks.append((text, start, end))
    return chunks


def pack(text: Column, max_chars: int = MAX_CHARS, keep_empty_lead: bool = True) -> Column:
    """The chunks of a page as an array; a fold over the page's sentences, so an Arrow-batched helper."""

    @F.arrow_udf(CHUNK)
    def run(pages: pa.Array) -> pa.Array:
        cut = [cut_page(p.as_py(), max_chars, keep_empty_lead) for p in pages]
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
        text, start, end = zip(*(x for c in cut for x in c)) if ends[-1] else ((), (), ())
        chunks = pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["text", "start_char", "end_char"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)

    return run(text)


def chunk_pages(pages: DataFrame, max_chars: int = MAX_CHARS, keep_empty_lead: bool = True) -> DataFrame:
    """doc_id, doc_name, page_number, chunk_id, text, start_char, end_char.

    Missing names are 'unknown', missing texts ''. Ids run from 0 through a document in the order of its pages
    (unnumbered first): pages are numbered on by the counts of those before, one exchange on rows that still hold
    their chunks as arrays. The raw page is not carried; join it by (doc_id, page_number).
    """
    small_batches(pages.sparkSession)
    packed = pages.select("doc_id", F.coalesce("doc_name", F.lit("unknown")).alias("doc_name"), "page_number", pack(F.coalesce("text", F.lit("")), max_chars, keep_empty_lead).alias("chunks"))
    before = Window.partitionBy("doc_id").orderBy(F.col("page_number").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    numbered = packed.withColumn("base", F.coalesce(F.sum(F.size("chunks")).over(before), F.lit(0)))
    each = numbered.select("doc_id", "doc_name", "page_number", "base", F.posexplode("chunks").alias("pos", "c"))
    return each.select("doc_id", "doc_name", "page_number", (F.col("base") + F.col("pos")).cast("int").alias("chunk_id"), "c.text", "c.start_char", "c.end_char")


def segment_count(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("doc_id").agg(F.count("*").alias("segments"))
