"""Condensing chunks, and a document's chunks together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cahier.functions.text import strip

PROMPT = "Condense the following passage of a tender. Keep figures, materials and requirements. Passage: "
UNUSABLE = ("non pertinent", "erreur")


def summary_prompt(text: Column | str, head: str = PROMPT) -> Column:
    return strip(F.concat(F.lit(head), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def is_usable(summary: Column | str) -> Column:
    """Not null, not empty, and not one of the words that stand for nothing or for a failed call."""
    s = F.col(summary) if isinstance(summary, str) else summary
    return F.coalesce((s != "") & ~F.lower(strip(s)).isin(*UNUSABLE), F.lit(False))


def usable_summary(rows: DataFrame, rejected: bool = False) -> DataFrame:
    return rows.where(~is_usable("summary") if rejected else is_usable("summary"))


def summary_rows(rows: DataFrame) -> DataFrame:
    """The index: keys, stripped summary and offsets. The raw page stays in the table of pages."""
    return rows.select("doc_id", "doc_name", "chunk_id", "page_number", strip("summary").alias("summary"), "start_char", "end_char")


def global_text(summaries: DataFrame, key: str = "doc_id", order: str = "chunk_id", text: str = "summary", max_chars: int | None = None) -> DataFrame:
    """Per document all summaries in order, a line each; ``max_chars`` bounds what is handed on of huge documents."""
    joined = F.array_join(F.sort_array(F.collect_list(F.struct(order, text)))[text], "\n")
    return summaries.groupBy(key).agg((F.substring(joined, 1, max_chars) if max_chars else joined).alias("text"))
