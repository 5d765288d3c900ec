"""Answers to hits: prompts, filters, scores, the best answer and the alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cahier.functions.text import is_blank
from cahier.sources.buckets import replace_documents

NOT_FOUND = "Non trouvé"
PROMPT = "Excerpt of a tender:\n%s\n\nAnswer from this excerpt only, in a few words, or with RAS if it does not say.\nQuestion: %s"


def qa_prompt(summary: Column, query: Column, template: str = PROMPT) -> Column:
    return F.format_string(template, summary, query)


def answered(c: Column, abstain: str = "substring") -> Column:
    """Not null, not empty, not an abstention: any answer that holds 'ras' ('substring'), or only that word ('exact')."""
    low = F.lower(c)
    none = low.contains("ras") if abstain == "substring" else F.trim(low) == "ras"
    return F.coalesce((c != "") & ~none, F.lit(False))


def abstain_filter(rows: DataFrame, abstain: str = "substring") -> DataFrame:
    return rows.where(answered(F.col("response"), abstain))


def score_guard(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("score").isNotNull() & ~F.isnan("score"))


def best_answer(pairs: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "question")) -> DataFrame:
    """keys, best_answer: the response with the largest unrounded score above -1, the first rank on a tie; a pair
    without answers gets NOT_FOUND."""
    best = rows.where("score > -1").groupBy(*keys).agg(F.max_by("response", F.struct("score", -F.col("rank"))).alias("best_answer"))
    return pairs.select(*keys).join(best.hint("merge"), list(keys), "left").withColumn("best_answer", F.coalesce("best_answer", F.lit(NOT_FOUND)))


def drop_blank_excerpt(rows: DataFrame, raw: str = "raw_text") -> DataFrame:
    return rows.where(~is_blank(raw))


def clamp_span(rows: DataFrame, raw: str = "raw_text") -> DataFrame:
    return rows.withColumn("start_char", F.least("start_char", F.length(raw))).withColumn("end_char", F.least("end_char", F.length(raw)))


def with_raw_page(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows + raw_text. Only pages of documents that rows are left for meet the join; unnumbered pages match each other."""
    raw = pages.select(F.col("doc_id").alias("_d"), F.col("page_number").alias("_p"), F.col("text").alias("raw_text"))
    return rows.join(raw, (rows["doc_id"] == raw["_d"]) & rows["page_number"].eqNullSafe(raw["_p"]), "left").drop("_d", "_p")


def page_key(page_number: str = "page_number") -> Column:
    """A page's name within its document; unnumbered pages have the empty one."""
    return F.coalesce(F.col(page_number).cast("string"), F.lit(""))


def with_page_facts(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows + _length, _blank of their pages: what ranking needs to know of a page. The page itself stays where it is.
    The rows are many more than Spark takes them for and must not be broadcast, hence the hint."""
    facts = pages.select(F.col("doc_id").alias("_d"), page_key().alias("_p"), F.length("text").alias("_length"), is_blank("text").alias("_blank"))
    return rows.join(facts.hint("merge"), (rows["doc_id"] == facts["_d"]) & (page_key() == facts["_p"]), "left").drop("_d", "_p")


FIELDS = ("response", "summary", "score", "doc_name", "page_number", "chunk_id", "excerpt", "start_char", "end_char")


def alternatives(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> Column:
    """An aggregate: the answers by score, highest first, retrieval order on ties, scores rounded to 3 places last."""
    packed = F.struct((-F.col("score")).alias("by"), F.col("rank").alias("then"), F.struct(*[F.round("score", 3).alias("score") if f == "score" else F.col(f) for f in fields]).alias("a"))
    return F.sort_array(F.collect_list(packed))["a"]


def with_excerpts(results: DataFrame, shown: DataFrame, pages: DataFrame) -> DataFrame:
    """``results`` whose alternatives get their pages as excerpts. Of the pages only those in ``shown`` (doc_id,
    page_number) are read on; each is shuffled once, to the list of its document's pages that are shown."""
    used = shown.select(F.col("doc_id").alias("_d"), page_key().alias("_p")).distinct()
    each = pages.select("doc_id", page_key().alias("key"), "text")
    kept = each.join(used, (each["doc_id"] == used["_d"]) & (each["key"] == used["_p"]), "left_semi")
    texts = kept.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("key", "text"))).alias("_pages"))
    joined = results.join(texts, results["doc_id"] == texts["_doc"], "left")

    def full(x: Column) -> Column:
        key = F.coalesce(x["page_number"].cast("string"), F.lit(""))
        excerpt = F.get("_pages", (F.array_position(F.col("_pages.key"), key) - 1).cast("int"))["text"]
        return F.struct(*[excerpt.alias("excerpt") if f == "excerpt" else x[f].alias(f) for f in FIELDS])

    return joined.withColumn("alternatives", F.transform("alternatives", full)).drop("_doc", "_pages")


def nest_results(pairs: DataFrame, rows: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, question, best_answer, alternatives. ``rows``: scored answers with the hit's columns.

    Answers are filtered, cut to their pages' lengths and collected by keys and offsets; the raw pages join last, once per
    page and document.
    """
    keys = ["doc_id", "question"]
    facts = with_page_facts(rows, pages)
    shown = facts.where(~F.coalesce("_blank", F.lit(True))).withColumn("start_char", F.least("start_char", "_length")).withColumn("end_char", F.least("end_char", "_length"))
    lists = shown.groupBy(*keys).agg(alternatives(shown, tuple(f for f in FIELDS if f != "excerpt")).alias("alternatives"))
    nested = best_answer(pairs, rows).join(lists.hint("merge"), keys, "left").withColumn("alternatives", F.coalesce("alternatives", F.array().cast(lists.schema["alternatives"].dataType)))
    return with_excerpts(nested, shown, pages)


def results_json(results: DataFrame) -> DataFrame:
    """doc_id, results: the JSON object label -> result."""
    kind = results.schema["alternatives"].dataType.simpleString()
    pairs = F.collect_list(F.struct(F.col("question").alias("key"), F.struct("question", "best_answer", "alternatives").alias("value")))
    typed = F.sort_array(pairs).cast(f"array<struct<key:string,value:struct<question:string,best_answer:string,alternatives:{kind}>>>")
    return results.groupBy("doc_id").agg(F.to_json(F.map_from_entries(typed)).alias("results"))


def index_results(documents: DataFrame, path: str) -> None:
    """The latest results of each document (rows of ``jobs.answer_documents``), in a table of hash buckets; a rerun replaces
    those of its own documents only. Chunks and pages are kept once per document; ``nested.unfold`` shows the results."""
    replace_documents(documents, path)
