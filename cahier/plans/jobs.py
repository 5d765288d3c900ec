"""The workloads: index files, ingest a corpus, answer a catalogue or single requests, save and read back."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cahier import schemas
from cahier.functions.text import clean_pages
from cahier.operators import answers as a
from cahier.operators import projects as p
from cahier.operators.chunks import MAX_CHARS, chunk_pages
from cahier.operators.ingest import dup_docs, new_docs, require_doc
from cahier.operators.nested import CELLS_PER_ROW, CHUNKS_PER_ROW, dense_answers, document_rows, own_answers, pack, pack_hits, question_vectors, sparse_answers, unfold
from cahier.operators.retrieval import BROADCAST_ROWS, TOP_K, SparseCatalog, adhoc_pairs, asked_topk, bounded, dense_chunks, dense_response_scores, doc_query_pairs, extract_answer, hit_rows, query_vectors, response_scores, topk_chunks
from cahier.operators.calls import Generator, generate
from cahier.operators.seams import FAILED, extract, extract_summary
from cahier.operators.summaries import global_text, summary_prompt, summary_rows, usable_summary
from cahier.session import cut_lineage
from cahier.sources.files import classify, decode_text, extract_guard, keep_original

#: Chunks times questions of its own that a document may have to answer in its row.
REQUEST_CELLS = 200_000


def first_files(raw: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the files to index, the rejected: doc_id, doc_name, error). Files of documents in ``index`` are rejected, and of
    several files with one id all but the first by name (of equal names, by digest).

    Ids and names alone decide, and come back to the files by broadcast below a checked number; the bytes then stay where
    they are, but for files that come twice under one id and name.
    """
    names = raw.select("doc_id", "doc_name")
    each = new_docs(names, index)
    first = each.groupBy("doc_id").agg(F.min(F.coalesce("doc_name", F.lit(""))).alias("_name"))
    at = F.coalesce("doc_name", F.lit("")).alias("_name")
    picked = cut_lineage(each.select("doc_id", at).join(first, ["doc_id", "_name"]).groupBy("doc_id", "_name").agg(F.count("*").alias("_n")))
    later = each.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_name"))).where("_n > 1").drop("_n")
    rejected = dup_docs(names, index).unionByName(later.withColumn("error", F.lit("document given twice")))
    named = raw.select("doc_id", "doc_name", "content", at)
    fresh = named.join(bounded(picked.where("_n = 1")), ["doc_id", "_name"], "left_semi")
    twice = picked.where("_n > 1")
    if not twice.isEmpty():
        again = named.join(bounded(twice), ["doc_id", "_name"], "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("doc_name", "content", "_name"), F.sha2("content", 256)).alias("f"))
        fresh = fresh.unionByName(again.select("doc_id", "f.*").select(*fresh.columns))
    return fresh.select("doc_id", "doc_name", "content"), rejected


def index_files(raw: DataFrame, index: DataFrame, extractor: Callable[[str, bytes], Iterable[dict]] | None = None, generator: Generator | None = None, originals: str | None = None, max_chars: int = MAX_CHARS, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """raw files (doc_id, doc_name, content) -> (the index of the new ones, the rejected: doc_id, doc_name, error).

    Text is decoded, everything else is the extractor's; a file that cannot be read becomes a page that says so. The bytes
    of the new files are kept below ``originals``, and are read from there again if that is given.
    """
    fresh, rejected = first_files(raw, index)
    if originals is not None:
        keep_original(fresh, originals)
        fresh = raw.sparkSession.read.parquet(originals).join(bounded(fresh.select("doc_id")), "doc_id", "left_semi").select("doc_id", "doc_name", "content")
    kinds = classify(fresh)
    other = kinds.where("kind <> 'text'")
    if extractor is None:
        read = other.select("doc_id", "doc_name", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("no extractor for "), "kind").alias("error"))
    else:
        read = extract(other, extractor)
    pages = extract_guard(decode_text(kinds.where("kind = 'text'"), divert=True).unionByName(read))
    return ingest(pages, generator, max_chars, store), rejected


def ingest(pages: DataFrame, generator: Generator | None = None, max_chars: int = MAX_CHARS, store: str | None = None) -> DataFrame:
    """pages -> the index of summaries. Chunks are cut from the raw text and cleaned afterwards; the shuffle by
    document numbers them. ``store``: where a generator's results are kept, so that a rerun does not ask again."""
    chunks = clean_pages(chunk_pages(pages, max_chars))
    if generator is None:
        return summary_rows(usable_summary(extract_summary(chunks)))
    asked = cut_lineage(chunks).withColumn("_p", summary_prompt("text"))
    return summary_rows(usable_summary(generate(asked, "_p", generator, "summary", FAILED, store=store)))


def answer_catalog(pages: DataFrame, summaries: DataFrame, catalog: DataFrame, generator: Generator | None = None, k: int = TOP_K, abstain: str = "substring", encoder: Generator | None = None, store: str | None = None) -> DataFrame:
    """doc_id, question, best_answer, alternatives for every indexed document and every question. Chunks are ranked and
    answers scored by the encoder's vectors, or by term frequencies without one. The index is kept for the job's length,
    a generator's results in ``store``."""
    _, packed, flat = _answered(pages, summaries, catalog, generator, k, abstain, encoder, store)
    if packed is None:
        return flat
    made = unfold(packed)
    return made if flat is None else made.unionByName(flat.select(*made.columns))


def answer_documents(pages: DataFrame, summaries: DataFrame, catalog: DataFrame, generator: Generator | None = None, k: int = TOP_K, abstain: str = "substring", encoder: Generator | None = None, store: str | None = None) -> DataFrame:
    """The same as a row per document, to be kept by ``answers.index_results``: its chunks and pages once, and ``results``,
    which refer to them by place (``nested.RESULT``)."""
    summaries, packed, flat = _answered(pages, summaries, catalog, generator, k, abstain, encoder, store)
    if flat is None:
        return packed
    made = pack_hits(flat, document_rows(summaries, pages, abstain))
    return made if packed is None else packed.unionByName(made.select(*packed.columns))


def _answered(pages: DataFrame, summaries: DataFrame, catalog: DataFrame, generator: Generator | None, k: int, abstain: str, encoder: Generator | None, store: str | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(the index, rows of documents that answer in their rows, results of those that go by hits)."""
    summaries = cut_lineage(summaries)
    if generator is None:
        asked = query_vectors(catalog)
        if asked.count() <= BROADCAST_ROWS and 0 < catalog.count() <= BROADCAST_ROWS:
            return (summaries, *_answers_in_rows(pages, summaries, catalog, asked, k, abstain, encoder))
    return summaries, None, _answers_by_hits(pages, summaries, catalog, generator, k, abstain, encoder, store)


def _answers_in_rows(pages: DataFrame, summaries: DataFrame, catalog: DataFrame, asked: DataFrame, k: int, abstain: str, encoder: Generator | None) -> tuple[DataFrame, DataFrame | None]:
    """Each document answers every question in its own row; documents of very many chunks go by their hits."""
    cat = SparseCatalog.of(catalog, asked)
    most = max(1, min(CHUNKS_PER_ROW, CELLS_PER_ROW // len(cat.names)))
    long = summaries.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("doc_id")
    some = not long.isEmpty()
    short = summaries.join(long, "doc_id", "left_anti") if some else summaries
    docs = document_rows(short, pages.join(long, "doc_id", "left_anti") if some else pages, abstain)
    if encoder is None:
        docs = sparse_answers(docs, cat, k)
    else:
        docs = dense_answers(docs, cat, question_vectors(catalog, cat, encoder), encoder, k)
    place = summaries.sparkSession.createDataFrame([(i, n) for i, n in enumerate(cat.names.to_pylist())], "_q int, question string")
    made = pack(docs, place.join(catalog.select("question"), "question"))
    if not some:
        return made, None
    return made, _answers_by_hits(pages.join(long, "doc_id", "left_semi"), summaries.join(long, "doc_id", "left_semi"), catalog, None, k, abstain, encoder, None)


def _answers_by_hits(pages: DataFrame, summaries: DataFrame, catalog: DataFrame, generator: Generator | None, k: int, abstain: str, encoder: Generator | None, store: str | None) -> DataFrame:
    pairs = doc_query_pairs(summaries, catalog)
    hits = topk_chunks(summaries, catalog, k) if encoder is None else dense_chunks(summaries, catalog, encoder, k)
    return _answers(pairs, hits, pages, summaries, catalog, generator, abstain, encoder, store)


def answer_requests(requests: DataFrame, pages: DataFrame, summaries: DataFrame, generator: Generator | None = None, k: int = TOP_K, abstain: str = "substring", encoder: Generator | None = None, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results as of ``answer_catalog``, the rejected with an error) for single questions on single documents
    (doc_id, question): a question is its own retrieval text, and only the documents asked about are worked on."""
    summaries = cut_lineage(summaries)
    known, unknown = require_doc(requests.select("doc_id", "question").distinct(), summaries)
    pairs = cut_lineage(adhoc_pairs(known))
    if generator is None and encoder is None:
        return _requests_in_rows(pages, summaries, pairs, k, abstain), unknown
    return _requests_by_hits(pages, summaries, pairs, generator, k, abstain, encoder, store), unknown


def _requests_in_rows(pages: DataFrame, summaries: DataFrame, pairs: DataFrame, k: int, abstain: str) -> DataFrame:
    """Each document answers its own questions in its row; those with very many chunks or questions go by hits."""
    lists = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("question")))["question"].alias("_q"))
    chunks = summaries.groupBy("doc_id").agg(F.count("*").alias("_n"))
    cells = F.col("_n") * F.size("_q")
    long = cut_lineage(lists.join(chunks, "doc_id").where((F.col("_n") > CHUNKS_PER_ROW) | (cells > REQUEST_CELLS)).select("doc_id"))
    some = not long.isEmpty()
    short = lists.join(long, "doc_id", "left_anti") if some else lists
    ids = bounded(short.select("doc_id"))
    docs = document_rows(summaries.join(ids, "doc_id", "left_semi"), pages.join(ids, "doc_id", "left_semi"), abstain)
    made = unfold(own_answers(docs.join(short, "doc_id"), k))
    if not some:
        return made
    ids = bounded(long)
    mine = [x.join(ids, "doc_id", "left_semi") for x in (pages, summaries, pairs)]
    return made.unionByName(_requests_by_hits(*mine, None, k, abstain, None, None).select(*made.columns))


def _requests_by_hits(pages: DataFrame, summaries: DataFrame, pairs: DataFrame, generator: Generator | None, k: int, abstain: str, encoder: Generator | None, store: str | None) -> DataFrame:
    hits = asked_topk(summaries, pairs, k, encoder)
    return _answers(pairs, hits, pages, summaries, pairs.select("question", "query").distinct(), generator, abstain, encoder, store)


def _answers(pairs: DataFrame, hits: DataFrame, pages: DataFrame, summaries: DataFrame, catalog: DataFrame, generator: Generator | None, abstain: str, encoder: Generator | None, store: str | None) -> DataFrame:
    hits = hits.drop("score")
    if generator is None:
        made = extract_answer(hits, summaries, catalog)
    else:
        hits = hit_rows(hits, summaries).join(bounded(catalog.select("question", "query")), "question")
        made = generate(hits.withColumn("_p", a.qa_prompt(F.col("summary"), F.col("query"))), "_p", generator, "response", store=store)
    made = cut_lineage(a.abstain_filter(made, abstain))
    scored = response_scores(made, catalog) if encoder is None else dense_response_scores(made, catalog, encoder)
    return a.nest_results(pairs, cut_lineage(a.score_guard(scored)), pages)


@dataclass
class Saved:
    projects: DataFrame
    queries: DataFrame
    answers: DataFrame
    rejected: DataFrame


def save(records: DataFrame, projects: DataFrame, summaries: DataFrame, first_query: int = 0, first_answer: int = 0, strict: bool = False, generator: Generator | None = None, store: str | None = None) -> Saved:
    """Rows to append to the three tables. ``records``: doc_id, name, uploaded_at, results (JSON).

    Incomplete and malformed records are rejected with an error; of a project that exists nothing is saved. The
    project's summary is the summary of all its chunks' summaries, the generator's if one is given; null without any.
    """
    checked = p.parse_results(p.required_fields(records, "doc_id", "name", "results"))
    checked = cut_lineage(checked.withColumn("error", F.when(F.col("error").isNull() & F.col("malformed"), "malformed results").otherwise(F.col("error"))))
    fresh = p.save_project(checked.where("error is null").withColumn("id", F.col("doc_id")), projects)
    text = global_text(summaries).select("doc_id", "text").withColumn("chunk_id", F.lit(0))
    made = extract_summary(text) if generator is None else generate(text.withColumn("_p", summary_prompt("text")), "_p", generator, "summary", FAILED, store=store)
    condensed = made.select(F.col("doc_id").alias("id"), "summary")
    rows = fresh.join(condensed, "id", "left").select("id", "name", "uploaded_at", "summary", F.lit(None).cast("string").alias("csv"))
    queries = cut_lineage(p.surrogate_ids(p.flatten_queries(fresh), "project_id", ["query_ord"], first_query))
    answers = p.surrogate_ids(p.flatten_answers(queries, strict), "query_id", ["pos"], first_answer)
    return Saved(rows, queries.select("id", "project_id", "question", "best_answer"), answers.select("id", "query_id", "response", "score", "summary", "doc_name", "page_number", "chunk_id", "excerpt"), checked.where("error is not null"))


@dataclass
class Added:
    queries: DataFrame
    answers: DataFrame
    rejected: DataFrame


def add_questions(requests: DataFrame, projects: DataFrame, queries: DataFrame, answers: DataFrame, order: str, strict: bool = False) -> Added:
    """Rows to append for questions that are added to saved projects. ``requests``: project_id, question, result (JSON of
    one result) and ``order``, a column that tells which comes first.

    Requests with a field that is null or empty, with a result that is no JSON, or for an unknown project are rejected
    with an error. Questions are numbered on after the largest id in ``queries``, by project and then by ``order``, their
    answers after that in ``answers``; equal questions are not merged.
    """
    checked = p.required_fields(requests, "project_id", "question", "result").withColumn("parsed", F.from_json("result", schemas.SAVED_RESULT[:-1] + ",_corrupt_record:string>"))
    known = projects.select(F.col("id").alias("project_id"), F.lit(True).alias("_known")).distinct()
    checked = checked.join(known, "project_id", "left")
    error = F.coalesce("error", F.when(F.col("parsed").isNull() | F.col("parsed._corrupt_record").isNotNull(), "malformed result"), F.when(F.col("_known").isNull(), "unknown project"))
    checked = cut_lineage(checked.withColumn("error", error).drop("_known"))
    each = checked.where("error is null").select(order, "project_id", "question", F.col("parsed.best_answer").alias("best_answer"), F.col("parsed.alternatives").alias("alternatives"))

    def largest(table: DataFrame) -> int:
        return table.agg(F.max("id")).first()[0] or 0

    numbered = cut_lineage(p.surrogate_ids(each, "project_id", [order], largest(queries)))
    rows = p.surrogate_ids(p.flatten_answers(numbered, strict), "query_id", ["pos"], largest(answers))
    return Added(numbered.drop("alternatives"), rows.drop("pos"), checked.where("error is not null").drop("parsed"))
