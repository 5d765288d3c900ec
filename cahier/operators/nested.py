"""Answers where the documents lie: every question of a catalogue on a document's own summaries, in one row.

A document with its summaries is one row; the hits, the sentences that answer and their scores are worked out inside it
and leave as places (chunk, sentence), so that no row per (document, question, hit) is shuffled or stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cahier.functions.text import is_blank, sentences, tokens
from cahier.functions.vectors import usable
from cahier.operators.answers import FIELDS, NOT_FOUND, answered, page_key
from cahier.operators.calls import Generator
from cahier.operators.retrieval import SCORES, SparseCatalog
from cahier.operators.seams import encode, in_blocks
from cahier.session import small_batches

#: Per question a list of the document's answers, best first: places of chunk and sentence, and the score.
PLACES = "array<array<struct<c:int,s:int,score:double>>>"
#: Documents with more chunks than this are no single row.
CHUNKS_PER_ROW = 1024
#: Scores of a document's chunks that a task holds at once; documents with more are no single row.
CELLS_PER_ROW = 4_000_000


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(lengths of the lists, their items)."""
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64), column.flatten()


def top(owner: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places (questions, m) of each owner's k best rows by ``scores`` (questions, rows) to 9 places, the earlier on a
    tie; the owner of each of the m). ``owner`` ascends."""
    order = np.lexsort((-np.round(scores, 9), np.broadcast_to(owner, scores.shape)), axis=1)
    held = np.flatnonzero(np.arange(len(owner)) - np.searchsorted(owner, owner) < k)
    return order[:, held], owner[held]


def best_sentences(shared: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among all sentences, tokens shared) of each chunk's sentence that shares most, the first on a tie, from
    ``shared`` (questions, sentences); chunk i has the sentences from ``first[i]``."""
    n = shared.shape[1]
    key = np.maximum.reduceat(shared * np.int64(n) + (n - 1 - np.arange(n)), first, axis=1)
    return n - 1 - key % n, key // n


def places(owner: np.ndarray, n_owners: int, first: np.ndarray, usable: np.ndarray, ranked: np.ndarray, shared: np.ndarray, score: np.ndarray, k: int, digits: int | None = None) -> pa.ListArray:
    """PLACES of each owner from ``ranked`` (questions, chunks), ``shared`` and ``score`` (questions, sentences); ``usable``
    tells of each sentence whether it may answer. Answers go by score (to ``digits``, if given), then by rank."""
    asked = len(ranked)
    hits, of = top(owner, ranked, k)
    at, count = best_sentences(shared, first)
    q = np.arange(asked)[:, None]
    sentence, count = at[q, hits], count[q, hits]
    value = score[q, sentence]
    good = (count > 0) & usable[sentence] & ~np.isnan(value) & (ranked[q, hits] > -np.inf)
    by = np.where(good, -(value if digits is None else np.round(value, digits)), np.inf)
    order = np.lexsort((by, np.broadcast_to(of, by.shape)), axis=1)
    hits, sentence, value, good = (x[q, order] for x in (hits, sentence, value, good))
    row, col = np.nonzero(good)
    cell = of[col] * asked + row
    order = np.argsort(cell, kind="stable")
    row, col = row[order], col[order]
    chunk, sentence = hits[row, col], sentence[row, col]
    begin = np.searchsorted(owner, owner)
    items = pa.StructArray.from_arrays([pa.array((chunk - begin[chunk]).astype(np.int32)), pa.array((sentence - first[chunk]).astype(np.int32)), pa.array(value[row, col])], ["c", "s", "score"])
    inner = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=n_owners * asked))])
    return pa.ListArray.from_arrays(pa.array(np.arange(n_owners + 1) * asked, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), items))


def by_block(function, most: int):
    """``function`` of Arrow columns, of which the first holds a list of lists per row, on runs of rows with at most ``most``
    inner lists."""

    def run(first: pa.Array, *others: pa.Array) -> pa.Array:
        outer, inner = flat(first)
        ends = np.concatenate([[0], np.cumsum(flat(inner)[0])])[np.concatenate([[0], np.cumsum(outer)])]
        return pa.concat_arrays([function(*(x.slice(i, z - i) for x in (first, *others))) for i, z in in_blocks(np.diff(ends), most)])

    return run


def cut(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.ListArray]:
    """(document of each chunk, first sentence of each chunk, tokens of each sentence, tokens of each chunk)."""
    chunks, of_chunk = flat(words)
    per_chunk, of_sentence = flat(of_chunk)
    per_sentence, all_tokens = flat(of_sentence)
    ends = np.concatenate([[0], np.cumsum(per_sentence)])
    begin = np.concatenate([[0], np.cumsum(per_chunk)])
    return np.repeat(np.arange(len(words)), chunks), begin[:-1], of_sentence, pa.ListArray.from_arrays(pa.array(ends[begin], pa.int32()), all_tokens)


def flags(may: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(may.flatten().flatten(), False).to_numpy(zero_copy_only=False)).astype(bool)


def sparse_places(cat: SparseCatalog, k: int):
    """An Arrow function of documents (tokens per chunk and sentence, which sentences may answer) to PLACES."""

    def block(words: pa.Array, may: pa.Array) -> pa.ListArray:
        owner, first, of_sentence, of_chunk = cut(words)
        score, shared = cat.scores_and_shared(of_sentence)
        return places(owner, len(words), first, flags(may), cat.scores(of_chunk).T, shared.T, score.T, k)

    run = by_block(block, max(1, SCORES // 8 // max(1, len(cat.names))))

    @F.arrow_udf(PLACES)
    def made(words: pa.Array, may: pa.Array) -> pa.Array:
        return run(words, may)

    return made


def dense_places(cat: SparseCatalog, vectors: np.ndarray, encoder: Generator, k: int):
    """As ``sparse_places``, of (summaries, sentences, tokens, which sentences may answer)."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def cosines(texts: pa.Array) -> np.ndarray:
        """(texts, questions); -inf without a usable vector."""
        if not len(texts):
            return np.zeros((0, len(unit)))
        got = [v for s in encoder(iter([texts.to_pandas()])) for v in s]
        good = np.array([v is not None and len(v) == unit.shape[1] for v in got])
        m = np.zeros((len(got), unit.shape[1]))
        if good.any():
            m[good] = np.array([v for v, g in zip(got, good) if g], dtype=np.float32)
        good &= np.isfinite(m).all(1)
        m = np.where(good[:, None], m, 0)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return np.where(good[:, None], m @ unit.T, -np.inf)

    def block(words: pa.Array, sentences_: pa.Array, may: pa.Array, summaries: pa.Array) -> pa.ListArray:
        owner, first, of_sentence, _ = cut(words)
        score = cosines(sentences_.flatten().flatten())
        _, shared = cat.scores_and_shared(of_sentence)
        return places(owner, len(words), first, flags(may), cosines(summaries.flatten()).T, shared.T, np.where(score > -np.inf, score, np.nan).T, k, 12)

    run = by_block(block, max(1, SCORES // 8 // max(1, len(cat.names))))

    @F.arrow_udf(PLACES)
    def made(summaries: pa.Array, sentences_: pa.Array, words: pa.Array, may: pa.Array) -> pa.Array:
        return run(words, sentences_, may, summaries)

    return made


def summary_sentences(chunk: Column) -> Column:
    return F.coalesce(sentences(chunk["summary"]), F.array(F.lit("")))


def document_rows(summaries: DataFrame, pages: DataFrame, abstain: str) -> DataFrame:
    """doc_id, _c (the chunks by id), _s (sentences of each), _may (which of these may answer), _pages (key, text of the
    pages that are not blank). Summaries and pages are shuffled once, together."""
    small_batches(summaries.sparkSession)
    kept = [c for c in ("chunk_id", "doc_name", "page_number", "summary", "start_char", "end_char") if c in summaries.columns]
    c, p = F.struct(*kept).alias("c"), F.struct(page_key().alias("key"), "text").alias("p")
    shown = pages.where(~is_blank("text")).select("doc_id", p)
    both = summaries.select("doc_id", c).unionByName(shown, allowMissingColumns=True)
    docs = both.groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("_c"), F.sort_array(F.collect_list("p")).alias("_pages")).where(F.size("_c") > 0)
    docs = docs.withColumn("_s", F.transform("_c", summary_sentences))
    return docs.withColumn("_may", F.transform("_s", lambda s: F.transform(s, lambda x: answered(x, abstain))))


def sparse_answers(docs: DataFrame, cat: SparseCatalog, k: int) -> DataFrame:
    """``docs`` (of ``document_rows``) + _a: the places of their answers by term frequencies, question by question."""
    words = F.transform("_s", lambda s: F.transform(s, tokens))
    return docs.withColumn("_a", sparse_places(cat, k)(words, F.col("_may")))


def dense_answers(docs: DataFrame, cat: SparseCatalog, vectors: np.ndarray, encoder: Generator, k: int) -> DataFrame:
    """As ``sparse_answers``: chunks ranked and answers scored by the encoder's vectors, ``vectors`` of the questions in the
    order of ``cat``. Each summary and each sentence is encoded once."""
    words = F.transform("_s", lambda s: F.transform(s, tokens))
    return docs.withColumn("_a", dense_places(cat, vectors, encoder, k)(F.transform("_c", lambda c: c["summary"]), F.col("_s"), words, F.col("_may")))


def own_places(k: int):
    """As ``sparse_places``, of documents that have questions of their own (tokens of each)."""

    def document(words: pa.Array, may: pa.Array, asked: pa.Array) -> pa.ListArray:
        owner, first, of_sentence, of_chunk = cut(words)
        cat = SparseCatalog.of_tokens(asked.flatten())
        score, shared = cat.scores_and_shared(of_sentence)
        return places(owner, 1, first, flags(may), cat.scores(of_chunk).T, shared.T, score.T, k)

    @F.arrow_udf(PLACES)
    def made(words: pa.Array, may: pa.Array, asked: pa.Array) -> pa.Array:
        return pa.concat_arrays([document(*(x.slice(i, 1) for x in (words, may, asked))) for i in range(len(words))])

    return made


def own_answers(docs: DataFrame, k: int) -> DataFrame:
    """As ``pack`` of ``docs`` with _q, the different questions of each document, by term frequencies."""
    tokens_ = F.transform("_s", lambda s: F.transform(s, tokens))
    made = docs.withColumn("_a", own_places(k)(tokens_, F.col("_may"), F.transform("_q", tokens)))
    results = F.transform("_q", lambda q, i: packed_result(q, F.get("_a", i)))
    return made.select("doc_id", "_c", "_pages", results.alias("results"))


def question_vectors(catalog: DataFrame, cat: SparseCatalog, encoder: Generator) -> np.ndarray:
    """The encoder's vectors of the retrieval texts, in the order of ``cat``; NaN where a question has none."""
    asked = encode(catalog.select("question", "query"), "query", encoder, "_v").where(usable("_v")).select("question", "_v").dropDuplicates(["question"])
    at = {r["question"]: r["_v"] for r in asked.collect()}
    width = max(map(len, at.values()), default=1)
    return np.array([at[n] if len(at.get(n, ())) == width else [np.nan] * width for n in cat.names.to_pylist()], float)


def packed_result(question: Column, at: Column) -> Column:
    """One of ``results`` that states nothing but places."""
    none = F.lit(None).cast("string")
    alternatives = F.transform(at, lambda p: F.struct(p["c"].alias("c"), p["s"].alias("s"), p["score"].alias("score"), none.alias("response")))
    return F.struct(question.alias("question"), none.alias("best_answer"), alternatives.alias("alternatives"))


def pack(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """doc_id, _c, _pages and ``results`` of ``docs`` with _a: of each question the alternatives by their places, and texts
    (best_answer, response) only where they are not what lies there. ``questions``: _q (place in _a), question."""
    listed = questions.agg(F.sort_array(F.collect_list(F.struct("_q", "question"))).alias("_asked"))
    made = F.transform("_asked", lambda n: packed_result(n["question"], F.get("_a", n["_q"])))
    return docs.crossJoin(F.broadcast(listed)).select("doc_id", "_c", "_pages", made.alias("results"))


def pack_hits(flat: DataFrame, docs: DataFrame) -> DataFrame:
    """As ``pack``, of results that were made by hits: what is shown of chunks and pages is left to ``docs`` (of
    ``document_rows``), only responses and scores are shuffled."""
    kept = F.transform("alternatives", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"), x["response"].alias("response")))
    lists = flat.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("question", "best_answer", kept.alias("alternatives")))).alias("_r"))
    joined = lists.join(docs, lists["_doc"] == docs["doc_id"])
    at = lambda x: F.struct((F.array_position(F.col("_c.chunk_id"), x["chunk_id"]) - 1).cast("int").alias("c"), F.lit(-1).alias("s"), x["score"].alias("score"), x["response"].alias("response"))
    made = F.transform("_r", lambda r: F.struct(r["question"].alias("question"), r["best_answer"].alias("best_answer"), F.transform(r["alternatives"], at).alias("alternatives")))
    return joined.select("doc_id", "_c", "_pages", made.alias("results"))


def unfold(packed: DataFrame) -> DataFrame:
    """doc_id, question, best_answer, alternatives of rows of ``pack``. What is shown of a document's chunks and pages is
    looked up in its row; a best answer or response that is not stated is the sentence at its place."""
    # What is the same for all questions is worked out once per document, below the explode.
    cut_ = packed.withColumn("_s", F.transform("_c", summary_sentences)).withColumn("_n", F.transform("_pages", lambda p: F.length(p["text"])))
    each = cut_.select("doc_id", "_c", "_s", "_n", "_pages", F.explode("results").alias("_r")).withColumn("_x", F.col("_r.alternatives"))

    def response(x):
        return F.coalesce(x["response"], F.get(F.get("_s", x["c"]), x["s"]))

    def page(x):
        return F.array_position(F.col("_pages.key"), F.coalesce(F.get("_c", x["c"])["page_number"].cast("string"), F.lit("")))

    def field(x, name):
        chunk, text, length = F.get("_c", x["c"]), F.get("_pages", (x["p"] - 1).cast("int"))["text"], F.get("_n", (x["p"] - 1).cast("int"))
        if name == "response":
            return response(x)
        if name == "score":
            return F.round(x["score"], 3)
        if name == "excerpt":
            return text
        return F.least(chunk[name], length) if name in ("start_char", "end_char") else chunk[name]

    best = F.get(F.filter("_x", lambda x: x["score"] > -1), 0)
    found = F.filter(F.transform("_x", lambda x: F.struct(*[x[f].alias(f) for f in ("c", "s", "score", "response")], page(x).alias("p"))), lambda x: x["p"] > 0)
    alternatives = F.transform(found, lambda x: F.struct(*[field(x, f).alias(f) for f in FIELDS]))
    return each.select("doc_id", F.col("_r.question").alias("question"), F.coalesce("_r.best_answer", response(best), F.lit(NOT_FOUND)).alias("best_answer"), alternatives.alias("alternatives"))
