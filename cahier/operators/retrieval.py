"""Ranking the chunks of every document against every question."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cahier.functions.text import sentences, tokens
from cahier.functions.vectors import cosine, dense_topk
from cahier.operators.calls import Generator
from cahier.operators.seams import ABSTAIN, encode, in_blocks, in_row_answer, token_counts, with_asked, with_sentences
from cahier.session import cut_lineage, small_batches

TOP_K = 5
#: A document's chunks that one task ranks; more are ranked in parts that are merged.
CHUNKS_PER_TASK = 4096
#: Scores that a task holds at once.
SCORES = 1_000_000
#: Products of a row's and a question's token that a task holds at once, or those of one row.
ENTRIES = 200_000
#: A catalogue with more token rows than this is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Texts that are broadcast have no more bytes than this together.
BROADCAST_BYTES = 16 << 20


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast up to BROADCAST_ROWS rows, left to Spark beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def doc_query_pairs(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every question for every requested document: the stated questions, of which there are a few, on each row."""
    return docs.select("doc_id").distinct().crossJoin(bounded(catalog.select("question", "query")))


def adhoc_pairs(requests: DataFrame) -> DataFrame:
    """One question for one document; the question is its own retrieval text."""
    return requests.select("doc_id", "question", F.col("question").alias("query"))


def rank_topk(scored: DataFrame, k: int = TOP_K, keys: tuple[str, ...] = ("doc_id", "question"), tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each key by score (to 9 places), ties by ``tie``; fewer where there are fewer."""
    by = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def query_vectors(catalog: DataFrame) -> DataFrame:
    """question, token, qtf, qnorm2: the sparse vectors of the retrieval texts and their squared norms."""
    asked = token_counts(catalog, ["question"], "query").withColumn("norm2", F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy("question")))
    return asked.select("question", "token", F.col("tf").alias("qtf"), F.col("norm2").alias("qnorm2"))


def response_scores(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """``rows`` (keys, question, response) with score: cosine of the term frequencies of the question's retrieval text and
    the response; null if one has no token.

    Each row is worked on by itself: below a checked size the questions are a sparse matrix in every task, of which a row
    takes its question's entries for its own tokens; a larger catalogue is joined by token.
    """
    asked = query_vectors(catalog)
    if asked.count() > BROADCAST_ROWS or catalog.count() > BROADCAST_ROWS:
        return _response_scores_by_join(rows, asked)
    cat = SparseCatalog.of(catalog, asked)

    @F.arrow_udf("double")
    def score(question: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array(cat.row_scores(question, words), from_pandas=True)

    return rows.withColumn("score", score("question", tokens("response")))


def extract_answer(hits: DataFrame, summaries: DataFrame, catalog: DataFrame) -> DataFrame:
    """``hits`` (doc_id, question, chunk_id) with their summaries' columns + response: the summary's sentence that shares
    most different tokens with the question's retrieval text, the first on a tie; ABSTAIN when none shares any.

    Summaries are taken apart before they meet the hits, and below a checked size of the catalogue only the places of
    their tokens in it go on."""
    asked = query_vectors(catalog)
    if asked.count() > BROADCAST_ROWS or catalog.count() > BROADCAST_ROWS:
        return in_row_answer(hit_rows(hits, with_sentences(summaries)).join(with_asked(catalog.select("question", "query")), "question")).drop("query")
    cat = SparseCatalog.of(catalog, asked)

    @F.arrow_udf("array<array<int>>")
    def places(words: pa.Array) -> pa.Array:
        return cat.token_places(words)

    @F.arrow_udf("int")
    def best(question: pa.Array, places_: pa.Array) -> pa.Array:
        return pa.array(cat.best_sentence(question, places_), pa.int32())

    cut = summaries.withColumn("_s", sentences("summary"))
    found = hit_rows(hits, cut.withColumn("_t", places(F.transform("_s", tokens)))).withColumn("_at", best("question", "_t"))
    return found.withColumn("response", F.when(F.col("_at") >= 0, F.get("_s", "_at")).otherwise(F.lit(ABSTAIN))).drop("_s", "_t", "_at")


def _response_scores_by_join(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The same by joins: each different (question, response) is scored once."""
    each = rows.select("question", "response").where("question is not null and response is not null").distinct()
    own = token_counts(each, ["question", "response"], "response")
    norms = own.groupBy("question", "response").agg(F.sum(F.col("tf") * F.col("tf")).alias("_yy"))
    dots = own.join(asked, ["question", "token"]).groupBy("question", "response").agg(F.sum(F.col("tf") * F.col("qtf")).alias("_dot"))
    xx = asked.groupBy("question").agg(F.first("qnorm2").alias("_xx"))
    scored = norms.join(xx, "question").join(dots, ["question", "response"], "left")
    return rows.join(scored.select("question", "response", score_of("_dot", "_xx", "_yy").alias("score")), ["question", "response"], "left")


def sparse_scores(summaries: DataFrame, asked: DataFrame, text: str = "summary") -> DataFrame:
    """doc_id, chunk_id, question, score: cosine of term frequencies of all pairs that share a token, by a join of tokens
    with ``asked`` (of ``query_vectors``): the way for catalogues of any size."""
    own = token_counts(summaries, ["doc_id", "chunk_id"], text)
    norms = own.groupBy("doc_id", "chunk_id").agg(F.sum(F.col("tf") * F.col("tf")).alias("norm2"))
    dots = own.join(asked, "token").groupBy("doc_id", "chunk_id", "question").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"), F.first("qnorm2").alias("qnorm2"))
    shared = dots.join(norms, ["doc_id", "chunk_id"])
    return shared.select("doc_id", "chunk_id", "question", score_of("dot", "norm2", "qnorm2").alias("score"))


def topk_by_shuffle(summaries: DataFrame, asked: DataFrame, catalog: DataFrame, k: int = TOP_K) -> DataFrame:
    """As ``topk_chunks``, with nothing broadcast but what is small."""
    ranked = rank_topk(sparse_scores(summaries, asked), k)
    # Zero scores: only pairs with fewer hits than chunks (or k) need them, and only each document's first chunks can be among them.
    first = summaries.select("doc_id", "chunk_id").withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id"))).where(F.col("_r") <= 2 * k).drop("_r")
    have = ranked.groupBy("doc_id", "question").agg(F.count("*").alias("_have"))
    pairs = first.groupBy("doc_id").agg(F.count("*").alias("_chunks")).crossJoin(bounded(catalog.select("question")))
    short = pairs.join(have, ["doc_id", "question"], "left").where(F.coalesce("_have", F.lit(0)) < F.least("_chunks", F.lit(k))).select("doc_id", "question")
    zero = short.join(first, "doc_id").join(ranked.select("doc_id", "chunk_id", "question"), ["doc_id", "chunk_id", "question"], "left_anti").withColumn("score", F.lit(0.0))
    return rank_topk(ranked.drop("rank").unionByName(zero.select("doc_id", "chunk_id", "question", "score")), k).select("doc_id", "question", "chunk_id", "score", "rank")


@dataclass
class SparseCatalog:
    """A catalogue as a compressed sparse matrix: per token (``tokens``) the questions that hold it (``question``, ``tf``,
    from ``first[i]`` to ``first[i + 1]``), and the questions' norms."""

    names: pa.Array
    tokens: pa.Array
    first: np.ndarray
    question: np.ndarray
    tf: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, catalog: DataFrame, asked: DataFrame) -> SparseCatalog:
        names = sorted(r["question"] for r in catalog.select("question").distinct().collect())
        t = asked.toArrow().combine_chunks()
        tokens, token = np.unique(t["token"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True) if t.num_rows else (np.array([], str), np.zeros(0, int))
        at = {n: i for i, n in enumerate(names)}
        question = np.array([at[q] for q in t["question"].to_pylist()], np.int64)
        order = np.argsort(token, kind="stable")
        norm2 = np.zeros(len(names))
        norm2[question] = t["qnorm2"].to_numpy()
        first = np.searchsorted(token[order], np.arange(len(tokens) + 1))
        return cls(pa.array(names, pa.string()), pa.array(tokens.tolist(), pa.string()), first, question[order], t["qtf"].to_numpy()[order].astype(float), np.sqrt(norm2))

    @classmethod
    def of_tokens(cls, words: pa.ListArray) -> SparseCatalog:
        """Of a few questions that are given by their tokens, named by their places."""
        n = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
        coded = words.flatten().dictionary_encode()
        key, tf = np.unique(np.asarray(coded.indices).astype(np.int64) * max(len(n), 1) + np.repeat(np.arange(len(n)), n), return_counts=True)
        token, question = np.divmod(key, max(len(n), 1))
        first = np.searchsorted(token, np.arange(len(coded.dictionary) + 1))
        names = pa.array([str(i) for i in range(len(n))], pa.string())
        return cls(names, coded.dictionary, first, question, tf.astype(float), np.sqrt(np.bincount(question, tf * tf, len(n))))

    def scores(self, words: pa.ListArray) -> np.ndarray:
        """Cosines of the term frequencies of each row's tokens with all questions, 0 where a side has none."""
        return self.scores_and_shared(words)[0]

    def scores_and_shared(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(``scores``, numbers of different tokens shared) of each row with all questions."""
        n, asked = len(words), len(self.names)
        row = np.repeat(np.arange(n), np.asarray(pc.fill_null(pc.list_value_length(words), 0)))
        code, size, place = self.known(words.flatten())
        key, tf = np.unique(row * size + code, return_counts=True)
        row, code = key // size, key % size
        norm = np.sqrt(np.bincount(row, tf * tf, n))
        known = place[code]
        row, tf, known = row[known >= 0], tf[known >= 0], known[known >= 0]
        length = self.first[known + 1] - self.first[known]
        dots, shared = np.zeros(n * asked), np.zeros(n * asked, np.int32)
        # Rows are multiplied in runs of about ENTRIES entries of the product, each with its own part of the result.
        for i, z in in_blocks(np.bincount(row, length, n).astype(np.int64), ENTRIES):
            mine = slice(*np.searchsorted(row, [i, z]))
            own, begin = length[mine], self.first[known[mine]]
            at = np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(own.sum())
            cell = np.repeat(row[mine] - i, own) * asked + self.question[at]
            dots[i * asked : z * asked] = np.bincount(cell, np.repeat(tf[mine], own) * self.tf[at], (z - i) * asked)
            shared[i * asked : z * asked] = np.bincount(cell, minlength=(z - i) * asked)
        return dots.reshape(n, asked) / np.maximum(norm[:, None] * self.norm, 1e-300), shared.reshape(n, asked)

    def entries(self, row_question: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among ``known`` and ``row_question``, entries of the matrix) of those tokens that their questions hold."""
        if not len(self.question):
            return np.zeros(0, int), np.zeros(0, int)
        held = np.repeat(np.arange(len(self.tokens)), np.diff(self.first)) * len(self.names) + self.question
        order = np.argsort(held)
        wanted = np.where((known >= 0) & (row_question >= 0), known * len(self.names) + row_question, -1)
        at = order[np.minimum(np.searchsorted(held, wanted, sorter=order), len(held) - 1)]
        there = np.flatnonzero(held[at] == wanted)
        return there, at[there]

    def known(self, tokens_: pa.StringArray) -> tuple[np.ndarray, int, np.ndarray]:
        """(code of each token, number of codes, each code's place in the catalogue or -1)."""
        coded = tokens_.dictionary_encode()
        place = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=self.tokens), -1))
        return np.asarray(coded.indices), max(len(coded.dictionary), 1), place

    def token_places(self, sentences_: pa.ListArray) -> pa.ListArray:
        """Per row and sentence (a list of tokens) the places in the catalogue of its different tokens, those that have one."""
        length = np.asarray(pc.fill_null(pc.list_value_length(sentences_), 0))
        each = sentences_.flatten()
        sentence = np.repeat(np.arange(len(each)), np.asarray(pc.list_value_length(each)))
        code, size, place = self.known(each.flatten())
        key = np.unique(sentence * size + code)
        sentence, place = key // size, place[key % size]
        sentence, place = sentence[place >= 0], place[place >= 0]
        inner = pa.ListArray.from_arrays(np.searchsorted(sentence, np.arange(len(each) + 1)).astype(np.int32), pa.array(place.astype(np.int32)))
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), inner)

    def best_sentence(self, question: pa.Array, places: pa.ListArray) -> np.ndarray:
        """Per row the sentence (of ``token_places``) that shares most different tokens with the row's question, the first
        on a tie; -1 where none shares any."""
        n = len(places)
        asked = np.asarray(pc.fill_null(pc.index_in(question, value_set=self.names), -1))
        length = np.asarray(pc.fill_null(pc.list_value_length(places), 0))
        row = np.repeat(np.arange(n), length)
        each = places.flatten()
        sentence = np.repeat(np.arange(len(row)), np.asarray(pc.list_value_length(each)))
        shared, _ = self.entries(asked[row[sentence]], np.asarray(each.flatten()))
        count = np.bincount(sentence[shared], minlength=len(row))
        begin = np.cumsum(length) - length
        order = np.lexsort((np.arange(len(row)), -count, row))
        out = np.full(n, -1)
        some = np.flatnonzero(length)
        top = order[begin[some]]
        out[some] = np.where(count[top] > 0, top - begin[some], -1)
        return out

    def row_scores(self, question: pa.Array, words: pa.ListArray) -> np.ndarray:
        """The cosine of each row's tokens with the row's own question; NaN where one of the two has no token."""
        n = len(words)
        asked = np.asarray(pc.fill_null(pc.index_in(question, value_set=self.names), -1))
        row = np.repeat(np.arange(n), np.asarray(pc.fill_null(pc.list_value_length(words), 0)))
        code, size, place = self.known(words.flatten())
        key, tf = np.unique(row * size + code, return_counts=True)
        row, code = key // size, key % size
        norm = np.sqrt(np.bincount(row, tf * tf, n)) * np.where(asked >= 0, np.append(self.norm, 0)[asked], 0)
        mine, entry = self.entries(asked[row], place[code])
        dots = np.bincount(row[mine], tf[mine] * self.tf[entry], n)
        return np.where(norm > 0, dots / np.where(norm > 0, norm, 1), np.nan)


class _Ranks:
    """The k best chunks of one document for every question, of rows that come in parts."""

    def __init__(self, doc, k: int):
        self.doc, self.k, self.ids, self.scores = doc, k, None, None

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids = np.broadcast_to(ids[:, None], scores.shape)
        if self.ids is not None:
            ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -np.round(scores, 9)), axis=0)[: self.k]
        self.ids, self.scores = np.take_along_axis(ids, order, 0), np.take_along_axis(scores, order, 0)


def _ranked(sorted_rows: DataFrame, cat: SparseCatalog, k: int, block: int, counted: bool = False) -> DataFrame:
    """doc_id, question, chunk_id, score, rank from doc_id, chunk_id, tokens, where a document's rows of one task are
    neighbours: the best of each run. ``counted``: of each run the last hits alone, whose ranks are the numbers of hits."""
    doc_type, id_type = (sorted_rows.schema[c].dataType.simpleString() for c in ("doc_id", "chunk_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = len(cat.names)
        kinds: list[pa.DataType] = []

        def emit(docs: pa.Array, ids: np.ndarray, scores: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
            """``ids``, ``scores`` (rows, questions) of one document's name for each row."""
            names = cat.names.take(pa.array(np.tile(np.arange(asked), len(ids))))
            who = docs.take(pa.array(np.repeat(np.arange(len(ids)), asked)))
            rank = np.repeat(ranks, asked).astype(np.int32)
            return pa.RecordBatch.from_arrays([who, names, pa.array(ids.ravel()).cast(kinds[1]), pa.array(scores.ravel()), pa.array(rank)], ["doc_id", "question", "chunk_id", "score", "rank"])

        def close(r: _Ranks) -> pa.RecordBatch:
            n = len(r.ids)
            if counted:
                return emit(pa.array([r.doc], kinds[0]), r.ids[-1:], r.scores[-1:], np.array([n]))
            return emit(pa.array([r.doc] * n, kinds[0]), r.ids, r.scores, np.arange(1, n + 1))

        open_: _Ranks | None = None
        for b in batches:
            kinds = [b.schema.field(0).type, b.schema.field(1).type]
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                docs, ids, scores = part.column(0), part.column(1).to_numpy(), cat.scores(part.column(2))
                code = np.asarray(docs.dictionary_encode().indices)
                cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
                if open_ is not None and docs[0].as_py() != open_.doc:
                    yield close(open_)
                    open_ = None
                # Runs of one row that end here are done as they are; the last run may go on.
                alone = np.flatnonzero(np.diff(cuts) == 1)
                alone = alone[(alone < len(cuts) - 2) & ((alone > 0) | (open_ is None))]
                at = cuts[alone]
                if len(at):
                    yield emit(docs.take(pa.array(at)), np.broadcast_to(ids[at, None], (len(at), asked)), scores[at], np.ones(len(at), int))
                for j in np.setdiff1d(np.arange(len(cuts) - 1), alone):
                    if open_ is not None and j > 0:
                        yield close(open_)
                        open_ = None
                    open_ = open_ or _Ranks(docs[int(cuts[j])].as_py(), k)
                    open_.add(ids[cuts[j] : cuts[j + 1]], scores[cuts[j] : cuts[j + 1]])
        if open_ is not None:
            yield close(open_)

    return sorted_rows.mapInArrow(run, f"doc_id {doc_type}, question string, chunk_id {id_type}, score double, rank int")


def hit_counts(summaries: DataFrame, catalog: DataFrame, k: int = TOP_K) -> DataFrame:
    """doc_id, question, k: how many hits of ``topk_chunks`` each question has in each document. They are ranked and counted
    in the task that holds the document; no hit is shuffled, but of documents that are ranked in parts."""
    return topk_chunks(summaries, catalog, k, counted=True)


def topk_chunks(summaries: DataFrame, catalog: DataFrame, k: int = TOP_K, counted: bool = False) -> DataFrame:
    """doc_id, question, chunk_id, score, rank: the k best chunks of every document for every question by the cosine of
    term frequencies, ties by chunk id. Chunks that share no token with a question score 0.

    The catalogue is a sparse matrix in every task, below a checked size, and is multiplied with batches of summaries. Only
    the summaries are dealt, by document, so that a task ranks a document's chunks itself and what the product yields is
    never shuffled; documents of more than CHUNKS_PER_TASK chunks are dealt in parts, whose k best are merged.
    """
    small_batches(summaries.sparkSession)
    asked = query_vectors(catalog)

    def shown(hits: DataFrame) -> DataFrame:
        return hits.groupBy("doc_id", "question").agg(F.count("*").alias("k")) if counted else hits.select("doc_id", "question", "chunk_id", "score", "rank")

    if asked.count() > BROADCAST_ROWS or catalog.count() > BROADCAST_ROWS:
        return shown(topk_by_shuffle(summaries, asked, catalog, k))
    cat = SparseCatalog.of(catalog, asked)
    if not len(cat.names):
        return shown(rank_topk(sparse_scores(summaries, asked), k))
    n = int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = min(256, max(1, SCORES // len(cat.names)))
    slim = summaries.select("doc_id", "chunk_id", "summary")
    long = slim.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") > CHUNKS_PER_TASK).select("doc_id")

    def ranked(rows: DataFrame, *by: Column | str, last: bool = False) -> DataFrame:
        dealt = rows.repartition(n, *by).sortWithinPartitions("doc_id")
        return _ranked(dealt.select("doc_id", "chunk_id", tokens("summary").alias("t")), cat, k, block, last)

    def whole(rows: DataFrame) -> DataFrame:
        hits = ranked(rows, "doc_id", last=counted)
        return hits.select("doc_id", "question", F.col("rank").cast("long").alias("k")) if counted else hits

    if long.isEmpty():
        return whole(slim)
    parts = ranked(slim.join(long, "doc_id", "left_semi"), "doc_id", F.xxhash64("chunk_id") % F.lit(n)).drop("rank")
    return whole(slim.join(long, "doc_id", "left_anti")).unionByName(shown(rank_topk(parts, k)))


def dense_chunks(summaries: DataFrame, catalog: DataFrame, encoder: Generator, k: int = TOP_K) -> DataFrame:
    """As ``topk_chunks`` by the cosine of an encoder's vectors. Each summary is encoded once, and only the k best of each
    document and question leave a task. Texts that the encoder has no usable vector for are not ranked."""
    items = cut_lineage(encode(summaries.select("doc_id", "chunk_id", "summary"), "summary", encoder, "_v"))
    asked = cut_lineage(encode(catalog.select("question", "query"), "query", encoder, "_v"))
    return rank_topk(dense_topk(items, asked, k, "doc_id", "chunk_id", "question", "_v"), k)


def dense_response_scores(rows: DataFrame, catalog: DataFrame, encoder: Generator) -> DataFrame:
    """``rows`` with score: cosine of the encoder's vectors of the question's retrieval text and the response."""
    asked = bounded(encode(catalog.select("question", "query"), "query", encoder, "_q").select("question", "_q"))
    return encode(rows, "response", encoder, "_v").join(asked, "question").withColumn("score", cosine("_v", "_q")).drop("_v", "_q")


def asked_topk(summaries: DataFrame, pairs: DataFrame, k: int = TOP_K, encoder: Generator | None = None) -> DataFrame:
    """As ``topk_chunks`` for stated pairs (doc_id, question, query) alone: only their documents are read and scored."""
    pairs = pairs.dropDuplicates(["doc_id", "question"])
    own = summaries.select("doc_id", "chunk_id", "summary").join(pairs.select("doc_id"), "doc_id", "left_semi")
    if encoder is not None:
        asked = encode(pairs.select("doc_id", "question", "query"), "query", encoder, "_q").drop("query")
        scored = encode(own, "summary", encoder, "_v").join(asked, "doc_id").withColumn("score", cosine("_v", "_q"))
        return rank_topk(scored.select("doc_id", "question", "chunk_id", "score"), k)
    keys = ["doc_id", "chunk_id", "question"]
    norm2 = F.sum(F.col("tf") * F.col("tf"))
    counts = token_counts(own, ["doc_id", "chunk_id"], "summary")
    asked = token_counts(pairs, ["doc_id", "question"], "query")
    dots = counts.join(asked.withColumnRenamed("tf", "qtf"), ["doc_id", "token"]).groupBy(*keys).agg(F.sum(F.col("tf") * F.col("qtf")).alias("_dot"))
    scored = own.select("doc_id", "chunk_id").join(pairs.select("doc_id", "question"), "doc_id").join(dots, keys, "left")
    scored = scored.join(counts.groupBy("doc_id", "chunk_id").agg(norm2.alias("_yy")), ["doc_id", "chunk_id"], "left").join(asked.groupBy("doc_id", "question").agg(norm2.alias("_xx")), ["doc_id", "question"], "left")
    return rank_topk(scored.select(*keys, F.coalesce(score_of("_dot", "_xx", "_yy"), F.lit(0.0)).alias("score")), k)


def hit_rows(hits: DataFrame, summaries: DataFrame) -> DataFrame:
    """Hits with the columns of their summaries.

    Hits are many more than Spark takes them for (it knows nothing of what ``mapInArrow`` adds), so they must not be the
    side that is broadcast: small summaries are, by their counted bytes; else both sides are shuffled and sorted.
    """
    size = summaries.agg(F.count("*"), F.sum(F.octet_length("summary"))).first()
    small = size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_BYTES
    return hits.join(F.broadcast(summaries) if small else summaries.hint("merge"), ["doc_id", "chunk_id"])


def text_cosine(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, score: cosine of the term frequencies of two texts of one row; null if one text has no token."""
    x = token_counts(df, keys, a).withColumnRenamed("tf", "x")
    y = token_counts(df, keys, b).withColumnRenamed("tf", "y")
    each = x.join(y, [*keys, "token"], "full").groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return each.select(*keys, score_of("dot", "xx", "yy").alias("score"))


def score_of(dot: str, xx: str, yy: str) -> Column:
    return F.coalesce(F.col(dot), F.lit(0)) / (F.sqrt(F.col(xx).cast("double")) * F.sqrt(F.col(yy).cast("double")))
