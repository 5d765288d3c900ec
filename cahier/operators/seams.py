"""The pluggable model calls, as vectorised functions, and deterministic baselines in plain Spark.

A generator maps prompts to texts (or null; see ``calls``), an encoder texts to vectors, an extractor (name, bytes) to
pages. Generators and encoders are given as functions from an iterator of pandas Series to an iterator of results, so that
a client or a model is made once per task. The baselines here are ours and need no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cahier.functions.text import sentences, tokens
from cahier.operators.calls import Generator
from cahier.session import small_batches

ABSTAIN = "RAS"
FAILED = "Erreur"


def encode(df: DataFrame, text: str, encoder: Generator, out: str) -> DataFrame:
    return df.withColumn(out, F.pandas_udf(encoder, "array<float>", F.PandasUDFType.SCALAR_ITER)(text))


#: Bytes of page text that an extractor's task holds before it hands them on.
HELD_BYTES = 4 << 20
EXTRACTED = "page_number int, text string, error string"


def extract(raw_files: DataFrame, extractor: Callable[[str, bytes], Iterable[dict]], held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, doc_name, page_number, text, error: the pages that the extractor yields for each file.

    Pages leave the task as they come, in batches of at most ``held_bytes`` of text (or one larger page), so a task never
    holds a file's pages together with those of others. What an extractor raises becomes a row of its own, behind the
    pages already read. A page that has no number or text has null there.
    """
    slim = raw_files.select("doc_id", "doc_name", "content")
    kind = slim.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        schema = None

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            schema = pa.schema([b.schema.field(0), ("doc_name", pa.string()), ("page_number", pa.int32()), ("text", pa.string()), ("error", pa.string())])
            for i in range(b.num_rows):
                key, name = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for number, text, error in _pages(extractor, name, b.column(2)[i].as_py()):
                    rows.append((key, name, number, text, error))
                    held += 100 + len(text or "") + len(error or "")
                    if held >= held_bytes:
                        yield emit()
                        rows, held = [], 0
            if rows:
                yield emit()
                rows, held = [], 0

    return slim.mapInArrow(run, f"doc_id {kind.simpleString()}, doc_name string, {EXTRACTED}")


def _pages(extractor: Callable[[str, bytes], Iterable[dict]], name: str, content: bytes) -> Iterator[tuple]:
    try:
        for p in extractor(name, content):
            yield p.get("page_number"), p.get("text"), None
    except Exception as e:  # a broken file is a row of its own, after the pages already read
        yield None, None, str(e)


def token_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, token, tf: the sparse vector of each text."""
    return df.select(*keys, F.explode(tokens(text)).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))


#: Tokens that a task weighs at once; a row has its tokens together.
HELD_TOKENS = 200_000


def in_blocks(weight: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows whose weights sum up to ``most`` at most, or of one row."""
    out, begin, held = [], 0, 0
    for i, w in enumerate(weight):
        if held + w > most and i > begin:
            out.append((begin, i))
            begin, held = i, 0
        held += int(w)
    return [*out, (begin, len(weight))]


def _heaviest(keep: int):
    """Per row (an array of sentences ``s`` with their tokens ``t``) the ``keep`` sentences with the largest sum of the row's
    term frequencies over their different tokens, the earlier on a tie, in their order, joined by blanks."""

    def block(rows: pa.Array) -> pa.Array:
        per_row = np.asarray(pc.fill_null(pc.list_value_length(rows), 0))
        cut = rows.flatten()
        each = cut.field("t")
        row = np.repeat(np.arange(len(per_row)), per_row)
        sentence = np.repeat(np.arange(len(row)), np.asarray(pc.list_value_length(each)))
        code = np.asarray(each.flatten().dictionary_encode().indices)
        size = int(code.max(initial=0)) + 1
        _, of, tf = np.unique(row[sentence] * size + code, return_inverse=True, return_counts=True)
        _, first = np.unique(sentence * size + code, return_index=True)
        weight = np.bincount(sentence[first], tf[of[first]], len(row))
        begin = np.cumsum(per_row) - per_row
        order = np.lexsort((np.arange(len(row)), -weight, row))
        best = np.sort(order[np.arange(len(row)) - begin[row] < keep])  # sorted by row, so the place is the rank as well
        ends = pa.array(np.concatenate([[0], np.cumsum(np.minimum(per_row, keep))]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(ends, cut.field("s").take(pa.array(best))), " ")
        return pc.if_else(rows.is_valid(), joined, pa.scalar(None, pa.string()))

    def run(rows: pa.Array) -> pa.Array:
        size = np.asarray(pc.fill_null(pc.list_value_length(rows), 0))
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows.flatten().field("t")), 0))])[np.concatenate([[0], np.cumsum(size)])]
        return pa.concat_arrays([block(rows.slice(i, z - i)) for i, z in in_blocks(np.diff(ends), HELD_TOKENS)])

    return F.arrow_udf(run, "string").asNondeterministic()  # else a filter on the summary works it out a second time


def extract_summary(chunks: DataFrame, keep: int = 3, text: str = "text") -> DataFrame:
    """``chunks`` + summary: the ``keep`` sentences with the largest sum of the chunk's term frequencies over their
    different tokens (the earlier on a tie), in their order, joined by blanks; null for a null text.

    Each chunk is worked on by itself, with no exchange: sentences and tokens are cut in the JVM, the sentences are picked
    over Arrow batches. They go there with their tokens: picked by place afterwards, Spark would cut (and clean) the text
    anew for every sentence and every use of the summary.
    """
    small_batches(chunks.sparkSession)
    cut = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), tokens(s).alias("t")))
    return chunks.withColumn("summary", _heaviest(keep)(cut))


def with_sentences(rows: DataFrame, summary: str = "summary") -> DataFrame:
    """rows + _sentences: the summary's sentences with their different tokens, taken apart once per summary."""
    return rows.withColumn("_sentences", F.transform(sentences(summary), lambda s: F.struct(s.alias("s"), F.array_distinct(tokens(s)).alias("t"))))


def with_asked(rows: DataFrame, query: str = "query") -> DataFrame:
    """rows + _asked: the different tokens of the question's retrieval text, taken apart once per question."""
    return rows.withColumn("_asked", F.array_distinct(tokens(query)))


def in_row_answer(hits: DataFrame) -> DataFrame:
    """hits (with ``_sentences`` and ``_asked``) + response, as ``retrieval.extract_answer`` for catalogues of any size."""
    scored = F.transform("_sentences", lambda x, i: F.struct(F.size(F.array_intersect(x["t"], F.col("_asked"))).alias("n"), (-i).alias("i")))
    best = hits.withColumn("_best", F.array_max(scored))
    found = F.get("_sentences", -F.col("_best.i"))["s"]
    return best.withColumn("response", F.when(F.col("_best.n") > 0, found).otherwise(F.lit(ABSTAIN))).drop("_best", "_sentences", "_asked")
