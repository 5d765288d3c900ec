"""Answers worked out in the document's row, against the way by hits."""

import re

import numpy as np
import pandas as pd
import pytest

from cahier.functions import vectors
from cahier.operators import answers, nested, retrieval, seams
from cahier.operators.chunks import chunk_pages
from cahier.plans import jobs
from cahier.plans.text_queries import letter_vectors
from cahier.sources import buckets

WORDS = "beton acier dalle mur porte ras toit prix delai lot".split()


def corpus(spark):
    pages = [(d, f"n{d}", p, " ".join(f"{WORDS[(d * 7 + p * 3 + i) % 10].title()} {WORDS[(d + i * i) % 10]} {WORDS[(p + i) % 9]}." for i in range(1 + (d + p) % 6)) if (d + p) % 7 else "  ") for d in range(12) for p in range(1, 3 + d % 9)]
    asked = [(f"q{i}", f"{WORDS[i % 10]} {WORDS[(i * 3 + 1) % 10]} {WORDS[i % 10] if i % 2 else ''}") for i in range(15)] + [("none", "..."), ("other", "zzz")]
    return spark.createDataFrame(pages, "doc_id long, doc_name string, page_number int, text string"), spark.createDataFrame(asked, "question string, query string")


def plain(df):
    return df.toPandas().sort_values(["doc_id", "question"]).reset_index(drop=True).map(str)


@pytest.mark.parametrize("encoder", [None, letter_vectors])
@pytest.mark.parametrize("most", [1024, 4])
def test_answers_in_rows_as_by_hits(spark, monkeypatch, encoder, most):
    monkeypatch.setattr(jobs, "CHUNKS_PER_ROW", most)
    pages, asked = corpus(spark)
    index = jobs.ingest(pages)
    ours = jobs.answer_catalog(pages, index, asked, encoder=encoder)
    theirs = jobs._answers_by_hits(pages, index, asked, None, 5, "substring", encoder, None)
    pd.testing.assert_frame_equal(plain(ours), plain(theirs.select(*ours.columns)))


def test_pairs_and_hits_are_not_shuffled(spark):
    pages, asked = corpus(spark)
    results = jobs.answer_catalog(pages, jobs.ingest(pages), asked)
    exchanges = re.findall(r"hashpartitioning\([^\n]*", results._jdf.queryExecution().executedPlan().toString())
    assert exchanges and not any("doc_id" in x and "question" in x for x in exchanges)


def test_python_gets_few_rows_of_texts_at_once(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    chunk_pages(corpus(spark)[0])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 16 << 20


def test_summaries_in_blocks(spark, monkeypatch):
    chunks = chunk_pages(corpus(spark)[0])
    whole = seams.extract_summary(chunks).orderBy("doc_id", "chunk_id").collect()
    monkeypatch.setattr(seams, "HELD_TOKENS", 5)
    assert seams.extract_summary(chunks).orderBy("doc_id", "chunk_id").collect() == whole


@pytest.mark.parametrize("pairs", [100_000, 7])
def test_all_cosines_in_small_batches(spark, monkeypatch, pairs):
    monkeypatch.setattr(vectors, "PAIRS", pairs)
    m = np.random.default_rng(2).normal(size=(60, 5))
    items = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(m)], "one int, i long, v array<double>")
    asked = spark.createDataFrame([(j, m[j].tolist()) for j in range(20)], "q long, v array<double>")
    got = {(r["q"], r["i"]): r["score"] for r in vectors.dense_topk(items, asked, None, "one", "i", "q", "v").collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert len(got) == 1200 and all(abs(s - unit[q] @ unit[i]) < 1e-12 for (q, i), s in got.items())


def test_products_in_runs_of_rows(spark, monkeypatch):
    pages, asked = corpus(spark)
    index = jobs.ingest(pages)
    want = plain(jobs.answer_catalog(pages, index, asked))
    hits = sorted(map(tuple, retrieval.topk_chunks(index, asked).collect()))
    monkeypatch.setattr(retrieval, "ENTRIES", 3)
    assert sorted(map(tuple, retrieval.topk_chunks(index, asked).collect())) == hits
    pd.testing.assert_frame_equal(plain(jobs.answer_catalog(pages, index, asked)), want)


@pytest.mark.parametrize("most", [1024, 4])
def test_kept_results_as_they_were(spark, monkeypatch, tmp_path, most):
    """what is kept shows the same results, and holds a document's pages and chunks once."""
    monkeypatch.setattr(jobs, "CHUNKS_PER_ROW", most)
    pages, asked = corpus(spark)
    index = jobs.ingest(pages)
    path = str(tmp_path / "results")
    answers.index_results(jobs.answer_documents(pages, index, asked), path)
    kept = buckets.open_table(spark, path)
    assert kept.count() == index.select("doc_id").distinct().count()
    assert not {"excerpt", "summary"} & set(kept.schema["results"].dataType.elementType["alternatives"].dataType.elementType.names)
    want = jobs.answer_catalog(pages, index, asked)
    pd.testing.assert_frame_equal(plain(nested.unfold(kept).select(*want.columns)), plain(want))


def test_generated_results_are_kept_as_they_were(spark, tmp_path):
    pages, asked = corpus(spark)
    index = jobs.ingest(pages)

    def generator(batches):
        for prompts in batches:
            yield prompts.map(lambda p: None if len(p) % 3 == 0 else f"{p[-9:]} beton")

    path = str(tmp_path / "results")
    answers.index_results(jobs.answer_documents(pages, index, asked, generator), path)
    want = jobs.answer_catalog(pages, index, asked, generator)
    pd.testing.assert_frame_equal(plain(nested.unfold(buckets.open_table(spark, path)).select(*want.columns)), plain(want))


@pytest.mark.parametrize("most", [200_000, 4])
def test_own_questions_in_rows_as_by_hits(spark, monkeypatch, most):
    """a document answers its own questions in its row; no row per (document, chunk, token) is shuffled."""
    monkeypatch.setattr(jobs, "REQUEST_CELLS", most)
    pages, asked = corpus(spark)
    index = jobs.ingest(pages)
    own = [(d, text) for d in range(14) for q, text in map(tuple, asked.collect()) if (d + len(text)) % 3]
    requests = spark.createDataFrame(own, "doc_id long, question string")
    ours, unknown = jobs.answer_requests(requests, pages, index)
    pairs = requests.distinct().join(index.select("doc_id"), "doc_id", "left_semi").withColumn("query", retrieval.F.col("question"))
    theirs = jobs._requests_by_hits(pages, index, pairs, None, 5, "substring", None, None)
    pd.testing.assert_frame_equal(plain(ours), plain(theirs.select(*ours.columns)))
    assert unknown.count() == requests.distinct().count() - pairs.count()
    exchanges = re.findall(r"hashpartitioning\([^\n]*", ours._jdf.queryExecution().executedPlan().toString())
    assert most == 4 or not any("token" in x or "chunk_id" in x for x in exchanges)


def test_lengths_of_pages_are_worked_out_once(spark):
    """catalogue_answers (F3): below the explode, not for each question's answers."""
    from cahier.plans import jobs, text_queries

    small = "/root/testdata/sf0.001"
    pages = text_queries.doc_pages(spark, small)
    made = jobs.answer_catalog(pages, jobs.ingest(pages), text_queries.questions(spark, small))
    above, below = made._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)
    assert "least(" in above and "length(" not in above and "length(" in below
