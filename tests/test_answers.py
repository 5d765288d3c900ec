import pandas as pd
from pyspark.sql import functions as F

from cahier.operators import answers as a
from cahier.operators import calls, retrieval, seams
from cahier.operators.summaries import is_usable
from cahier.plans import jobs


def test_abstention(spark):
    df = spark.createDataFrame([("RAS",), ("bras long",), ("oui",), ("",), (None,)], "response string")
    assert [r[0] for r in a.abstain_filter(df).collect()] == ["oui"]
    assert [r[0] for r in a.abstain_filter(df, "exact").collect()] == ["bras long", "oui"]


def test_usable(spark):
    df = spark.createDataFrame([("Erreur",), (" NON PERTINENT ",), ("Erreur ici",), (None,), ("",)], "s string")
    assert [r[0] for r in df.where(is_usable("s")).collect()] == ["Erreur ici"]


def test_best_answer_ties_floor_and_missing(spark):
    pairs = spark.createDataFrame([("d", "q"), ("d", "none"), ("d", "low")], "doc_id string, question string")
    rows = spark.createDataFrame([("d", "q", 1, "first", 0.5), ("d", "q", 2, "second", 0.5), ("d", "q", 3, "third", 0.1), ("d", "low", 1, "x", -1.0)], "doc_id string, question string, rank int, response string, score double")
    got = {r["question"]: r["best_answer"] for r in a.best_answer(pairs, rows).collect()}
    assert got == {"q": "first", "none": "Non trouvé", "low": "Non trouvé"}


def test_topk_ties_and_zero_scores(spark):
    s = spark.createDataFrame([("d", i, t) for i, t in enumerate(["x y", "z", "x y", "w", "x", "v", "u"])], "doc_id string, chunk_id int, summary string")
    c = spark.createDataFrame([("q", "x y"), ("nothing", "k")], "question string, query string")
    got = {}
    for r in retrieval.topk_chunks(s, c).orderBy("rank").collect():
        got.setdefault(r["question"], []).append(r["chunk_id"])
    assert got == {"q": [0, 2, 4, 1, 3], "nothing": [0, 1, 2, 3, 4]}


def test_blank_page_keeps_the_answer_and_loses_the_alternative(spark):
    pages = spark.createDataFrame([("d", "n", None, "  "), ("d", "n", 1, "Short.")], "doc_id string, doc_name string, page_number int, text string")
    rows = spark.createDataFrame([("d", "q", 1, "best", 0.9, "s", "n", None, 0, 0, 50), ("d", "q", 2, "other", 0.12345, "s", "n", 1, 1, 2, 50)], "doc_id string, question string, rank int, response string, score double, summary string, doc_name string, page_number int, chunk_id int, start_char int, end_char int")
    pairs = spark.createDataFrame([("d", "q")], "doc_id string, question string")
    r = a.nest_results(pairs, rows, pages).first()
    assert r["best_answer"] == "best" and [x["excerpt"] for x in r["alternatives"]] == ["Short."]
    assert [(x["response"], x["score"], x["start_char"], x["end_char"]) for x in r["alternatives"]] == [("other", 0.123, 2, 6)]
    assert '"q":{"question":"q","best_answer":"best"' in a.results_json(a.nest_results(pairs, rows, pages)).first()["results"]


def test_generator_is_asked_once_per_prompt(spark):
    seen = spark.sparkContext.accumulator(0)

    def shout(batches):
        for s in batches:
            seen.add(len(s))
            yield s.map(lambda x: None if x == "b" else x.upper())

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, p string")
    got = {r["i"]: r["out"] for r in calls.generate(df, "p", shout, "out", "Erreur").collect()}
    assert got == {1: "A", 2: "A", 3: "Erreur"} and seen.value == 2


def test_extractor_failures_become_rows(spark):
    raw = spark.createDataFrame([("1", "a.pdf", bytearray(b"x")), ("2", "b.pdf", bytearray(b"y"))], "doc_id string, doc_name string, content binary")

    def read(name, content):
        yield {"page_number": 1, "text": name}
        if content == b"y":
            raise ValueError("broken")

    got = sorted((r["doc_id"], r["page_number"] or 0, r["text"], r["error"]) for r in seams.extract(raw, read).collect())
    assert got == [("1", 1, "a.pdf", None), ("2", 0, None, "broken"), ("2", 1, "b.pdf", None)]


def test_ingest_and_answer_with_own_generator(spark):
    pages = spark.createDataFrame([("d", "n", 1, "The frame is blue. It is large."), ("e", "n", 1, "Nothing here.")], "doc_id string, doc_name string, page_number int, text string")
    catalog = spark.createDataFrame([("colour", "frame blue")], "question string, query string")

    def echo(batches):
        for s in batches:
            yield pd.Series([x[-40:] for x in s])

    index = jobs.ingest(pages, echo)
    assert index.count() == 2
    results = jobs.answer_catalog(pages, jobs.ingest(pages), catalog)
    assert {r["doc_id"]: r["best_answer"] for r in results.select("doc_id", "best_answer").collect()} == {"d": "The frame is blue.", "e": "Non trouvé"}
    assert results.where(F.size("alternatives") == 1).count() == 1


def letters(batches):
    for s in batches:
        yield s.map(lambda x: [float(x.count(c)) for c in "abc"])


def test_encoder_ranks_and_scores(spark):
    s = spark.createDataFrame([("d", 0, "aa"), ("d", 1, "ab"), ("d", 2, "c"), ("e", 0, "b")], "doc_id string, chunk_id int, summary string")
    c = spark.createDataFrame([("q", "a")], "question string, query string")
    assert [list(r["_v"]) for r in seams.encode(s.limit(1), "summary", letters, "_v").collect()] == [[2.0, 0.0, 0.0]]
    got = sorted((r["doc_id"], r["rank"], r["chunk_id"]) for r in retrieval.dense_chunks(s, c, letters, 2).collect())
    assert got == [("d", 1, 0), ("d", 2, 1), ("e", 1, 0)]
    rows = spark.createDataFrame([("d", "q", "aaa"), ("d", "q", "c")], "doc_id string, question string, response string")
    assert {r["response"]: r["score"] for r in retrieval.dense_response_scores(rows, c, letters).collect()} == {"aaa": 1.0, "c": 0.0}
    asked = spark.createDataFrame([("d", "q", "a"), ("d", "q", "a")], "doc_id string, question string, query string")
    for encoder in (None, letters):
        top = sorted((r["doc_id"], r["rank"], r["chunk_id"]) for r in retrieval.asked_topk(s, asked, 2, encoder).collect())
        assert top == [("d", 1, 0), ("d", 2, 1)]


def test_response_scores_in_the_row(spark):
    c = spark.createDataFrame([("q", "a a b"), ("none", "?")], "question string, query string")
    rows = spark.createDataFrame([("q", "b a b c"), ("q", ""), ("q", None), ("none", "a")], "question string, response string")
    got = {(r["question"], r["response"]): r["score"] for r in retrieval.response_scores(rows, c).collect()}
    assert abs(got.pop(("q", "b a b c")) - 4 / (5 * 6) ** 0.5) < 1e-12
    assert set(got.values()) == {None}


def test_index_files(spark):
    raw = spark.createDataFrame([("1", "a.txt", bytearray("Un texte.".encode())), ("2", "b.pdf", bytearray(b"x")), ("3", "c.txt", bytearray(b"\xff")), ("4", "d.txt", bytearray(b"known")), ("1", "z.txt", bytearray(b"again"))], "doc_id string, doc_name string, content binary")
    made, rejected = jobs.index_files(raw, spark.createDataFrame([("4",)], "doc_id string"))
    got = {r["doc_id"]: r["summary"] for r in made.collect()}
    assert set(got) == {"1", "2", "3"} and got["1"] == "Un texte." and "no extractor for pdf" in got["2"] and "not UTF-8" in got["3"]
    assert sorted((r["doc_id"], r["error"]) for r in rejected.collect()) == [("1", "document given twice"), ("4", "document already indexed")]


def test_save_with_own_generator(spark):
    records = spark.createDataFrame([("d", "n", None, "{}")], "doc_id string, name string, uploaded_at timestamp, results string")
    summaries = spark.createDataFrame([("d", 0, "One."), ("d", 1, "Two.")], "doc_id string, chunk_id int, summary string")

    def last(batches):
        for s in batches:
            yield s.map(lambda x: x[-9:])

    saved = jobs.save(records, spark.createDataFrame([], "id string"), summaries, generator=last)
    assert [r["summary"] for r in saved.projects.collect()] == ["One.\nTwo."]
