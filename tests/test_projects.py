import pytest
from pyspark.sql import functions as F

from cahier import schemas
from cahier.operators import feedback as fb
from cahier.operators import projects as p
from cahier.operators.spans import locate_span
from cahier.plans import jobs
from cahier.sources import catalog, files, tables
from cahier.streaming import feeds

RESULTS = '{"q1": {"question": "q1", "best_answer": "b", "alternatives": [{"response": "b", "score": 0.5, "excerpt": "page", "chunk_id": 3}, {"response": "c", "score": 0.1, "chunk_text": "old"}]}, "q2": {"question": "q2", "best_answer": "Non trouvé", "alternatives": []}}'


def test_save_and_history(spark, tmp_path):
    records = spark.createDataFrame([("d1", "one", RESULTS), ("d2", "two", "{broken"), ("d3", "", RESULTS), ("d4", "known", RESULTS)], "doc_id string, name string, results string").withColumn("uploaded_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    known = spark.createDataFrame([("d4", "known", None, None, None)], schemas.PROJECTS)
    index = spark.createDataFrame([("d1", 0, "Sum one."), ("d1", 1, "Sum two.")], "doc_id string, chunk_id int, summary string")
    saved = jobs.save(records, known, index)
    assert [(r["id"], r["summary"]) for r in saved.projects.collect()] == [("d1", "Sum one. Sum two.")]
    assert {r["doc_id"]: r["error"] for r in saved.rejected.collect()} == {"d2": "malformed results", "d3": "missing: name"}
    assert [(r["id"], r["question"]) for r in saved.queries.orderBy("id").collect()] == [(1, "q1"), (2, "q2")]
    assert [(r["id"], r["query_id"], r["excerpt"]) for r in saved.answers.orderBy("id").collect()] == [(1, 1, "page"), (2, 1, "old")]
    tables.write_tables(str(tmp_path), saved.projects, saved.queries, saved.answers)
    _, queries, answers = tables.read_tables(spark, str(tmp_path))
    again = queries.unionByName(spark.createDataFrame([(9, "d1", "q1", "later")], schemas.QUERIES))
    history = {r["question"]: (r["best_answer"], len(r["alternatives"])) for r in p.project_history(again, answers).collect()}
    assert history == {"q1": ("later", 0), "q2": ("Non trouvé", 0)}


def test_strict_flag_reproduces_null_excerpts(spark):
    parsed = p.parse_results(spark.createDataFrame([("d", RESULTS)], "doc_id string, results string"))
    queries = p.surrogate_ids(p.flatten_queries(parsed), "project_id", ["query_ord"])
    assert [r["excerpt"] for r in p.flatten_answers(queries, strict=True).orderBy("pos").collect()] == [None, "old"]


def test_malformed_results_fail_when_strict(spark):
    with pytest.raises(Exception):
        p.parse_results(spark.createDataFrame([("d", "{x")], "doc_id string, results string"), strict=True).collect()


def test_surrogate_ids_are_dense_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") % 37).cast("string").alias("o"), "id").withColumnRenamed("id", "n")
    got = p.surrogate_ids(rows, "o", ["n"], 10).orderBy("o", "n").collect()
    assert [r["id"] for r in got] == list(range(11, 1011))


def test_orphans_with_null_keys(spark):
    children = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "id int, query_id int")
    assert sorted(r["id"] for r in p.fk_check(children, "query_id", spark.createDataFrame([(5,)], "id int")).collect()) == [1, 3]


def test_iso_timestamps(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02 03:04:05.25",), (None,)], "t string")
    assert [r[0] for r in df.select(p.iso_timestamp(F.col("t").cast("timestamp"))).collect()] == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.250000", None]


@pytest.mark.parametrize(("n", "status"), [(0, "not_enough_feedback"), (99, "not_enough_feedback"), (100, "ok")])
def test_gate(spark, n, status):
    assert tuple(fb.feedback_gate(spark.range(n)).first()) == (status, n)
    assert tuple(fb.no_feedback(spark).first()) == ("no_feedback_file", 0)


def test_batches(spark):
    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    got = [(r["batch"], r["at"], r["doc_id"]) for r in fb.training_batches(rows, ("doc_id",), 8, 3, 40).collect()]
    assert sorted(x[:2] for x in got) == [(i // 8, i % 8) for i in range(500)] and len({x[2] for x in got}) == 500
    assert sorted(got) == sorted((r["batch"], r["at"], r["doc_id"]) for r in fb.training_batches(rows.repartition(3), ("doc_id",), 8, 3).collect())
    assert fb.training_batches(rows.where("false"), ("doc_id",)).collect() == []


def test_feedback_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("q", "r", 0.5), ("q", "é\n", 1.0)], schemas.FEEDBACK)
    tables.append_feedback(rows, path)
    tables.append_feedback(rows, path)
    assert tables.read_feedback(spark, path).count() == 4
    (tmp_path / "log" / "broken.json").write_text('{"question": ')
    with pytest.raises(Exception):
        tables.read_feedback(spark, path).collect()


def test_stream_counts(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("q", "r", 0.5), ("p", "r", 1.0)], schemas.FEEDBACK)
    for _ in range(2):
        tables.append_feedback(rows, path)
        feeds.run_counts(feeds.feedback_counts(spark, path), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r["question"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"q": 2, "p": 2}


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("é".encode())
    (tmp_path / "b.Pdf").write_bytes(b"\xff\xfe")
    raw = files.read_files(spark, str(tmp_path))
    assert {r["doc_name"]: r["kind"] for r in files.classify(raw).collect()} == {"a.TXT": "text", "b.Pdf": "pdf"}
    assert files.decode_text(raw.where("doc_name = 'a.TXT'")).first()["text"] == "é"
    diverted = {r["doc_name"]: r["error"] for r in files.decode_text(raw, divert=True).collect()}
    assert diverted == {"a.TXT": None, "b.Pdf": "not UTF-8"}
    with pytest.raises(Exception):
        files.decode_text(raw).collect()


def test_catalog_keeps_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"z": "1", "a": "2",\n "m": "3"}')
    assert [(r["query_ord"], r["question"], r["query"]) for r in catalog.load_catalog(spark, str(tmp_path / "c.json")).collect()] == [(0, "z", "1"), (1, "a", "2"), (2, "m", "3")]


def test_span_errors(spark):
    pages = spark.createDataFrame([("d", None, "x ab x ab"), ("p", 1, "other")], "doc_id string, page_number int, text string")
    chunks = spark.createDataFrame([("d", 0, None, 2, 4), ("d", 1, None, 50, 52), ("p", 0, 2, 0, 1)], "doc_id string, chunk_id int, page_number int, start_char int, end_char int")
    asked = spark.createDataFrame([("d", 0), ("d", 1), ("d", 7), ("x", 0), ("p", 0)], "doc_id string, chunk_id int")
    got = {(r["doc_id"], r["chunk_id"]): (r["occurrences"], r["error"]) for r in locate_span(asked, chunks, pages).collect()}
    assert got[("d", 0)] == (2, None)
    assert {k: v[1] for k, v in got.items() if k != ("d", 0)} == {("d", 1): "not found", ("d", 7): "unknown chunk", ("x", 0): "unknown document", ("p", 0): "unknown page"}


def test_rows_are_worked_out_once_for_their_numbers(spark):
    """counting and numbering read what was kept; rows dealt by owner are not shuffled again."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(300).selectExpr("id % 7 as o", "id as n").repartition("o").mapInArrow(count, "o long, n long")
    got = p.surrogate_ids(rows, "o", ["n"]).orderBy("id").collect()
    assert [(r["o"], r["n"]) for r in got] == sorted((i % 7, i) for i in range(300)) and seen.value == 300
