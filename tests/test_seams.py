"""Model calls that fail or hang, files and their pages, dense vectors, spans, streams and tables of buckets."""

import glob
import os
import re
import threading
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cahier.functions import vectors
from cahier.operators import calls, feedback, retrieval, seams, spans
from cahier.operators.chunks import chunk_pages
from cahier.plans import jobs
from cahier.sources import buckets, files
from cahier.streaming import feeds

# Calls


def test_calls_fail_alone_in_order_and_in_time():
    tries, most, now, lock = [], [0], [0], threading.Lock()

    def call(p):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            tries.append(p)
        try:
            time.sleep(0.6 if p == "hang" else 0.01)
            if p == "bad":
                raise ValueError("no")
            if p == "once" and tries.count("once") == 1:
                raise ValueError("at first")
            return None if p == "none" else p.upper()
        finally:
            with lock:
                now[0] -= 1

    prompts = ["a", "bad", "hang", "none", "once", "b"] + [f"x{i}" for i in range(30)]
    began = time.time()
    got = calls.Calls(call, concurrent=4, timeout=0.2, retries=1, pause=0.01).answer(prompts)
    assert got[:6] == [("A", None), (None, "ValueError: no"), (None, "no answer in 0.2 s"), (None, None), ("ONCE", None), ("B", None)]
    assert got[6:] == [(f"X{i}", None) for i in range(30)]
    assert tries.count("bad") == 2 and tries.count("a") == 1 and most[0] <= 6 and time.time() - began < 5
    assert calls.Calls(call).answer([]) == []
    with pytest.raises(TimeoutError):
        calls.Calls(lambda p: time.sleep(3), timeout=0.05, retries=0, most_hung=2).answer(["p", "q", "r"])


def test_generators_of_batches_fail_by_prompt():
    made = []

    def shout(batches):
        made.append(1)
        for s in batches:
            if "bad" in list(s):
                raise ValueError("bad batch")
            yield s.str.upper()

    def eager(batches):
        yield from [s.str.upper() for s in batches]

    data = [pd.Series(["a", "b"]), pd.Series(["c", "bad", "d"]), pd.Series(["e"])]
    want = [[("A", None), ("B", None)], [("C", None), (None, "ValueError: bad batch"), ("D", None)], [("E", None)]]
    assert list(calls.answers(shout, iter(data))) == want and len(made) == 5
    assert list(calls.answers(eager, iter([data[0], data[2]]))) == [want[0], want[2]]


def test_results_are_kept_and_not_sent_again(spark, tmp_path, monkeypatch):
    store, sent = str(tmp_path / "results"), spark.sparkContext.accumulator(0)

    def model(tag):
        def call(p):
            sent.add(1)
            if p.startswith("bad"):
                raise ValueError("no")
            return f"{tag} {p}"

        return calls.Calls(call, retries=0)

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", "bad", None, "", "a"])], "i int, p string")

    def run(tag, rows=df, **more):
        return {r["i"]: (r["out"], r["why"]) for r in calls.generate(rows, "p", model(tag), "out", "Erreur", store=store, error="why", **more).collect()}

    first = run("one")
    assert first == {0: ("one a", None), 1: ("one b", None), 2: ("one a", None), 3: ("Erreur", "ValueError: no"), 4: ("Erreur", None), 5: ("one ", None), 6: ("one a", None)}
    assert sent.value == 4
    assert run("two") == first and sent.value == 4
    more = run("two", df.unionByName(spark.createDataFrame([(7, "new")], "i int, p string")))
    assert more[7] == ("two new", None) and more[0] == first[0] and sent.value == 5
    assert run("three", retry_failed=True) == first and sent.value == 6
    assert run("four", model="other")[0] == ("four a", None) and sent.value == 10
    # Prompts of very many rows take another way, in waves, to the same result.
    monkeypatch.setattr(calls, "FREQUENT_ROWS", 2)
    assert run("five") == first and sent.value == 10
    waves = calls.results(spark.createDataFrame([(str(i), f"p{i}") for i in range(20)], "digest string, prompt string"), model("w"), str(tmp_path / "waves"), per_wave=3)
    assert sorted(r["text"] for r in waves.collect()) == sorted(f"w p{i}" for i in range(20))


def test_jobs_with_calls(spark, tmp_path):
    pages = spark.createDataFrame([("d", "n", 1, "The frame is blue."), ("e", "n", 1, "Broken page.")], "doc_id string, doc_name string, page_number int, text string")

    def call(p):
        if "Broken" in p:
            raise OSError("gone")
        return p[-18:]

    index = jobs.ingest(pages, calls.Calls(call, retries=0), store=str(tmp_path / "s"))
    assert [(r["doc_id"], r["summary"]) for r in index.collect()] == [("d", "The frame is blue.")]
    results = jobs.answer_catalog(pages, index, spark.createDataFrame([("q", "blue")], "question string, query string"), calls.Calls(lambda p: 1 / 0, retries=0), store=str(tmp_path / "s"))
    assert [r["best_answer"] for r in results.collect()] == ["Non trouvé"]


# Summaries and sparse ranking


def test_summary_in_the_row(spark):
    rows = [(0, "One two. Two three! Two? Two."), (1, ""), (2, None), (3, "?! ... !!"), (4, "a. b. c. d. e."), (5, "x x x. y. x y. z."), (6, "no break here")]
    got = {r["i"]: r["summary"] for r in seams.extract_summary(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert got == {0: "One two. Two three! Two?", 1: "", 2: None, 3: "?! ... !!", 4: "a. b. c.", 5: "x x x. y. x y.", 6: "no break here"}


@pytest.mark.parametrize("split", [4096, 5])
def test_topk_by_matrix_and_by_shuffle_agree(spark, monkeypatch, split):
    monkeypatch.setattr(retrieval, "CHUNKS_PER_TASK", split)
    monkeypatch.setattr(retrieval, "SCORES", 12)  # three rows at a time
    r = np.random.default_rng(5)
    rows = [(f"d{d}", i, " ".join(r.choice(list("abcdefg"), r.integers(0, 6)))) for d, n in enumerate([1, 1, 2, 9, 14, 1]) for i in range(n)] + [("d0", 7, None)]
    s = spark.createDataFrame(rows, "doc_id string, chunk_id int, summary string").repartition(3)
    c = spark.createDataFrame([("p", "a b b"), ("q", "c"), ("r", "zzz"), ("s", "")], "question string, query string")
    show = lambda df: sorted((x["doc_id"], x["question"], x["rank"], x["chunk_id"], round(x["score"], 9)) for x in df.collect())
    ours, other = show(retrieval.topk_chunks(s, c, 3)), show(retrieval.topk_by_shuffle(s, retrieval.query_vectors(c), c, 3))
    assert ours == other and len(ours) == 4 * (2 + 1 + 2 + 3 + 3 + 1)
    hits = retrieval.topk_chunks(s, c, 3)
    best = lambda: sorted((x["doc_id"], x["question"], x["chunk_id"], x["response"]) for x in retrieval.extract_answer(hits.drop("score"), s, c).collect())
    scored = lambda: sorted(((x["question"], x["summary"] or "", x["score"] and round(x["score"], 9)) for x in retrieval.response_scores(retrieval.hit_rows(hits.drop("score"), s).withColumn("response", F.col("summary")), c).collect()), key=repr)
    a, b = best(), scored()
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert best() == a and scored() == b
    assert retrieval.topk_chunks(s, c.where("false")).collect() == []


# Files


def test_ranges_of_files(spark, tmp_path):
    (tmp_path / "a b%").mkdir()
    data = {"a b%/x.bin": os.urandom(100_003), "empty": b"", "small": b"xyz", "even": b"e" * 8192}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    listed = files.list_files(spark, str(tmp_path))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    parts = files.read_ranges(listed, 4096)
    back = {}
    for r in parts.collect():
        back.setdefault(r["doc_name"], {})[r["start"]] = bytes(r["content"])
    assert {n: b"".join(p[k] for k in sorted(p)) for n, p in back.items()} == {os.path.basename(n): c for n, c in data.items() if c}
    assert parts.select(F.spark_partition_id()).distinct().count() > 1
    got = {r["doc_id"].rsplit("/", 1)[1]: (r["length"], r["parts"]) for r in files.range_digests(parts).collect()}
    assert got == {"x.bin": (100_003, 25), "small": (3, 1), "even": (8192, 2)}
    assert files.range_digests(parts).select("digest").distinct().count() == 3


def test_pages_leave_as_they_come(spark):
    raw = spark.createDataFrame([("1", "a.pdf", bytearray(b"x")), ("2", "b.pdf", None)], "doc_id string, doc_name string, content binary")

    def read(name, content):
        for i in range(20_000):
            yield {"page_number": i + 1, "text": "t" * 100}
        raise ValueError(f"broken {len(content)}")

    got = seams.extract(raw, read, held_bytes=50_000)
    assert got.where("error is null").count() == 40_000
    assert sorted(r["error"] for r in got.where("error is not null").collect()) == ["broken 1", "object of type 'NoneType' has no len()"]


def test_one_file_of_very_many_pages_in_bounded_memory():
    """The extractor's task by itself: a hundred thousand pages of 10 KB, of which it never holds more than a few MB."""
    import tracemalloc

    captured = {}

    class Frame:
        schema = {"doc_id": type("F", (), {"dataType": type("T", (), {"simpleString": lambda self: "string"})()})()}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            captured["run"] = run

    import pyarrow as pa

    seams.extract(Frame(), lambda n, c: ({"page_number": i, "text": "x" * 10_000} for i in range(100_000)))
    batch = pa.RecordBatch.from_pydict({"doc_id": ["d"], "doc_name": ["n"], "content": [b"c"]})
    tracemalloc.start()
    assert sum(b.num_rows for b in captured["run"](iter([batch]))) == 100_000
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_bytes_of_files_are_not_shuffled(spark, tmp_path):
    rows = [("1", "b.txt", bytearray(b"later")), ("1", "a.txt", bytearray(b"first")), ("2", "c.txt", bytearray(b"two")), ("4", "k.txt", bytearray(b"known")), ("5", None, bytearray(b"no name"))]
    raw = spark.createDataFrame(rows, "doc_id string, doc_name string, content binary")
    index = spark.createDataFrame([("4",)], "doc_id string")
    fresh, rejected = jobs.first_files(raw, index)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "content" in plan and not re.search(r" Exchange[^\n]*\n[^\n]*content", plan)
    assert sorted((r["doc_id"], bytes(r["content"])) for r in fresh.collect()) == [("1", b"first"), ("2", b"two"), ("5", b"no name")]
    assert sorted((r["doc_id"], r["doc_name"]) for r in rejected.collect()) == [("1", "b.txt"), ("4", "k.txt")]
    # The same id and name twice, with other and with equal bytes: one of them.
    twice = raw.unionByName(spark.createDataFrame([("1", "a.txt", bytearray(b"other")), ("2", "c.txt", bytearray(b"two"))], raw.schema))
    fresh, rejected = jobs.first_files(twice, index)
    assert sorted(r["doc_id"] for r in fresh.collect()) == ["1", "2", "5"] and rejected.count() == 4
    made, _ = jobs.index_files(raw, index, originals=str(tmp_path / "originals"))
    assert {r["doc_id"]: r["summary"] for r in made.collect()} == {"1": "first", "2": "two", "5": "no name"}
    assert spark.read.parquet(str(tmp_path / "originals")).count() == 3


# Dense vectors


@pytest.mark.parametrize("sizes", [(16384, 4096), (30, 3)])
def test_dense_topk(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "GROUP_ITEMS", sizes[0])
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", sizes[1])
    r = np.random.default_rng(2)
    items = [("big" if i < 250 else f"o{i % 7}", i, r.normal(size=5).tolist()) for i in range(300)]
    items += [("big", 1000 + i, [1.0, 1.0, 0.0, 0.0, 0.0]) for i in range(40)] + [("zero", 2000, [0.0] * 5), ("big", 2001, [0.0] * 5)]
    queries = [(f"q{i}", r.normal(size=5).tolist()) for i in range(8)] + [("zero", [0.0] * 5), ("tie", [1.0, 1.0, 0.0, 0.0, 0.0])]
    bad = [("bad", 3000, None), ("bad", 3001, [1.0, None, 0.0, 0.0, 0.0]), ("big", 3002, [float("nan")] * 5), ("big", 3003, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(items + bad, "o string, i long, v array<double>").repartition(3)
    asked = spark.createDataFrame([*queries, ("null", None), ("nan", [float("nan")] * 5)], "q string, v array<double>")
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    want = []
    for q, v in queries:
        by = {}
        for o, i, w in items:
            by.setdefault(o, []).append((-round(float(unit(v) @ unit(w)), 9), i))
        want += [(o, q, n + 1, i) for o, each in by.items() for n, (_, i) in enumerate(sorted(each)[:4])]
    got = retrieval.rank_topk(vectors.dense_topk(df, asked, 4, "o", "i", "q", "v"), 4, ("o", "q"), "i")
    assert sorted((x["o"], x["q"], x["rank"], x["i"]) for x in got.collect()) == sorted(want)
    assert vectors.dense_topk(df, asked, None, "o", "i", "q", "v").count() == len(items) * len(queries)
    assert vectors.dense_topk(df.where("false"), asked, 4, "o", "i", "q", "v").collect() == []


def test_balls_that_are_too_far_are_passed_over(spark):
    r = np.random.default_rng(4)
    centres = np.eye(16)
    rows = [("d", i, (centres[i % 16] + 0.02 * r.normal(size=16)).tolist()) for i in range(4000)]
    df, asked = spark.createDataFrame(rows, "o string, i long, v array<double>"), spark.createDataFrame([(f"q{i}", centres[i].tolist()) for i in range(16)], "q string, v array<double>")
    pruned, pairs = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = retrieval.rank_topk(vectors.dense_topk(df, asked, 3, "o", "i", "q", "v", pruned, pairs), 3, ("o", "q"), "i").collect()
    m = np.array([v for *_, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert {(x["q"], x["rank"], x["i"]) for x in got} == {(f"q{i}", n + 1, int(j)) for i in range(16) for n, j in enumerate(np.argsort(-(m @ centres[i]))[:3])}
    assert pruned.value > 0.5 * pairs.value > 0


# Spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé😀", max_size=40), st.lists(st.text(alphabet="abé😀", max_size=4), max_size=6))
def test_all_places_of_spans(text, asked):
    want = [[i + 1 for i in range(len(text)) if s and text.startswith(s, i)] for s in asked]
    assert spans.PageHashes(text).find(asked) == want


def test_locate_span_overlapping_repeated_and_missing(spark, monkeypatch):
    pages = spark.createDataFrame([("d", 1, "anana banana"), ("d", None, "one page"), ("e", 1, None)], "doc_id string, page_number int, text string")
    chunks = spark.createDataFrame([("d", 0, 1, 0, 3), ("d", 1, 1, 6, 12), ("d", 2, None, 0, 3), ("d", 3, 9, 0, 1), ("e", 0, 1, 0, 1), ("d", 4, 1, 2, 2), ("d", 5, 1, -1, 3)], "doc_id string, chunk_id int, page_number int, start_char int, end_char int")
    asked = [("d", i) for i in range(6)] + [("d", 0), ("d", 77), ("x", 0), ("e", 0)]
    df = spark.createDataFrame(asked, "doc_id string, chunk_id int")

    def show():
        return sorted(((r["doc_id"], r["chunk_id"], r["span_text"], r["places"], r["first_at"], r["error"]) for r in spans.locate_span(df, chunks, pages).collect()), key=repr)

    want = [("d", 0, "ana", [1, 3, 8, 10], 1, None)] * 2 + [("d", 1, "banana", [7], 7, None), ("d", 2, "one", [1], 1, None), ("d", 3, None, None, None, "unknown page"), ("e", 0, None, None, None, "unknown page")]
    want += [("d", 4, "", [], 0, "not found"), ("d", 5, None, [], 0, "not found"), ("d", 77, None, None, None, "unknown chunk"), ("x", 0, None, None, None, "unknown document")]
    assert show() == sorted(want, key=repr)
    monkeypatch.setattr(spans, "SPANS", 1)
    assert show() == sorted(want, key=repr)


# Streams


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, doc_name string, page_number int, text string, n_pages int")


def test_documents_wait_for_their_pages(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = pages_of(spark, []).schema

    def arrive(rows):
        pages_of(spark, rows).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        feeds.run_ingest(stream, out, chunk_pages, state, "n_pages", patience=2).awaitTermination()

    def index():
        return sorted((r["doc_id"], r["chunk_id"], r["page_number"] or 0, r["text"]) for r in feeds.read_index(spark, out).collect())

    p = lambda d, i, n: (d, "n", i, f"Text {i} of {d}.", n)
    arrive([p("a", 3, 3), p("b", 1, None), p("c", None, 1), p("late", 2, 9)])
    assert [r[0] for r in index()] == ["c"]
    arrive([p("a", 1, 3), p("b", 2, None)])
    arrive([p("a", 2, 3), p("a", 2, 3)])
    assert [r[:3] for r in index()] == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("c", 0, 0)]
    before = index()
    # The last batch is run again, as after a failure before its commit: nothing is added.
    last = max(glob.glob(f"{state}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)
    os.remove(os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc"))
    arrive([p("c", 7, 1)])
    assert [r for r in index() if r[0] != "b"] == before
    assert [r[:3] for r in index() if r[0] == "b"] == [("b", 0, 1), ("b", 1, 2)]
    assert [r["page_number"] for r in spark.read.parquet(f"{out}/late").collect()] == [7]
    feeds.finish_ingest(spark, out, schema, chunk_pages)
    assert [r[:3] for r in index() if r[0] == "late"] == [("late", 0, 2)]
    whole = chunk_pages(pages_of(spark, [p("a", i, 3) for i in (1, 2, 3)]))
    assert sorted((r["chunk_id"], r["text"]) for r in whole.collect()) == [(r[1], r[3]) for r in index() if r[0] == "a"]
    feeds.finish_ingest(spark, str(tmp_path / "nothing"), schema, chunk_pages)


def test_the_gate_opens_once(spark, tmp_path):
    path, out, state, gate = (str(tmp_path / x) for x in ("in", "out", "state", "gate"))
    opened = []

    def arrive(n):
        spark.range(n).select((F.col("id") % 3).cast("string").alias("question"), F.lit("r").alias("response"), F.lit(0.5).alias("score")).coalesce(1).write.mode("append").json(path)
        feeds.run_counts(feeds.feedback_counts(spark, path, 1), out, state, gate, on_open=opened.append).awaitTermination()
        return tuple(spark.read.parquet(f"{gate}/status").select("status", "count").first())

    assert arrive(99) == ("not_enough_feedback", 99) and opened == []
    assert arrive(1) == ("ok", 100) and opened == [100]
    assert arrive(50) == ("ok", 150) and opened == [100]
    row = spark.read.parquet(f"{gate}/opened").first()
    assert (row["count"], row["batch_id"]) == (feedback.MINIMUM, 1)
    # The batch that opened it is run again: its row stays one.
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 150


# Buckets


def test_documents_are_replaced_in_their_shards(spark, tmp_path):
    path = str(tmp_path / "t")
    assert buckets.open_table(spark, path) is None
    buckets.replace_documents(spark.range(3000).select((F.col("id") % 1000).alias("doc_id"), F.lit("old").alias("x")), path)
    before = set(glob.glob(f"{path}/*/*.parquet"))
    buckets.replace_documents(spark.createDataFrame([(5, "new"), (5, "more"), (10_000, "new")], "doc_id long, x string"), path)
    after = set(glob.glob(f"{path}/*/*.parquet"))
    assert len(before) <= buckets.SHARDS * buckets.BUCKETS and len(before & after) >= len(before) * 13 // 16
    spark.sql(f"DROP TABLE {buckets.name_of(path)}")  # as another session, which knows only the path
    t = buckets.open_table(spark, path)
    assert t.count() == 3000 and sorted(r["x"] for r in t.where("doc_id in (5, 10000)").collect()) == ["more", "new", "new"]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in t.alias("a").join(t.alias("b"), "doc_id")._jdf.queryExecution().executedPlan().toString()
        hits = spark.range(50).withColumnRenamed("id", "doc_id").join(t, "doc_id")._jdf.queryExecution().executedPlan().toString()
        assert hits.count("Exchange hash") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_files_are_written_by_name_to_few_folders(spark, tmp_path):
    rows = [(i, "é" * (i % 7) + "\n" * (i % 3)) for i in range(300)]
    path = f"file:{tmp_path}/new files"
    files.write_files(spark.createDataFrame(rows, "doc_id long, text string"), path, 4)
    files.write_files(spark.createDataFrame(rows, "doc_id long, text string"), path, 4)  # a rerun writes the same
    assert len(list((tmp_path / "new files").iterdir())) == 4
    assert {p.name: p.read_bytes() for p in (tmp_path / "new files").glob("*/*")} == {f"{i}.txt": f"{t}\n".encode() for i, t in rows}


def test_a_text_is_cut_and_cleaned_once_for_its_summary(spark):
    """the plan holds the cutting of sentences and each step of cleaning once, however often the summary is used."""
    from cahier.functions import text as t
    from cahier.operators import summaries

    chunks = t.clean_pages(spark.createDataFrame([(1, "A one.  B two one! C. D one two three? "), (2, None)], "i int, text string"))
    made = summaries.usable_summary(seams.extract_summary(chunks)).select("i", "summary")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?<=[.?!])") == plan.count(" {2,}") == 1
    assert [(r["i"], r["summary"]) for r in made.collect()] == [(1, "A one. B two one! D one two three?")]


def test_hits_are_counted_where_they_are_ranked(spark, monkeypatch):
    """F8: no row per document and question is shuffled for its count; long documents and large catalogues agree."""
    rows = [(d, c, f"alpha beta {d} word{c}") for d, n in ((1, 1), (2, 7), (3, 3), (4, 1), (5, 5)) for c in range(n)]
    s = spark.createDataFrame(rows, "doc_id long, chunk_id int, summary string")
    c = spark.createDataFrame([("a", "alpha word1"), ("b", "nothing of it"), ("c", "")], "question string, query string")
    want = sorted((d, q, k) for d, k in ((1, 1), (2, 5), (3, 3), (4, 1), (5, 5)) for q in "abc")
    counts = lambda: sorted((r["doc_id"], r["question"], r["k"]) for r in retrieval.hit_counts(s, c).collect())
    exchanges = re.findall(r"hashpartitioning\([^\n]*", retrieval.hit_counts(s, c)._jdf.queryExecution().executedPlan().toString())
    assert exchanges and not any("question" in x for x in exchanges) and counts() == want
    monkeypatch.setattr(retrieval, "CHUNKS_PER_TASK", 2)
    assert counts() == want
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert counts() == want and retrieval.hit_counts(s, c.where("false")).collect() == []
