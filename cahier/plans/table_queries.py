"""Registered queries on project tables, reports, feedback and streams, with their SQL.

Customers stand for projects, orders for questions (so questions repeat), line items for answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cahier import schemas
from cahier.operators import chunks as c
from cahier.operators import feedback as fb
from cahier.operators import projects as p
from cahier.operators.spans import locate_span as locate
from cahier.plans import jobs
from cahier.plans.text_queries import SQL_CONV, conv_pages, scratch, sql_chunks, table
from cahier.session import cut_lineage
from cahier.sources import tables
from cahier.streaming import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def projects(spark, sf_dir) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("uploaded_at"))
    joined = table(spark, sf_dir, "customer").join(first, "c_custkey", "left")
    return joined.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), "uploaded_at", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("csv"))


def queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("best_answer"))


def answers(spark, sf_dir) -> DataFrame:
    """Ids from the rows' whole content, so that equal order and line numbers have an order."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", *[F.lpad(F.col(x).cast("string"), 8, "0") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return lines.select(key.alias("id"), F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("response"), F.col("l_discount").alias("score"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("doc_name"), F.lit(None).cast("int").alias("page_number"), F.col("l_linenumber").alias("chunk_id"), F.col("l_linestatus").alias("excerpt"))


SQL_TABLES = """pr AS (SELECT c_custkey::VARCHAR AS id, c_name AS name, (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS uploaded_at FROM customer),
qu AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS project_id, o_orderpriority AS question, o_orderstatus AS best_answer FROM orders),
an AS (SELECT lpad(l_orderkey::VARCHAR, 8, '0') || '-' || lpad(l_linenumber::VARCHAR, 8, '0') || '-' || lpad(l_partkey::VARCHAR, 8, '0') || '-' || lpad(l_suppkey::VARCHAR, 8, '0') AS id,
  l_orderkey AS query_id, l_returnflag AS response, l_discount AS score, l_linenumber AS chunk_id, l_linestatus AS excerpt FROM lineitem),
lq AS (SELECT * FROM qu QUALIFY row_number() OVER (PARTITION BY project_id, question ORDER BY id DESC) = 1)"""


@query("""SELECT user_id, event_id, CASE WHEN lack <> '' THEN 'missing: ' || lack END AS error FROM (
SELECT user_id, event_id, concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'doc_id' END, CASE WHEN event_id % 5 = 0 THEN 'name' END, CASE WHEN event_id % 11 = 0 THEN 'results' END) AS lack FROM events)""")
def required_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    records = e.select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, "d").alias("doc_id"), F.when(F.col("event_id") % 5 != 0, "n").otherwise("").alias("name"), F.when(F.col("event_id") % 11 != 0, F.col("props")).alias("results"))
    return p.required_fields(records, "doc_id", "name", "results").select("user_id", "event_id", "error")


def records(spark, sf_dir) -> DataFrame:
    """Results as JSON: each customer's orders as questions with their line items as alternatives."""
    a = answers(spark, sf_dir)
    item = F.struct("response", "score", "chunk_id", "excerpt")
    lists = a.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", item.alias("a"))))["a"].alias("alternatives"))
    q = queries(spark, sf_dir).join(lists, F.col("id") == F.col("query_id"), "left")
    label = F.concat_ws(" ", "question", F.col("id").cast("string"))
    entry = F.struct(label.alias("key"), F.struct(label.alias("question"), "best_answer", F.coalesce("alternatives", F.array().cast(lists.schema["alternatives"].dataType)).alias("alternatives")).alias("value"))
    return q.groupBy(F.col("project_id").alias("doc_id")).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("results"))


@query("SELECT o_custkey::VARCHAR AS doc_id, o_custkey % 9 = 0 AS malformed, CASE WHEN o_custkey % 9 <> 0 THEN n END AS n_questions FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def parse_results(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("results", F.when(F.col("doc_id").cast("int") % 9 == 0, F.lit("{broken")).otherwise(F.col("results")))
    parsed = p.parse_results(r)
    return parsed.select("doc_id", "malformed", F.when(~F.col("malformed"), F.size("parsed")).cast("bigint").alias("n_questions"))


@query(f"WITH {SQL_TABLES} SELECT id, name FROM pr WHERE id NOT IN (SELECT project_id FROM qu WHERE best_answer = 'P')")
def save_project(spark, sf_dir):
    known = queries(spark, sf_dir).where("best_answer = 'P'").select(F.col("project_id").alias("id")).distinct()
    return p.save_project(projects(spark, sf_dir), known).select("id", "name")


def saved_queries(spark, sf_dir) -> DataFrame:
    return p.surrogate_ids(p.flatten_queries(p.parse_results(records(spark, sf_dir))), "project_id", ["query_ord"])


SQL_SAVED = """sq AS (SELECT row_number() OVER (ORDER BY o_custkey::VARCHAR, o_orderpriority || ' ' || o_orderkey) AS id, o_custkey::VARCHAR AS project_id, o_orderkey,
  o_orderpriority || ' ' || o_orderkey AS question, o_orderstatus AS best_answer FROM orders)"""


@query(f"WITH {SQL_SAVED} SELECT id, project_id, question, best_answer FROM sq")
def flatten_queries(spark, sf_dir):
    return saved_queries(spark, sf_dir).select("id", "project_id", "question", "best_answer")


@query(f"WITH {SQL_TABLES}, {SQL_SAVED} SELECT sq.id AS query_id, (row_number() OVER (PARTITION BY sq.id ORDER BY an.id, response, score, excerpt) - 1)::INT AS pos, chunk_id FROM sq JOIN an ON an.query_id = o_orderkey")
def flatten_answers(spark, sf_dir):
    return p.flatten_answers(saved_queries(spark, sf_dir)).select("query_id", "pos", "chunk_id")


@query(f"WITH {SQL_TABLES}, {SQL_SAVED} SELECT sq.id AS query_id, count(*) AS n, count(excerpt) AS n_excerpts, 0::BIGINT AS n_excerpts_strict, round(sum(score), 6) AS score FROM sq JOIN an ON an.query_id = o_orderkey GROUP BY sq.id")
def saved_columns(spark, sf_dir):
    """What is saved of an answer, with the excerpt looked for under both names and under one only."""
    saved = saved_queries(spark, sf_dir)
    ours = p.flatten_answers(saved).groupBy("query_id").agg(F.count("*").alias("n"), F.count("excerpt").alias("n_excerpts"), F.round(F.sum("score"), 6).alias("score"))
    strict = p.flatten_answers(saved, strict=True).groupBy("query_id").agg(F.count("excerpt").alias("n_excerpts_strict"))
    return ours.join(strict, "query_id")


@query("SELECT o_orderkey AS id, o_custkey::VARCHAR AS project_id, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') THEN 'unknown project' END AS error FROM orders")
def add_query(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").cast("string").alias("id"))
    good, bad = p.add_query(queries(spark, sf_dir), known)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad).select("id", "project_id", "error")


@query(f"""WITH rq AS (SELECT o_orderkey AS request_id, o_custkey::VARCHAR AS project_id, o_orderkey % 5 AS kind, o_orderstatus AS status, o_orderpriority AS question FROM orders),
ck AS (SELECT *, CASE WHEN kind = 1 THEN 'missing: result' WHEN kind = 0 THEN 'malformed result' WHEN project_id NOT IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_mktsegment <> 'BUILDING') THEN 'unknown project' END AS error FROM rq),
nm AS (SELECT request_id, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY project_id, request_id) AS id FROM ck WHERE error IS NULL)
SELECT request_id, id, CASE WHEN error IS NULL THEN status END AS best_answer, CASE WHEN error IS NULL THEN kind - 2 END::BIGINT AS n_answers,
CASE WHEN error IS NULL AND kind > 2 THEN 1000 + sum(CASE WHEN error IS NULL THEN kind - 2 END) OVER (ORDER BY id NULLS LAST) END::BIGINT AS last_answer, error FROM ck LEFT JOIN nm USING (request_id)""")
def add_question(spark, sf_dir):
    """Orders as requests to add a question with its result, some without one, some malformed, with up to two answers;
    numbered on after the saved questions and after a saved answer with the number 1000."""
    kind = F.col("o_orderkey") % 5
    alternative = F.struct(F.lit("r").alias("response"), F.lit(0.5).alias("score"))
    result = F.to_json(F.struct(F.col("o_orderstatus").alias("best_answer"), F.array_repeat(alternative, (kind - 2).cast("int")).alias("alternatives")))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderpriority").alias("question"), F.when(kind == 0, "{").when(kind > 1, result).alias("result"))
    known = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").cast("string").alias("id"))
    made = jobs.add_questions(asked, known, queries(spark, sf_dir), spark.range(1000, 1001), "request_id")
    n = made.answers.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n_answers"), F.max("id").alias("last_answer"))
    good = made.queries.join(n, "id", "left").select("request_id", "id", "best_answer", F.coalesce("n_answers", F.lit(0)).alias("n_answers"), "last_answer")
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(made.rejected.select("request_id", "error"), allowMissingColumns=True)


@query("SELECT event_id AS id, event_type AS name, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS uploaded_at FROM events UNION ALL SELECT o_orderkey, 'order', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders")
def list_projects(spark, sf_dir):
    """Times with fractions from events and without from orders."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.col("ts").alias("uploaded_at"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("name"), F.col("o_orderdate").alias("uploaded_at"))
    rows = e.unionByName(o).withColumn("summary", F.lit(None).cast("string")).withColumn("csv", F.lit(None).cast("string"))
    return p.list_projects(rows).select("id", "name", "uploaded_at")


@query(f"WITH {SQL_TABLES} SELECT id, project_id, question, best_answer FROM lq")
def last_question_wins(spark, sf_dir):
    return p.last_question_wins(queries(spark, sf_dir))


@query(f"""WITH {SQL_TABLES} SELECT lq.project_id, lq.question, lq.best_answer, count(an.id) AS n_answers, round(coalesce(sum(score), 0), 6) AS total, coalesce(string_agg(response || chunk_id, ',' ORDER BY an.id, response, score, excerpt), '') AS listed
FROM lq LEFT JOIN an ON an.query_id = lq.id GROUP BY ALL""")
def project_history(spark, sf_dir):
    a = answers(spark, sf_dir)
    history = p.project_history(queries(spark, sf_dir), a.withColumn("id", F.struct("id", "response", "score", "excerpt")))
    total = F.round(F.aggregate("alternatives", F.lit(0.0), lambda s, x: s + x["score"]), 6)
    listed = F.array_join(F.transform("alternatives", lambda x: F.concat(x["response"], x["chunk_id"].cast("string"))), ",")
    return history.select("project_id", "question", "best_answer", F.size("alternatives").cast("bigint").alias("n_answers"), total.alias("total"), listed.alias("listed"))


@query(f"""WITH {SQL_TABLES}, rq AS (SELECT DISTINCT user_id::VARCHAR AS project_id FROM events)
SELECT project_id, question, count(an.id) AS n_answers, NULL AS error FROM rq JOIN lq USING (project_id) LEFT JOIN an ON an.query_id = lq.id GROUP BY project_id, question
UNION ALL SELECT project_id, NULL, NULL, 'unknown project' FROM rq WHERE project_id NOT IN (SELECT id FROM pr)""")
def history_of(spark, sf_dir):
    """The users of events as requested projects, most of which are unknown."""
    asked = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("project_id")).distinct()
    found, unknown = p.history_of(asked, projects(spark, sf_dir), queries(spark, sf_dir), answers(spark, sf_dir))
    shown = found.select("project_id", "question", F.size("alternatives").cast("bigint").alias("n_answers"), F.lit(None).cast("string").alias("error"))
    return shown.unionByName(unknown, allowMissingColumns=True)


@query(f"""WITH {SQL_TABLES}, gone AS (SELECT id FROM pr WHERE id::INT % 4 = 0), ql AS (SELECT * FROM qu WHERE project_id NOT IN (SELECT id FROM gone))
SELECT 'projects' AS tab, count(*) AS n FROM pr WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'queries', count(*) FROM ql
UNION ALL SELECT 'answers', count(*) FROM an WHERE query_id NOT IN (SELECT id FROM qu WHERE project_id IN (SELECT id FROM gone))""")
def drop_project(spark, sf_dir):
    left = p.drop_project(projects(spark, sf_dir).where("cast(id as int) % 4 = 0"), projects(spark, sf_dir), queries(spark, sf_dir), answers(spark, sf_dir))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n") for name, df in zip(("projects", "queries", "answers"), left)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {SQL_TABLES} SELECT id, query_id FROM an WHERE query_id NOT IN (SELECT id FROM qu WHERE best_answer <> 'F')")
def fk_check(spark, sf_dir):
    return p.fk_check(answers(spark, sf_dir), "query_id", queries(spark, sf_dir).where("best_answer <> 'F'")).select("id", "query_id")


@query(f"""WITH {SQL_TABLES} SELECT lq.project_id AS doc_id, lq.question, (row_number() OVER (PARTITION BY lq.id ORDER BY an.id, response, score, excerpt))::INT AS number, response, format('{{:.3f}}', score) AS score,
'No summary' AS summary, '/highlight/?doc_id=' || lq.project_id || '&page=&chunk_id=' || chunk_id AS link FROM lq JOIN an ON an.query_id = lq.id
UNION ALL SELECT project_id, question, NULL, NULL, NULL, 'No summary', NULL FROM lq WHERE id NOT IN (SELECT query_id FROM an)""")
def report_rows(spark, sf_dir):
    a = answers(spark, sf_dir).withColumn("id", F.struct("id", "response", "score", "excerpt"))
    history = p.project_history(queries(spark, sf_dir), a)
    return p.report_rows(history.withColumnRenamed("project_id", "doc_id")).select("doc_id", "question", "number", "response", F.when(F.col("number").isNotNull(), F.col("score")).alias("score"), "summary", "link")


@query(f"""{sql_chunks(SQL_CONV, 120)}, rq AS (SELECT doc_id, chunk_id FROM ch UNION ALL SELECT doc_id, 100000 FROM pg WHERE pn = 1 UNION ALL SELECT -doc_id - 1, 0 FROM pg WHERE pn = 1),
sp AS (SELECT rq.doc_id, rq.chunk_id, ch.page_number, CASE WHEN start_char >= 0 THEN substr(text_, start_char + 1, end_char - start_char) END AS span, text_ FROM rq LEFT JOIN ch USING (doc_id, chunk_id) LEFT JOIN (SELECT doc_id, pn, text AS text_ FROM pg) g ON g.doc_id = ch.doc_id AND g.pn = ch.pn),
pl AS (SELECT *, CASE WHEN text_ IS NULL THEN NULL WHEN coalesce(span, '') = '' THEN [] ELSE list_filter(range(1, length(text_) - length(span) + 2), lambda i: substr(text_, i, length(span)) = span) END AS places FROM sp)
SELECT doc_id, chunk_id, page_number, md5(span) AS span, len(places)::INT AS occurrences, array_to_string(places, ',') AS places,
CASE WHEN doc_id < 0 THEN 'unknown document' WHEN page_number IS NULL THEN 'unknown chunk' WHEN coalesce(len(places), 0) = 0 THEN 'not found' END AS error FROM pl""")
def locate_span(spark, sf_dir):
    pages = conv_pages(spark, sf_dir)
    made = cut_lineage(c.chunk_pages(pages, 120))
    docs = pages.select("doc_id").distinct()
    asked = made.select("doc_id", "chunk_id").unionByName(docs.select("doc_id", F.lit(100000).alias("chunk_id"))).unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(0).alias("chunk_id")))
    return locate(asked, made, pages).select("doc_id", "chunk_id", "page_number", F.md5("span_text").alias("span"), "occurrences", F.array_join("places", ",").alias("places"), "error")


# Feedback.


def feedback(spark, sf_dir) -> DataFrame:
    y = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return table(spark, sf_dir, "documents").join(y, "doc_id").select("doc_id", F.col("source").alias("question"), F.col("text").alias("response"), "score")


def event_feedback(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("question"), F.col("props").alias("response"), F.col("value").alias("score"))


@query("SELECT event_type AS question, count(*) AS n, count(*) FILTER (value BETWEEN 0 AND 1) AS valid FROM events GROUP BY event_type")
def feedback_domain(spark, sf_dir):
    return event_feedback(spark, sf_dir).groupBy("question").agg(F.count("*").alias("n"), F.count_if(fb.in_domain()).alias("valid"))


@query("SELECT CASE WHEN count(*) < 100 THEN 'not_enough_feedback' ELSE 'ok' END AS status, count(*) AS count FROM labels JOIN documents USING (doc_id)")
def feedback_gate(spark, sf_dir):
    return fb.feedback_gate(feedback(spark, sf_dir))


@query("SELECT doc_id, source AS question, text AS response, quality::DOUBLE AS label FROM labels JOIN documents USING (doc_id)")
def training_pairs(spark, sf_dir):
    pairs = fb.training_pairs(feedback(spark, sf_dir), keep=("doc_id",))
    return pairs.select("doc_id", F.col("texts")[0].alias("question"), F.col("texts")[1].alias("response"), "label")


@query("""WITH k AS (SELECT doc_id, ('0x' || substr(md5('0|' || doc_id), 1, 15))::BIGINT AS k FROM labels JOIN documents USING (doc_id)),
n AS (SELECT doc_id, row_number() OVER (ORDER BY k, doc_id) - 1 AS r FROM k) SELECT doc_id, (r // 8)::BIGINT AS batch, (r % 8)::INT AS "at" FROM n""")
def training_batches(spark, sf_dir):
    return fb.training_batches(feedback(spark, sf_dir), ("doc_id",)).select("doc_id", "batch", "at")


@query("SELECT event_type AS question, props AS response, value AS score FROM events")
def append_feedback(spark, sf_dir):
    """The events appended to a log in two goes and read back."""
    path, rows = scratch(spark, "feedback"), event_feedback(spark, sf_dir)
    tables.append_feedback(rows.where("score < 10"), path)
    tables.append_feedback(rows.where("not (score < 10)"), path)
    return spark.read.schema(schemas.FEEDBACK).json(path)


@query("SELECT event_type AS question, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def read_feedback(spark, sf_dir):
    path = scratch(spark, "feedback")
    tables.append_feedback(event_feedback(spark, sf_dir), path)
    return tables.read_feedback(spark, path).groupBy("question").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(f"WITH {SQL_TABLES} SELECT pr.id, pr.name, count(DISTINCT qu.id) AS n_queries FROM pr LEFT JOIN qu ON qu.project_id = pr.id GROUP BY ALL")
def table_sink(spark, sf_dir):
    """The three tables written and read back, and joined."""
    path = scratch(spark, "tables")
    lines = answers(spark, sf_dir).withColumn("id", F.xxhash64("id"))
    tables.write_tables(path, projects(spark, sf_dir), queries(spark, sf_dir), lines)
    pr, qu, _ = tables.read_tables(spark, path)
    n = qu.groupBy("project_id").agg(F.count("*").alias("n_queries"))
    return pr.join(n, pr["id"] == n["project_id"], "left").select("id", "name", F.coalesce("n_queries", F.lit(0)).alias("n_queries"))


@query("""SELECT event_type AS question, count(*) AS n, round(sum(value), 4) AS total, CASE WHEN sum(count(*)) OVER () < 100 THEN 'not_enough_feedback' ELSE 'ok' END AS status, sum(count(*)) OVER ()::BIGINT AS every, sum(count(*)) OVER () >= 100 AS opened FROM events GROUP BY event_type""")
def feedback_stream(spark, sf_dir):
    """The log as a stream of files, two at a time, with running counts per question and the gate over all of them."""
    path, out, gate = scratch(spark, "feedback"), scratch(spark, "counts"), scratch(spark, "gate")
    event_feedback(spark, sf_dir).repartition(4).write.json(path)
    feeds.run_counts(feeds.feedback_counts(spark, path, 2), out, scratch(spark, "state"), gate).awaitTermination()
    status = spark.read.parquet(f"{gate}/status").select("status", F.col("count").alias("every"))
    opened = feeds.read_if_there(spark, f"{gate}/opened", feeds.GATE).agg((F.count("*") == 1).alias("opened"))
    counts = spark.read.parquet(out).select("question", "n", F.round("total", 4).alias("total"))
    return counts.crossJoin(F.broadcast(status)).crossJoin(F.broadcast(opened))


@query(f"{sql_chunks(SQL_CONV)} SELECT doc_id, count(*) AS n_chunks, md5(string_agg(raw_chunk, '|' ORDER BY chunk_id)) AS texts, CASE WHEN doc_id % 3 = 0 THEN (SELECT count(*) FROM conversations c WHERE c.conv_id = ch.doc_id) ELSE 0 END AS n_late FROM ch GROUP BY doc_id")
def ingest_stream(spark, sf_dir):
    """Conversations whose pages arrive in three files; every other one says how many pages it has, the others wait for the
    end. Every third comes once more when it is in the index, and is found among the late pages."""
    path, out, state = scratch(spark, "pages"), scratch(spark, "index"), scratch(spark, "state")
    pages = conv_pages(spark, sf_dir)
    n = F.when(F.col("doc_id") % 2 == 0, F.count("*").over(Window.partitionBy("doc_id")).cast("int"))
    pages = cut_lineage(pages.withColumn("n_pages", n))

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(path)
        feeds.run_ingest(stream, out, c.chunk_pages, state, "n_pages", patience=2).awaitTermination()

    for part in range(3):
        arrive(pages.where(F.col("page_number") % 3 == part))
    for _ in range(2):
        arrive(pages.where("false"))
    arrive(pages.where("doc_id % 3 = 0"))
    feeds.finish_ingest(spark, out, pages.schema, c.chunk_pages)
    late = feeds.read_if_there(spark, f"{out}/late", pages.schema).groupBy("doc_id").agg(F.count("*").alias("n_late"))
    texts = F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("chunk_id", "text")))["text"], "|")).alias("texts")
    made = feeds.read_index(spark, out).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), texts)
    return made.join(late, "doc_id", "left").withColumn("n_late", F.coalesce("n_late", F.lit(0)))
