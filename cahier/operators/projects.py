"""Projects, their questions and answers as three related tables: checking, saving, reading back, reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cahier import schemas
from cahier.operators.retrieval import bounded
from cahier.session import cut_lineage


def missing(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def required_fields(records: DataFrame, *fields: str) -> DataFrame:
    """records + error: which of the required fields is null or empty, null if none is."""
    lacking = F.array_join(F.array_compact(F.array(*[F.when(missing(f), F.lit(f)) for f in fields])), ",")
    return records.withColumn("error", F.when(lacking != "", F.concat(F.lit("missing: "), lacking)))


def parse_results(records: DataFrame, strict: bool = False) -> DataFrame:
    """records + parsed (question -> result) and malformed; ``strict`` fails on a malformed record."""
    parsed = F.from_json("results", schemas.SAVED, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return records.withColumn("parsed", parsed).withColumn("malformed", F.col("results").isNotNull() & F.col("parsed").isNull())


def save_project(incoming: DataFrame, projects: DataFrame) -> DataFrame:
    """Those to be added: projects whose id is not there yet. For the others nothing is saved."""
    return incoming.join(projects.select("id"), "id", "left_anti")


def surrogate_ids(rows: DataFrame, owner: str, order: list[str], start: int = 0) -> DataFrame:
    """rows + id: consecutive from ``start`` + 1 in the order of owner, then ``order``.

    Rows are counted per owner and the counts summed up in ranges of owners, so no window spans the table: first
    within a range, then over the few ranges, then within an owner. What ``rows`` takes is worked out once and kept, where
    it lies as it was dealt: rows that are dealt by owner are not shuffled again.
    """
    rows = cut_lineage(rows)
    per = rows.groupBy(owner).agg(F.count("*").alias("_n"))
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = per.repartitionByRange(parts, owner).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # partition ids must not be worked out again
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy("_part").agg(F.sum("_n").alias("_n"))
    starts = sums.select("_part", upto(Window.orderBy("_part")).alias("_start"))  # one row per range
    within = ranged.join(F.broadcast(starts), "_part").select(owner, (F.col("_start") + upto(Window.partitionBy("_part").orderBy(owner))).alias("_base"))
    at = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return rows.join(bounded(within), owner).withColumn("id", (F.lit(start) + F.col("_base") + at).cast("bigint")).drop("_base")


def flatten_queries(parsed: DataFrame) -> DataFrame:
    """project_id, query_ord, question, best_answer, alternatives: one row per question."""
    each = parsed.select(F.col("doc_id").alias("project_id"), F.posexplode("parsed").alias("query_ord", "label", "r"))
    return each.select("project_id", "query_ord", F.col("label").alias("question"), F.col("r.best_answer").alias("best_answer"), F.col("r.alternatives").alias("alternatives"))


def flatten_answers(queries: DataFrame, strict: bool = False) -> DataFrame:
    """query_id, pos and the saved columns: one row per alternative of each question (which has its id).

    The excerpt is looked for under both of its names; ``strict`` looks under chunk_text only and saves no doc_name.
    """
    each = queries.select(F.col("id").alias("query_id"), F.posexplode("alternatives").alias("pos", "a"))
    excerpt = F.col("a.chunk_text") if strict else F.coalesce("a.excerpt", "a.chunk_text")
    name = F.lit(None).cast("string") if strict else F.col("a.doc_name")
    return each.select("query_id", "pos", "a.response", "a.score", "a.summary", name.alias("doc_name"), "a.page_number", "a.chunk_id", excerpt.alias("excerpt"))


def add_query(requests: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions of existing projects, the others with an error); equal questions are not merged."""
    ids = projects.select(F.col("id").alias("project_id"))
    return requests.join(ids, "project_id", "left_semi"), requests.join(ids, "project_id", "left_anti").withColumn("error", F.lit("unknown project"))


def iso_timestamp(ts: Column) -> Column:
    """ISO text; without a fraction where there is none."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def list_projects(projects: DataFrame) -> DataFrame:
    return projects.select("id", "name", iso_timestamp(F.col("uploaded_at")).alias("uploaded_at"), "summary", "csv")


def last_question_wins(queries: DataFrame) -> DataFrame:
    """Of equal questions of a project the one saved last."""
    by = Window.partitionBy("project_id", "question").orderBy(F.desc("id"))
    return queries.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def project_history(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """project_id, question, best_answer, alternatives: a question without answers keeps an empty list."""
    shown = last_question_wins(queries)
    fields = [c for c in ("response", "summary", "score", "doc_name", "page_number", "chunk_id") if c in answers.columns]
    packed = F.struct("id", F.struct(*fields, F.col("excerpt").alias("chunk_text")).alias("a"))
    lists = answers.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(packed))["a"].alias("alternatives"))
    joined = shown.join(lists, "id", "left")
    return joined.select("project_id", "question", "best_answer", F.coalesce("alternatives", F.array().cast(lists.schema["alternatives"].dataType)).alias("alternatives"))


def history_of(requests: DataFrame, projects: DataFrame, queries: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(histories of the requested projects (project_id), the requests for unknown ones with an error). Only the
    questions and answers of requested projects are read."""
    ids = projects.select(F.col("id").alias("project_id"))
    known = requests.select("project_id").distinct().join(ids, "project_id", "left_semi")
    unknown = requests.join(ids, "project_id", "left_anti").withColumn("error", F.lit("unknown project"))
    asked = queries.join(known, "project_id", "left_semi")
    return project_history(asked, answers.join(asked.select(F.col("id").alias("query_id")), "query_id", "left_semi")), unknown


def drop_project(gone: DataFrame, projects: DataFrame, queries: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the projects in ``gone`` (id), their questions and the answers to these."""
    ids = gone.select(F.col("id").alias("_id"))
    lost = queries.join(ids, queries["project_id"] == ids["_id"], "left_semi").select(F.col("id").alias("_q"))
    left = answers.join(lost, answers["query_id"] == lost["_q"], "left_anti")
    return projects.join(ids, projects["id"] == ids["_id"], "left_anti"), queries.join(ids, queries["project_id"] == ids["_id"], "left_anti"), left


def fk_check(children: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """Children whose key is null or names no parent."""
    ids = parents.select(F.col("id").alias("_id"))
    return children.join(ids, children[key] == ids["_id"], "left_anti")


def report_rows(results: DataFrame, base_url: str = "") -> DataFrame:
    """Display rows: alternative number from 1, score with 3 decimals, page, summary or a default, link."""
    each = results.select("doc_id", "question", "best_answer", F.posexplode_outer("alternatives").alias("pos", "a"))
    link = F.concat(F.lit(f"{base_url}/highlight/?doc_id="), F.col("doc_id").cast("string"), F.lit("&page="), F.coalesce(F.col("a.page_number").cast("string"), F.lit("")), F.lit("&chunk_id="), F.coalesce("a.chunk_id", "pos").cast("string"))
    return each.select("doc_id", "question", "best_answer", (F.col("pos") + 1).alias("number"), F.col("a.response").alias("response"), F.format_string("%.3f", "a.score").alias("score"), F.col("a.page_number").alias("page"), F.coalesce("a.summary", F.lit("No summary")).alias("summary"), F.when(F.col("pos").isNotNull(), link).alias("link"))
