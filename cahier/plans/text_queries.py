"""Registered queries on sources, cleaning, chunks, summaries, retrieval and answers, with their SQL."""

from __future__ import annotations

import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cahier.functions import text as t
from cahier.functions.vectors import dense_topk
from cahier.operators import answers as a
from cahier.operators import chunks as c
from cahier.operators import ingest, retrieval, seams, summaries
from cahier.operators.calls import Calls, generate
from cahier.operators.nested import unfold
from cahier.plans import jobs
from cahier.session import cut_lineage, ensure_checkpoint_dir, keep
from cahier.sources import catalog as cat
from cahier.sources import files
from cahier.sources.buckets import open_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# The inputs of the stages, from the driver's tables.


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*[F.lit(e) for e in (".PDF", ".docx", ".png", ".JPG", ".jpeg", ".tiff", ".txt")])
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("doc_name"), F.lit(None).cast("int").alias("page_number"), "text")


def conv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")
    return files.number_pages(turns).select("doc_id", F.concat(F.lit("conv"), F.col("doc_id").cast("string")).alias("doc_name"), "page_number", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question"), F.col("text").alias("query"))


def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers to the user turns before them: doc_id, rank, query, response."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("rank"), F.col("text").alias("query"))
    made = turns.where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), (F.col("turn") - 1).alias("rank"), F.col("text").alias("response"))
    return user.join(made, ["doc_id", "rank"]).withColumn("question", F.lit("q"))


# SQL building blocks.

W = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
MARK = "chr(57344)"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{W}+', ''), '{W}+$', '')"


def sql_plain(x: str) -> str:
    return f"translate({x}, '•·–—―’“”', '-----''\"\"')"


def sql_controls(x: str) -> str:
    return rf"regexp_replace({x}, '[\x00-\x1F\x7F]', ' ', 'g')"


def sql_spaces(x: str) -> str:
    return f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"


def sql_marks(x: str) -> str:
    return rf"regexp_replace({x}, '([.,;:!?])([\p{{L}}\p{{N}}_])', '\1 \2', 'g')"


def sql_clean(x: str) -> str:
    return sql_strip(sql_marks(sql_spaces(sql_controls(sql_plain(f"coalesce({x}, '')")))))


def sql_sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.?!]){W}+', '\1' || {MARK}, 'g'), {MARK})"


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


EXT = "list_extract(['.PDF', '.docx', '.png', '.JPG', '.jpeg', '.tiff', '.txt'], (doc_id % 7 + 1)::INT)"
SQL_PAGES = f"pg AS (SELECT doc_id, 'doc' || doc_id || {EXT} AS doc_name, NULL::INT AS page_number, -1 AS pn, coalesce(text, '') AS text FROM documents)"
SQL_CONV = f"pg AS (SELECT conv_id AS doc_id, 'conv' || conv_id AS doc_name, n AS page_number, n AS pn, {sql_strip('text')} AS text FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS n FROM conversations))"


def sql_chunks(pages: str, limit: int = 3000) -> str:
    """CTEs up to ``ch``: doc_id, doc_name, page_number, pn, chunk_id, raw_chunk, text (cleaned), start_char, end_char."""
    return f"""WITH RECURSIVE {pages},
sent AS (SELECT doc_id, pn, unnest(x) AS s, generate_subscripts(x, 1) AS ord FROM (SELECT doc_id, pn, {sql_sentences('text')} AS x FROM pg)),
pk(doc_id, pn, ord, chunk, used) AS (
  SELECT doc_id, pn, ord, CASE WHEN length(s) < {limit} THEN 0 ELSE 1 END, length(s) + 1 FROM sent WHERE ord = 1
  UNION ALL
  SELECT s.doc_id, s.pn, s.ord, CASE WHEN used + length(s) < {limit} THEN chunk ELSE chunk + 1 END,
         CASE WHEN used + length(s) < {limit} THEN used + length(s) + 1 ELSE length(s) + 1 END
  FROM pk JOIN sent s ON s.doc_id = pk.doc_id AND s.pn = pk.pn AND s.ord = pk.ord + 1),
grp AS (
  SELECT doc_id, pn, chunk, {sql_strip("string_agg(s, ' ' ORDER BY ord)")} AS raw_chunk, arg_min(s, ord) AS first_s, count(*) AS n_sentences
  FROM pk JOIN sent USING (doc_id, pn, ord) GROUP BY ALL
  UNION ALL SELECT doc_id, pn, 0, '', NULL, 0 FROM pk WHERE ord = 1 AND chunk = 1),
kept AS (SELECT * FROM grp QUALIFY NOT (raw_chunk = '' AND chunk = max(chunk) OVER (PARTITION BY doc_id, pn))),
off(doc_id, pn, chunk, start_char, end_char) AS (
  SELECT doc_id, pn, chunk, a, a + length(raw_chunk) FROM (
    SELECT k.*, CASE WHEN coalesce(first_s, '') = '' THEN 0 ELSE instr(text, first_s) - 1 END AS a FROM kept k JOIN pg USING (doc_id, pn) WHERE chunk = 0)
  UNION ALL
  SELECT doc_id, pn, chunk, a, a + length(raw_chunk) FROM (
    SELECT k.*, CASE WHEN first_s = '' THEN o.end_char WHEN instr(substr(text, o.end_char + 1), first_s) = 0 THEN -1 ELSE o.end_char + instr(substr(text, o.end_char + 1), first_s) - 1 END AS a
    FROM off o JOIN kept k ON k.doc_id = o.doc_id AND k.pn = o.pn AND k.chunk = o.chunk + 1 JOIN pg ON pg.doc_id = k.doc_id AND pg.pn = k.pn)),
per AS (SELECT doc_id, pn, count(*) AS n FROM kept GROUP BY ALL),
base AS (SELECT doc_id, pn, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM per),
ch AS (SELECT k.doc_id, doc_name, page_number, k.pn, (b + k.chunk)::INT AS chunk_id, raw_chunk, {sql_clean('raw_chunk')} AS text, start_char::INT AS start_char, end_char::INT AS end_char, n_sentences
       FROM kept k JOIN base USING (doc_id, pn) JOIN off USING (doc_id, pn, chunk) JOIN pg USING (doc_id, pn))"""


SQL_SUMMARY = f"""cs AS (SELECT doc_id, chunk_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, chunk_id, {sql_sentences('text')} AS x FROM ch)),
ct AS (SELECT doc_id, chunk_id, pos, token, count(*) AS n FROM (SELECT doc_id, chunk_id, pos, unnest({sql_tokens('s')}) AS token FROM cs) GROUP BY ALL),
cw AS (SELECT doc_id, chunk_id, pos, sum(tf) AS w FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, chunk_id, token) AS tf FROM ct) GROUP BY ALL),
cr AS (SELECT cs.*, row_number() OVER (PARTITION BY cs.doc_id, cs.chunk_id ORDER BY coalesce(w, 0) DESC, cs.pos) AS r FROM cs LEFT JOIN cw USING (doc_id, chunk_id, pos)),
sm AS (SELECT doc_id, chunk_id, string_agg(s, ' ' ORDER BY pos) AS summary FROM cr WHERE r <= 3 GROUP BY ALL),
ix AS (SELECT ch.doc_id, doc_name, chunk_id, page_number, pn, {sql_strip('summary')} AS summary, start_char, end_char FROM ch JOIN sm USING (doc_id, chunk_id)
       WHERE summary <> '' AND lower({sql_strip('summary')}) NOT IN ('non pertinent', 'erreur'))"""
SQL_TOPK = f"""cq AS (SELECT 'q' || item_id AS question, text AS query FROM benchmark),
qt AS (SELECT question, token, count(*) AS qtf FROM (SELECT question, unnest({sql_tokens('query')}) AS token FROM cq) GROUP BY ALL),
qn AS (SELECT question, sum(qtf * qtf) AS q2 FROM qt GROUP BY ALL),
st AS (SELECT doc_id, chunk_id, token, count(*) AS tf FROM (SELECT doc_id, chunk_id, unnest({sql_tokens('summary')}) AS token FROM ix) GROUP BY ALL),
sn AS (SELECT doc_id, chunk_id, sum(tf * tf) AS c2 FROM st GROUP BY ALL),
dt AS (SELECT doc_id, chunk_id, question, sum(tf * qtf) AS dot FROM st JOIN qt USING (token) GROUP BY ALL),
sc AS (SELECT ix.doc_id, ix.chunk_id, cq.question, coalesce(dot / (sqrt(c2::DOUBLE) * sqrt(q2::DOUBLE)), 0) AS score
       FROM ix CROSS JOIN cq LEFT JOIN dt USING (doc_id, chunk_id, question) LEFT JOIN sn USING (doc_id, chunk_id) LEFT JOIN qn USING (question)),
tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 5)"""
SQL_QA = """qa AS (SELECT u.conv_id AS doc_id, u.turn AS rank, u.text AS query, m.text AS response, 'q' AS question
  FROM conversations u JOIN conversations m ON m.conv_id = u.conv_id AND m.turn = u.turn + 1 WHERE u.role = 'user' AND m.role = 'assistant')"""


def sql_cosine(source: str, x: str, y: str, keys: str) -> str:
    """CTEs xt, yt and cosines: keys, score of columns x and y of a source."""
    return f"""xt AS (SELECT {keys}, token, count(*) AS x FROM (SELECT {keys}, unnest({sql_tokens(x)}) AS token FROM {source}) GROUP BY ALL),
yt AS (SELECT {keys}, token, count(*) AS y FROM (SELECT {keys}, unnest({sql_tokens(y)}) AS token FROM {source}) GROUP BY ALL),
co AS (SELECT {keys}, coalesce(sum(x * y), 0) / (sqrt(sum(x * x)::DOUBLE) * sqrt(sum(y * y)::DOUBLE)) AS score FROM xt FULL JOIN yt USING ({keys}, token) GROUP BY ALL)"""


SQL_ANSWERS = f"""hs AS (SELECT doc_id, question, rank, unnest(x) AS s, generate_subscripts(x, 1) AS i, list_distinct({sql_tokens('query')}) AS asked
       FROM (SELECT tk.*, query, {sql_sentences('summary')} AS x FROM tk JOIN ix USING (doc_id, chunk_id) JOIN cq USING (question))),
hn AS (SELECT doc_id, question, rank, s, i, len(list_intersect(list_distinct({sql_tokens('s')}), asked)) AS n FROM hs),
an AS (SELECT doc_id, question, rank, CASE WHEN max(n) > 0 THEN arg_max(s, (n, -i)) ELSE 'RAS' END AS response FROM hn GROUP BY ALL),
ok AS (SELECT an.*, query FROM an JOIN cq USING (question) WHERE response <> '' AND NOT contains(lower(response), 'ras')),
{sql_cosine('ok', 'query', 'response', 'doc_id, question, rank')}"""


# Sources.


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS length, md5(coalesce(text, '') || chr(10)) AS digest, (octet_length(encode(coalesce(text, ''))) // 8192 + 1)::BIGINT AS parts FROM documents")
def src_files(spark, sf_dir):
    """A file for each document, read whole and by ranges of 8,192 bytes."""
    path = scratch(spark, "files")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files.write_files(docs.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id"), path)
    listed = files.list_files(spark, path)
    whole = files.read_listed(listed).select("doc_id", F.md5("content").alias("digest"))
    parts = files.range_digests(files.read_ranges(listed, 8192)).select("doc_id", "length", "parts")
    own = F.regexp_extract("doc_id", "/(-?[0-9]+)[.]txt$", 1).cast("bigint").alias("doc_id")
    return parts.join(whole, "doc_id").select(own, "length", "digest", "parts")


@query(f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'pdf' WHEN doc_id % 7 = 1 THEN 'docx' WHEN doc_id % 7 < 6 THEN 'image' ELSE 'text' END AS kind FROM documents")
def route_type(spark, sf_dir):
    return files.classify(doc_pages(spark, sf_dir)).select("doc_id", "kind")


@query("SELECT doc_id, NULL::INT AS page_number, text FROM documents")
def decode_text(spark, sf_dir):
    raw = doc_pages(spark, sf_dir).select("doc_id", "doc_name", F.encode("text", "UTF-8").alias("content"))
    return files.decode_text(raw).select("doc_id", "page_number", "text")


@query(f"""WITH p AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, NULL::INT AS page_number, coalesce(string_agg(s, chr(10) ORDER BY pos) FILTER ({sql_strip('s')} <> ''), '') AS text FROM p GROUP BY doc_id""")
def join_paragraphs(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return files.join_paragraphs(each)


@query(f"WITH {SQL_CONV} SELECT doc_id, page_number, text FROM pg")
def number_pages(spark, sf_dir):
    return conv_pages(spark, sf_dir).select("doc_id", "page_number", "text")


@query(f"""WITH {SQL_CONV} SELECT doc_id, CASE WHEN length(text) % 5 <> 0 THEN page_number END AS page_number,
CASE WHEN length(text) % 5 = 0 THEN '[Erreur lors de l''extraction : broken ' || page_number || ']' ELSE text END AS text FROM pg""")
def extract_guard(spark, sf_dir):
    pages = conv_pages(spark, sf_dir)
    broken = F.when(F.length("text") % 5 == 0, F.concat(F.lit("broken "), F.col("page_number").cast("string")))
    return files.extract_guard(pages.withColumn("error", broken)).select("doc_id", "page_number", "text")


@query(f"""SELECT doc_id, count(*) AS n_blank FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS s FROM documents
UNION ALL SELECT doc_id, '  ' FROM documents WHERE doc_id % 3 = 0) WHERE {sql_strip('s')} = '' GROUP BY doc_id""")
def blank_pages(spark, sf_dir):
    """Documents cut at empty lines, every third with a page of blanks more."""
    docs = table(spark, sf_dir, "documents")
    each = docs.select("doc_id", F.explode(F.split("text", "\n\n")).alias("text")).unionByName(docs.where("doc_id % 3 = 0").select("doc_id", F.lit("  ").alias("text")))
    return files.blank_pages(each)


@query("SELECT 'doc' || doc_id AS doc_id, octet_length(encode(text)) AS length, md5(text) AS digest FROM documents")
def keep_original(spark, sf_dir):
    path = scratch(spark, "originals")
    raw = doc_pages(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_id"), "doc_name", F.encode("text", "UTF-8").alias("content"))
    files.keep_original(raw, path)
    return spark.read.parquet(path).select("doc_id", F.length("content").cast("bigint").alias("length"), F.md5("content").alias("digest"))


@query("""SELECT item_id AS doc_id, 0 AS query_ord, 'q' || item_id AS question, text AS query FROM benchmark
UNION ALL SELECT item_id, 1, 'first word', string_split(text, ' ')[1] FROM benchmark""")
def load_catalog(spark, sf_dir):
    """A catalogue of two questions per item, written as JSON and exploded again."""
    items = table(spark, sf_dir, "benchmark")
    entries = F.create_map(F.concat(F.lit("q"), F.col("item_id").cast("string")), F.col("text"), F.lit("first word"), F.split("text", " ")[0])
    path = scratch(spark, "catalogues")
    items.select("item_id", F.to_json(entries).alias("json")).write.json(path)
    read = spark.read.schema("item_id bigint, json string").json(path)
    return read.select(F.col("item_id").alias("doc_id"), F.posexplode(cat.parse_catalog(F.col("json"))).alias("query_ord", "question", "query"))


# Cleaning, step by step.


def _step(name, spark_step, sql_step):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", spark_step("text").alias("text"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql_step('text')} AS text FROM documents")(run)


_step("clean_null", lambda x: t.no_null(F.when(F.col("doc_id") % 2 == 0, F.col(x))), lambda x: f"coalesce(CASE WHEN doc_id % 2 = 0 THEN {x} END, '')")
_step("clean_typo", lambda x: t.plain_marks(F.concat(x, F.lit(" “a” – b’c • d"))), lambda x: sql_plain(f"{x} || ' “a” – b’c • d'"))
_step("clean_ctrl", t.no_controls, sql_controls)
_step("clean_spaces", lambda x: t.single_spaces(F.replace(x, F.lit(" "), F.lit("  "))), lambda x: sql_spaces(f"replace({x}, ' ', '  ')"))
_step("clean_punct", lambda x: t.spaced_marks(F.replace(x, F.lit(". "), F.lit("."))), lambda x: sql_marks(f"replace({x}, '. ', '.')"))
_step("clean_strip", lambda x: t.strip(F.concat(F.lit(" \u00a0\t"), x, F.lit("\n\u2003 "))), lambda x: sql_strip(f"' ' || chr(160) || chr(9) || {x} || chr(10) || chr(8195) || ' '"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def clean_nfkc(spark, sf_dir):
    """The texts of this table hold nothing that NFKC changes more than NFC does, which the SQL has."""
    return t.nfkc(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"SELECT doc_id, source, {sql_clean('text')} AS text FROM documents")
def clean_pages(spark, sf_dir):
    return t.clean_pages(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


# Chunks.


@query(f"SELECT doc_id, unnest(x) AS sentence, (generate_subscripts(x, 1) - 1)::INT AS pos FROM (SELECT doc_id, {sql_sentences('text')} AS x FROM documents)")
def split_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.sentences("text")).alias("pos", "sentence"))


@query(f"{sql_chunks(SQL_PAGES)} SELECT doc_id, chunk_id, raw_chunk AS text FROM ch")
def pack_chunks(spark, sf_dir):
    return c.chunk_pages(doc_pages(spark, sf_dir)).select("doc_id", "chunk_id", "text")


@query(f"{sql_chunks(SQL_PAGES, 200)} SELECT doc_id, chunk_id, length(raw_chunk)::INT AS n_chars FROM ch WHERE length(raw_chunk) >= 200")
def long_sentence(spark, sf_dir):
    """Chunks over a small limit, which hold one sentence that was not cut."""
    return c.chunk_pages(doc_pages(spark, sf_dir), 200).select("doc_id", "chunk_id", F.length("text").alias("n_chars")).where("n_chars >= 200")


@query(f"{sql_chunks(SQL_PAGES, 60)} SELECT doc_id, chunk_id, start_char, end_char FROM ch WHERE raw_chunk = ''")
def empty_lead_chunk(spark, sf_dir):
    return c.chunk_pages(doc_pages(spark, sf_dir), 60).where("text = ''").select("doc_id", "chunk_id", "start_char", "end_char")


@query(f"{sql_chunks(SQL_PAGES, 500)} SELECT doc_id, chunk_id, raw_chunk AS text FROM ch")
def chunk_text_join(spark, sf_dir):
    return c.chunk_pages(doc_pages(spark, sf_dir), 500).select("doc_id", "chunk_id", "text")


@query(f"{sql_chunks(SQL_PAGES, 500)} SELECT doc_id, chunk_id, start_char, end_char FROM ch")
def chunk_offsets(spark, sf_dir):
    return c.chunk_pages(doc_pages(spark, sf_dir), 500).select("doc_id", "chunk_id", "start_char", "end_char")


@query(f"{sql_chunks(SQL_CONV.replace(sql_strip('text'), 'CASE WHEN n % 2 = 0 THEN chr(32) ELSE text END'))} SELECT doc_id, page_number, chunk_id FROM ch")
def skip_blank(spark, sf_dir):
    """Every other page blanked: such pages give no chunk and use no id."""
    turns = table(spark, sf_dir, "conversations").withColumn("page_number", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    text = F.when(F.col("page_number") % 2 == 0, " ").otherwise(F.col("text"))
    return c.chunk_pages(turns.select(F.col("conv_id").alias("doc_id"), F.lit("c").alias("doc_name"), "page_number", text.alias("text"))).select("doc_id", "page_number", "chunk_id")


@query(f"{sql_chunks(SQL_CONV, 120)} SELECT doc_id, page_number, chunk_id, start_char, end_char FROM ch")
def chunk_ids(spark, sf_dir):
    return c.chunk_pages(conv_pages(spark, sf_dir), 120).select("doc_id", "page_number", "chunk_id", "start_char", "end_char")


@query(f"""{sql_chunks(SQL_PAGES.replace("'doc' || doc_id || " + EXT, "coalesce(CASE WHEN doc_id % 2 = 0 THEN 'd' END, 'unknown')").replace("coalesce(text, '')", "coalesce(CASE WHEN doc_id % 5 <> 0 THEN text END, '')"))}
SELECT doc_id, doc_name, page_number, chunk_id FROM ch""")
def chunk_defaults(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    pages = pages.withColumn("doc_name", F.when(F.col("doc_id") % 2 == 0, "d")).withColumn("text", F.when(F.col("doc_id") % 5 != 0, F.col("text")))
    return c.chunk_pages(pages).select("doc_id", "doc_name", "page_number", "chunk_id")


# Ingest control.


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ingest.new_docs(docs.unionByName(docs.withColumn("source", F.lit("~"))), table(spark, sf_dir, "labels"), arrival="source")


@query("SELECT doc_id, source, 'document already indexed' AS error FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def dup_docs(spark, sf_dir):
    return ingest.dup_docs(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"))


@query("SELECT event_id, user_id AS doc_id, CASE WHEN user_id IN (SELECT doc_id FROM labels) THEN NULL ELSE 'unknown document' END AS error FROM events")
def require_doc(spark, sf_dir):
    known, unknown = ingest.require_doc(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id")), table(spark, sf_dir, "labels"))
    return known.withColumn("error", F.lit(None).cast("string")).unionByName(unknown).select("event_id", "doc_id", "error")


# Summaries.


def index(spark, sf_dir, pages=doc_pages) -> DataFrame:
    return jobs.ingest(pages(spark, sf_dir))


@query(f"SELECT doc_id, {sql_strip(repr(summaries.PROMPT) + " || coalesce(text, '')")} AS prompt FROM documents")
def summary_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", summaries.summary_prompt("text").alias("prompt"))


@query(f"{sql_chunks(SQL_PAGES)}, {SQL_SUMMARY} SELECT doc_id, chunk_id, summary FROM sm")
def summarize(spark, sf_dir):
    return seams.extract_summary(t.clean_pages(c.chunk_pages(doc_pages(spark, sf_dir)))).select("doc_id", "chunk_id", "summary")


_MARKED = "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN ' NON Pertinent ' WHEN 2 THEN 'Erreur' ELSE '' END"


@query(f"SELECT conv_id, turn, summary FROM (SELECT conv_id, turn, {_MARKED} AS summary FROM conversations) WHERE summary <> '' AND lower({sql_strip('summary')}) NOT IN ('non pertinent', 'erreur')")
def usable_summary(spark, sf_dir):
    return summaries.usable_summary(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_MARKED).alias("summary")))


@query(f"{sql_chunks(SQL_PAGES)}, {SQL_SUMMARY} SELECT doc_id, doc_name, chunk_id, page_number, summary, start_char, end_char FROM ix")
def summary_rows(spark, sf_dir):
    return index(spark, sf_dir)


@query(f"{sql_chunks(SQL_PAGES)}, {SQL_SUMMARY} SELECT doc_id, count(*) AS segments FROM ix GROUP BY doc_id")
def segment_count(spark, sf_dir):
    return c.segment_count(index(spark, sf_dir))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def global_text(spark, sf_dir):
    return summaries.global_text(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id"), order="turn", text="text")


@query(f"WITH ch AS (SELECT conv_id AS doc_id, 0 AS chunk_id, string_agg(text, chr(10) ORDER BY turn) AS text, '' AS doc_name, 0 AS page_number, 0 AS pn, 0 AS start_char, 0 AS end_char FROM conversations GROUP BY conv_id), {SQL_SUMMARY} SELECT doc_id, summary FROM sm")
def global_summary(spark, sf_dir):
    joined = summaries.global_text(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id"), order="turn", text="text")
    return seams.extract_summary(joined).select("doc_id", "summary")


# Retrieval.


@query(f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY ALL")
def encode(spark, sf_dir):
    return seams.token_counts(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query("SELECT doc_id, 'q' || item_id AS question FROM documents, benchmark")
def doc_query_pairs(spark, sf_dir):
    return retrieval.doc_query_pairs(table(spark, sf_dir, "documents"), questions(spark, sf_dir)).select("doc_id", "question")


@query(f"WITH r AS (SELECT conv_id AS doc_id, text AS a, text || ' ' || role AS b FROM conversations WHERE role = 'user'), {sql_cosine('r', 'a', 'b', 'doc_id, a')} SELECT doc_id, md5(a) AS request, round(score, 6) AS score FROM co")
def adhoc_query(spark, sf_dir):
    """One question for one document: its own text is what is looked for, here in the text with the speaker's role."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("question"), "role")
    pairs = retrieval.adhoc_pairs(turns)
    rows = pairs.join(turns.select("doc_id", "question", F.concat_ws(" ", "question", "role").alias("b")), ["doc_id", "question"])
    return retrieval.text_cosine(rows, ["doc_id", "question"], "query", "b").select("doc_id", F.md5("question").alias("request"), F.round("score", 6).alias("score"))


@query("SELECT a.vec_id, b.vec_id AS query_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0")
def cosine_dense(spark, sf_dir):
    """The stated queries, ids divisible by 50, against all rows."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("one", F.lit(0))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense_topk(vectors, asked, None, "one", "vec_id", "query_id", "embedding").select("vec_id", "query_id", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_QA}, {sql_cosine('qa', 'query', 'response', 'doc_id, rank')} SELECT doc_id, rank, round(score, 6) AS score FROM co")
def cosine_sparse(spark, sf_dir):
    return retrieval.text_cosine(answer_rows(spark, sf_dir), ["doc_id", "rank"], "query", "response").select("doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"{sql_chunks(SQL_PAGES)}, {SQL_SUMMARY}, {SQL_TOPK} SELECT doc_id, question, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM tk")
def topk_chunks(spark, sf_dir):
    hits = retrieval.topk_chunks(cut_lineage(index(spark, sf_dir)), questions(spark, sf_dir))
    return hits.select("doc_id", "question", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT a.label AS doc_id, a.vec_id, b.vec_id AS query_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0)
SELECT doc_id, query_id, vec_id, (row_number() OVER (PARTITION BY doc_id, query_id ORDER BY round(score, 9) DESC, vec_id))::INT AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 5""")
def topk_dense(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), "vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    best = dense_topk(vectors, asked, 5, "doc_id", "vec_id", "query_id", "embedding")
    return retrieval.rank_topk(best, 5, ("doc_id", "query_id"), "vec_id").select("doc_id", "query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"{sql_chunks(SQL_PAGES)}, {SQL_SUMMARY} SELECT doc_id, 'q' || item_id AS question, least(5, count(*))::BIGINT AS k FROM ix CROSS JOIN benchmark GROUP BY doc_id, item_id")
def clamp_k(spark, sf_dir):
    """How many hits each question gets: five, or as many as there are summaries."""
    return retrieval.hit_counts(cut_lineage(index(spark, sf_dir)), questions(spark, sf_dir))


@query(f"{sql_chunks(SQL_CONV)}, {SQL_SUMMARY}, {SQL_TOPK} SELECT doc_id, question, chunk_id, rank::INT AS rank, round(score, 6) AS score, page_number, summary FROM tk JOIN ix USING (doc_id, chunk_id)")
def hit_rows(spark, sf_dir):
    summaries_ = cut_lineage(index(spark, sf_dir, conv_pages))
    hits = retrieval.hit_rows(retrieval.topk_chunks(summaries_, questions(spark, sf_dir)), summaries_)
    return hits.select("doc_id", "question", "chunk_id", "rank", F.round("score", 6).alias("score"), "page_number", "summary")


# Answers.


@query(f"WITH {SQL_QA} SELECT doc_id, rank, printf({repr(a.PROMPT.replace('%s', '{}'))}, response, query) AS prompt FROM qa".replace("printf(", "format(E"))
def qa_prompt(spark, sf_dir):
    return answer_rows(spark, sf_dir).select("doc_id", "rank", a.qa_prompt(F.col("response"), F.col("query")).alias("prompt"))


@query(f"{sql_chunks(SQL_CONV)}, {SQL_SUMMARY}, {SQL_TOPK}, {SQL_ANSWERS} SELECT doc_id, question, rank::INT AS rank, response FROM an")
def answer(spark, sf_dir):
    summaries_ = cut_lineage(index(spark, sf_dir, conv_pages))
    asked = questions(spark, sf_dir)
    hits = retrieval.topk_chunks(summaries_, asked)
    return retrieval.extract_answer(hits, summaries_, asked).select("doc_id", "question", "rank", "response")


def unsteady(marker: str, calls_: Calls) -> Calls:
    """A stand-in for a model behind a network: it fails on some prompts, hangs on others, and returns nothing to some."""

    def call(prompt: str) -> str | None:
        if len(prompt) % 7 == 0:
            raise ConnectionError("refused")
        if len(prompt) % 101 == 1:
            time.sleep(1.5)
        return None if len(prompt) % 11 == 0 else f"{marker} {prompt[:20]}"

    return replace(calls_, call=call)


@query("""WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS t, text IS NULL AS no FROM conversations)
SELECT conv_id, turn, CASE WHEN no OR length(t) % 7 = 0 OR length(t) % 101 = 1 OR length(t) % 11 = 0 THEN 'Erreur' ELSE 'first ' || substr(t, 1, 20) END AS made,
CASE WHEN no THEN NULL WHEN length(t) % 7 = 0 THEN 'ConnectionError: refused' WHEN length(t) % 101 = 1 THEN 'no answer in 0.3 s' END AS error FROM p""")
def generator_calls(spark, sf_dir):
    """All turns as prompts to a generator that fails on some; a second run over the same table of results sends nothing,
    or its texts would differ."""
    store, turns = scratch(spark, "calls"), table(spark, sf_dir, "conversations")
    how = Calls(lambda p: None, concurrent=16, timeout=0.3, retries=1, pause=0.01)
    n = 4 * spark.sparkContext.defaultParallelism
    first = generate(turns, "text", unsteady("first", how), "made", seams.FAILED, n, store, error="error")
    first.write.format("noop").mode("overwrite").save()
    again = generate(turns, "text", unsteady("second", how), "made", seams.FAILED, n, store, error="error")
    return again.select("conv_id", "turn", "made", "error")


@query(f"WITH {SQL_QA} SELECT doc_id, rank, response FROM qa WHERE response <> '' AND NOT contains(lower(response), 'ras')")
def abstain_filter(spark, sf_dir):
    return a.abstain_filter(answer_rows(spark, sf_dir)).select("doc_id", "rank", "response")


def scored_answers(spark, sf_dir) -> DataFrame:
    rows = a.abstain_filter(answer_rows(spark, sf_dir))
    return rows.join(retrieval.text_cosine(rows, ["doc_id", "rank"], "query", "response"), ["doc_id", "rank"])


SQL_SCORED = f"WITH {SQL_QA}, ok AS (SELECT * FROM qa WHERE response <> '' AND NOT contains(lower(response), 'ras')), {sql_cosine('ok', 'query', 'response', 'doc_id, rank')}, sa AS (SELECT ok.*, score FROM ok JOIN co USING (doc_id, rank))"


@query(f"{SQL_SCORED} SELECT doc_id, rank, round(score, 6) AS score FROM sa")
def answer_score(spark, sf_dir):
    return scored_answers(spark, sf_dir).select("doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"{SQL_SCORED} SELECT doc_id, rank FROM sa WHERE rank % 4 = 0 AND score IS NOT NULL")
def score_guard(spark, sf_dir):
    bad = F.when(F.col("rank") % 4 == 0, F.col("score")).otherwise(F.lit(float("nan")))
    return a.score_guard(scored_answers(spark, sf_dir).withColumn("score", bad)).select("doc_id", "rank")


@query(f"{SQL_SCORED} SELECT c.doc_id, coalesce(b.best, 'Non trouvé') AS best_answer FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) c LEFT JOIN (SELECT doc_id, arg_max(response, (score, -rank)) AS best FROM sa WHERE score > -1 GROUP BY doc_id) b USING (doc_id)")
def best_answer(spark, sf_dir):
    pairs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("q").alias("question")).distinct()
    return a.best_answer(pairs, scored_answers(spark, sf_dir)).select("doc_id", "best_answer")


@query(f"{SQL_SCORED} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank))::INT AS number, response FROM sa")
def alternatives(spark, sf_dir):
    rows = scored_answers(spark, sf_dir)
    for name, kind in (("summary", "string"), ("doc_name", "string"), ("page_number", "int"), ("chunk_id", "int"), ("excerpt", "string"), ("start_char", "int"), ("end_char", "int")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    lists = rows.groupBy("doc_id").agg(a.alternatives(rows).alias("x"))
    return lists.select("doc_id", F.posexplode("x").alias("pos", "a")).select("doc_id", (F.col("pos") + 1).alias("number"), "a.response")


@query(f"WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE chr(160) || ' ' END AS raw_text FROM conversations) SELECT conv_id, turn FROM r WHERE {sql_strip('raw_text')} <> ''")
def drop_blank_excerpt(spark, sf_dir):
    raw = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit("\u00a0 "))
    return a.drop_blank_excerpt(table(spark, sf_dir, "conversations").withColumn("raw_text", raw)).select("conv_id", "turn")


@query(f"{sql_chunks(SQL_PAGES, 500)} SELECT doc_id, chunk_id, least(start_char, greatest(0, length(pg.text) - 100))::INT AS start_char, least(end_char, greatest(0, length(pg.text) - 100))::INT AS end_char FROM ch JOIN pg USING (doc_id, pn)")
def clamp_span(spark, sf_dir):
    """Offsets against a page that has become 100 characters shorter."""
    pages = doc_pages(spark, sf_dir)
    rows = a.with_raw_page(c.chunk_pages(pages, 500), pages.withColumn("text", F.expr("substring(text, 1, greatest(0, length(text) - 100))")))
    short = a.clamp_span(rows.withColumn("start_char", F.col("start_char")))
    return short.select("doc_id", "chunk_id", "start_char", "end_char")


@query("SELECT event_id, round(value / 7, 3) AS score FROM events")
def round_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") / 7, 3).alias("score"))


SQL_NESTED = f"""{sql_chunks(SQL_CONV)}, {SQL_SUMMARY}, {SQL_TOPK}, {SQL_ANSWERS},
sa AS (SELECT ok.*, score, chunk_id FROM ok JOIN co USING (doc_id, question, rank) JOIN (SELECT doc_id, question, rank, chunk_id FROM tk) USING (doc_id, question, rank) WHERE score IS NOT NULL),
ba AS (SELECT doc_id, question, arg_max(response, (score, -rank)) AS best FROM sa WHERE score > -1 GROUP BY ALL),
al AS (SELECT sa.doc_id, question, (row_number() OVER (PARTITION BY sa.doc_id, question ORDER BY score DESC, rank))::INT AS number, response, round(score, 3) AS score, ix.page_number, sa.chunk_id,
         md5(pg.text) AS excerpt, least(start_char, length(pg.text))::INT AS start_char, least(end_char, length(pg.text))::INT AS end_char
       FROM sa JOIN ix USING (doc_id, chunk_id) JOIN pg ON pg.doc_id = sa.doc_id AND pg.pn = ix.pn WHERE {sql_strip('pg.text')} <> ''),
nr AS (SELECT d.doc_id, cq.question, coalesce(best, 'Non trouvé') AS best_answer, number, response, score, page_number, chunk_id, excerpt, start_char, end_char
       FROM (SELECT DISTINCT doc_id FROM ix) d CROSS JOIN cq LEFT JOIN ba USING (doc_id, question) LEFT JOIN al USING (doc_id, question))"""


def _flat(results: DataFrame) -> DataFrame:
    each = results.select("doc_id", "question", "best_answer", F.posexplode_outer("alternatives").alias("pos", "a"))
    return each.select("doc_id", "question", "best_answer", (F.col("pos") + 1).alias("number"), "a.response", "a.score", "a.page_number", "a.chunk_id", F.md5("a.excerpt").alias("excerpt"), "a.start_char", "a.end_char")


def conv_results(spark, sf_dir) -> DataFrame:
    pages = conv_pages(spark, sf_dir)
    return jobs.answer_catalog(pages, jobs.ingest(pages), questions(spark, sf_dir))


@query(f"{SQL_NESTED} SELECT * FROM nr")
def nest_results(spark, sf_dir):
    """Ingest and the whole catalogue over the conversations as documents of many pages."""
    return _flat(conv_results(spark, sf_dir))


@query(f"{SQL_NESTED} SELECT DISTINCT doc_id, question, CASE WHEN doc_id % 2 = 0 THEN 'rerun' ELSE best_answer END AS best_answer FROM nr")
def index_results(spark, sf_dir):
    """Results written per document; a second run of every other document replaces only theirs."""
    path, pages = scratch(spark, "results"), conv_pages(spark, sf_dir)
    a.index_results(jobs.answer_documents(pages, jobs.ingest(pages), questions(spark, sf_dir)), path)
    rerun = F.transform("results", lambda r: r.withField("best_answer", F.lit("rerun")))
    again = keep(open_table(spark, path).drop("shard").where("doc_id % 2 = 0").withColumn("results", rerun))
    a.index_results(again, path)
    return unfold(open_table(spark, path)).select("doc_id", "question", "best_answer")


SQL_FLAGSHIP = f"""{sql_chunks(SQL_PAGES)}, {SQL_SUMMARY}, {SQL_TOPK}, {SQL_ANSWERS},
sa AS (SELECT ok.*, score FROM ok JOIN co USING (doc_id, question, rank) WHERE score IS NOT NULL),
ba AS (SELECT doc_id, question, arg_max(response, (score, -rank)) AS best, count(*) AS n FROM sa WHERE score > -1 GROUP BY ALL)
SELECT d.doc_id, cq.question, coalesce(best, 'Non trouvé') AS best_answer, coalesce(n, 0)::INT AS n_alternatives FROM (SELECT DISTINCT doc_id FROM ix) d CROSS JOIN cq LEFT JOIN ba USING (doc_id, question)"""


@query(SQL_FLAGSHIP)
def catalogue_answers(spark, sf_dir):
    """The flagship: all documents ingested and asked all questions."""
    pages = doc_pages(spark, sf_dir)
    results = jobs.answer_catalog(pages, jobs.ingest(pages), questions(spark, sf_dir))
    return results.select("doc_id", "question", "best_answer", F.size("alternatives").alias("n_alternatives"))


SQL_ASKED = f"""{sql_chunks(SQL_CONV)}, {SQL_SUMMARY},
rq AS (SELECT DISTINCT conv_id AS doc_id, text AS question FROM conversations WHERE role = 'user' AND conv_id IN (SELECT doc_id FROM ix)),
rt AS (SELECT doc_id, question, token, count(*) AS qtf FROM (SELECT doc_id, question, unnest({sql_tokens('question')}) AS token FROM rq) GROUP BY ALL),
rn AS (SELECT doc_id, question, sum(qtf * qtf) AS q2 FROM rt GROUP BY ALL),
st AS (SELECT doc_id, chunk_id, token, count(*) AS tf FROM (SELECT doc_id, chunk_id, unnest({sql_tokens('summary')}) AS token FROM ix) GROUP BY ALL),
sn AS (SELECT doc_id, chunk_id, sum(tf * tf) AS c2 FROM st GROUP BY ALL),
dt AS (SELECT doc_id, chunk_id, question, sum(tf * qtf) AS dot FROM st JOIN rt USING (doc_id, token) GROUP BY ALL),
sc AS (SELECT doc_id, chunk_id, question, summary, coalesce(dot / (sqrt(c2::DOUBLE) * sqrt(q2::DOUBLE)), 0) AS score
       FROM ix JOIN rq USING (doc_id) LEFT JOIN dt USING (doc_id, chunk_id, question) LEFT JOIN sn USING (doc_id, chunk_id) LEFT JOIN rn USING (doc_id, question)),
tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 5),
hs AS (SELECT doc_id, question, rank, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, question, rank, {sql_sentences('summary')} AS x FROM tk)),
hn AS (SELECT *, len(list_intersect(list_distinct({sql_tokens('s')}), list_distinct({sql_tokens('question')}))) AS n FROM hs),
an AS (SELECT doc_id, question, rank, CASE WHEN max(n) > 0 THEN arg_max(s, (n, -i)) ELSE 'RAS' END AS response FROM hn GROUP BY ALL),
ok AS (SELECT * FROM an WHERE response <> '' AND NOT contains(lower(response), 'ras')), {sql_cosine('ok', 'question', 'response', 'doc_id, question, rank')},
ba AS (SELECT doc_id, question, arg_max(response, (score, -rank)) AS best, count(*) AS n FROM ok JOIN co USING (doc_id, question, rank) WHERE score IS NOT NULL GROUP BY ALL)"""


@query(f"""{SQL_ASKED} SELECT doc_id, md5(question) AS request, coalesce(best, 'Non trouvé') AS best_answer, coalesce(n, 0)::INT AS n_alternatives, NULL AS error FROM rq LEFT JOIN ba USING (doc_id, question)
UNION ALL SELECT DISTINCT -conv_id - 1, md5(text), NULL, NULL::INT, 'unknown document' FROM conversations WHERE role = 'user'""")
def adhoc_answer(spark, sf_dir):
    """Every user turn as a question on its own conversation, and on one that is unknown."""
    pages = conv_pages(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("question"))
    asked = turns.unionByName(turns.withColumn("doc_id", -F.col("doc_id") - 1))
    results, unknown = jobs.answer_requests(asked, pages, jobs.ingest(pages))
    shown = results.select("doc_id", F.md5("question").alias("request"), "best_answer", F.size("alternatives").alias("n_alternatives"), F.lit(None).cast("string").alias("error"))
    return shown.unionByName(unknown.select("doc_id", F.md5("question").alias("request"), "error"), allowMissingColumns=True)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_vectors(batches):
    """A stand-in for a sentence encoder that SQL knows as well: how often each letter occurs."""
    for texts in batches:
        yield texts.fillna("").map(lambda s: [float(s.count(x)) for x in LETTERS])


def sql_letters(x: str) -> str:
    return f"[{', '.join(f'length({x}) - length(replace({x}, {c!r}, {chr(39) * 2}))' for c in LETTERS)}]::DOUBLE[]"


def sql_letter_cosine(x: str, y: str) -> str:
    return f"coalesce(list_dot_product({x}, {y}) / (greatest(sqrt(list_dot_product({x}, {x})), 1e-12) * greatest(sqrt(list_dot_product({y}, {y})), 1e-12)), 0)"


SQL_DENSE = f"""{sql_chunks(SQL_CONV)}, {SQL_SUMMARY},
cq AS (SELECT 'q' || item_id AS question, text AS query, {sql_letters('text')} AS qv FROM benchmark),
iv AS (SELECT doc_id, chunk_id, {sql_letters('summary')} AS v FROM ix),
sc AS (SELECT doc_id, chunk_id, question, {sql_letter_cosine('v', 'qv')} AS score FROM iv CROSS JOIN cq),
tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 5), {SQL_ANSWERS},
sa AS (SELECT ok.*, {sql_letter_cosine(sql_letters('response'), 'qv')} AS score FROM ok JOIN cq USING (question)),
nb AS (SELECT doc_id, question, round(max(score), 6) AS best_score, count(*) AS n FROM sa GROUP BY ALL)"""


@query(f"{SQL_DENSE} SELECT doc_id, question, best_score, coalesce(n, 0)::INT AS n_alternatives FROM (SELECT DISTINCT doc_id FROM ix) CROSS JOIN cq LEFT JOIN nb USING (doc_id, question)")
def dense_answers(spark, sf_dir):
    """The whole catalogue over the conversations, ranked and scored by an encoder's vectors."""
    pages, asked = conv_pages(spark, sf_dir), questions(spark, sf_dir)
    results = jobs.answer_catalog(pages, jobs.ingest(pages), asked, encoder=letter_vectors)
    best = results.select("doc_id", "question", F.col("best_answer").alias("response"), F.size("alternatives").alias("n_alternatives"))
    scored = retrieval.dense_response_scores(best, asked, letter_vectors)
    return scored.select("doc_id", "question", F.when(F.col("n_alternatives") > 0, F.round("score", 6)).alias("best_score"), "n_alternatives")


def one_page(name: str, content: bytes):
    """A stand-in for a parser of files."""
    return [{"page_number": 1, "text": content.decode()}]


@query(f"""{sql_chunks(SQL_PAGES)}, {SQL_SUMMARY} SELECT doc_id, count(*) AS segments, NULL AS error FROM ix WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 'document already indexed' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def index_files(spark, sf_dir):
    """All documents as files of seven types, indexed but for those that are indexed already."""
    raw = doc_pages(spark, sf_dir).select("doc_id", "doc_name", F.encode("text", "UTF-8").alias("content"))
    made, rejected = jobs.index_files(raw, table(spark, sf_dir, "labels").select("doc_id"), one_page)
    return c.segment_count(made).withColumn("error", F.lit(None).cast("string")).unionByName(rejected.select("doc_id", "error"), allowMissingColumns=True)
