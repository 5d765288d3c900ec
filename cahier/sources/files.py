"""Files to pages: reading, routing by type, decoding, and the rows that extractors return."""

from __future__ import annotations

import fnmatch
import functools
import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cahier.functions.text import is_blank, strip
from cahier.session import keep


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """raw_files: doc_id (the path), doc_name, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("doc_name"), "content")


def write_files(texts: DataFrame, path: str, folders: int = 256) -> None:
    """A file ``path``/folder/``doc_id``.txt for each row of ``texts`` (doc_id, text), its text and a line end.

    Tasks write the files under their own names, so no committer moves a folder per file, and the few folders that they are
    dealt to are all that a reader has to list. A file is put in place whole; a task that is run again writes the same.
    """
    folder = F.lower(F.hex(F.pmod(F.xxhash64("doc_id"), F.lit(folders))))
    rows = texts.select(F.concat_ws("/", F.lit(path), folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("to"), F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "UTF-8").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for to, content in zip(b.column(0).to_pylist(), b.column(1)):
                _put(to, content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _put(path: str, content) -> None:
    if not path.startswith("file:"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner.rsplit("/", 1)[0])
        with store.open_output_stream(inner) as f:
            f.write(content)
        return
    to = unquote(urlsplit(path).path)
    part = f"{to.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    try:
        f = open(part, "wb")
    except FileNotFoundError:
        os.makedirs(to.rsplit("/", 1)[0], exist_ok=True)
        f = open(part, "wb")
    with f:
        f.write(content)
    os.replace(part, to)


#: Bytes of a file that one row holds at most when files are read by ranges.
RANGE_BYTES = 64 << 20
#: Bytes of small ranges that leave a task together.
HELD_BYTES = 1 << 20
#: Files and folders that leave a task together when folders are listed.
LISTED_ROWS = 10_000


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id (the path), doc_name, length: no byte of a file is read. As Spark's reader, it passes over empty and hidden files.

    Tasks list the folders, level by level, and the driver holds no file's name; Spark's reader has the driver list all.
    """
    context = spark.sparkContext
    given = context._jvm.org.apache.hadoop.fs.Path(path)
    root = given.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(given).toString()
    names = [re.compile(fnmatch.translate(x.replace("[^", "[!"))) for x in _alternatives(glob)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                held = []
                for name, length in _inside(folder):
                    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
                    if not hidden and (length is None or (length and any(x.match(name) for x in names))):
                        held.append((f"{folder}/{name}", name, length))
                    if len(held) == LISTED_ROWS:
                        yield _listed(held)
                        held = []
                yield _listed(held)

    folders, found = spark.createDataFrame([(root.rstrip("/"),)], "doc_id string"), []
    while True:
        level = keep(folders.repartition(4 * context.defaultParallelism, "doc_id").mapInArrow(run, "doc_id string, doc_name string, length long"))
        found.append(level.where("length is not null"))
        folders = level.where("length is null").select("doc_id")
        if folders.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def _alternatives(glob: str) -> list[str]:
    """A glob with braces as globs without."""
    m = re.search(r"\{([^{}]*)\}", glob)
    return [y for x in m[1].split(",") for y in _alternatives(glob[: m.start()] + x + glob[m.end() :])] if m else [glob]


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, name, length = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.string()), pa.array(name, pa.string()), pa.array(length, pa.int64())], ["doc_id", "doc_name", "length"])


def _inside(folder: str) -> Iterator[tuple[str, int | None]]:
    """(name, bytes) of each file in a folder, (name, None) of each folder."""
    if folder.startswith("file:"):
        with os.scandir(unquote(urlsplit(folder).path) or "/") as entries:
            for x in entries:
                yield x.name, None if x.is_dir() else x.stat().st_size
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(folder)
    for x in store.get_file_info(fs.FileSelector(inner)):
        yield x.base_name, None if x.type == fs.FileType.Directory else x.size


def _open(path: str):
    """A file that executors reach: by the file system if it is mounted there, else by Arrow's (HDFS, S3, GCS)."""
    if path.startswith("file:"):
        return open(unquote(urlsplit(path).path), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def read_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """doc_id, doc_name, part, start, content for each range of ``size`` bytes of each of ``files`` (doc_id, doc_name,
    length as of ``list_files``).

    For files that are too large for one row or one task: ranges are rows of their own before a byte is read, dealt over
    the cluster, and a task holds one range at a time, or HELD_BYTES of smaller ones.
    """
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size)))
    ranges = files.select("doc_id", "doc_name", F.explode(parts).alias("part")).withColumn("start", F.col("part") * size)
    dealt = ranges.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "part").select("doc_id", "doc_name", "part", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, held = 0, []
            for i in range(b.num_rows):
                with _open(b.column(0)[i].as_py()) as f:
                    f.seek(b.column(3)[i].as_py())
                    held.append(f.read(size))
                if i + 1 == b.num_rows or sum(map(len, held)) + size > HELD_BYTES:
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(held)) for c in b.columns), pa.array(held, pa.binary())], [*b.schema.names, "content"])
                    first, held = i + 1, []

    return dealt.mapInArrow(run, "doc_id string, doc_name string, part long, start long, content binary")


def read_listed(files: DataFrame) -> DataFrame:
    """raw_files of ``files`` (of ``list_files``): doc_id, doc_name, content, read whole by tasks that the names are dealt to."""
    dealt = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").select("doc_id", "doc_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, held = 0, []
            for i in range(b.num_rows):
                with _open(b.column(0)[i].as_py()) as f:
                    held.append(f.read())
                if i + 1 == b.num_rows or sum(map(len, held)) > HELD_BYTES:
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(held)) for c in b.columns), pa.array(held, pa.binary())], [*b.schema.names, "content"])
                    first, held = i + 1, []

    return dealt.mapInArrow(run, "doc_id string, doc_name string, content binary")


def range_digests(ranges: DataFrame) -> DataFrame:
    """doc_id, length, parts, digest: SHA-256 of the ranges' SHA-256 in their order. Only digests leave the tasks, so a
    file of any size is known by its content without being held anywhere."""
    each = ranges.select("doc_id", "part", F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("d"))
    order = F.array_join(F.sort_array(F.collect_list(F.struct("part", "d")))["d"], "")
    return each.groupBy("doc_id").agg(F.sum("n").alias("length"), F.count("*").alias("parts"), F.sha2(order, 256).alias("digest"))


def kind_of(name: Column) -> Column:
    """pdf, docx, image or text, by the name's ending in any case."""
    low = F.lower(name)
    image = low.endswith(".png") | low.endswith(".jpg") | low.endswith(".jpeg") | low.endswith(".tiff")
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").when(image, "image").otherwise("text")


def classify(raw_files: DataFrame) -> DataFrame:
    return raw_files.withColumn("kind", kind_of(F.col("doc_name")))


def decode_text(raw_files: DataFrame, divert: bool = False) -> DataFrame:
    """pages of text files: one unnumbered page each. Bytes that are no UTF-8 are an error, or with ``divert`` a row
    with null text and a message in ``error``."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.col("content").cast("string")) if divert else F.decode("content", "UTF-8")
    pages = raw_files.select("doc_id", "doc_name", F.lit(None).cast("int").alias("page_number"), text.alias("text"), good.alias("good"))
    return pages.withColumn("error", F.when(~F.col("good"), "not UTF-8")).drop("good") if divert else pages.drop("good")


def join_paragraphs(paragraphs: DataFrame, key: str = "doc_id", order: str = "pos", text: str = "text") -> DataFrame:
    """One unnumbered page per document from its paragraphs that are not blank, joined by line ends in their order."""
    kept = F.collect_list(F.when(~is_blank(text), F.struct(order, text)))
    joined = F.array_join(F.sort_array(kept)[text], "\n")
    return paragraphs.groupBy(key).agg(joined.alias("text")).select(key, F.lit(None).cast("int").alias("page_number"), "text")


def number_pages(pages: DataFrame, key: str = "doc_id", order: str = "pos", text: str = "text") -> DataFrame:
    """Pages numbered from 1 in their order, texts stripped, empty pages kept."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return pages.select(key, at.alias("page_number"), strip(text).alias("text"))


def extract_guard(pages: DataFrame, drop_errors: bool = False) -> DataFrame:
    """Rows with a message in ``error`` become unnumbered pages that say so, or go."""
    if drop_errors:
        return pages.where("error is null").drop("error")
    failed = F.col("error").isNotNull()
    text = F.when(failed, F.concat(F.lit("[Erreur lors de l'extraction : "), "error", F.lit("]"))).otherwise(F.col("text"))
    return pages.withColumn("text", text).withColumn("page_number", F.when(~failed, F.col("page_number"))).drop("error")


def blank_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the number of pages without text, those that OCR would have to read."""
    return pages.where(is_blank("text")).groupBy(key).agg(F.count("*").alias("n_blank"))


def keep_original(raw_files: DataFrame, path: str, mode: str = "append") -> None:
    """The bytes as they came, under their own names, dealt by the first byte of the id's hash."""
    raw_files.withColumn("dealt", F.substring(F.md5("doc_id"), 1, 2)).write.mode(mode).partitionBy("dealt").parquet(path)
