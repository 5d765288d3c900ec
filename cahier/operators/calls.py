"""Calls of a text generator that may fail: bounded and timed calls inside a task, and a durable table of their results.

A prompt is known by its digest. Results are kept in a Parquet table below a path that all executors share; a rerun joins
it first and sends only what is not there.
"""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cahier.session import cut_lineage

Generator = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]
RESULTS = "digest string, text string, error string"
#: Prompts that are sent and saved as one job; what a lost driver has to send again is less than this.
PER_WAVE = 500_000
#: A prompt with more rows than this, and more than a thousandth of all rows, is joined by broadcast.
FREQUENT_ROWS = 10_000


@dataclass(frozen=True)
class Calls:
    """A generator made of single calls: ``call`` takes a prompt and returns a text or null, or raises.

    At most ``concurrent`` calls of a task are under way at once, each for at most ``timeout`` seconds. A call that raises
    or takes too long is tried again up to ``retries`` times, ``pause`` seconds later (twice as long each time), then its
    prompt alone has failed. A call that hangs keeps its thread; a task with ``most_hung`` of these gives up.
    """

    call: Callable[[str], str | None]
    concurrent: int = 8
    timeout: float = 120.0
    retries: int = 1
    pause: float = 0.5
    most_hung: int = 1000

    def answer(self, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        """(text, error) of each prompt, in order."""
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(prompts)
        todo = deque((i, 0, 0.0) for i in range(len(prompts)))  # place, tries so far, not before
        running: dict[tuple[int, int], float] = {}
        done: queue.SimpleQueue = queue.SimpleQueue()
        hung: list[threading.Thread] = []
        threads: dict[tuple[int, int], threading.Thread] = {}

        def work(key: tuple[int, int], prompt: str) -> None:
            try:
                done.put((key, self.call(prompt), None))
            except Exception as e:  # whatever a client raises fails this prompt only
                done.put((key, None, f"{type(e).__name__}: {e}"))

        def failed(key: tuple[int, int], error: str) -> None:
            i, tries = key
            if tries < self.retries:
                todo.append((i, tries + 1, time.monotonic() + self.pause * 2**tries))
            else:
                out[i] = (None, error)

        while todo or running:
            now = time.monotonic()
            for _ in range(len(todo)):
                if len(running) >= self.concurrent:
                    break
                i, tries, ready = todo.popleft()
                if ready > now:
                    todo.append((i, tries, ready))
                    continue
                running[i, tries] = now + self.timeout
                threads[i, tries] = threading.Thread(target=work, args=((i, tries), prompts[i]), daemon=True)
                threads[i, tries].start()
            due = min([*running.values(), *([r for *_, r in todo] if len(running) < self.concurrent else [])])
            try:
                key, text, error = done.get(timeout=max(0.0, due - time.monotonic()))
                if running.pop(key, None) is not None:  # else it came after its time
                    threads.pop(key)
                    if error is None:
                        out[key[0]] = (text, None)
                    else:
                        failed(key, error)
            except queue.Empty:
                late = [k for k, end in running.items() if end <= time.monotonic()]
                for key in late:
                    del running[key]
                    hung.append(threads.pop(key))
                    failed(key, f"no answer in {self.timeout} s")
                hung = [t for t in hung if t.is_alive()]
                if len(hung) >= self.most_hung:
                    raise TimeoutError(f"{len(hung)} calls hang") from None
        return out

    def __call__(self, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([text for text, _ in self.answer(list(s))], dtype=object)


def _one_by_one(generator: Generator, prompts: pd.Series) -> list[tuple[str | None, str | None]]:
    out = []
    for p in prompts:
        try:
            out.append((next(iter(generator(iter([pd.Series([p])])))).iloc[0], None))
        except Exception as e:
            out.append((None, f"{type(e).__name__}: {e}"))
    return out


def answers(generator: Generator, batches: Iterator[pd.Series]) -> Iterator[list[tuple[str | None, str | None]]]:
    """(text, error) for each prompt of each batch. Where a generator of batches raises, it is begun anew and the prompts
    of that batch are sent one by one, so that only those fail that raise by themselves."""
    if isinstance(generator, Calls):
        yield from (generator.answer(list(s)) for s in batches)
        return
    given: deque[pd.Series] = deque()

    def feed() -> Iterator[pd.Series]:
        while given:
            yield given.popleft()

    made = None
    for s in batches:
        given.append(s)
        try:
            made = generator(feed()) if made is None else made
            texts = next(made, None)
            if texts is None:  # its input ended between two batches
                made = generator(iter([s]))
                texts = next(made)
                made = None
            if len(texts) != len(s):
                raise ValueError(f"{len(texts)} texts for {len(s)} prompts")
            yield [(t, None) for t in texts]
        except Exception:
            made = None
            yield _one_by_one(generator, s)
        given.clear()


def digest(prompt: Column, model: str = "") -> Column:
    """What a prompt is known by; ``model`` keeps the results of different models and settings apart. Null stays null."""
    return F.sha2(F.concat(F.lit(f"{model}\n"), prompt), 256)


def read_results(spark: SparkSession, store: str) -> DataFrame:
    """digest, text, error: what is in the table at ``store``, nothing where there is none yet."""
    try:
        return spark.read.schema(RESULTS).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS)


def send(prompts: DataFrame, generator: Generator, partitions: int | None = None) -> DataFrame:
    """digest, text, error for each row of ``prompts`` (digest, prompt)."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests: deque[pd.Series] = deque()

        def texts() -> Iterator[pd.Series]:
            for t in tables:
                if len(t):
                    digests.append(t["digest"])
                    yield t["prompt"]

        for got in answers(generator, texts()):
            text, error = zip(*got)
            yield pd.DataFrame({"digest": digests.popleft().to_numpy(), "text": pd.Series([None if x is None or x is pd.NA or x != x else x for x in text], dtype=object), "error": pd.Series(error, dtype=object)})

    asked = prompts.select("digest", "prompt")
    return (asked.repartition(partitions) if partitions else asked).mapInPandas(run, RESULTS)


def results(asked: DataFrame, generator: Generator, store: str | None = None, partitions: int | None = None, retry_failed: bool = False, per_wave: int = PER_WAVE) -> DataFrame:
    """digest, text, error for each row of ``asked`` (digest, prompt: one row per digest).

    With a ``store``, what is in it is not sent, and what is sent is added wave by wave, so a job that is run again sends
    at most one wave twice. Failed prompts are kept with their error and not sent again, unless ``retry_failed``; a later
    result counts for more than a failure. Without a store the results are kept for this job only.
    """
    if store is None:
        return cut_lineage(send(asked, generator, partitions))
    spark = asked.sparkSession
    known = read_results(spark, store)
    known = known.where("error is null") if retry_failed else known
    todo = cut_lineage(asked.join(known.select("digest"), "digest", "left_anti"))
    waves = -(-todo.count() // per_wave)
    for i in range(waves):
        part = todo.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == i)
        send(part, generator, partitions).write.mode("append").parquet(store)
    mine = read_results(spark, store).join(asked.select("digest"), "digest", "left_semi")
    best = F.max_by(F.struct("text", "error"), F.struct(F.col("error").isNull(), F.col("text"), F.col("error")))
    return mine.groupBy("digest").agg(best.alias("r")).select("digest", "r.text", "r.error")


def generate(df: DataFrame, prompt: str, generator: Generator, out: str, on_failure: str | None = None, partitions: int | None = None, store: str | None = None, model: str = "", retry_failed: bool = False, error: str | None = None) -> DataFrame:
    """``df`` with the generated text of each prompt in ``out``, and why there is none in ``error`` if that is named.

    Equal prompts are sent once. A prompt that fails by an exception, by time or by a null result has ``on_failure``, it
    alone; null prompts are not sent and have it too. Prompts meet their results by digest: texts are shuffled once, to
    find equal ones, with those of a task summed up before. Prompts of very many rows are few; their results are broadcast
    and their rows spread by row number, so that they meet in no one task.
    """
    keyed = df.withColumn("_digest", digest(F.col(prompt), model))
    asked = cut_lineage(keyed.where(F.col("_digest").isNotNull()).groupBy(F.col("_digest").alias("digest")).agg(F.any_value(prompt).alias("prompt"), F.count("*").alias("n")))
    made = results(asked.select("digest", "prompt"), generator, store, partitions, retry_failed).select(F.col("digest").alias("_d"), F.col("text").alias("_text"), F.col("error").alias("_error"))
    total = asked.agg(F.sum("n")).first()[0] or 0
    frequent = asked.where(F.col("n") > max(FREQUENT_ROWS, total // 1000)).select(F.col("digest").alias("_d"))
    often = cut_lineage(made.join(F.broadcast(frequent), "_d", "left_semi"))  # below a thousand rows
    if often.count():
        keyed = keyed.join(F.broadcast(often.select(F.col("_d").alias("_o"), F.struct("_text", "_error").alias("_often"))), F.col("_digest") == F.col("_o"), "left").drop("_o")
        spread = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
        keyed = keyed.withColumn("_digest", F.when(F.col("_often").isNull(), F.coalesce("_digest", spread)).otherwise(spread))
    else:
        keyed = keyed.withColumn("_often", F.lit(None).cast("struct<_text:string,_error:string>"))
    joined = keyed.join(made, keyed["_digest"] == made["_d"], "left")
    text = F.coalesce("_often._text", "_text", F.lit(on_failure).cast("string"))
    joined = joined.withColumn(out, text)
    joined = joined.withColumn(error, F.coalesce("_often._error", "_error")) if error else joined
    return joined.drop("_digest", "_d", "_text", "_error", "_often")
