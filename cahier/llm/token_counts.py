"""Token counts by the whole-token shortcut.

Offline, once per worker: every vocabulary string is encoded by itself and those that come back as one token are kept.
A pre-token in that set counts 1 without any merging; only the others go through the tokenizer's merges, once per
distinct string and worker while the bounded cache holds it. Exact for tokenizers whose pre-tokens are encoded apart
from each other, as byte-level BPE's are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE with ``use_regex`` (a fixed value).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 500_000
#: Longer pre-tokens are counted but not remembered.
CACHE_CHARS = 64

_counters: dict[str, TokenCounter] = {}


class TokenCounter(dict):
    """pre-token -> number of tokens. Holds the proven whole tokens and a bounded cache of merged ones."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without normalizer has pre-tokens that can be counted apart")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile(PRETOKEN).findall
        super().__init__(self.prove())
        self.whole = len(self)

    def prove(self) -> dict[str, int]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        from tokenizers.decoders import ByteLevel

        decode = ByteLevel().decode
        texts = [decode([t]) for t in self.tokenizer.get_vocab() if t not in self.added]
        texts = [t for t in texts if t and "�" not in t and self.split(t) == [t]]
        return {t: 1 for t, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1}

    def __missing__(self, pretoken: str) -> int:
        n = len(self.tokenizer.encode(pretoken, add_special_tokens=False).ids)
        if len(pretoken) <= CACHE_CHARS:
            if len(self) >= self.whole + CACHE_ENTRIES:
                for old in list(self)[self.whole :]:
                    del self[old]
            self[pretoken] = n
        return n

    def count(self, text: str) -> int:
        if any(a in text for a in self.added):  # the library cuts these out before its pre-tokens
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.split(text)))


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    The path must name the file on every executor. Null and empty texts have 0 bytes and 0 tokens; texts are counted
    whole whatever their length; repeated rows are counted each; an empty table gives no rows; other columns are not
    read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for b in batches:
            c = c or counter(tokenizer_path)
            n = [c.count(t) if t else 0 for t in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
