"""Text functions: stripping, cleaning, sentences, tokens. All are Column expressions but NFKC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All Unicode white space.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without leading and trailing Unicode white space (``trim`` knows U+0020 only)."""
    return F.regexp_replace(F.regexp_replace(col(c), f"^{SPACE}+", ""), f"{SPACE}+$", "")


def is_blank(c: Column | str) -> Column:
    return strip(F.coalesce(col(c), F.lit(""))) == ""


def no_null(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def plain_marks(c: Column | str) -> Column:
    """Typographic bullets, dashes and quotes as ASCII."""
    return F.translate(col(c), "•·–—―’“”", "-----'\"\"")


def no_controls(c: Column | str) -> Column:
    """Control characters as spaces, line ends and tabs included."""
    return F.regexp_replace(col(c), r"[\x00-\x1F\x7F]", " ")


def single_spaces(c: Column | str) -> Column:
    return F.regexp_replace(col(c), " {2,}", " ")


def spaced_marks(c: Column | str, keep_numbers: bool = False) -> Column:
    """A space after . , ; : ! ? where a word character follows; ``keep_numbers`` leaves 3.5 and 10:30 alone."""
    before = r"(?<![\p{N}](?=[.,:]\p{N}))" if keep_numbers else ""
    return F.regexp_replace(col(c), before + r"([.,;:!?])(?=[\p{L}\p{N}_])", "$1 ")


def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([t and unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(df: DataFrame, name: str = "text") -> DataFrame:
    """Unicode NFKC of one column, in one pass: texts of ASCII alone are kept as they are and go through Python as null."""
    other = F.when(F.col(name).rlike(r"[^\x00-\x7F]"), F.col(name))
    return df.withColumn(name, F.coalesce(F.arrow_udf(_nfkc, "string")(other), F.col(name)))


def clean_text(c: Column | str, keep_numbers: bool = False) -> Column:
    """All steps after NFKC, in their order."""
    return strip(spaced_marks(single_spaces(no_controls(plain_marks(no_null(c)))), keep_numbers))


def clean_pages(df: DataFrame, name: str = "text", keep_numbers: bool = False) -> DataFrame:
    """``name`` normalised and cleaned, all other columns kept; null becomes ''."""
    return nfkc(df.withColumn(name, no_null(name)), name).withColumn(name, clean_text(name, keep_numbers))


def sentences(c: Column | str) -> Column:
    """Cut at white space behind . ? or !; an empty tail stays."""
    return F.split(col(c), rf"(?<=[.?!]){SPACE}+", -1)


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"({TOKEN})"), F.lit(1))
