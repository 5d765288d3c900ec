import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cahier.functions import text as t
from cahier.functions.vectors import cosine
from cahier.operators.chunks import chunk_pages, cut_page

CASES = [
    (None, ""),
    ("", ""),
    ("ＡＢ ½ ﬁ", "AB 1⁄2 fi"),
    ("• a · b – c — d ― e ’ “ ”", "- a - b - c - d - e ' \" \""),
    ("a b", "a b"),
    ("3.5 m at 10:30, see x.org/a?b", "3. 5 m at 10: 30, see x. org/a? b"),
    ("a\tb\r\nc\n\n\nd", "a b c d"),
    ("   x \x85", "x"),
    ("fin.Début", "fin. Début"),
]


def test_clean_cases(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, text string")
    got = {r["i"]: r["text"] for r in t.clean_pages(df).collect()}
    assert got == {i: b for i, (_, b) in enumerate(CASES)}


def test_keep_numbers(spark):
    df = spark.createDataFrame([("3.5 at 10:30.Yes",)], "text string")
    assert df.select(t.clean_text("text", keep_numbers=True)).first()[0] == "3.5 at 10:30. Yes"


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([(a,) for a, _ in CASES], "text string")
    once = t.clean_pages(df)
    assert sorted(r[0] for r in once.collect()) == sorted(r[0] for r in t.clean_pages(once).collect())


def test_sentences_keep_the_empty_tail(spark):
    df = spark.createDataFrame([("One. Two?  Three! ",), ("",), ("a.b",)], "text string")
    assert [r[0] for r in df.select(t.sentences("text")).collect()] == [["One.", "Two?", "Three!", ""], [""], ["a.b"]]


def by_hand(page: str, limit: int) -> list[tuple[str, int, int]]:
    """The packing rules, sentence by sentence, as a state machine."""
    buffer, begun, after, out = [], 0, 0, []
    length = 0
    for s in re.split(r"(?<=[.?!])\s+", page):
        if length + len(s) >= limit:
            text = " ".join(buffer).strip()
            out.append((text, begun, begun + len(text)))
            after, buffer, length = begun + len(text), [], 0
        if not buffer:
            begun = page.find(s, after)
        buffer.append(s)
        length += len(s) + 1
    text = " ".join(buffer).strip()
    return out + ([(text, begun, begun + len(text))] if text else [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. !?\n", max_size=80), st.integers(3, 25))
def test_cut_page_follows_the_rules(page, limit):
    assert cut_page(page, limit) == by_hand(page, limit)


@pytest.mark.parametrize("first", [9, 10, 11])
def test_limit_is_strict(first):
    page = "a" * (first - 1) + ". b."
    assert (cut_page(page, 10)[0] == ("", 0, 0)) == (first >= 10)


def test_ids_run_through_a_document(spark):
    rows = [("d", None, 2, "B b."), ("d", "n", None, "A a."), ("d", "n", 1, "  "), ("e", "n", 1, None), ("f", "n", 1, "C.")]
    got = chunk_pages(spark.createDataFrame(rows, "doc_id string, doc_name string, page_number int, text string")).collect()
    assert sorted((r["doc_id"], r["doc_name"], r["chunk_id"], r["text"]) for r in got) == [("d", "n", 0, "A a."), ("d", "unknown", 1, "B b."), ("f", "n", 0, "C.")]


def test_offsets_of_repeated_sentences_and_double_blanks(spark):
    page = "Same.  Same. Same."
    assert cut_page(page, 6) == [("", 0, 0), ("Same.", 0, 5), ("Same.", 7, 12), ("Same.", 13, 18)] or cut_page(page, 6) == by_hand(page, 6)


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [0.0, 1.0]


def test_nfkc_agrees_with_python(spark):
    texts = ["ﬀ", "①", "Å", "plain", "é"]
    got = t.nfkc(spark.createDataFrame([(x,) for x in texts], "text string")).collect()
    assert sorted(r[0] for r in got) == sorted(unicodedata.normalize("NFKC", x) for x in texts)


def test_strip_is_unicode(spark):
    assert spark.range(1).select(t.strip(F.lit(" \x1c a b 　\n"))).first()[0] == "a b"
