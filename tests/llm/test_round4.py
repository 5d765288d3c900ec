import random

import pytest
from pyspark.sql import functions as F

from .test_llm import brute_components


def rows_of(frame):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect())


def test_sets_that_share_a_few_shingles_stay_apart(spark, monkeypatch):
    """op5, pipeline (F1, F2): each text has a half-like partner and some pieces of six words in common with the next; what
    is compared ships no set many times."""
    import cahier.llm.jaccard_join as j

    r, rows = random.Random(6), []
    word = lambda: f"w{r.randrange(10**9)}"
    piece = [[[word() for _ in range(6)] for _ in range(8)] for _ in range(81)]
    for i in range(40):
        own = [word() for _ in range(240)]
        for k, half in ((2 * i, own), (2 * i + 1, [*own[:140], *[word() for _ in range(100)]])):
            rows.append((k, " ".join([*half, *(w for p in piece[k] + piece[k + 1] for w in p)])))
    monkeypatch.setattr(j, "CHUNK", 4)
    links, shipped = j._links, []

    def watched(members, sets, percent):
        shipped.append(members.agg(F.sum("n")).first()[0] or 0)
        return links(members, sets, percent)

    monkeypatch.setattr(j, "_links", watched)
    got = rows_of(j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(i, c) for i, _, c in got] == [(i, i) for i in range(80)]
    assert 0 < sum(shipped) <= 4 * sum(n for _, n, _ in got)


@pytest.mark.parametrize(("pair_sets", "usual"), [(16, None), (2, None), (1, None), (16, 3.0)])
def test_pairs_and_shingles_of_many_lose_no_link(spark, monkeypatch, pair_sets, usual):
    """Families around the threshold, chained by passages, compared in chunks of three by every way there is."""
    import cahier.llm.jaccard_join as j

    r, rows = random.Random(8), []
    passage = [[f"p{k}x{x}" for x in range(30)] for k in range(6)]
    for f in range(12):
        base = [f"f{f}w{x}" for x in range(r.randrange(8, 90))]
        for _ in range(r.randrange(2, 9)):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(w[: len(w) - r.randrange(4)] + (passage[f % 6] if r.random() < 0.5 else []))))
    monkeypatch.setattr(j, "CHUNK", 3)
    monkeypatch.setattr(j, "PAIR_SETS", pair_sets)
    monkeypatch.setattr(j, "_cheap", lambda rest, percent: rest.select("bucket").where("false"))
    if usual:
        monkeypatch.setattr(j, "_usual", lambda total, bits: usual)
    want = sorted(brute_components([(i, t, None, None) for i, t in rows]))
    assert len({c for _, _, c in want}) < len(rows) - 5
    assert rows_of(j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want
