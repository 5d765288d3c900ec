"""Language identification, fill-in-the-middle and hard negatives against brute-force versions."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

# Language identification


def spoken(seed: int, sounds: str, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(sounds) for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    sounds = {"aa": "abcdeé", "bb": "abefgh", "cc": "αβγδε"}
    rows = [(i, spoken(i, sounds[lang], 3 + i % 40), lang, "x", 1.0) for i in range(90) for lang in [["aa", "aa", "bb", "cc"][i % 4]]]
    rows += [(200, None, "aa", None, None), (201, "", "bb", "x", 0.0), (202, "12 .,\n 4!", "aa", "x", None), (203, "日本語", None, "x", 2.0), (204, "abé " * 30000, None, "y", 2.0), (205, "abcé", "aa", "y", 2.0), (205, "abcé", "aa", "y", 2.0)]
    rows += [(None, "βγδ εα", None, "y", 2.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)


def plain_grams(text):
    c = " " + re.sub(r"\s+", " ", "".join(x.lower() if x.isalpha() else " " for x in text or "")).strip() + " "
    return [c[i : i + n] for n in range(1, 5) for i in range(len(c) - n + 1) if c[i : i + n].strip() and " " not in c[i + 1 : i + n - 1] and (n > 1 or c[i] != " ")] if c.strip() else []


def test_ngrams_are_those_of_plain_strings():
    from cahier.llm.language_id import ngrams

    texts = ["Ab c", "", "é1É", "...", "x" * 9, " zz  top"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = {}
    for n, doc, h in ngrams(np.frombuffer(b"".join(raw), np.uint8), off):
        for d, x in zip(doc, h):
            got.setdefault((int(d), n), []).append(int(x))
    back, forth = {}, {}
    for d, t in enumerate(texts):
        for n in range(1, 5):
            want = [g for g in plain_grams(t) if len(g) == n]
            assert len(want) == len(got.get((d, n), []))
            for g, x in zip(want, got.get((d, n), [])):
                assert back.setdefault(x, g) == g and forth.setdefault(g, x) == x


def test_language_id_against_exact_sets(spark, tongues, none):
    """With sets in place of the filter: the same language wherever the exact shares are not level."""
    from cahier.llm.language_id import predict, train

    rows, df = tongues
    model = train(df, F.col("doc_id") % 5 != 0)
    assert model.languages[0] == "aa" and sorted(model.languages) == ["aa", "bb", "cc"]
    counts = {}
    for i, t, lang, *_ in rows:
        if i is not None and i % 5 and t is not None and lang:
            for g in plain_grams(t):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    total = {(x, n): sum(c for g, c in counts[x].items() if len(g) == n) for x in counts for n in range(1, 5)}
    rate = {x: {g: c / total[x, len(g)] for g, c in counts[x].items()} for x in counts}
    sets = {x: {g for g, r in rate[x].items() if r >= 1e-5 and r >= 0.5 * max(rate[y].get(g, 0) for y in rate)} for x in rate}
    got = predict(df, model, keep=(F.col("lang").alias("truth"),)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        grams = plain_grams(texts[r["doc_id"]])
        if not grams:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        share = sorted(((sum(g in sets[x] for g in grams) / len(grams), x) for x in sets), reverse=True)
        if share[0][0] - share[1][0] > 0.05:
            assert r["lang_pred"] == share[0][1] and r["score"] == pytest.approx(share[0][0] / (share[0][0] + share[1][0]), abs=0.05)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in sets
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 5 == 0 and r["doc_id"] < 90]
    assert sum(r["lang_pred"] == r["truth"] for r in held) >= 0.9 * len(held)
    assert {r["lang_pred"] for r in got if r["doc_id"] is None} == {"cc"}
    # Nothing to learn from, and nothing to predict.
    empty = train(none, F.lit(True))
    assert empty.languages == [] and {r["lang_pred"] for r in predict(df, empty).collect()} == {"und"}
    assert predict(none, model).collect() == []


def test_filter_with_more_than_eight_languages_and_its_correction(spark):
    from cahier.llm import language_id as li

    alphabet = "abcdefghijklmnopqrstuvwxyzàâæçéèêëîïôœùûüÿñß"
    rows = [(i, spoken(i, alphabet[4 * (i % 11) : 4 * (i % 11) + 4], 30), f"l{i % 11:02d}") for i in range(110)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df, F.col("doc_id") % 10 != 0)
    assert model.rows.shape[1] == 2 and (model.chance > 0).all() and (model.chance < 0.2).all()
    assert all(r["lang_pred"] == r["truth"] for r in li.predict(df, model, keep=(F.col("lang").alias("truth"),)).collect())
    # A text of which no language has an n-gram: what is left after the correction is near nothing.
    raw = "你好世界".encode() * 500
    _, share = li.shares(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert share.max() < 0.2


# Fill-in-the-middle


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c", "é", " ", "\n", "😀", "<", "x" * 90, "Zz" * 700]), max_size=120))
def test_rank_index_is_exact(parts):
    from cahier.llm.fill_in_middle import boundaries, fit

    text = "".join(parts)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    want = np.concatenate([[0], np.cumsum([len(u.encode()) for u in units])]).astype(int)
    for error in (127, 9):
        index = fit(boundaries(np.frombuffer(text.encode(), np.uint8)), error)
        assert index.n == len(units) and [index.cut(i) for i in range(len(want))] == want.tolist()
        assert np.abs(index.residual.astype(int)).max() <= error


def plain_fim(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, len(units), "plain", None, None, text)
    a, z = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    spm = h[3] % 100 < 20
    return (i, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, docs, rows, none):
    from cahier.llm.fill_in_middle import restore, transform

    more = [(300, "has <S> inside"), (301, "<<P <M S>"), (None, "no id at all"), (302, "\x00é😀\n" * 50), (303, "word, " * 40000)]
    more += [(400 + i, f"Some <tex{'t' * i}> é{i}\nwith lines <" + "S" * (i % 3)) for i in range(80)]
    df = docs.select("doc_id", "text", "size", "score").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = transform(df).withColumn("back", restore("output", "form")).collect()
    want = [plain_fim(r[0], r[1]) for r in [*rows, *more]]
    cols = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} and max(r["n_segments"] for r in got) >= 1
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], set()).add(r["back"])
    assert texts == {i: {t or ""} for i, t, *_ in [*rows, *more]}
    assert transform(none).collect() == []


# Hard negatives


def plain_negatives(rows, scale=256):
    ready = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(scale * float(x)) for x in v]
        ready[i] = min(ready.get(i, (label, whole)), (label, whole))
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    for a, (label, v) in ready.items():
        if a % 10:
            continue
        each = sorted((-score(v, w), i, other) for i, (other, w) in ready.items() if i != a)
        for s, p, _ in [x for x in each if x[2] == label][:5]:
            fit = [x for x in each if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s][:10]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, labels=3, width=6, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, width))
    return [(i, i % labels, (centres[i % labels] * (1 - spread) + spread * r.normal(size=width)).tolist()) for i in range(n)]


def mined(df, **more):
    from cahier.llm.hard_negatives import hard_negatives

    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in cols) for r in hard_negatives(df, F.col("id") % 10 == 0, **more).collect())


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("cells", [(8192, 4096), (40, 3)])
def test_hard_negatives(spark, cells, monkeypatch):
    from cahier.llm import hard_negatives as hn

    monkeypatch.setattr(hn, "GROUP_ROWS", cells[0])
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", cells[1])
    rows = vectors(1, 300)
    rows += [(1000 + i, i % 2, [0.5, 0.5, 0.25, 0.0, 0.0, 0.0]) for i in range(120)]  # ties without end
    rows += [(2000, None, [1.0] * 6), (2010, 1, None), (2020, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2030, 1, [1.0, math.nan, 0.0, 0.0, 0.0, 0.0]), (2040, 1, [math.inf, 1.0, 0.0, 0.0, 0.0, 0.0]), (None, 1, [1.0] * 6)]
    rows += [(2050, 1, [0.0] * 6), (2060, 0, []), (2070, 2, [0.75, -1.0]), (2080, 7, [1.0] * 6), (2090, 2, [-0.001] * 6), (2090, 2, [-0.001] * 6)]
    df = spark.createDataFrame([(*r, "c", 0, 1.0) for r in rows], SCHEMA + ", cell string, side int, angle double").repartition(3)
    want = plain_negatives(rows)
    assert len(want) > 1000 and mined(df) == want
    assert mined(df, count=1, sample=1) == want


def test_hard_negatives_of_huge_numbers_and_of_nothing(spark):
    rows = [(i, i % 2, [x * 3e5, -x * 1e3, 7e6]) for i, x in enumerate(np.linspace(-2, 2, 40).tolist())]
    rows += [(50, 0, [4e6, 1e5, 3.0]), (51, 1, [2e6, 1e5, 3.0]), (52, 0, [4e6, 0.0, 1.0])]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain_negatives(rows) != []
    huge = [(i, i % 2, [1e200 * (i + 1), -1e300]) for i in range(25)]
    assert all(r[4] == 2**63 - 1 for r in mined(spark.createDataFrame(huge, SCHEMA)))
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(i, 1, [1.0]) for i in range(20)], SCHEMA)) == []


def test_windows_that_cannot_hold_a_score_are_not_scored():
    """Rows in tight bundles: most windows are passed over, and no result is lost."""
    from cahier.llm.hard_negatives import Cell, angles, norms

    rows = vectors(3, 6000, labels=40, width=16, spread=0.05)
    m = np.floor(256 * np.array([v for *_, v in rows]))
    refs = np.array([m[i] / np.linalg.norm(m[i]) for i in range(16)])
    ids, labels, turn = np.arange(6000), np.array([x for _, x, _ in rows]), angles(m, refs)
    order = np.lexsort((turn.min(1), turn.argmin(1), labels))
    picked = np.arange(0, 6000, 100)
    cell = Cell(ids[picked], labels[picked], m[picked], norms(m[picked]), turn[picked], 5)
    cell.see(ids[order], labels[order], m[order], norms(m)[order], turn[order])
    first = cell.rows().to_pylist()
    targets = (np.repeat(np.arange(60), 5), np.array([r["positive_id"] for r in first]), np.array([r["positive_score"] for r in first]))
    cell = Cell(ids[picked], labels[picked], m[picked], norms(m[picked]), turn[picked], 10, targets)
    cell.see(ids[order], labels[order], m[order], norms(m)[order], turn[order])
    assert cell.scored < 0.6 * cell.met
    s = (m[picked] @ m.T).astype(int)
    for a, p, score in list(zip(*targets))[::7]:
        fit = [i for i in np.lexsort((ids, -s[a])) if labels[i] != labels[picked[a]] and 30 * score <= 100 * s[a, i] <= 90 * score][:10]
        assert [r["negative_id"] for r in cell.rows().to_pylist() if (r["anchor_id"], r["positive_id"]) == (picked[a], p)] == fit


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_score_bounds_hold(seed):
    from cahier.llm.hard_negatives import angles, inner, norms, score_bounds

    r = np.random.default_rng(seed)
    a, x = np.floor(r.normal(size=(5, 4)) * 10.0 ** r.integers(0, 4)), np.floor(r.normal(size=(7, 4)) * 10.0 ** r.integers(0, 4))
    x[0] = a[0] * 3 if seed % 2 else -a[0]
    refs = np.eye(4)[: r.integers(1, 5)]
    t, n = angles(x, refs), norms(x)
    down, up = score_bounds(angles(a, refs), norms(a), t.min(0), t.max(0), n.min(), n.max())
    s = inner(a, x)
    assert (s >= down[:, None]).all() and (s <= up[:, None]).all()


def test_matrix_of_uneven_lists():
    from cahier.llm.hard_negatives import matrix

    col = pa.array([[1.0, 2.0], [], [3.0]], pa.list_(pa.float64()))
    assert matrix(col).tolist() == [[1, 2], [0, 0], [3, 0]] and matrix(col.slice(1)).tolist() == [[0], [3]]


def test_registered_language_query(spark):
    import __spark_entry__ as driver

    got = driver.queries()["op11_language_id"](spark, driver.SMALL)
    truth = spark.read.parquet(f"{driver.SMALL}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert got.count() == truth.count() and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)


def test_units_are_counted_from_the_words_pairs(spark):
    """op2: the texts are read for the pairs of words only; the units' pairs are sums of these."""
    import cahier.llm.class_lm as m

    words = [f"w{i * i % 37}x{i % 5}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 7 : i * 7 + 40])) for i in range(50)], "doc_id long, text string")
    counts = m._count_words(docs, 16).toPandas()
    often = counts.sort_values(["c", "h"], ascending=False).head(30)
    h, e = often["h"].to_numpy().view(np.uint64), np.maximum(often["e"].to_numpy(), 0)
    top = spark.sparkContext.broadcast((m.Lookup(h), often["c"].to_numpy()))
    pairs = m._count_pairs(docs, top, 16, 4)
    unit = np.concatenate([np.arange(10), 10 + e[10:], np.arange(10, 26)])
    units = m._unit_pairs(pairs, unit, 26)

    def read(df, size):
        out = np.zeros((size, 2 * size), int)
        for r in df.collect():
            w, at, x, n = m._unpack(r.asDict(), np.int32, np.int32)
            np.add.at(out, (w[at], x), n)
        return out

    full, want = read(pairs, 46), np.zeros((26, 52), int)
    np.add.at(want, (np.repeat(unit, 92), np.tile(np.concatenate([unit, 26 + unit]), 46)), full.ravel())
    assert (read(units, 26) == want).all() and want.sum() == 2 * counts["c"].sum()


def test_counts_ship_half_of_each_hash(spark, monkeypatch):
    """op5: what a set's prefix takes on its way to be counted; shingles that look alike lose no link."""
    import cahier.llm.jaccard_join as j

    r = np.random.default_rng(3)
    texts = [" ".join(f"a{x}" for x in r.integers(0, 10**9, 2000)) for _ in range(64)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(2).localCheckpoint()
    levels = spark.sparkContext.broadcast(np.zeros(1 << 16, np.uint8))
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    j._meet(docs, 5, 75, levels, 16, 8.0, 64 * 1996, "counts").collect()
    entries = 64 * (1996 * 45 // 100)
    assert 0 < written() - before < 8 * entries


def test_sets_of_shingles_are_shuffled_once(spark):
    """op5: sets that may have links are long; neither their making nor a join with what is known of them ships them."""
    import cahier.llm.jaccard_join as j

    r = np.random.default_rng(5)
    rows = []
    for i in range(40):
        w = [f"a{x}" for x in r.integers(0, 10**9, 2000)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-3], "x", "y", "z"])), (2 * i + 1, " ".join([*w[:-3], "x", "y", "z"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in j.near_duplicates(docs).collect())
    assert got == sorted((i, 1996, i - i % 2) for i, _ in rows)
    assert 0 < written() - before < 2.5 * 8 * 80 * 1996
