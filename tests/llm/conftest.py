import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed: int, n: int) -> str:
    x, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append(WORDS[x >> 8 & 15] + WORDS[x >> 16 & 7])
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, exact and near copies, repeated rows, shared passages, equal ids."""
    passage, base = text(99, 70), text(7, 120)
    near = base.split()
    near[60] = "changed"
    out = [(i, text(i, 20 + 17 * i % 90), ["en", "fr", None][i % 3], f"s{i % 4}") for i in range(30)]
    out += [(40, None, "en", "s1"), (41, "", None, None), (42, " \n\t ", "fr", "s2"), (43, "One", "en", "s1"), (44, "ONE", "en", None)]
    out += [(50, base, "en", "s0"), (51, base, "fr", "s1"), (52, " ".join(near), "en", "s0"), (53, base.upper(), "en", "s3"), (53, base.upper(), "en", "s3")]
    out += [(60, text(61, 40) + " " + passage + "\n" + text(62, 30), "en", "s0"), (61, passage, "en", "s0"), (62, text(63, 5) + "\n" + passage, "fr", "s1")]
    out += [(70, "tail " * 3000 + text(3, 3000), "en", "s0"), (71, "same same same " * 30, "en", "s0"), (72, "é ünï x |#$ |#$\nline one\nline one\n", "fr", "s9")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with columns whose names the operators use themselves."""
    extra = [(*r, "x", 1, None, 5) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, shard string, size int, score double, k int").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
