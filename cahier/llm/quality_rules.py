"""Quality rules with risk-controlled thresholds.

Labelled holdouts decide, per stratum, how strict the rules may be together: of the good documents of a stratum at most
``risk`` may be rejected by any rule, the base rules included. One half of a stratum's holdout, by hash of the id, puts
all (rule, cutoff) pairs in one order, those that reject fewest first. The other half then tests that order step by step:
a step is allowed when the exact binomial bound says that all rules up to it, and the base rules, falsely reject at most
``risk``. The order is fixed before the test and ends at the first step that fails (a fixed sequence), so the steps need no
correction; the strata have Bonferroni's. Where even the base rules alone fail the test, or the holdout is too small, no
rule fires. Everything is DataFrame expressions; all per-document work happens inside the document's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cahier.session import cut_lineage

BREAKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]"
WINDOW = 8
#: Cutoffs of every rule: a document is rejected when its ratio is above. A fixed grid, so that it is not fitted to the holdout.
CUTOFFS = (0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)
#: A table of strata up to this many rows is broadcast.
BROADCAST_ROWS = 200_000
RULES = ("symbol_ratio", "dup_line_words", "repeat_ratio", "mark_ratio")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def repeat_words(words: Column, n: Column) -> Column:
    """Words inside windows of WINDOW words that are found twice or more, the first included.

    Hashes of the windows are compared (64 bits); only where two are equal are they sorted, with their places, to
    find which. The covered words are the sum of min(WINDOW, distance to the next repeated window).
    """
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))[0].cast("long")


def _covered(h: Column) -> Column:
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    before = lambda a: F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(a, 1, F.size(a) - 1))
    after = lambda a: F.concat(F.slice(a, 2, F.size(a) - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    own = F.transform(F.array(placed), lambda a: F.zip_with(a, F.arrays_zip(before(a).alias("p"), after(a).alias("q")), lambda x, y: F.when(x["h"].eqNullSafe(y["p"]["h"]) | x["h"].eqNullSafe(y["q"]["h"]), x["i"])))[0]
    at = F.sort_array(F.filter(own, lambda i: i.isNotNull()))
    return F.transform(F.array(at), lambda a: F.aggregate(F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x))[0]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts that the rules use. A null text has no words; a null stratum is one of its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, BREAKS, "") != "")
    step = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("t"), words_of(text).alias("w"), lines.alias("lines"))
    n = F.size("w")
    return step.select(
        "doc_id",
        "stratum",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", BREAKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("t", r"[\p{L}\p{N}\x20\x09-\x0D]+", "")).cast("long").alias("n_marks"),
        repeat_words(F.col("w"), n).alias("n_repeat_words"),
    )


def ratios() -> dict[str, Column]:
    """Rule -> ratio. A document without words has ratio 0 everywhere."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_ratio": share("n_symbols", "word_chars"), "dup_line_words": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"), "mark_ratio": share("n_marks", "word_chars")}


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Binomial(n, p): terms from k downwards, each from the one before, relative to the largest.

    The first term's binomial coefficient comes from log-factorials by Stirling's series (error below 1e-10 from 10
    on, exact values below). Terms are added while k is below the mean, where they fall from k on; above it the
    bound is of no use and the value is 0 (probability 1).
    """
    small = F.array(*[F.lit(x) for x in _LOG_FACTORIALS])

    def log_factorial(x: Column) -> Column:
        y = x.cast("double") + 1.0
        stirling = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
        return F.when(x < len(_LOG_FACTORIALS), F.try_element_at(small, x.cast("int") + 1)).otherwise(stirling)

    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    # A term less than 1e-17 of the sum is lost in a double anyway; below the mean that is at most about 9 standard deviations away.
    steps = F.least(k.cast("int"), (F.sqrt(n * p * (1 - p)) * 12 + 60).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, j: Column) -> Column:
        i = k - j  # from term i+1 to term i
        term = s["term"] * (i + 1) / (n - i) * odds
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    total = F.when(steps < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, add, lambda s: s["total"]))
    return F.when(k >= n * p, F.lit(0.0)).otherwise(first + F.log(total))


_LOG_FACTORIALS = [0.0, 0.0, 0.6931471805599453, 1.791759469228055, 3.1780538303479458, 4.787491742782046, 6.579251212010101, 8.525161361065415, 10.60460290274525, 12.801827480081469]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: All steps that a stratum's order has: (rule, cutoff), by rule and from the lowest cutoff on.
STEPS = [(r, c) for r in RULES for c in CUTOFFS]


def _order(half: DataFrame) -> DataFrame:
    """stratum, order: for each of STEPS its place (from 1) in the stratum's order, by the good documents of this half that
    it rejects beyond the base rules, then the higher cutoff, then the rule. Along a rule cutoffs fall."""
    counts = half.groupBy("stratum").agg(*[F.count_if(~F.col("base") & (F.col(r) > c)).alias(f"n_{i}") for i, (r, c) in enumerate(STEPS)])
    keyed = F.array_sort(F.array(*[F.struct(F.col(f"n_{i}").alias("n"), F.lit(-c).alias("c"), F.lit(i).alias("i")) for i, (_, c) in enumerate(STEPS)]))
    places = F.sort_array(F.transform(keyed, lambda x, at: F.struct(x["i"].alias("i"), (at + 1).alias("at"))))
    return counts.select(F.col("stratum").alias("_s"), F.transform(places, lambda x: x["at"]).alias("order"))


def _first_step() -> Column:
    """The place of the first step that rejects a document: 0 if the base rules do, null if none does. A rule's first is
    that of the largest cutoff below its ratio."""
    at = []
    for k, r in enumerate(RULES):
        below = sum((F.when(F.col(r) > c, 1).otherwise(0) for c in CUTOFFS[1:]), F.when(F.col(r) > CUTOFFS[0], 1).otherwise(0))
        at.append(F.when(below > 0, F.element_at("order", (below + k * len(CUTOFFS)).cast("int"))))
    return F.when(F.col("base"), F.lit(0)).otherwise(F.least(*at))


def thresholds(feats: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """stratum, rule, cutoff, n_good, n_false: the strictest cutoffs of each stratum that the labelled holdout allows
    together, with the size of the half that tested them and its documents that all of them and the base rules reject.

    The holdout is all labelled documents with label 1. An id that is labelled twice is good if any label is; rows that
    share an id and a stratum are one document, rejected if any of them is; rows without an id are not in the holdout. A
    step passes when P(X <= n_false) <= delta / strata for X ~ Binomial(n_good, risk); with probability 1 - delta no
    stratum whose rules fire rejects more than ``risk`` of its good documents. A null stratum is one of its own. No
    labels: no thresholds. Strata are few rows; they are broadcast up to BROADCAST_ROWS and joined by shuffle beyond.
    """
    good = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col)).alias("y")).where("y = 1").select("doc_id")
    rated = feats.withColumn("base", base_failed()).select("stratum", "doc_id", "base", *[v.alias(r) for r, v in ratios().items()])
    once = rated.join(good, "doc_id", "left_semi").groupBy("stratum", "doc_id").agg(F.max("base").alias("base"), *[F.max(r).alias(r) for r in RULES])
    once = cut_lineage(once.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2))))
    order = cut_lineage(_order(once.where("half = 0")))
    strata = once.select("stratum").distinct().count()
    small = F.broadcast(order) if strata <= BROADCAST_ROWS else order
    tested = once.where("half = 1").join(small, F.col("stratum").eqNullSafe(F.col("_s"))).select("stratum", _first_step().alias("at"))
    n_good = tested.groupBy(F.col("stratum").alias("_s")).agg(F.count("*").alias("n_good"))
    rejected = tested.where("at is not null").groupBy(F.col("stratum").alias("_r"), "at").agg(F.count("*").alias("n"))
    steps = n_good.select("_s", "n_good", F.explode(F.sequence(F.lit(0), F.lit(len(STEPS)))).alias("step"))
    each = steps.join(rejected, F.col("_s").eqNullSafe(F.col("_r")) & (F.col("step") == F.col("at")), "left")
    upto = Window.partitionBy("_s").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row per step
    each = each.select("_s", "step", "n_good", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n_false"))
    level = F.log(F.lit(delta / max(1, strata)))
    passed = each.where(log_binomial_cdf(F.col("n_false"), F.col("n_good"), risk) <= level)
    # More rejected never pass where fewer did not, so what passes is a beginning of the order.
    last = passed.groupBy(F.col("_s").alias("stratum")).agg(F.max("step").alias("last"), F.max_by("n_good", "step").alias("n_good"), F.max_by("n_false", "step").alias("n_false"))
    named = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff")) for r, c in STEPS])
    allowed = last.join(order, F.col("stratum").eqNullSafe(F.col("_s"))).select("stratum", "last", "n_good", "n_false", F.explode(F.arrays_zip(named.alias("step"), F.col("order").alias("place"))).alias("x")).where("x.place <= last")
    return allowed.groupBy("stratum", F.col("x.step.rule").alias("rule")).agg(F.min("x.step.cutoff").alias("cutoff"), F.first("n_good").alias("n_good"), F.first("n_false").alias("n_false"))


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, failed_rules, kept.

    Null and empty texts have no words and fail the base rule; repeated rows are judged each; an empty table gives no
    rows; a stratum without thresholds (null is one of its own) keeps what the base rules keep; columns other than id,
    text and stratum are not read. The table of thresholds has one row per stratum and is broadcast up to BROADCAST_ROWS
    rows; beyond, it is joined by shuffle.
    """
    feats = cut_lineage(features(docs, id_col, text_col, stratum_col))
    limits = thresholds(feats, labels, risk, delta, id_col).groupBy(F.col("stratum").alias("_stratum")).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    limits = cut_lineage(limits.select("_stratum", *[F.col(r).alias(f"max_{r}") for r in RULES]))
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    failed = F.filter(F.array(*[F.when(v > F.col(f"max_{r}"), F.lit(r)) for r, v in ratios().items()]), lambda x: x.isNotNull())
    judged = feats.join(limits, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.array_join("failed_rules", ",").alias("failed_rules"), (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
