"""The registered queries of this package: every operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cahier.session import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.sharding import kd_shards

    placed = kd_shards(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.class_lm import fit, score

    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    scored = score(docs, fit(docs, fold != 2))
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.substring_dedup import repeated_passages

    found = repeated_passages(_table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.license_scan import scan

    found = scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), F.col("n_unmatched").cast("long").alias("n_unmatched"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=75, words=5)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cahier.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.quality_classifier import fold, score, train

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, _table(spark, sf_dir, "labels"), fold() != 0))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.decontamination import matched_items

    return matched_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), max_epochs=3)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.quality_rules import apply_rules

    return apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.language_id import predict, train

    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(docs, fold != 0)
    return predict(docs, model, keep=((fold == 0).alias("held_out"),)).select("doc_id", "held_out", "lang_pred", "score")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.fill_in_middle import restore, transform

    made = transform(_table(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore("output", "form"), 256).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cahier.llm.hard_negatives import hard_negatives

    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_lm_scoring, op3_substring_dedup, op4_license_scan, op5_jaccard_join, op6_token_counts, op7_quality_classifier, op8_decontamination, op9_mixing, op10_quality_rules, op11_language_id, op12_fill_in_middle, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    from cahier.llm import fill_in_middle, hard_negatives, license_scan, mixing

    return {"op4_license_scan": license_scan.oracle(), "op9_mixing": mixing.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
