"""The queries of this subpackage, for __spark_entry__.py: each applies one operator to its whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontaminate, langid, line_dedup, mixing, ngram_join, pii, quality, quality_rules, substring_dedup, token_alignment, toxicity, warc
from .common import fold_of, table, written


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"), 5)
    model = langid.train(docs.where(fold != 0))
    return langid.identify(docs, model).withColumn("held_out", fold == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.label_domains(table(spark, sf_dir, "labels")), mixing.TARGETS)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(doc_id, label) of the rows that may teach: fold 1 of 3 is held out."""
    return table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 3) != 1).select("doc_id", F.col(label).alias("label"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _labelled(spark, sf_dir, "toxic"))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.policy_mask("v1"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_exact", "n_near", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), "n_left", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.score(docs, quality.train(docs, _labelled(spark, sf_dir, "quality")))
    return rows.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = conversation_trie.share_heads(conversation_trie.sequences(table(spark, sf_dir, "conversations")))
    nodes = conversation_trie.prefix_nodes(shared)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(warc.records_of(table(spark, sf_dir, "pages")), warc.new_folder(spark))
    return warc.resolved(warc.records(warc.read_archives(files))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") + F.col("n_b") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def near_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's index asked for near matches."""
    return decontaminate.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, alone or at all, from op6's ledger, which is written once."""
    rows = written(quality_rules.ledger(table(spark, sf_dir, "documents")).select("doc_id", "fail_bits"), "ledger")
    of = [quality_rules.ablation(rows, p).select(F.lit(p).alias("policy"), "rule", "failed", "only") for p in quality_rules.POLICIES]
    return reduce(DataFrame.unionByName, of)


def queries() -> dict:
    named = {"near_benchmark_items": near_benchmark_items, "rule_ablation": rule_ablation}
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | named
