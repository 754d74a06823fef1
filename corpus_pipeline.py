"""A corpus pipeline of five stages over the table documents; each stage is one operator of siftline.llm.

Every stage takes (spark, docs, sf_dir) and returns documents again, the last one with sampling rates. run() writes
each stage's rows to the shared folder and reads them back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from siftline.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2 of the quality rules keeps, each row judged by itself. Null and empty texts go, as they have
    too few words. All columns stay as they are, those too that are named like a measurement."""
    rows = docs.select("text", F.struct(*docs.columns).alias("__row"))
    return quality_rules.apply_policy(quality_rules.ledger(rows), "v2").where("kept").select("__row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one goes if that leaves it without a word. Texts that never had one stay, null ones
    too. text and n_chars follow; all other columns stay as they are."""
    own = [c for c in docs.columns if c in ("doc_id", "text", "n_chars")]
    rest = [c for c in docs.columns if c not in own]
    rows = docs.select(*own, F.struct(F.lit(0).alias("__none"), *rest).alias("__rest"))
    out = line_dedup.dedup_lines(rows).where("n_left > 0 or size(removed) = 0")
    return out.select(*[F.col(c) if c in own else F.col(f"__rest.{c}").alias(c) for c in docs.columns])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id. Texts without words, and rows with a null
    doc_id, are never copies; of rows with one doc_id all stay or go together."""
    return ngram_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items. Null and empty texts, and rows with a null doc_id, stay; without
    items all do."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their domain posteriors and sampling rates, which replace columns of those names. Rows with one
    doc_id get one rate; those with a null doc_id get none."""
    rates = mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), mixing.TARGETS)
    return docs.drop(*(c for c in rates.columns if c != "doc_id")).join(rates, "doc_id", "left")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return docs


#: Fitted rates can't be stated in SQL; tests/llm/test_queries.py holds the stages against brute force.
ORACLE_SQL = None
