"""Quality rules as a ledger: every rule runs once per document and leaves one failure bit and its measurement.

A policy is a named set of rules. Applying one, comparing versions and ablating a rule then need only bitwise
work on the ledger, never the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, blank_words, let


@dataclass(frozen=True)
class Rule:
    """fails: a condition over the measured columns; a null counts as passed."""

    name: str
    bit: int
    fails: str


#: Integers only, so that every engine gives the same verdict.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_trigrams", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", 2, "5 * n_symbols > n_words"),
    Rule("short_words", 3, "10 * word_chars < 25 * n_words"),
    Rule("long_words", 4, "word_chars > 12 * n_words"),
    Rule("duplicate_lines", 5, "2 * n_dup_lines > n_lines"),
    Rule("shouting", 6, "2 * n_upper > word_chars"),
)
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ("few_words", "repeated_trigrams"),
    "v2": ("few_words", "repeated_trigrams", "symbol_heavy", "short_words", "long_words", "duplicate_lines", "shouting"),
}


def policy_mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs at least twice."""

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(rows: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(rows, k)["h"] == x["h"], F.lit(False))
            again = F.filter(rows, lambda x, k: ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))) | same(x, k + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["k"], x["k"] + 1, x["k"] + 2)))))

        rows = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(rows, of_sorted))

    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda k: F.xxhash64(F.get(words, k), F.get(words, k + 1), F.get(words, k + 2)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(grams, of_hashes))


def ledger(docs: DataFrame) -> DataFrame:
    """docs with the measurements and fail_bits (bit k set: rule k failed).

    A null or empty text has no words and measures 0 throughout, so it fails few_words alone. Other columns of
    docs stay; those that are named like a measurement are replaced. Repeated ids are measured row by row.
    """

    def measure(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_upper"),
        )

    text = F.coalesce(F.col("text"), F.lit(""))
    names = {"n_words": "n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_lines": "lines.n", "n_dup_lines": "lines.dup", "n_repeat_words": "n_repeat_words", "n_upper": "n_upper"}
    out = docs.withColumn("__m", let(blank_words(text), measure)).withColumns({k: F.col(f"__m.{v}") for k, v in names.items()}).drop("__m")
    bits = [F.when(F.coalesce(F.expr(r.fails), F.lit(False)), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return out.withColumn("fail_bits", total.cast("long"))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds policy and kept: no rule of the policy failed."""
    return rows.withColumns({"policy": F.lit(policy), "kept": F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0})


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: failed (documents that fail it) and only (those that nothing else of the policy rejects).

    The ledger is first counted per distinct mask, at most 2 ** rules rows, so one pass serves every rule.
    """
    mask = policy_mask(policy)
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).count()
    return masks.agg(
        *[F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << r.bit)) != 0, F.col("count")).otherwise(0)).alias(f"{r.name}__failed") for r in RULES if r.name in POLICIES[policy]],
        *[F.sum(F.when(F.col("bits") == F.lit(1 << r.bit), F.col("count")).otherwise(0)).alias(f"{r.name}__only") for r in RULES if r.name in POLICIES[policy]],
    ).select(
        F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.coalesce(F.col(f"{r.name}__failed"), F.lit(0)).alias("failed"), F.coalesce(F.col(f"{r.name}__only"), F.lit(0)).alias("only")) for r in RULES if r.name in POLICIES[policy]])).alias("x")
    ).select("x.*")
