"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes with the counts of what followed them. A text's code
length under a frozen tree is the sum over its bytes of -log2 of the predicted probability: in the longest known
context the byte's share, or else the escape probability times the prediction of the next shorter context, down to
1/256. Escapes follow method C: distinct followers against total plus distinct. The shortest code names the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, written

ORDER = 3
#: Up to so many leaves (contexts of ORDER bytes with a follower, per language) the trees go to the tasks as a whole;
#: beyond, texts' contexts are joined with them. Both give the same code lengths.
MOST_LEAVES = 2_000_000
UNKNOWN = "und"
_START = b"\n" * ORDER
_SLOTS = 21


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """ORDER + 1 bytes up to each byte of each text as one number, and where each text's numbers begin."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(x for r in raw for x in (_START, r)), np.uint8).astype(np.uint32)
    size = np.array([len(r) for r in raw], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    if len(data) < ORDER + 1:
        return np.empty(0, np.uint32), begin
    codes = data[3:] | data[2:-1] << np.uint32(8) | data[1:-2] << np.uint32(16) | data[:-3] << np.uint32(24)
    inside = np.ones(len(data), bool)
    for k in range(ORDER):
        inside[begin[:-1] + np.arange(len(raw)) * ORDER + k] = False
    return codes[inside[ORDER:]], begin


def count_contexts(rows: DataFrame) -> DataFrame:
    """(lang, code, n) over all of rows (lang, text): summed within each task before the shuffle."""

    def each(batches):
        held: dict[str, list] = {}

        def merged(parts):
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                for k in range(0, len(texts), 256):
                    codes, _ = _codes([t for x, t in zip(langs[k : k + 256], texts[k : k + 256], strict=True) if x == lang])
                    held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                if len(held[lang]) >= 32:
                    held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            codes, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])

    return rows.select("lang", "text").mapInArrow(each, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(rows: DataFrame) -> DataFrame:
    """The trees of all languages: their leaves (lang, code, n), all of them. rows: lang, text; null languages and texts
    are left out, repeated rows count as often as they come."""
    return written(count_contexts(rows.where("lang is not null and text is not null")), "contexts")


def collected(model: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language the leaves and counts of its tree; for models of at most MOST_LEAVES rows."""
    whole = model.toPandas().sort_values(["lang", "code"])
    return {lang: (x["code"].to_numpy().astype(np.uint32), x["n"].to_numpy(np.int64)) for lang, x in whole.groupby("lang")}


class Trees:
    """Frozen statistics of all languages, ready to score."""

    def __init__(self, model: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(model)
        self.levels = [self._levels(*model[x]) for x in self.langs]
        known = np.unique(np.concatenate([model[x][0] for x in self.langs]))
        self.keys = np.zeros(1 << _SLOTS, np.uint32)
        self.at = np.full(1 << _SLOTS, -1, np.int32)
        slot = self._slot(known)
        self.keys[slot], self.at[slot] = known, np.arange(len(known))
        self.cost = self._code_length(known).astype(np.float32)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)

    @staticmethod
    def _levels(codes: np.ndarray, n: np.ndarray):
        """From the longest context to none: leaves, counts, contexts, totals, distinct followers."""
        out = []
        for k in range(ORDER, -1, -1):
            leaf, at = np.unique(codes & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(at, n)
            context, of, distinct = np.unique(leaf >> np.uint32(8), return_inverse=True, return_counts=True)
            out.append((leaf, count, context, np.bincount(of, count), distinct))
        return out

    def _code_length(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code after the others, per language."""
        out = np.zeros((len(codes), len(self.langs)))
        for j, levels in enumerate(self.levels):
            open_ = np.arange(len(codes))
            for k, (leaf, count, context, total, distinct) in zip(range(ORDER, -1, -1), levels, strict=True):
                here = codes[open_] & np.uint32((1 << 8 * (k + 1)) - 1)
                c = np.minimum(np.searchsorted(context, here >> np.uint32(8)), len(context) - 1)
                known = context[c] == here >> np.uint32(8)
                x = np.minimum(np.searchsorted(leaf, here), len(leaf) - 1)
                found = known & (leaf[x] == here)
                whole = np.log2(total[c] + distinct[c])
                out[open_[found], j] += (whole - np.log2(count[x]))[found]
                escape = known & ~found
                out[open_[escape], j] += (whole - np.log2(distinct[c]))[escape]
                open_ = open_[~found]
            out[open_, j] += 8
        return out

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """Bits of each text under each language."""
        codes, begin = _codes(texts)
        slot = self._slot(codes)
        hit = (self.keys[slot] == codes) & (self.at[slot] >= 0)
        bits = self.cost[np.where(hit, self.at[slot], 0)]
        if not hit.all():
            rare, at = np.unique(codes[~hit], return_inverse=True)
            bits[~hit] = self._code_length(rare)[at]
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(bits, axis=0, dtype=np.float64)])
        return sums[begin[1:]] - sums[begin[:-1]]


def identify(docs: DataFrame, model: DataFrame, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """docs' doc_id and text scored: (doc_id, lang_pred, score, bits_per_byte).

    score is the share of the best language when each is weighted by 2 to the minus code length. A null text, one
    without a letter, or an empty model gives 'und' with score 0. Of equal code lengths the first name wins. A row for
    each of docs, repeated ones too; doc_id may have any type, other columns are ignored.
    """
    if model.count() > most_leaves:
        return _identify_joined(docs, model)
    trees_of = collected(model)
    # plain arrays, so that executors can read them without this package
    frozen = docs.sparkSession.sparkContext.broadcast(vars(Trees(trees_of))) if trees_of else None

    def each(batches):
        trees = None
        if frozen:
            trees = Trees.__new__(Trees)
            vars(trees).update(frozen.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = batch.column("text").to_pylist()
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
                if trees is None:
                    pred, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                else:
                    bits = trees.code_lengths(texts)
                    best = bits.argmin(axis=1)
                    least = bits.min(axis=1)
                    score = np.where(letters, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0)
                    pred = [trees.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                    rate = np.where(letters, least / [max(1, len((t or "").encode("utf-8", "replace"))) for t in texts], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind_of(docs)}, lang_pred string, score double, bits_per_byte double")


def _joined_costs(codes: DataFrame, model: DataFrame) -> DataFrame:
    """(code, lang, bits): the code length of each code (code) in each language, by joins with the trees' levels."""
    langs = model.select("lang").distinct()
    rows = codes.crossJoin(F.broadcast(langs)).withColumns({"bits": F.lit(0.0), "open": F.lit(True)})  # a row per language
    for k in range(ORDER, -1, -1):
        leaf = F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        leaves = written(model.groupBy("lang", leaf.alias("leaf")).agg(F.sum("n").alias("count")), f"leaves-{k}")
        contexts = leaves.groupBy("lang", F.shiftrightunsigned("leaf", 8).alias("context")).agg(F.sum("count").alias("total"), F.count("*").alias("distinct"))
        rows = rows.withColumn("leaf", leaf).join(leaves, ["lang", "leaf"], "left").withColumn("context", F.shiftrightunsigned("leaf", 8)).join(contexts, ["lang", "context"], "left")
        known, found = F.col("total").isNotNull(), F.col("count").isNotNull()
        step = F.when(F.col("open") & known, F.log2(F.col("total") + F.col("distinct")) - F.log2(F.when(found, F.col("count")).otherwise(F.col("distinct")))).otherwise(0.0)
        rows = rows.withColumn("bits", F.col("bits") + step).withColumn("open", F.col("open") & ~found).select("code", "lang", "bits", "open")
    return rows.select("code", "lang", F.when(F.col("open"), F.col("bits") + 8).otherwise(F.col("bits")).alias("bits"))


def _identify_joined(docs: DataFrame, model: DataFrame) -> DataFrame:
    """identify() for trees of any size: each text's contexts are counted, and joined with their code lengths."""

    def each(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                found, begin = _codes(batch.column("text").to_pylist())
                parts = [np.unique(found[a:b], return_counts=True) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                of = np.repeat(np.arange(len(parts)), [len(c) for c, _ in parts])
                codes, n = (np.concatenate([np.empty(0, np.int64), *(p[j].astype(np.int64) for p in parts)]) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in ("h1", "h2")), pa.array(codes), pa.array(n)], ["h1", "h2", "code", "n"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    counts = texts.where("text is not null").mapInArrow(each, "h1 long, h2 long, code long, n long")
    counts = written(counts.groupBy("h1", "h2", "code").agg(F.max("n").alias("n")), "text-codes")  # equal texts are one
    costs = written(_joined_costs(counts.select("code").distinct(), model), "code-lengths")
    bits = counts.join(costs, "code").groupBy("h1", "h2", "lang").agg(F.sum(F.col("n") * F.col("bits")).alias("bits"))
    told = bits.groupBy("h1", "h2").agg(F.min(F.struct("bits", "lang")).alias("least"), F.collect_list("bits").alias("all"))
    rows = texts.join(told, ["h1", "h2"], "left")
    fine = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.col("least").isNotNull()
    share = 1 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), F.greatest(F.col("least.bits") - x, F.lit(-1000.0))))
    return rows.select("doc_id", F.when(fine, F.col("least.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(fine, share).otherwise(0.0).alias("score"), F.when(fine, F.col("least.bits") / F.greatest(F.octet_length("text"), F.lit(1))).otherwise(0.0).alias("bits_per_byte"))
