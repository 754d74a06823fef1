"""Line deduplication by deletion neighbourhoods, the earliest line kept.

Lines are sequences of words, and the edit distance counts inserted, deleted or replaced words. Two lines with at
least MIN_WORDS words each that lie within one edit are near copies; equal lines of any length are copies. Of a
group of equal lines the first by (doc_id, line number) counts as the line; a line goes if it isn't the first of
its equals, or if a line within the bound comes earlier, be that one kept or not. Lines without a word always stay.

How the join stays small: equal lines are one class from the start. Within one edit, either the first or the last
half of the shorter line is the same in both, so only classes that share such a half with another one can have a
near copy; these alone emit variants, and only those that lack a word outside the shared half. Nothing is compared all against all: lines that lack the same word at
the same place are within one edit of each other, so the earliest of each such group stands for it, and an
inserted word is found by an equality join with whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, blank_words, let, repeated_ids, written

MIN_WORDS = 5
#: Tasks that share the occurrences of one line.
SALTS = 8


def _halves(words: Column, n: Column) -> Column:
    """Hashes of the first and last q words, for q that suit a partner of the same length, one more or one less."""

    def keys(q: Column) -> Column:
        return F.array(F.xxhash64(F.lit("first"), F.slice(words, 1, q)), F.xxhash64(F.lit("last"), F.slice(words, n - q + 1, q)))

    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.when(n < MIN_WORDS, F.array().cast("array<bigint>")).when(half == less, keys(half)).otherwise(F.concat(keys(half), keys(less)))


def _xor(values: Column, start: Column | None = None) -> Column:
    return F.aggregate(values, F.lit(0).cast("long") if start is None else start, lambda x, y: x.bitwiseXOR(y))


def _whole_key(words: Column) -> Column:
    """The key of a sequence of words: the hashes of each word with its place, by exclusive or."""
    return _xor(F.transform(words, lambda w, i: F.xxhash64(w, i)))


def _variant_keys(words: Column) -> Column:
    """The keys of the sequences that lack word 0, 1, 2 and so on.

    Each differs from the one before in one word at one place. The changes are summed up over blocks of the root of
    their number first, so that n words take n times that root of steps, not n times n.
    """

    def keys(changes: Column) -> Column:
        n = F.size(changes)
        s = F.ceil(F.sqrt(n)).cast("int")

        def block(sums: Column, b: Column) -> Column:
            ks = F.sequence(F.lit(1), F.least(s, n - b * s))
            return let(_xor(F.slice(sums, 1, b)), lambda start: F.transform(ks, lambda k: _xor(F.slice(changes, b * s + 1, k), start)))

        blocks = F.sequence(F.lit(0), F.floor((n - 1) / s).cast("int"))
        return let(F.transform(blocks, lambda b: _xor(F.slice(changes, b * s + 1, s))), lambda sums: F.flatten(F.transform(blocks, lambda b: block(sums, b))))

    places = F.sequence(F.lit(1), F.size(words) - 1)
    moved = lambda k: F.xxhash64(F.get(words, k), k - 1)
    change = lambda k: F.xxhash64(F.get(words, k - 1), k - 1).bitwiseXOR(moved(k))
    return let(F.concat(F.array(_xor(F.transform(places, moved))), F.transform(places, change)), keys)


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two different sequences are alike but for one word replaced, missing or added. Linear: what follows the
    first difference has to be the same."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    rest = lambda words, skipped: F.slice(words, at + F.lit(skipped), F.greatest(F.size(words), F.lit(1)))
    n, m = F.size(a), F.size(b)
    return (
        F.when(n == m, rest(a, 1) == rest(b, 1)).when(n == m + 1, rest(a, 1) == rest(b, 0)).when(m == n + 1, rest(a, 0) == rest(b, 1)).otherwise(False)
    )


def _salted(df: DataFrame) -> DataFrame:
    """A row of df for each of the SALTS tasks that the rows of one key go to."""
    return df.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")


def _hashes(words: Column) -> list[Column]:
    """128 bits of a sequence of words."""
    return [F.xxhash64(words), F.xxhash64(F.lit("second"), words)]


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def line_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, verdict) of the lines that go: verdict 'exact' or 'near'.

    docs needs doc_id, unique, and text (dedup_lines() sees to repeated ids); a null text has no lines. Everything is shuffled by a hash of
    lines, with counts and minima formed before the shuffle, so a line that fills a third of the rows is no burden.
    """
    words = blank_words(F.col("line"))
    described = _lines(docs).where(F.col("line").rlike(NOT_BLANK)).select(
        "doc_id", "line_no",
        let(words, lambda w: F.struct(F.size(w).alias("n"), *[h.alias(k) for h, k in zip(_hashes(w), ("h1", "h2"), strict=True)], _halves(w, F.size(w)).alias("halves"))).alias("x"),
    )
    lines = written(described.select("doc_id", "line_no", "x.*"), "lines")
    at = F.struct("doc_id", "line_no")
    classes = written(
        lines.groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("halves").alias("halves")), "classes"
    )
    halves = classes.select("at", F.posexplode("halves").alias("i", "half")).select("at", (F.col("i") % 2).alias("side"), "half")
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    met = halves.withColumn("salt", _salt("at")).join(_salted(shared), ["half", "salt"], "left_semi").select("at.doc_id", "at.line_no", "side")
    sides = met.repartition("doc_id").groupBy("doc_id", "line_no").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    near_docs = sides.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "low", "high")).alias("wanted"))
    texts = written(
        docs.select("doc_id", "text").join(near_docs, "doc_id")
        .select("doc_id", let(F.split("text", "\n"), lambda parts: F.transform("wanted", lambda k: F.struct(k.alias("k"), F.get(parts, k["line_no"]).alias("line")))).alias("x"))
        .select("doc_id", F.explode("x").alias("x"))
        .select(F.struct("doc_id", "x.k.line_no").alias("at"), "x.k.low", "x.k.high", blank_words(F.col("x.line")).alias("words")),
        "near-lines",
    )
    # a shared first half leaves the words after it to differ, a shared last half those before it
    q = F.floor((F.size("words") - 1) / 2).cast("int")
    outside = lambda k: ((F.col("low") == 0) & (k >= q)) | ((F.col("high") == 1) & (k < F.size("words") - q))
    numbered = F.transform(_variant_keys(F.col("words")), lambda v, k: F.struct(k.alias("k"), v.alias("v")))
    emitted = texts.select("at", F.size("words").alias("n"), F.explode(F.filter(numbered, lambda x: outside(x["k"]))).alias("x"))
    variants = written(emitted.select("at", F.xxhash64("x.v", "n", "x.k").alias("same"), "x.v"), "variants")
    earliest = variants.groupBy("same").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").select("same", "first")
    replaced = variants.select("same", "at", _salt("at")).join(_salted(earliest), ["same", "salt"]).where("first < at").select("at", F.col("first").alias("other"))
    whole = texts.select(F.col("at").alias("short"), _whole_key(F.col("words")).alias("v"))
    inserted = variants.select("v", "at").join(whole, "v").where("at <> short").select(F.greatest("at", "short").alias("at"), F.least("at", "short").alias("other"))
    pairs = replaced.unionByName(inserted).groupBy("at").agg(F.min("other").alias("other"))
    verified = (
        pairs.join(texts.select("at", "words"), "at").join(texts.select(F.col("at").alias("other"), F.col("words").alias("other_words")), "other")
        .where(_within_one_edit(F.col("words"), F.col("other_words"))).select("at")
    )
    near = classes.join(verified, "at", "left_semi").select("h1", "h2", "at", F.lit(True).alias("near"))
    copied = classes.where("copies > 1").select("h1", "h2", "at", F.lit(False).alias("near"))
    gone = near.unionByName(copied).groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("near").alias("near"))
    # a line of a third of the documents is one key: its rows go to SALTS tasks, and each gets the class's row
    return (
        lines.withColumn("salt", _salt("doc_id")).join(_salted(gone), ["h1", "h2", "salt"]).where(F.col("near") | (at > F.col("first")))
        .select("doc_id", "line_no", F.when(at > F.col("first"), "exact").otherwise("near").alias("verdict"))
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that go, plus n_exact and n_near (lines removed), removed (their numbers) and n_left
    (lines with a word that stay).

    Every document comes back, an emptied one with the text ''; one with a null text as it is. n_chars, where docs
    has it, is set to the length of what is left. Columns of docs named like the new ones are replaced.
    Rows with one doc_id and one text are one document, whose rows get the same lines; texts that share a doc_id are
    documents of their own, in the order of a hash of theirs.
    """
    key = "doc_id"
    if not repeated_ids(docs).isEmpty():
        key, docs = "__key", docs.withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("h")))
        lined = docs.select(F.col("__key").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    else:
        lined = docs.select("doc_id", "text")
    per_doc = line_verdicts(lined).groupBy(F.col("doc_id").alias(key)).agg(
        F.count_if(F.col("verdict") == "exact").alias("__exact"), F.count_if(F.col("verdict") == "near").alias("__near"), F.collect_list("line_no").alias("__gone")
    )
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    parts = F.split(F.col("text"), "\n")
    kept = let(parts, lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone), lambda k: F.get(p, k)))
    out = docs.join(per_doc, key, "left").withColumn("__kept", kept).withColumns({
        "text": F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join("__kept", "\n")),
        "n_exact": F.coalesce("__exact", F.lit(0)), "n_near": F.coalesce("__near", F.lit(0)),
        "removed": F.array_sort(gone),
        "n_left": F.coalesce(F.size(F.filter("__kept", lambda x: x.rlike(NOT_BLANK))), F.lit(0)).cast("long"),
    })
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(gone) == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.drop("__exact", "__near", "__gone", "__kept", "__key")
