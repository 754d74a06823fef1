"""Benchmark decontamination by a positional inverted index.

The index is a stored table of postings (document, term, position) of every corpus word that some item has; texts are cut
into words once for it. Looked up are, per window of test words, its two rarest terms by corpus count. A window can occur in a document only where both terms lie on one diagonal, that is, at
positions whose offsets from the item's positions are equal. Intersecting the offset-adjusted lists leaves few
(document, item, diagonal) triples; along these the words are compared, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, one_each, written

#: What parts terms, and the longest window.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
RAREST = 2


def terms(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PARTS), "")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, words, w): the terms of each item that has any, and the length of its windows."""
    words = items.select("item_id", terms(F.col("text")).alias("words")).where(F.size("words") > 0)
    return words.withColumn("w", F.least(F.size("words"), F.lit(WINDOW)))


def postings(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The index: (doc_id, term, pos), each place where docs (doc_id, text) hold a word of items (item_terms()), as a written table."""
    vocabulary = written(items.select(F.explode("words").alias("term")).distinct(), "vocabulary")  # a file's size is known: broadcast only if small
    places = docs.select("doc_id", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    return written(places.join(vocabulary, "term", "left_semi").select("doc_id", "term", "pos"), "postings")


def rarest_terms(items: DataFrame, index: DataFrame) -> DataFrame:
    """(term, item_id, n, at): where the items, of n terms each, hold the RAREST terms of each of their windows, as a written table.

    items: of item_terms(); index: of postings(). Ties go to the earlier place.
    """
    counted = index.groupBy("term").agg(F.count("*").alias("df"))
    placed = items.select("item_id", "w", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    known = placed.join(counted, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    listed = known.groupBy("item_id", "w", "n").agg(F.array_sort(F.collect_list(F.struct("at", "df", "term"))).alias("x"))
    starts = listed.select("item_id", "n", "w", "x", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("w") + 1)).alias("s"))
    window = F.array_sort(F.transform(F.slice("x", F.col("s"), F.col("w")), lambda y: F.struct(y["df"].alias("df"), y["at"].alias("at"), y["term"].alias("term"))))
    return written(starts.select("item_id", "n", F.explode(F.slice(window, 1, RAREST)).alias("y")).select("y.term", "item_id", "n", "y.at").distinct(), "rarest")


def diagonals(index: DataFrame, looked_up: DataFrame) -> DataFrame:
    """(doc_id, item_id, n, shift): diagonals on which two looked-up terms of an item meet; of a one-term item, one."""
    places = looked_up.groupBy("item_id").agg(F.least(F.count("*"), F.lit(RAREST)).alias("least"))
    by_term = looked_up.join(places, "item_id")
    met = index.join(by_term, "term").select("doc_id", "item_id", "n", (F.col("pos") - F.col("at")).alias("shift"), "least")
    return met.groupBy("doc_id", "item_id", "n", "shift").agg(F.count("*").alias("c"), F.first("least").alias("least")).where("c >= least").drop("c", "least")


def window_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, pos): the document positions that lie in an occurrence of one of the item's windows."""
    tests = item_terms(items)
    index = postings(docs, tests)
    found = written(diagonals(index, rarest_terms(tests, index)), "diagonals")
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "n", "shift")).alias("met"))
    cut = (
        # merged at every size, so that the shuffle of the texts grows with them instead of setting in at some size
        docs.select("doc_id", "text").join(per_doc.hint("merge"), "doc_id").select("doc_id", "met", terms(F.col("text")).alias("words"))
        .select("doc_id", let(F.col("words"), lambda ws: F.transform("met", lambda m: F.struct(
            m["item_id"].alias("item_id"), m["shift"].alias("shift"),
            F.slice(ws, F.greatest(m["shift"], F.lit(0)) + 1, F.greatest(m["n"] + F.least(m["shift"], F.lit(0)), F.lit(0))).alias("part")))).alias("cut"))
        .select("doc_id", F.explode("cut").alias("c")).select("doc_id", "c.*")
    )
    # part begins at item position `skip`; equal words are 1s, and those in a run that is long enough become 2s
    skip = F.greatest(-F.col("shift"), F.lit(0))
    same = F.array_join(F.zip_with(F.slice("words", skip + 1, F.size("words")), F.col("part"), lambda x, y: F.when(x == y, "1").otherwise("0")), "")
    in_run = F.concat(F.lit("(?:(?<!1)(?=1{"), F.col("w").cast("string"), F.lit(r"})|(?!^)\G)1"))
    marks = cut.join(tests, "item_id").select("doc_id", "item_id", F.posexplode(F.split(F.regexp_replace(same, in_run, F.lit("2")), "")).alias("k", "mark"), (skip + F.col("shift")).alias("start"))
    return marks.where("mark = '2'").select("doc_id", "item_id", (F.col("k") + F.col("start")).alias("pos")).distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    A window is 13 consecutive words of an item, all of them where it has fewer; a document word in an occurrence
    of one is hit. contaminated: 20 * n_hit >= n_words and n_hit > 0. Null texts have no words. docs needs doc_id, of any
    type, and text; items item_id and text; other columns are ignored. Rows with one doc_id are one document, that with
    the least text, and come back as one row; rows with a null doc_id come back one by one, without hits. Items with
    one text are hit together. Empty tables give no hits or no rows.
    """
    docs = one_each(docs.select("doc_id", "text"))
    hits = written(window_hits(docs, items), "hits")
    words = hits.select("doc_id", "pos").distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    listed = hits.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    counted = docs.select("doc_id", F.size(terms(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(words.join(listed, "doc_id"), "doc_id", "left")
    hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def proximity(docs: DataFrame, items: DataFrame, slop: int = 3) -> DataFrame:
    """(doc_id, item_id, n_near): items whose rare terms lie in a document in almost the item's order and distance.

    Two looked-up terms of an item count as near where their offset-adjusted positions differ by at most slop
    words; n_near counts such neighbours in the sorted list of adjusted positions. Exact phrases are near, too. Pairs
    without neighbours have no row, nor have null texts, null ids and empty tables. Rows with one doc_id are one document, that
    with the least text. Other columns are ignored.
    """
    tests = item_terms(items)
    index = postings(one_each(docs.select("doc_id", "text")).where("doc_id is not null"), tests)
    met = index.join(rarest_terms(tests, index), "term").select("doc_id", "item_id", "at", (F.col("pos") - F.col("at")).alias("shift"))
    order = Window.partitionBy("doc_id", "item_id").orderBy("shift", "at")
    near = met.withColumns({"d": F.col("shift") - F.lag("shift").over(order), "other": F.lag("at").over(order)}).where((F.col("d") <= slop) & (F.col("other") != F.col("at")))
    return near.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_near"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    return docs.join(contamination(docs, items).where("contaminated").select("doc_id"), "doc_id", "left_anti")
