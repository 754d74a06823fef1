"""N-gram Jaccard join by vertical partitioning: texts whose five-word shingle sets are alike, 0.8 or more.

All shingles have one global order: those that fill many documents last, and by hash within each part. The order is
cut into fragments; each fragment's overlap of a pair is counted apart and the counts are summed per pair.

Candidates come from the low end of that order. Of a set of n shingles, any partner shares at least one of the
first n - ceil(0.8 n) + 1, so only these are dealt out by shingle. Equal sets are one class from the start. Within
the documents that share a shingle and are of about one length, a first round tests each only against the one
before it and the first few in a random order: that joins large groups of near copies without listing their pairs, and
is all there is to test in small groups. A second round tests what is
left: pairs that share such a shingle and aren't in one component yet. So components are exact, whatever the groups.
Before the texts' whole sets are fetched, the parity of a 2048-bit count sketch gives a lower bound of each pair's
symmetric difference, which drops chance candidates and never a true one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, kind_of, one_each, written
from .shingles import mixed, shingle_hashes, signed, word_hashes

SIZE = 5
#: The global order is cut here, by the top bits of the shingle's hash.
FRAGMENTS = 8
PIECE = 6
SKETCH_BITS = 2048
#: Bits of the short sketch that goes with each document of a shingle; it tells sets of up to 500 shingles apart.
SMALL_BITS = 256
#: Documents of one shingle that are compared with each other in one go.
BLOCK = 1024
#: Documents per shingle and length that each further one is compared with before components are formed.
HUBS = 16
#: Which shingles come last in the order: seen this often among one in SAMPLE documents; at most so many of them.
#: Any order gives the same links; this one keeps the groups of candidates small.
SAMPLE, OFTEN, MOST = 16, 4, 500_000


def _sets(batch: pa.RecordBatch):
    """(row, sorted distinct shingle hashes) of each text."""
    words, begin = word_hashes(batch.column("text").to_pylist())
    for k in range(batch.num_rows):
        yield k, np.unique(shingle_hashes(words[begin[k] : begin[k + 1]], SIZE))


def _halved(batches, rows: int = 512):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that many documents hold, at most MOST, sorted."""

    def each(batches):
        for batch in _halved(batches):
            found = [u for _, u in _sets(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found)) if found else [], pa.int64())], ["h"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(each, "h long")
    counts = written(sample.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN), "frequent")
    total, least = 0, None
    for c, n in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(100_000).toLocalIterator():
        if (total := total + n) > MOST:
            break
        least = c
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(counts.where(F.col("c") >= least).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, sketch, small, prefix): set size, 128-bit signature of the set, parity sketch and the same
    in fewer bits, least shingles."""
    often = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def each(batches):
        last = often.value
        for batch in _halved(batches):
            n, s1, s2, sketch, small, prefix = [], [], [], [], [], []
            for _, u in _sets(batch):
                n.append(len(u))
                s1.append(int(signed(u.sum(dtype=np.uint64, keepdims=True))[0]))
                s2.append(int(signed(mixed(u + np.uint64(77)).sum(dtype=np.uint64, keepdims=True))[0]))
                odd = np.packbits(np.bincount((u & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1)
                sketch.append(odd.tobytes())
                small.append(np.bitwise_xor.reduce(odd.reshape(-1, SMALL_BITS // 8)).tobytes())
                if len(last) and len(u):
                    common = last[np.minimum(np.searchsorted(last, u), len(last) - 1)] == u
                    u = np.concatenate([u[~common], u[common]])
                prefix.append(signed(u[: len(u) - (4 * len(u) + 4) // 5 + 1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sketch, pa.binary()), pa.array(small, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "n", "s1", "s2", "sketch", "small", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind_of(docs)}, n int, s1 long, s2 long, sketch binary, small binary, prefix array<long>")


def _possible(n1, p1, n2, p2):
    """Whether sets of these sizes that meet at these places of their orders, and not before, can be alike."""
    return (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)) & (9 * (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)) >= 4 * (n1 + n2))


def _neighbours(frames):
    """Of rows sorted by (h, length): those whose h occurs again, with themselves as other; and for each of these a row per candidate
    partner: the row before, and the first HUBS rows of like length, with the partner's rep as other.

    Holds one batch and HUBS + 1 rows, so a shingle that fills many documents needs no more memory than a rare one.
    """
    carry = None
    for frame in frames:
        rows = frame.assign(out=False)
        if carry is not None:
            rows = pd.concat([carry, rows], ignore_index=True)
        if not len(rows):
            continue
        h, n, rep, pos, length, out = (rows[c].to_numpy() for c in ("h", "n", "rep", "pos", "length", "out"))
        same = np.concatenate([[False], h[1:] == h[:-1]])
        again = same | np.append(same[1:], False)
        at = np.arange(len(rows))
        start = np.maximum.accumulate(np.where(same & np.concatenate([[False], length[1:] == length[:-1]]), 0, at))
        mine = np.flatnonzero(again & ~out)
        found = [(mine, rep[mine])]
        for k in range(-1, HUBS):
            other = mine - 1 if k < 0 else start[mine] + k
            fits = same[mine] if k < 0 else other < mine
            i, j = mine[fits], other[fits]
            fits = (rep[i] != rep[j]) & _possible(n[j], pos[j], n[i], pos[i])
            found.append((i[fits], rep[j[fits]]))
        i, other = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pd.DataFrame({"h": h[i], "rep": rep[i], "n": n[i], "pos": pos[i], "other": other})
        # the last row waits if nothing before it has its h; it and the first rows of its run meet the next batch
        kept = np.unique(np.append(np.arange(start[-1], min(start[-1] + HUBS, len(rows))), len(rows) - 1))
        carry = rows.iloc[kept].assign(out=again[kept])


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that their sketches don't rule out: (a, b, n_a, n_b, apart), apart a lower bound of how
    many shingles only one of them has."""

    @F.pandas_udf("int")
    def differ(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        u, v = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
        return pd.Series(np.bitwise_count(u ^ v).sum(axis=1).astype(np.int32))

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    # merged at every size, so that what is shuffled grows with the input instead of setting in at some size
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    apart = both.select("a", "b", "n_a", "n_b", differ("sketch_a", "sketch_b").alias("apart"))
    return written(apart.where(9 * F.col("apart") <= F.col("n_a") + F.col("n_b")), "pairs")


def _fragments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, pieces): the sets of the wanted (rep), cut into FRAGMENTS where the global order is cut. Within its
    fragment a shingle goes by PIECE bytes of its hash."""

    def pieces(batches):
        for batch in _halved(batches):
            ids, parts = [], []
            for k, u in _sets(batch):
                cuts = np.searchsorted(u >> np.uint64(64 - FRAGMENTS.bit_length() + 1), np.arange(FRAGMENTS + 1))
                raw = (u << np.uint64(FRAGMENTS.bit_length() - 1)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :PIECE]
                ids.append(k)
                parts.append([raw[cuts[f] : cuts[f + 1]].tobytes() for f in range(FRAGMENTS)])
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(ids, pa.int64())), pa.array(parts, pa.list_(pa.binary()))], ["rep", "pieces"])

    rows = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep", "left_semi")
    return written(rows.mapInArrow(pieces, f"rep {kind_of(docs)}, pieces array<binary>"), "fragments")


def _links(near: DataFrame, held: DataFrame) -> DataFrame:
    """Of pairs (a, b, n_a, n_b) those that are alike, (a, b, overlap): overlaps are counted fragment by fragment and
    summed per pair. held: fragments of all that the pairs name."""

    @F.pandas_udf("int")
    def shared(x: pd.Series, y: pd.Series) -> pd.Series:
        def numbers(piece: bytes) -> np.ndarray:
            out = np.zeros((len(piece) // PIECE, 8), np.uint8)
            out[:, :PIECE] = np.frombuffer(piece, np.uint8).reshape(-1, PIECE)
            return out.view(np.uint64).ravel()

        return pd.Series([len(np.intersect1d(numbers(p), numbers(q))) for p, q in zip(x, y, strict=True)], dtype="int32")

    # a document's fragments lie side by side, so that one shuffle of them serves both sides
    of = lambda x, y: held.select(F.col("rep").alias(x), F.col("pieces").alias(y))
    met = near.select("a", "b", "n_a", "n_b").hint("merge").join(of("a", "x"), "a").hint("merge").join(of("b", "y"), "b")
    parts = met.select("a", "b", "n_a", "n_b", F.explode(F.arrays_zip("x", "y")).alias("part")).where("octet_length(part.x) > 0 and octet_length(part.y) > 0")
    counted = parts.select("a", "b", "n_a", "n_b", shared("part.x", "part.y").alias("part")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    return written(counted.where(100 * F.col("overlap") >= 80 * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b", "overlap"), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Of pairs (a, b, ...) those whose ends aren't in one component of named (rep, component) yet."""
    of = lambda x: named.select(F.col("rep").alias(x), F.col("component").alias(f"c_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def _one_partner(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, n_a, n_b, apart) one for each document that has a partner before it in the order by hash: the
    first one that the sketches say is alike, or else the nearest. So a group meets at few documents."""
    order = lambda x: F.struct(F.xxhash64(x).alias("hash"), F.col(x).alias("rep"))
    # apart counts the odd ones of SKETCH_BITS buckets; so many shingles are in one set only, on average
    only = -SKETCH_BITS / 2 * F.log(F.greatest(1 - 2 * F.col("apart") / SKETCH_BITS, F.lit(1e-9)))
    sided = pairs.withColumns({"first": F.least(order("a"), order("b")), "last": F.greatest(order("a"), order("b"))})
    rank = F.when(9 * only <= F.col("n_a") + F.col("n_b"), 0.0).otherwise(only / (F.col("n_a") + F.col("n_b")))
    return sided.groupBy("last.rep").agg(F.min_by(F.struct("a", "b", "n_a", "n_b"), F.struct(rank, "first")).alias("x")).select("x.*")


def _blocks(frames):
    """Of rows sorted by (h, i, j): the pairs (a, b) of each block that aren't in one component, can be alike by their
    sizes and places, and aren't ruled out by their short sketches. Holds one batch and one block."""
    carry = None
    for frame in frames:
        rows = frame if carry is None else pd.concat([carry, frame], ignore_index=True)
        if not len(rows):
            continue
        key = rows[["h", "i", "j"]].to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        yield from _pairs(rows, [0, *edge])
        carry = rows.iloc[edge[-1] if len(edge) else 0 :]
    if carry is not None:
        yield from _pairs(carry, [0, len(carry)])


def _pairs(rows: pd.DataFrame, edges: list[int]):
    rep, n, pos, c, own = (rows[x].to_numpy() for x in ("rep", "n", "pos", "c", "own"))
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    small = np.frombuffer(b"".join(rows["small"]), np.uint64).reshape(len(rows), -1)
    a, b = [], []
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        for k in range(start, end - 1):
            m = np.arange(k + 1, end)
            fits = (c[m] != c[k]) & (rep[m] != rep[k]) & _possible(n[k], pos[k], n[m], pos[m]) & ((i[k] == j[k]) | (own[m] != own[k]))
            m = m[fits]
            m = m[9 * np.bitwise_count(small[m] ^ small[k]).sum(axis=1, dtype=np.int64) <= n[m].astype(np.int64) + n[k]]
            a += [rep[k]] * len(m)
            b += rep[m].tolist()
    if a:
        yield pd.DataFrame({"a": a, "b": b})


def _open_pairs(met: DataFrame, sets: DataFrame, named: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a shingle of met, aren't in one component and may be alike.

    The documents of a shingle are dealt out to blocks of about BLOCK, and each pair of blocks is one task's work, so
    that a frequent shingle neither fills a task nor makes a row for each of its pairs.
    """
    own = met.where("other = rep").select("h", "rep", "n", "pos")
    marked = own.join(named, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    mixed_up = marked.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("h", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    open_ = written(marked.join(written(mixed_up, "mixed"), "h"), "open")
    rows = open_.join(sets.select(F.col("doc_id").alias("rep"), "small").hint("merge"), "rep").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("blocks")).cast("int"))
    dealt = rows.select("h", "rep", "n", "pos", "c", "small", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "pos", "c", "small")
    kind = sets.schema["doc_id"].dataType.simpleString()
    found = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInPandas(_blocks, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document.

    class_id is the least doc_id with the same set; component_id the least that links reach. A text without words, and
    a null one, has no shingles and is linked with nothing. docs needs doc_id, of any type that has an order, and text.
    Rows with one doc_id are one document, that with the least text, and come back as one row; those with a null
    doc_id come back one by one, linked with nothing. Extra columns are ignored; an empty table gives an empty one.
    """
    docs = one_each(docs.select("doc_id", "text"))
    rows = written(shingle_sets(docs), "sets")
    first = rows.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = written(first, "first-copies")  # of its own, so that the rows of a text with many copies can be split in the join
    member = rows.select("doc_id", "n", "s1", "s2").join(first.hint("merge"), ["n", "s1", "s2"], "left")
    member = written(member.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "classes")
    sets = rows.join(member.where("doc_id = rep and n > 0").select("doc_id").hint("merge"), "doc_id", "left_semi")
    entries = sets.select(F.col("doc_id").alias("rep"), "n", F.posexplode("prefix").alias("pos", "h"))
    length = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    spread = entries.repartition("h").withColumn("length", length).sortWithinPartitions("h", "length", F.xxhash64("rep"), "rep").select("h", "length", "n", "rep", "pos")
    kind = kind_of(docs)
    met = written(spread.mapInPandas(_neighbours, f"h long, rep {kind}, n int, pos int, other {kind}"), "shared")
    tried = met.where("other <> rep").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    near = _near(tried, rows)
    # one partner of each first, the first one in the order by hash: that joins most groups with a pair for each document
    chosen = written(_one_partner(near), "chosen")
    held = _fragments(docs, _ends(chosen))
    links = _links(chosen, held)
    named = components(links).withColumnRenamed("id", "rep")
    # what is left: pairs that share a shingle and aren't in one component yet
    rest = _near(_open_pairs(met, rows, named).join(near, ["a", "b"], "left_anti"), rows)
    rest = written(rest.unionByName(_apart(near.join(chosen, ["a", "b"], "left_anti"), named)), "rest")
    ends = written(_ends(rest), "ends")
    new = _fragments(docs, ends.join(_ends(chosen), "rep", "left_anti"))
    links = links.unionByName(_links(rest, held.join(ends, "rep", "left_semi").unionByName(new)))
    final = components(links).select(F.col("id").alias("rep"), "component")
    out = member.join(final.hint("merge"), "rep", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, the one with the least doc_id; a text without words is a group of its own.

    Rows with a null doc_id stay.
    """
    goes = similar_groups(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(goes, "doc_id", "left_anti")
