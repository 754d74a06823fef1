"""The trie of conversation prefixes, without building a tree.

Conversations, as sequences of turn keys, are sorted; neighbours' common prefixes (LCPs) then say everything: the members
of a prefix of depth d are the interval around any of them within which no LCP is less than d. A sparse table of LCP
minima lets each candidate prefix (sequence, depth) find both ends of its interval by a binary search of its own; the
candidate at the left end speaks for the node. No stack, no order of visits.

The sorted sequences are cut into blocks of bounded size, one task each. A prefix that goes on over a block's ends
leaves a piece in each block; pieces are summed by the digest of the prefix. Each end of a block has one path of such
prefixes, so there are few of them. Equal conversations are one sequence with a number, so that many copies fill
no block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold_of, written

#: Bytes of a turn's key: 12 of its digest, 4 of its length in code points.
KEY = 16
#: Largest block, in sequences and bytes; and the least size that blocks are cut to for the sake of more tasks.
BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS = 200_000, 32 << 20, 2048
#: Ids that one row of a member list holds at most.
IDS = 1 << 16
#: Turns that a conversation of each hundred lends to the others, at most (the query's rule).
HEAD = 5
NO_IDS = hashlib.sha256(b"").hexdigest()


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turns: array of hexadecimal keys) of rows (conv_id, turn, role, text), ordered by turn, null first.

    Null role or text count as empty; turns of one number go by their digest; repeated rows are turns of their own. Rows with a
    null conv_id belong to no conversation. Texts stay where they are: only keys are shuffled, 16 bytes a turn, so that a
    conversation of tens of millions of turns still is one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    key = F.concat(F.substring(digest, 1, 24), F.lpad(F.hex(F.char_length(text)), 8, "0"))
    turns = F.sort_array(F.collect_list(F.struct("turn", key.alias("key"))))
    return rows.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.transform(turns, lambda t: t["key"]).alias("turns"))


def share_heads(sequences: DataFrame) -> DataFrame:
    """Conversations rebuilt on shared beginnings: conversation c takes the first h turns of c - c % 100 in place of its own
    first h, h = crc32 of its id % 6. Without that conversation nothing comes before the rest."""
    heads = sequences.where("conv_id % 100 = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, HEAD).alias("head"))
    h = fold_of(F.col("conv_id"), HEAD + 1).cast("int")
    rows = sequences.withColumns({"h": h, "head_id": F.expr("conv_id - conv_id % 100")}).join(heads, "head_id", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h")), own).alias("turns"))


def _id_lists(sequences: DataFrame) -> DataFrame:
    """(k, ends_sha256): the digest of each sequence's ids, ascending and joined by commas. Sorted ids come as lists of up to
    IDS; a digest goes over its lists one by one, so nothing holds all ids of a sequence that very many share."""

    def lists(batches):
        key, held = None, []

        def row():
            return pa.RecordBatch.from_pydict({"k": [key], "low": pa.array([held[0]], pa.int64()), "ids": [",".join(map(str, held)).encode()]})

        for batch in batches:
            for k, c in zip(batch.column("k").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (k != key or len(held) >= IDS):
                    yield row()
                    held = []
                key = k
                held.append(c)
        if held:
            yield row()

    def digests(batches):
        key, running = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("k").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    running.update(b",")
                else:
                    if running:
                        done.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256()
                running.update(ids)
            if done:
                yield pa.RecordBatch.from_pydict({"k": [k for k, _ in done], "ends_sha256": [d for _, d in done]})
        if running:
            yield pa.RecordBatch.from_pydict({"k": [key], "ends_sha256": [running.hexdigest()]})

    rows = sequences.select("k", "conv_id").repartitionByRange("k", "conv_id").sortWithinPartitions("k", "conv_id").mapInArrow(lists, "k binary, low long, ids binary")
    return rows.repartition("k").sortWithinPartitions("k", "low").mapInArrow(digests, "k binary, ends_sha256 string")


class RangeMinimum:
    """A sparse table: minima of all stretches of 2, 4, 8 ... values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of values[low : high], none of them empty."""
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - 2**k])
        return out

    def reach_left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least p for each start with all of values[p + 1 : start + 1] at least its bound."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            to = at - 2**k
            ok = to >= 0
            ok[ok] = self.levels[k][to[ok] + 1] >= least[ok]
            at = np.where(ok, to, at)
        return at

    def reach_right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest p for each start with all of values[start + 1 : p + 1] at least its bound."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            ok = at + 2**k < len(self.levels[0])
            ok[ok] = self.levels[k][at[ok] + 1] >= least[ok]
            at = np.where(ok, at + 2**k, at)
        return at


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences begin with alike; -1 if one of them isn't there."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // KEY
    x, y = (np.frombuffer(z[: n * KEY], np.uint64).reshape(n, 2) for z in (a, b))
    same = (x == y).all(axis=1)
    return n if same.all() else int(same.argmin())


def neighbour_lcps(seqs: list[bytes]) -> np.ndarray:
    """common_turns of each sequence with the one before it, -1 for the first."""
    size = np.array([len(s) // KEY for s in seqs], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    keys = np.frombuffer(b"".join(seqs), np.uint64).reshape(-1, 2)
    n = np.minimum(size[1:], size[:-1])
    pair = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    same = (keys[begin[pair] + place] == keys[begin[pair + 1] + place]).all(axis=1)
    out = n.copy()
    np.minimum.at(out, pair[~same], place[~same])
    return np.concatenate([[-1], out])


_PIECE = "block int, depth long, key binary, parent_key binary, side int, chars long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, parent_side int"


def _block_nodes(rows: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
    """All nodes of one block. Those that go on beyond it have a key and are pieces; side 0: on the path to the block before,
    side 1: only on that to the next one. parent_side names the path that a whole node's parent is a piece of."""
    rows = rows.sort_values("seq", ignore_index=True)
    seqs, n = rows["seq"].tolist(), len(rows)
    ids, weight = rows["conv_id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    before, after = common_turns(edge["before"].iloc[0], seqs[0]), common_turns(seqs[-1], edge["after"].iloc[0])
    size = np.array([len(s) // KEY for s in seqs], np.int64)
    lcp = neighbour_lcps(seqs)
    table, least_id = RangeMinimum(lcp), RangeMinimum(ids)
    # every prefix of every sequence
    i = np.repeat(np.arange(n), size + 1)
    d = np.arange(len(i)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    left, right = table.reach_left(i, d), table.reach_right(i, d)
    own = left == i
    node_of = np.full(len(i), -1)
    node_of[own] = np.arange(own.sum())
    first = np.concatenate([[0], np.cumsum(size + 1)])
    parent = node_of[np.where(d > 0, first[table.reach_left(i, np.maximum(d - 1, 0))] + d - 1, 0)][own]
    i, d, right = i[own], d[own], right[own]
    parent[d == 0] = -1
    on_left, on_right = (i == 0) & (d <= before), (right == n - 1) & (d <= after)
    open_ = on_left | on_right
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    heads, leaf = sums(weight), sums(np.append(lcp[1:], after) < size)
    n_convs, n_leaves = heads[right + 1] - heads[i], leaf[right + 1] - leaf[i]
    conv = least_id.of(i, right + 1)
    keys = b"".join(seqs)
    chars = np.frombuffer(keys, ">u4").reshape(-1, KEY // 4)[:, 3].astype(np.int64)
    begin = sums(size)
    last = np.where(d > 0, chars[np.minimum(begin[i] + d - 1, max(len(chars) - 1, 0))] if len(chars) else 0, 0)
    # nodes are in the order (sequence, depth), so those of a subtree follow one another
    saved = sums(np.where(open_, 0, (n_convs - 1) * last))
    nodes_to = np.searchsorted(i, right, side="right")
    children = np.bincount(parent[(parent >= 0) & ~open_], minlength=len(i))
    inner = (parent >= 0) & ~open_[parent]
    ends = rows["ends_sha256"].to_numpy(object)[i]
    ends[d != size[i]] = None
    digest = np.full(len(i), None, object)
    for path in {0, n - 1}:  # open prefixes are those of the first and of the last sequence
        running, told = hashlib.md5(), [hashlib.md5().digest()]
        for t in range(size[path] if open_.any() else 0):
            running.update(seqs[path][t * KEY : (t + 1) * KEY])
            told.append(running.copy().digest())
        mine = open_ & (on_left if path == 0 else ~on_left | (n == 1))
        digest[mine] = np.array([*told, None], object)[d[mine]]
    parent_key = np.full(len(i), None, object)
    linked = open_ & (parent >= 0)
    parent_key[linked] = digest[parent[linked]]
    return pd.DataFrame({
        "block": np.int32(rows["block"].iloc[0]), "depth": d, "key": digest, "parent_key": parent_key, "side": np.where(on_left, 0, 1).astype(np.int32), "chars": last, "conv_id": conv, "n_convs": n_convs, "n_children": children,
        "n_leaves": n_leaves, "saved_tokens": saved[nodes_to] - saved[np.arange(len(i))], "ends_sha256": ends,
        "parent_conv_id": pd.Series(conv[parent], dtype="Int64").mask(~inner),
        "parent_side": pd.Series(np.where(on_left[parent], 0, 1), dtype="Int32").mask(inner | (parent < 0) | open_),
    })


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """Per node, a distinct prefix of sequences (conv_id, turns): conv_id (its least member), depth, parent_conv_id (its
    parent's least member), n_convs (members), n_children, n_leaves (childless nodes below or at it), saved_tokens (what storing
    shared turns once saves, in code points, below and at it) and ends_sha256 (the digest of the ids of members that end here).

    The root (depth 0) has all conversations as members, those too without any turn. Without conversations there are no nodes.
    """
    rows = written(sequences.select("conv_id", F.unhex(F.array_join("turns", "")).alias("seq")).withColumn("k", F.unhex(F.md5("seq"))), "sequences")
    classes = rows.groupBy("k", "seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    classes = written(classes.join(_id_lists(rows), "k").drop("k"), "sequence-classes")
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).alias("b")).first()
    wanted = min(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size.n / LEAST_ROWS))
    blocks = max(1, wanted, math.ceil(size.n / BLOCK_ROWS), math.ceil(size.b / BLOCK_BYTES))
    ordered = written(classes.repartitionByRange(blocks, "seq").withColumn("block", F.spark_partition_id()), "ordered-sequences")
    ends = ordered.groupBy("block").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    # a row per block, here and for the sums below
    order = Window.orderBy("block")
    edges = written(ends.select("block", F.row_number().over(order).alias("rank"), F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after")), "block-ends")
    nodes = written(ordered.groupBy("block").cogroup(edges.groupBy("block")).applyInPandas(_block_nodes, _PIECE), "block-nodes")

    pieces = nodes.where("key is not null").join(edges.select("block", "rank"), "block")
    top = pieces.groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("parent_key", "depth", "chars", "ends_sha256")], F.min("conv_id").alias("conv_id"), F.min("rank").alias("from"), F.max("rank").alias("to"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    top = written(top.withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "open-nodes")
    # open nodes below one: those that begin at the same end of a block and go deeper, and all that begin at later ends within it
    path = Window.partitionBy("from").orderBy(F.desc("depth"))
    ends = top.groupBy("from").agg(F.sum("own").alias("all"))
    ends = written(edges.select(F.col("rank").alias("from")).join(ends, "from", "left").select("from", F.sum(F.coalesce("all", F.lit(0))).over(Window.orderBy("from")).alias("until")), "open-sums")
    until = lambda at: ends.select(F.col("from").alias(at), F.col("until").alias(f"until_{at}"))
    whole = (
        top.withColumns({"deeper": F.sum("own").over(path), "before_to": F.col("to") - 1})
        .join(until("from"), "from").join(until("before_to"), "before_to")
        .join(top.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("open_children")), "key", "left")
        .join(top.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key", "left")
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")]
    saved = F.col("saved_tokens") + F.col("deeper") + F.col("until_before_to") - F.col("until_from")
    whole = whole.withColumns({"saved_tokens": saved, "n_children": F.col("n_children") + F.coalesce("open_children", F.lit(0))}).select(*columns)
    closed = nodes.where("key is null")
    parents = pieces.join(top.select("key", F.col("conv_id").alias("found")), "key").select("block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "found")
    below = closed.where("parent_side is not null").join(parents, ["block", "parent_side", "depth"]).withColumn("parent_conv_id", F.col("found")).select(*columns)
    return closed.where("parent_side is null").select(*columns).unionByName(below).unionByName(whole)


def with_turns(nodes: DataFrame, rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """nodes with role and text of their last turn, which is looked up by its key; the root has none."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = rows.select(F.substring(digest, 1, 24).alias("turn_key"), role.alias("role"), text.alias("text")).groupBy("turn_key").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    keyed = sequences.select("conv_id", F.posexplode("turns").alias("depth", "key")).select("conv_id", (F.col("depth") + 1).cast("long").alias("depth"), F.substring("key", 1, 24).alias("turn_key"))
    return nodes.join(keyed, ["conv_id", "depth"], "left").join(turns, "turn_key", "left").drop("turn_key")
