"""The attack-signature feed: reading, validating and matching it."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from functools import partial
from re import _constants as ops
from re import _parser as parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import urls
from ..schemas import FEED, SIGNATURE
from ..tables import written

#: Where signatures apply, how severe they are, and how they match.
SURFACES = ("input", "tool_result", "url", "tool_definition", "model_output", "tool_args")
SEVERITIES = ("high", "medium", "low")
TYPES = ("regex", "substring")
#: Largest feed file, and most entries that are tried on every text.
MOST_FEED_BYTES, MOST_ENTRIES = 64 << 20, 1_000_000
#: Errors of a long feed that are told.
MOST_ERRORS = 1000
#: Numbers of characters that an entry is looked up by, and those that ignoring case equates with others than their upper case.
GRAMS, ODD_CASES = (3, 6), set("ski")
#: Format characters (Unicode category Cf).
_FORMAT = r"\p{Cf}+"


class FeedError(ValueError):
    """The feed has errors; it is rejected as a whole."""


def feed_errors(entries: DataFrame) -> DataFrame:
    """S5. (id, error) of the entries that break a rule; an empty result accepts the feed."""
    blank = [F.when(F.coalesce(F.trim(c) == "", F.lit(True)), F.lit(f"{c} is missing")) for c in ("id", "category", "severity", "type", "pattern")]
    rules = [
        *blank,
        F.when(F.coalesce(F.size("applies_to") <= 0, F.lit(True)), F.lit("applies_to is empty")),
        F.when(F.size(F.array_except("applies_to", F.array(*map(F.lit, SURFACES)))) > 0, F.lit("unknown surface")),
        F.when(~F.col("severity").isin(*SEVERITIES), F.lit("unknown severity")),
        F.when(~F.col("type").isin(*TYPES), F.lit("unknown type")),
    ]
    single = entries.select("id", F.explode(F.array_compact(F.array(*rules))).alias("error"))
    twice = entries.groupBy("id").count().where("count > 1").select("id", F.lit("id is not unique").alias("error"))
    return single.unionByName(twice)


def parse_feed(spark: SparkSession, path: str) -> tuple[str, list[dict]]:
    """S5. (version, entries) of a feed file; raises FeedError with all errors.

    The version is the file's own, or else that of its content: sha256: and 16 hexadecimal digits. A feed is a policy file:
    one of over MOST_FEED_BYTES is refused before it is read, as its entries are to be literals; see parse_long_feed() for those.
    """
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > MOST_FEED_BYTES:
        raise FeedError(f"the feed has {size} bytes, {MOST_FEED_BYTES} at most are read")
    feed = spark.read.schema(FEED).option("multiLine", True).json(path)
    head = feed.select(F.nullif("version", F.lit("")).alias("version")).first()
    digest = files.select(F.sha2("content", 256)).first()
    entries = feed.select(F.explode("signatures").alias("s")).select("s.*")
    rows = [r.asDict() for r in entries.collect()]
    errors = [f"{r['id']}: {r['error']}" for r in feed_errors(entries).collect()]
    for r in rows:
        try:
            re.compile(r["pattern"] or "")
        except re.error as e:
            errors.append(f"{r['id']}: {e}")
    if head is None or not rows:
        errors.append("no signatures")
    if errors:
        raise FeedError("; ".join(sorted(errors)))
    return head["version"] or f"sha256:{digest[0][:16]}", rows


#: In JSON: what opens or closes something, and the rest of a string.
_MARK, _REST = re.compile(rb'["{}\[\]]'), re.compile(rb'(?s)(?:[^"\\]|\\.)*+')


def _taken_apart(batches):
    """Pieces of a feed (value, file, at and size in bytes), in order, as its entries, a row each, and at last a row with the rest of
    the document and the digest of all bytes. Holds one entry at a time, and the rest of the document."""
    digest, rest, entry, key, name = hashlib.sha256(), bytearray(), bytearray(), bytearray(), b""
    inside, depth, after, file, at = False, 0, False, None, 0
    bad = False
    out = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema([("entry", pa.binary()), ("rest", pa.binary()), ("digest", pa.string())]))
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["file"] != file:
                file, at = row["file"], 0
            piece = row["value"]
            at += len(piece) + 1
            piece += b"}" if at <= row["size"] else b""
            digest.update(piece)
            here = 0  # up to here the piece is kept
            k = 0
            while k < len(piece):
                if inside:
                    end = _REST.match(piece, k).end()
                    if depth == 1:
                        key += piece[k:end]
                    inside = end >= len(piece) or piece[end : end + 1] != b'"'
                    k = end + 1
                    continue
                m = _MARK.search(piece, k)
                if m is None:
                    break
                k, mark = m.end(), m[0]
                if mark == b'"':
                    inside = True
                    if depth == 1:
                        key.clear()
                elif mark in b"{[":
                    depth += 1
                    if depth == 2:
                        name = bytes(key) if mark == b"[" else b""
                        if name == b"signatures":
                            rest += piece[here:k]
                            here, after = k, False
                    elif depth == 3 and name == b"signatures" and mark == b"{":
                        between = (bytes(entry) + piece[here : k - 1]).strip()  # what stands before the entry
                        bad |= between != (b"," if after else b"")
                        entry.clear()
                        here = k - 1
                else:
                    depth -= 1
                    if depth == 2 and name == b"signatures" and mark == b"}":
                        rows.append({"entry": bytes(entry) + piece[here:k], "rest": None, "digest": None})
                        entry.clear()
                        here, after = k, True
                    elif depth == 1 and name == b"signatures":
                        bad |= (bytes(entry) + piece[here : k - 1]).strip() != b""
                        entry.clear()
                        here, name = k - 1, b""
            if depth >= 2 and name == b"signatures":
                entry += piece[here:]
            else:
                rest += piece[here:]
        if rows:
            yield out(rows)
    yield out([{"entry": None, "rest": None if bad else bytes(rest + entry), "digest": digest.hexdigest()}])


def parse_long_feed(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """S5 for feeds of any length: (version, entries) as parse_feed() has them, the entries as a table. path: a file, or a folder
    of files that are the document one after the other, by their names. Of errors the message has MOST_ERRORS at most.

    A digest needs the bytes one after the other, so one task streams them, and cuts them into entries on its way; entries are
    parsed and checked wherever they lie.
    """
    raw = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    pieces = raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    stream = pieces.repartition(1).sortWithinPartitions("file", "start", "n").select("value", "file", "size")
    parts = written(stream.mapInArrow(_taken_apart, "entry binary, rest binary, digest string"), "feed-parts")
    last = parts.where("digest is not null").first()
    head = parts.where("digest is not null").select(F.from_json(F.col("rest").cast("string"), FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("f")).select(F.nullif("f.version", F.lit("")).alias("version")).first()
    entries = parts.where("digest is null").select(F.from_json(F.col("entry").cast("string"), SIGNATURE).alias("s")).select("s.*")

    @F.pandas_udf("string")
    def refused(patterns: pd.Series) -> pd.Series:
        out = []
        for p in patterns:
            try:
                re.compile(p or "")
                out.append(None)
            except re.error as e:
                out.append(str(e))
        return pd.Series(out, dtype=object)

    wrong = feed_errors(entries).unionByName(entries.select("id", refused(F.when(F.col("type") == "regex", F.col("pattern"))).alias("error")).where("error is not null"))
    errors = [f"{r['id']}: {r['error']}" for r in wrong.orderBy("id", "error").limit(MOST_ERRORS).collect()]
    if last["rest"] is None or not _is_object(last["rest"]):
        errors.append("the feed isn't a JSON object")
    if entries.isEmpty():
        errors.append("no signatures")
    if errors:
        raise FeedError("; ".join(sorted(errors)))
    return head["version"] or f"sha256:{last['digest'][:16]}", entries


def _is_object(text: bytes) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, RecursionError):
        return False


def strip_format(text: Column) -> Column:
    """T11. Format characters can't split a pattern."""
    return F.regexp_replace(text, _FORMAT, "")


def _matches(pattern: str, text: Column) -> Column:
    return text.rlike(pattern)


def _holds(part: str, text: Column) -> Column:
    return F.contains(F.lower(text), F.lit(part))


def _unary(test):
    """A function of one argument, which is how Spark tells what a lambda gets."""
    return lambda x: test(x)


def match_signatures(texts: DataFrame, feed: list[dict], surface: Column, mode: str = "block", text: str = "text") -> DataFrame:
    """T11. Adds signature_verdict and signature_ids (comma-joined, in feed order).

    High severity blocks, medium follows the mode, low logs; mode off finds nothing. The feed's patterns are literals
    of one projection, so each is compiled once per task and no join is needed. Entries for the surface 'url' are
    tried on the addresses in a text as well.
    """
    clean, found = F.col("_clean"), []
    rows = texts.withColumns({"_clean": strip_format(F.coalesce(F.col(text), F.lit("")))}).withColumns({"_urls": urls(clean), "_surface": surface})
    for s in feed if mode != "off" else []:
        if s["type"] == "regex":
            # word characters are Unicode; a dot stops at a newline only; \Z is the very end
            pattern = "(?Ud)" + s["pattern"].replace(r"\Z", r"\z")
            test = partial(_matches, pattern)
        else:
            low = s["pattern"].lower()
            test = partial(_holds, low)
        hit = F.col("_surface").isin(*s["applies_to"]) & test(clean)
        there = F.exists("_urls", _unary(test))
        action = {"high": "block", "medium": mode, "low": "log"}[s["severity"]]
        found.append(F.when(hit | there if "url" in s["applies_to"] else hit, F.struct(F.lit(s["id"]).alias("id"), F.lit(action).alias("action"))))
    hits = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<id:string,action:string>>")
    rows = rows.withColumn("_hits", hits)
    return rows.withColumns({
        "signature_verdict": F.when(F.exists("_hits", lambda h: h["action"] == "block"), "block").when(F.size("_hits") > 0, "log").otherwise("allow"),
        "signature_ids": F.array_join(F.array_distinct(F.transform("_hits", lambda h: h["id"])), ", "),
    }).drop("_clean", "_urls", "_surface", "_hits")


def required_runs(pattern: str) -> list[str]:
    """Runs of characters, in lower case, that every match of a regular expression holds. Groups and repeats that must occur
    count; what may be left out, alternatives and look-around don't."""
    parsed = parser.parse(pattern)
    runs, run = [], []

    def end() -> None:
        if run:
            runs.append("".join(run))
            run.clear()

    def walk(items, fold: bool) -> None:
        for op, value in items:
            if op is ops.LITERAL and not (fold and chr(value).lower() in ODD_CASES):
                run.append(chr(value).lower())
            elif op is ops.SUBPATTERN:
                _, added, removed, inner = value
                walk(inner, (fold or bool(added & re.IGNORECASE)) and not removed & re.IGNORECASE)
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] > 0:
                end()
                walk(value[2], fold)
                end()
            else:
                end()

    walk(parsed, bool(parsed.state.flags & re.IGNORECASE))
    end()
    return [r for r in runs if len(r.lower()) == len(r)]


def _place(gram: Column) -> Column:
    """Where a gram is counted: 26 bits, of which the first 20 tell its cell."""
    return F.shiftright(F.crc32(gram.cast("binary")), 6)


def feed_index(feed: DataFrame) -> DataFrame:
    """T11. feed (id, severity, applies_to, type, pattern, and pos, its order) with gram: characters in a row that each text with
    a match holds once it is in lower case, as many as one of GRAMS; of those the one that fewest entries have, and of these
    the longest. Null where there are none. Grams are counted in a fixed number of cells, so that a count may be too high."""

    @F.pandas_udf("array<string>")
    def grams(kinds: pd.Series, patterns: pd.Series) -> pd.Series:
        runs = [required_runs(p) if k == "regex" else [p.lower()] for k, p in zip(kinds, patterns, strict=True)]
        return pd.Series([sorted({r[i : i + n] for r in x for n in GRAMS for i in range(len(r) - n + 1)}) for x in runs], dtype=object)

    rows = written(feed.withColumn("_grams", grams("type", "pattern")), "feed-grams")
    found = rows.select(F.explode("_grams").alias("gram")).groupBy(F.shiftright(_place(F.col("gram")), 6).alias("cell")).agg(F.least(F.count("*"), F.lit(2**31 - 1)).alias("n")).toArrow()  # up to 2^20 numbers
    counts = np.zeros(1 << 20, np.int32)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()

    @F.pandas_udf("string")
    def rarest(some: pd.Series) -> pd.Series:
        n = memoryview(counts)
        return pd.Series([min(x, key=lambda g: (n[zlib.crc32(g.encode()) >> 12], -len(g), g), default=None) for x in some], dtype=object)

    return rows.withColumn("gram", rarest("_grams")).drop("_grams")


def _searcher(kind: str, pattern: str):
    if kind == "regex":
        return re.compile(pattern).search
    low = pattern.lower()
    return lambda text: low in text.lower()


def match_feed(texts: DataFrame, feed: DataFrame, surface: Column, mode: str = "block", text: str = "text", key: str = "id") -> DataFrame:
    """T11 for feeds of any length: match_signatures() with the feed as a DataFrame (id, severity, applies_to, type, pattern, pos).

    Every entry is looked up by one gram, so that a text meets only the entries whose gram it holds: a join by equality. Those are
    verified, one by one, with the patterns as they are; entries without a gram are verified on every text, so more than
    MOST_ENTRIES of those are an error. A bit for each gram of the index, among 2^26, goes to all tasks, so that few others
    are dealt out of a text. key: unique per row.
    """
    names = texts.columns
    index = written(feed_index(feed), "feed-index")
    places = index.where("gram is not null").select(_place(F.col("gram")).alias("place"))
    found = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("b")).toArrow()  # up to 2^20 numbers
    words = np.zeros(1 << 20, "<i8")
    words[found["word"].to_numpy()] = found["b"].to_numpy()
    wanted = words.tobytes()
    bare = [r.asDict() for r in index.where("gram is null").orderBy("pos").limit(MOST_ENTRIES + 1).collect()]
    if len(bare) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries have no {GRAMS[0]} characters that each match must hold; every text would meet each of them")

    @F.pandas_udf("array<string>")
    def held(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            found = {x[i : i + n] for n in GRAMS for i in range(len(x) - n + 1)}
            places = ((g, zlib.crc32(g.encode()) >> 6) for g in found)
            out.append(sorted(g for g, k in places if wanted[k >> 3] >> (k & 7) & 1))
        return pd.Series(out, dtype=object)

    made: dict = {}  # compiled patterns, kept from batch to batch within a task

    @F.pandas_udf("array<struct<pos:long,id:string,severity:string>>")
    def verified(xs: pd.Series, where: pd.Series, addresses: pd.Series, entries: pd.Series) -> pd.Series:
        out = []
        for x, at, links, some in zip(xs, where, addresses, entries, strict=True):
            hits = []
            for e in (*(some if some is not None else ()), *bare):
                kind = e["type"], e["pattern"]
                find = made.get(kind) or made.setdefault(kind, _searcher(*kind))
                if (at in e["applies_to"] and find(x)) or ("url" in e["applies_to"] and any(find(u) for u in links)):
                    hits.append({"pos": e["pos"], "id": e["id"], "severity": e["severity"]})
            out.append(sorted(hits, key=lambda h: h["pos"]) if x else [])
        return pd.Series(out, dtype=object)

    rows = texts.withColumn("_clean", strip_format(F.coalesce(F.col(text), F.lit("")))).withColumns({"_urls": urls(F.col("_clean")), "_surface": surface})
    met = rows.select(F.col(key).alias("_key"), F.explode(held(F.lower("_clean"))).alias("gram")).join(index, "gram")
    entries = met.groupBy("_key").agg(F.collect_list(F.struct("pos", "id", "severity", "applies_to", "type", "pattern")).alias("_entries"))
    rows = rows.join(entries, F.col(key) == F.col("_key"), "left").withColumn("_hits", verified("_clean", "_surface", "_urls", "_entries"))
    action = lambda h: F.when(h["severity"] == "high", "block").when(h["severity"] == "medium", mode).otherwise("log")
    hits = F.col("_hits") if mode != "off" else F.filter("_hits", lambda h: F.lit(False))
    return rows.select(
        *names, F.when(F.exists(hits, lambda h: action(h) == "block"), "block").when(F.size(hits) > 0, "log").otherwise("allow").alias("signature_verdict"),
        F.array_join(F.array_distinct(F.transform(hits, lambda h: h["id"])), ", ").alias("signature_ids"),
    )
