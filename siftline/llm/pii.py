"""Personal data by bootstrapped contextual extraction.

Seeds are the spans of four strict patterns. The words beside them are lexical patterns; pattern and instance form a
graph whose edges Spark scores in rounds: a pattern is worth the share of its instances that are known, an instance
what its patterns say together. Tokens, runs of tokens and spelled-out addresses that fail a kind's strict pattern
become spans where confident patterns speak for them, the sooner if they look like the kind's seeds. Spans of the
strict patterns always stay.

A pattern is one or two words on the left, one or two on the right, or the word on either side, in whole; rounds go on
until no further instance is accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: The kinds, in order, with their patterns. Quantifiers are possessive where nothing could be given
#: back, so that Java's matcher neither recurses nor tries a run of characters twice; the matches are the same.
_LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be worth trying.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}", "phone": "+"}
ORDER = list(KINDS)
#: Tokens that could be an identifier: parted by blanks, with a digit or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
#: Candidates of several tokens: identifiers side by side, with lone punctuation between, and 'name at domain dot com'.
_TOKEN = r"[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
RUN = rf"(?<![^\x20\x09-\x0D]){_TOKEN}(?:\x20(?:[-./()]++\x20)?+{_TOKEN})++"
_AT = r"(?i:\x20at\x20|\x20?[\[({]\x20?at\x20?[\])}]\x20?)"
SPELLED = rf"(?<![{_LOCAL}])[{_LOCAL}]++{_AT}[A-Za-z0-9-]++(?:(?i:\x20dot\x20|\x20?[\[({{]\x20?dot\x20?[\])}}]\x20?|\.)[A-Za-z0-9-]++)++"
#: Punctuation around a candidate that isn't part of it.
_OPEN, _CLOSE = r"^[\[({<\"'`,;:.!?]++", r"[\])}>\"'`,;:.!?]+$"
#: Characters looked at for the words beside an instance; where they don't hold two whole words, more are.
SIGHT = 80
#: A pattern counts from so many different instances; it is confident, and an instance accepted, from these scores.
MIN_INSTANCES, CONFIDENT, ACCEPTED = 5, 0.7, 0.85
#: What an instance's score is worth if no seed of the kind has its shape.
UNSEEN = 0.9
_MARK, _OTHER = "\x01", "\x02"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255")))
        return F.forall(F.split(x, r"\."), small)
    if kind == "card":
        return let(_digits(x), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, kind: str, valid) -> Column:
    """Spans of the leftmost matches that don't overlap: every match is put between marks, then parts are counted."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(_SPAN).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.char_length(x)
        span = F.array(F.struct(F.lit(kind).alias("kind"), a["at"].alias("start"), end.alias("end"), x.alias("value")))
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), F.when(a["inside"] & valid(x), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda a: a["spans"])


def _words(part: Column) -> Column:
    """The words of a stretch of text, in lower case and without punctuation."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(part), r"[^\p{L}=:@#]+", " "), " "), "")


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns around an instance, from the words (up to two) on its left and on its right."""
    one = F.array(F.when(F.size(left) > 0, F.concat(F.lit("<"), F.element_at(left, -1))), F.when(F.size(right) > 0, F.concat(F.lit(">"), F.get(right, 0))))
    two = F.array(F.when(F.size(left) > 1, F.concat(F.lit("<"), F.array_join(left, " "))), F.when(F.size(right) > 1, F.concat(F.lit(">"), F.array_join(right, " "))))
    both = F.array(F.when((F.size(left) > 0) & (F.size(right) > 0), F.concat(F.lit("<"), F.element_at(left, -1), F.lit(">"), F.get(right, 0))))
    return F.array_compact(F.concat(one, two, both))


def _shape(value: Column) -> Column:
    """Digits as 9, letters as a, in runs: what instances of a kind look like."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "9"), "9{13,19}", "N")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base, near): a hash of the text, the strict spans, and both these and the candidate tokens with the words beside them."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    text = F.when(F.contains(raw, F.lit(_MARK)), F.translate(raw, _MARK, _OTHER)).otherwise(raw)
    none = F.array().cast(_SPAN)
    has = {k: F.contains(F.col("t"), F.lit(h)) if len(h) == 1 else F.col("t").rlike(h) for k, h in _HINTS.items()}
    # texts that hold no digit, no at sign and no spelled-out address have neither spans nor candidates
    rows = docs.select("doc_id", F.xxhash64(raw).alias("h"), F.when(raw.rlike("[0-9@]") | raw.rlike(_AT), text).alias("t"))
    base = F.concat(*[F.when(has[k], _matches(F.col("t"), KINDS[k], k, lambda x, k=k: _valid(k, x))).otherwise(none) for k in ORDER])
    rows = rows.withColumn("base", F.when(F.col("t").isNull(), none).otherwise(base))

    def words_by(at: Column, end: bool) -> Column:
        """The two words that end (or begin) at a place: from SIGHT characters, from more where these hold no two whole ones."""
        def seen(n: int) -> Column:
            return _words(F.substring(F.col("t"), F.greatest(at - n + 1, F.lit(1)), F.least(at, F.lit(n))) if end else F.substring(F.col("t"), at + 1, n))

        def enough(words: Column, n: int) -> Column:
            return (F.size(words) > 2) | ((at if end else F.char_length("t") - at) <= n)

        whole = _words(F.substring(F.col("t"), F.lit(1), at) if end else F.substring(F.col("t"), at + 1, F.char_length("t")))
        more = let(seen(50 * SIGHT), lambda w: F.when(enough(w, 50 * SIGHT), w).otherwise(whole))
        found = let(seen(SIGHT), lambda w: F.when(enough(w, SIGHT), w).otherwise(more))
        return let(found, lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)) if end else F.slice(w, 1, 2))

    def beside(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _shape(s["value"]).alias("shape"), F.xxhash64(s["value"]).alias("value"),
            words_by(s["start"], True).alias("left"), words_by(s["end"], False).alias("right")))

    def trimmed(s: Column) -> Column:
        bare = let(F.regexp_replace(s["value"], _OPEN, ""), lambda x: F.struct(x.alias("x"), F.regexp_replace(x, _CLOSE, "").alias("y")))
        return let(bare, lambda b: F.struct(
            s["kind"].alias("kind"), (s["end"] - F.char_length(b["x"])).alias("start"), (s["end"] - F.char_length(b["x"]) + F.char_length(b["y"])).alias("end"), b["y"].alias("value")))

    every = F.concat(*[_matches(F.col("t"), p, "", lambda x: F.char_length(x) >= 5) for p in (CANDIDATE, RUN)], F.when(F.col("t").rlike(_AT), _matches(F.col("t"), SPELLED, "", lambda x: F.lit(True))).otherwise(none))
    tokens = F.filter(F.transform(every, trimmed), lambda s: F.char_length(s["value"]) >= 5)
    free = F.filter(tokens, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "h", F.transform("base", lambda b: b.dropFields("value")).alias("base"), F.when(F.col("t").isNotNull(), beside(F.concat("base", free))).alias("near"))


def bootstrap(near: DataFrame) -> DataFrame:
    """Accepted candidates (doc_id, h, kind, start, end) of near: (doc_id, h, kind or '', start, end, shape, value, left, right).

    Every candidate can join any kind. A pattern is worth the share of its different instances that are known, from
    MIN_INSTANCES on: seeds, and what was accepted. An instance's score is 1 minus the product of 1 - worth over its
    confident patterns, times UNSEEN if no seed of the kind has its shape; from ACCEPTED on it is known, and stays so.
    Rounds end when nothing new is known. Of candidates that overlap the best one is taken, on a tie the longest.
    """
    near = written(near, "near")
    seeds = near.where("kind <> ''")
    shapes = written(seeds.select("kind", "shape").distinct(), "shapes")
    kinds = F.explode(F.array(*map(F.lit, ORDER))).alias("kind")
    candidates = near.where("kind = ''").drop("kind").select("*", kinds).join(shapes.withColumn("seen", F.lit(True)), ["kind", "shape"], "left").withColumn("worth", F.when(F.col("seen"), 1.0).otherwise(UNSEEN)).drop("seen")
    sides = F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern")
    edges = seeds.select("kind", "value", F.lit(1.0).alias("worth"), sides).withColumn("seed", F.lit(True)).unionByName(candidates.select("kind", "value", "worth", sides).withColumn("seed", F.lit(False)))
    edges = written(edges.groupBy("kind", "value", "pattern").agg(F.max("seed").alias("seed"), F.max("worth").alias("worth")), "edges")
    known, count, scores = edges.where("seed").select("kind", "value").distinct(), 0, None
    while True:
        marked = edges.join(known.withColumn("known", F.lit(True)), ["kind", "value"], "left")
        patterns = marked.groupBy("kind", "pattern").agg(F.avg(F.when(F.col("known"), 1.0).otherwise(0.0)).alias("p"), F.count("*").alias("n")).where((F.col("n") >= MIN_INSTANCES) & (F.col("p") >= CONFIDENT))
        # written, so that the rows of a frequent pattern can be split in the join
        told = edges.where("not seed").join(written(patterns, "patterns"), ["kind", "pattern"]).groupBy("kind", "value").agg((F.max("worth") * (1 - F.product(1 - F.col("p")))).alias("score"))
        told = told.where(F.col("score") >= ACCEPTED)
        if scores is not None:
            told = told.unionByName(scores).groupBy("kind", "value").agg(F.max("score").alias("score"))
        scores = written(told, "accepted")
        if (now := scores.count()) == count:
            break
        count = now
        known = edges.where("seed").select("kind", "value").unionByName(scores.select("kind", "value")).distinct()
    spans = candidates.join(scores, ["kind", "value"])
    # a token that two kinds claim goes to the better one, on a tie to the first in order
    rank = F.struct(-F.col("score"), F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind")))
    best = spans.groupBy("doc_id", "h", "start", "end").agg(F.min(rank).alias("rank"), F.min_by("kind", rank).alias("kind"))
    order = F.struct(F.col("rank.col1").alias("a"), (F.col("start") - F.col("end")).alias("b"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("kind").alias("kind"))
    rows = best.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(order)).alias("x"))
    free = lambda a, s: ~F.exists(a, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    none = F.filter("x", lambda s: F.lit(False))
    kept = F.aggregate("x", none, lambda a, s: F.when(free(a, s), F.concat(a, F.array(s))).otherwise(a))
    return rows.select("doc_id", "h", F.explode(kept).alias("s")).select("doc_id", "h", "s.kind", "s.start", "s.end")


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document.

    n_* count strict spans; spans lists all, kind:start:end in code points, end exclusive, by kind and start. A null
    text has no spans. docs needs doc_id, of any type, and text; other columns are ignored. A row for each of docs: rows
    with one doc_id, or none, have the spans of their own texts.
    """
    rows = written(found(docs), "found")
    near = rows.where("size(near) > 0").select("doc_id", "h", F.explode("near").alias("s")).select("doc_id", "h", "s.*")
    added = bootstrap(near).groupBy(F.col("doc_id").alias("id"), F.col("h").alias("h2")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    listed = lambda spans, k: F.array_join(F.transform(F.array_sort(F.filter(spans, lambda s: s["kind"] == k)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    text = lambda spans: F.array_join(F.filter(F.array(*[listed(spans, k) for k in ORDER]), lambda x: x != ""), ",")
    more = F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    return rows.select("doc_id", "h", "base").join(added, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("h2")), "left").select(
        "doc_id", *[F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in ORDER],  # noqa: B023
        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.concat("base", more)).alias("spans"), F.size(more).alias("n_added"),
    )
