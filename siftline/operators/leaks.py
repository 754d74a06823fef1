"""Leak detection: an index of protected numbers, their traces in text, issued values, placeholders and audit records."""

from __future__ import annotations

import json
import re
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import integer_form, markdown_escape, number_form, number_spellings
from ..tables import written
from .scan import find_spans, rewritten

#: A number in text, with grouped thousands and a decimal part; what replaces and marks values.
NUMBER = r"(?<!\d)(?<!\d[.,])\d+(?:[  .,]\d{3})*(?:[.,]\d+)?(?!\d)(?![.,]\d)"
REDACTED, MARKER = "[REDACTED]", "[unavailable]"
PLACEHOLDER = r"\{x\d+\}"
#: Fields of a record that don't come from the request; the shortest value looked for.
UNGUARDED = ("request_id", "timestamp", "policy_version", "feed_version", "verdict", "user_id", "role", "department", "ai_data_policy", "answer_model", "judge_model", "disabled_controls", "step_latency_ms")
MIN_GUARDED = 3
#: What stands in a record whose details are left out.
WITHHELD = "Left out: this record spelled one of its request's own values."
#: Runs of letters and digits that tokens are found by: of any script in messages, of ASCII in records and arguments.
RUN, ASCII_RUN = r"[\p{L}\p{N}]+", "[0-9A-Za-z]+"
#: A whole token; a number isn't the start or end of a longer one.
BEFORE, AFTER = r"(?<![^\W_])(?<!\d[.,])", r"(?![^\W_])(?![.,]\d)"


def text_number_forms(text: str) -> set[str]:
    """L1. Normal forms of a number as text: both readings of '48.000'; none for anything but a number."""
    if not re.fullmatch(NUMBER, text.strip()):
        return set()
    whole, *later = re.split("[.,]", "".join(c for c in text if c.isdigit() or c in ".,"))
    readings = [(whole, "")] if not later else [("".join([whole, *later[:-1]]), later[-1])]
    if all(len(p) == 3 for p in later):
        readings.append(("".join([whole, *later]), ""))  # every mark parts thousands
    return {".".join(filter(None, (w.lstrip("0") or "0", part.rstrip("0")))) for w, part in readings}


def token_forms(token: str, most_digits: int | None = None) -> set[str]:
    """L4. Forms of a number in text and of each run of its thousands groups, so that values glued together show.

    most_digits: digits of the longest form that is looked for; longer forms may be left out.
    """
    groups = re.split(r"[  .,](?=\d{3}(?!\d))", token)
    forms = text_number_forms(token)
    for k, first in enumerate(groups):
        # what follows a group of zeros has the forms of the runs that begin there
        for run in accumulate(groups[k:] if first.strip("0") else [first]):
            if most_digits is not None and len(re.split("[.,]", run.lstrip("0"))[0]) > most_digits:
                break
            forms |= text_number_forms(run)
    return forms


def protected_columns(schema: DataFrame, roles: DataFrame, grants: DataFrame, labels: DataFrame) -> DataFrame:
    """L2. (role, table, column) that a role may not read, or that are sensitive (as is any column without a label).

    schema: table, column; roles: role; grants: role, table, column; labels: table, column or null, label. All small.
    """
    own = labels.where("column is not null").select("table", "column", F.col("label").alias("own"))
    whole = labels.where("column is null").select("table", F.col("label").alias("whole"))
    every = schema.join(own, ["table", "column"], "left").join(whole, "table", "left").select("table", "column", F.coalesce("own", "whole", F.lit("sensitive")).alias("label"))
    pairs = roles.select("role").distinct().join(every, how="cross")  # policy tables: roles times columns
    unread = pairs.join(grants.select("role", "table", "column"), ["role", "table", "column"], "left_anti").select("role", "table", "column")
    return unread.unionByName(pairs.where("label not in ('public', 'internal')").select("role", "table", "column")).distinct()


def protected_index(tables: dict[str, DataFrame], protected: DataFrame, min_digits: int = 4) -> DataFrame:
    """L3. (role, form): distinct normal forms, of min_digits digits at least, of each role's protected columns.

    Values are made distinct per column before roles multiply them, and short forms go before the shuffle. All rows
    of a table are read; text columns go through the number helper.
    """

    @F.pandas_udf("array<string>")
    def forms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(text_number_forms(t)) if t is not None else [] for t in texts])

    parts = []
    for name, table in tables.items():
        for column, kind in table.dtypes:
            if kind in ("tinyint", "smallint", "int", "bigint"):
                form = F.array(integer_form(F.col(column)))
            elif kind in ("float", "double") or kind.startswith("decimal"):
                form = F.array(number_form(F.col(column)))
            elif kind == "string":
                form = F.when(F.col(column).rlike(r"^\s*[0-9]"), forms(column))
            else:
                continue
            parts.append(table.select(F.lit(name).alias("table"), F.lit(column).alias("column"), F.explode(form).alias("form")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    long = F.length(F.regexp_replace("form", "[^0-9]", "")) >= min_digits
    return rows.where(long).distinct().join(protected, ["table", "column"]).select("role", "form").distinct()


def number_tokens(texts: DataFrame, text: str = "text", most_digits: Column | None = None) -> DataFrame:
    """L4. Adds s, end, form rows: each number of a text with each of its forms; texts without a digit yield none.

    most_digits: digits of the longest form that is looked for; all forms if null.
    """

    @F.pandas_udf("array<struct<start:int,end:int,form:string>>")
    def find(xs: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([[{"start": m.start(), "end": m.end(), "form": f} for m in re.finditer(NUMBER, x or "") for f in sorted(token_forms(m[0], None if pd.isna(n) else int(n)))] for x, n in zip(xs, most, strict=True)])

    most = F.lit(None).cast("int") if most_digits is None else most_digits

    return texts.where(F.col(text).rlike("[0-9]")).withColumn("_n", F.explode(find(text, most))).select(*texts.columns, "_n.start", "_n.end", "_n.form")


def find_protected(texts: DataFrame, index: DataFrame, min_digits: int = 4, key: str = "id") -> DataFrame:
    """L4. (key, role, start, end) of numbers in texts (key, role, text) that the role's index holds."""
    digits = F.length(F.regexp_replace("form", "[^0-9]", ""))
    index = written(index, "protected-index")  # read twice
    most = index.agg(F.coalesce(F.max(digits), F.lit(0)).alias("_most"))  # one row
    rows = texts.select(key, "role", "text").crossJoin(F.broadcast(most))
    tokens = number_tokens(rows, most_digits=F.col("_most")).drop("text", "_most").where(digits >= min_digits)
    return tokens.join(index, ["role", "form"], "left_semi").select(key, "role", "start", "end").distinct()


def _by_model(text: str, spans) -> bytearray:
    """A mark per character: 1 where the model wrote it, 0 where the gateway put it in."""
    marks = bytearray(b"\x01" * len(text))
    for s in spans:
        if s["source"] == "gateway":
            marks[s["start"] : s["end"]] = bytes(max(0, min(s["end"], len(text)) - s["start"]))
    return marks


def cleaned(text: str, spans, protected) -> tuple[str, list[str], int]:
    """L5. (text, kinds found, placeholders marked): whatever touches text of the model and is a secret, personal data or
    a protected value is redacted; placeholders that the model left outside of these are marked.

    Stretches of the model's are looked at alone and within the whole, so that a value put in can neither complete nor
    hide a match. Matches that overlap go as one, named for the first.
    """
    marks = _by_model(text, spans)
    stretches = [m.span() for m in re.finditer(b"\x01+", marks)]
    hits = [(x + a, x + b, k) for x, y in stretches for a, b, k in find_spans(text[x:y])]
    hits += find_spans(text) if stretches != [(0, len(text))] else []
    hits += [(p["start"], p["end"], "protected value") for p in protected]
    gone, kinds = bytearray(len(text)), []
    starts = set()
    for a, b, kind in sorted(h for h in hits if marks.find(1, h[0], h[1]) >= 0):
        if gone.find(1, a, b) < 0:
            kinds.append(kind)
            starts.add(a)
        gone[a:b] = b"\x01" * (b - a)
    edits, left = [], 0
    for m in re.finditer(b"\x01+", gone):
        cuts = [m.start(), *(k for k in range(m.start() + 1, m.end()) if k in starts), m.end()]
        edits += [(x, y, REDACTED) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    for x, y in stretches:
        for part in re.finditer(b"\x00+", gone[x:y]):
            for m in re.finditer(PLACEHOLDER, text[x + part.start() : x + part.end()]):
                edits.append((x + part.start() + m.start(), x + part.start() + m.end(), MARKER))
                left += 1
    return rewritten(text, sorted(edits)), sorted(set(kinds)), left


def filter_answers(answers: DataFrame, index: DataFrame | None, mode: str = "redact", min_digits: int = 4) -> DataFrame:
    """L5. Adds filtered, verdict and kinds to answers (id, role, text, spans array<struct<start,end,source,binding>>).

    Without an index every answer is blocked. Mode block empties an answer that holds a finding; one with nothing but
    left-over placeholders, which are marked, has the verdict redact in either mode.
    """
    if index is None:
        return answers.withColumns({"filtered": F.lit(""), "verdict": F.lit("block"), "kinds": F.array(F.lit("index missing"))})
    hits = find_protected(answers, index, min_digits).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("_p"))

    @F.pandas_udf("struct<text:string,kinds:array<string>,left:int>")
    def clean(text: pd.Series, spans: pd.Series, protected: pd.Series) -> pd.DataFrame:
        none = lambda x: x if x is not None else []
        return pd.DataFrame([cleaned(t or "", none(s), none(p)) for t, s, p in zip(text, spans, protected, strict=True)], columns=["text", "kinds", "left"])

    rows = answers.join(hits, "id", "left").withColumn("_c", clean("text", "spans", "_p"))
    caught = F.size("_c.kinds") > 0
    return rows.select(*answers.columns, F.when(caught & F.lit(mode == "block"), "").otherwise(F.col("_c.text")).alias("filtered"), F.when(caught, mode).when(F.col("_c.left") > 0, "redact").otherwise("allow").alias("verdict"), F.col("_c.kinds").alias("kinds"))


#: JSON nested deeper than this is taken as text.
MOST_LEVELS = 200


def json_leaves(value) -> list[str]:
    """All keys, strings and numbers (as text) of a JSON value, in order, without recursion."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += [y for k, v in reversed(x.items()) for y in (v, k)]
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, str):
            out.append(x)
        elif isinstance(x, int | float) and not isinstance(x, bool):
            out.append(str(x))
    return out


def too_deep(text: str) -> bool:
    """Whether JSON is nested deeper than MOST_LEVELS, by its brackets outside of strings, so that it isn't parsed for that.
    True or False where the text isn't JSON."""
    if text.count("{") + text.count("[") <= MOST_LEVELS:
        return False
    bare = re.sub(r'(?s)"(?:[^"\\]|\\.)*+(?:"|\Z)', "", text).encode("utf-8", "replace")
    steps = np.zeros(256, np.int8)
    steps[list(b"{[")], steps[list(b"}]")] = 1, -1
    return bool(bare) and int(steps[np.frombuffer(bare, np.uint8)].cumsum(dtype=np.int64).max()) > MOST_LEVELS


def filter_arguments(calls: DataFrame, approved: DataFrame | None = None, index: DataFrame | None = None, min_digits: int = 4) -> DataFrame:
    """L10. Adds filtered and changed to calls (call_id, arguments, and role if there is an index): in every string, key and
    number of the JSON what is a secret, personal data, or a number that the role's index protects is redacted, and
    placeholders are marked; a changed number becomes text. approved: call_id, args left as they are. What isn't JSON, or is
    nested deeper than MOST_LEVELS, is cleaned as plain text."""

    def parsed(text: str | None):
        """The JSON value, or the text itself if it is none or nested too deep to be taken apart."""
        try:
            return text if text is None or too_deep(text) else json.loads(text)
        except (ValueError, RecursionError):
            return text

    @F.pandas_udf("array<string>")
    def texts(arguments: pd.Series) -> pd.Series:
        return pd.Series([sorted({p for p in json_leaves(parsed(a)) if re.search("[0-9]", p)}) for a in arguments], dtype=object)

    hits = calls.select("call_id", F.lit(None).cast("map<string,array<struct<start:int,end:int>>>").alias("_p")).limit(0)
    if index is not None:
        parts = calls.select("call_id", "role", F.explode(texts("arguments")).alias("text")).withColumn("id", F.struct("call_id", "text"))
        found = find_protected(parts, index, min_digits).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("p"))
        hits = found.groupBy("id.call_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("id.text"), "p"))).alias("_p"))

    @F.pandas_udf("struct<text:string,changed:boolean>")
    def clean(arguments: pd.Series, keep: pd.Series, protected: pd.Series) -> pd.DataFrame:
        def walk(x, known):
            if isinstance(x, dict):
                return {cleaned(k, [], known.get(k, []))[0]: walk(v, known) for k, v in x.items()}
            if isinstance(x, list):
                return [walk(v, known) for v in x]
            if isinstance(x, str):
                return cleaned(x, [], known.get(x, []))[0]
            if isinstance(x, int | float) and not isinstance(x, bool):
                shown = cleaned(str(x), [], known.get(str(x), []))[0]
                return x if shown == str(x) else shown
            return x

        rows, done = [], {}  # arguments that come again within a batch are cleaned once
        for a, k, p in zip(arguments, keep, protected, strict=True):
            plain = k is None and p is None
            if plain and a in done:
                rows.append(done[a])
                continue
            value, spared, known = parsed(a), set(k) if k is not None else set(), dict(p) if p is not None else {}
            if isinstance(value, dict):
                new = {}
                for x, v in value.items():
                    new |= {x: v} if x in spared else walk({x: v}, known)
            else:
                new = walk(value, known)
            rows.append((new if value is a or a is None else json.dumps(new, ensure_ascii=False), new != value))
            if plain:
                done[a] = rows[-1]
        return pd.DataFrame(rows, columns=["text", "changed"])

    rows = calls.join(approved, "call_id", "left") if approved is not None else calls.withColumn("args", F.lit(None).cast("array<string>"))
    rows = rows.join(hits, "call_id", "left").withColumn("_c", clean("arguments", "args", "_p"))
    return rows.select(*calls.columns, F.col("_c.text").alias("filtered"), F.col("_c.changed").alias("changed"))


def whole_token(value: Column) -> Column:
    """A Java pattern of the value as a whole token, in any case."""
    return F.concat(F.lit(r"(?iu)(?<![0-9A-Za-z])\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![0-9A-Za-z])"))


def token_hits(texts: DataFrame, values: DataFrame, owner: list[str], run: str, text: str = "text", value: str = "value") -> DataFrame:
    """Rows of texts beside rows of values of one owner (columns of both) where the text may hold the value as a whole token.

    An index by equality: a value is looked up by its first run of letters and digits, which a text that holds it has as a
    whole run; all other pairs never meet. Each text is split once. Values without any run meet all texts of the owner.
    Columns other than the owner's must differ. The hit has still to be verified.
    """
    runs = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({run})"), F.lit(1)))
    keyed = texts.withColumn("_run", F.explode(F.concat(F.array(F.lit("")), runs)))
    return keyed.join(values.withColumn("_run", F.regexp_extract(F.lower(value), f"({run})", 1)), [*owner, "_run"]).drop("_run")


def _cells(value: Column, expect: Column) -> Column:
    """What a list's cells or a row's parts say, without their escapes."""
    none = F.array().cast("array<string>")
    lines = F.split(value, r"\R")
    bare = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"\\(.)", "$1"), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    cells = F.transform(F.flatten(F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1))), lambda x: F.split(x, r"(?<!\\)\|"))), bare)
    parts = F.transform(F.split(value, ", "), lambda x: F.regexp_extract(x, r"(?s)^.*?: (.*)$", 1))
    return F.when((expect == "list") & (F.size(lines) > 2), cells).when(expect == "row", parts).otherwise(none)


def value_forms(values: DataFrame) -> DataFrame:
    """L6. (request_id, form, whole) that a request's values may appear as. values: request_id, kind ('vault' or 'binding'),
    value, and perhaps expect ('scalar', 'list', 'row'). Vault originals count anywhere; binding values, a list's cells
    (below its header) and a row's parts count as whole tokens, in any number spelling."""
    expect = F.coalesce(F.col("expect"), F.lit("")) if "expect" in values.columns else F.lit("")
    texts = F.transform(F.concat(F.array("value"), _cells(F.col("value"), expect)), lambda x: F.trim(x))
    spelled = lambda x: F.when(x.rlike(r"^-?\d+(\.\d+)?$"), F.concat(F.array(x), number_spellings(x.try_cast("double")))).otherwise(F.array(x))
    forms = F.when(F.col("kind") == "vault", F.array("value")).otherwise(F.flatten(F.transform(texts, spelled)))
    return values.where("value is not null").select("request_id", F.explode(F.array_distinct(forms)).alias("form"), (F.col("kind") != "vault").alias("whole")).where((F.length("form") >= MIN_GUARDED) | ~F.col("whole")).where("form <> ''").distinct()


def _field_texts(name: str, field) -> Column:
    """array<struct<path, text>> of one field, a text or a list of them, of all structs in the list column of that name."""
    item = lambda path, text: F.struct(path.alias("path"), text.cast("string").alias("text"))
    place = lambda k: F.concat(F.lit(f"{name}["), k.cast("string"), F.lit(f"].{field.name}"))
    if field.dataType.typeName() == "string":
        return F.transform(name, lambda x, k: item(place(k), x[field.name]))
    inner = lambda x, k: F.transform(x[field.name], lambda y, n: item(F.concat(place(k), F.lit("["), n.cast("string"), F.lit("]")), y))
    return F.flatten(F.filter(F.transform(name, inner), lambda y: y.isNotNull()))


def _guarded_texts(records: DataFrame) -> Column:
    """array<struct<path, text>> of all texts in the fields that come from the request."""
    item = lambda path, text: F.struct(path.alias("path"), text.cast("string").alias("text"))
    none = F.array().cast("array<struct<path:string,text:string>>")
    parts = [none]
    for field in records.schema:
        kind = field.dataType
        if field.name in UNGUARDED:
            continue
        if kind.typeName() == "string":
            parts.append(F.array(item(F.lit(field.name), F.col(field.name))))
        elif kind.typeName() == "array" and kind.elementType.typeName() == "struct":
            parts += [F.coalesce(_field_texts(field.name, sub), none) for sub in kind.elementType if sub.dataType.simpleString() in ("string", "array<string>")]
    return F.concat(*parts)


def leaking_records(records: DataFrame, values: DataFrame) -> DataFrame:
    """L6. (request_id, paths): texts of a record that spell a value of its own request. Joins by request and, for whole
    tokens, by the first run of a value, so that no value meets a text that doesn't hold that run. Records without a value
    go first, and of the others' texts those that hold no first run of theirs."""
    runs = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({ASCII_RUN})"), F.lit(1)))
    item = lambda rows: rows.select("request_id", F.explode(_guarded_texts(records)).alias("t"), *[c for c in rows.columns if c == "_runs"]).where("t.text <> ''")
    forms = written(value_forms(values), "value-forms")  # read twice
    whole = forms.where("whole").withColumn("_run", F.regexp_extract(F.lower("form"), f"({ASCII_RUN})", 1))
    wanted = whole.groupBy("request_id").agg(F.collect_set("_run").alias("_runs"))
    held = F.array_intersect(F.concat(F.array(F.lit("")), runs(F.col("t.text"))), F.col("_runs"))
    keyed = item(records.join(wanted, "request_id")).select("request_id", "t.*", F.explode(held).alias("_run"))
    tokens = keyed.join(whole, ["request_id", "_run"]).where(F.rlike("text", whole_token(F.col("form"))))
    texts = item(records).select("request_id", "t.*")
    vault = texts.join(forms.where("not whole"), "request_id").where(F.contains(F.lower("text"), F.lower("form")))
    return tokens.select("request_id", "path").unionByName(vault.select("request_id", "path")).groupBy("request_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def guard_records(records: DataFrame, values: DataFrame) -> DataFrame:
    """L6. Records with the details of leaking ones left out and their decisions replaced by one of the guard's: no prompt, no
    SQL, purpose, reason, tables or columns of a binding, no tool or reason of a tool decision, and no name or rule that
    is itself where the value stands. Counts, statuses and identity stay."""
    hit = leaking_records(records, values).withColumnRenamed("paths", "_paths")
    guard = F.array(F.struct(F.lit("audit").alias("stage"), F.lit("audit.guard").alias("control"), F.lit("log").alias("verdict"), F.lit(WITHHELD).alias("reason"), F.lit(0.0).alias("latency_ms")))
    rows = records.join(hit, "request_id", "left")
    leaks = F.col("_paths").isNotNull()
    spelled = lambda pattern: F.exists("_paths", lambda p: p.rlike(pattern))

    def emptied(name: str, always: tuple, if_spelled: tuple) -> Column:
        fields = {f.name: f.dataType for f in records.schema[name].dataType.elementType}

        def one(x: Column) -> Column:
            for f in (*always, *if_spelled):
                if f in fields:
                    nothing = F.lit("") if fields[f].typeName() == "string" else F.array().cast(fields[f])
                    x = x.withField(f, nothing if f in always else F.when(spelled(rf"^{name}\[\d+\]\.{f}$"), nothing).otherwise(x[f]))
            return x

        return F.when(leaks, F.transform(name, one)).otherwise(F.col(name))

    return rows.withColumns({
        "decisions": F.when(leaks, guard.cast(records.schema["decisions"].dataType)).otherwise(F.col("decisions")),
        "prompt_text": F.when(~leaks, F.col("prompt_text")),
        "bindings": emptied("bindings", ("sql", "purpose", "reason", "tables", "columns"), ("name", "status", "label")),
        "tool_decisions": emptied("tool_decisions", ("tool", "reason"), ("rule", "verdict")),
    }).select(records.columns)


def issued_values(bindings: DataFrame, most: int = 1000) -> DataFrame:
    """L7. (user_id, value, issued_at): values a user got and the model didn't see, the newest `most` per user.

    bindings: user_id, status, disclosed, expect, value, ts. A value counts in plain and in markdown form, a list in
    plain form only; issuing it again renews its age. The limit is the feature: older values are forgotten.
    """
    live = bindings.where("status = 'resolved' and not coalesce(disclosed, false) and trim(value) <> ''")
    forms = F.when(F.col("expect") == "list", F.array("value")).otherwise(F.array_distinct(F.array(F.col("value"), markdown_escape(F.col("value")))))
    newest = live.select("user_id", F.explode(forms).alias("value"), "ts").groupBy("user_id", "value").agg(F.max("ts").alias("issued_at"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("issued_at"), "value"))
    return newest.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def remask_history(messages: DataFrame, issued: DataFrame, ttl_seconds: int, marker: str = "[value]") -> DataFrame:
    """L8. Adds masked and replaced to messages (id, user_id, role, ts, text): the user's live issued values in
    assistant messages become the marker, longest first, in one pass, as whole tokens only.

    A value lives while issued_at > ts - ttl. The range is cut into buckets of ttl and values are looked up by their first
    run of letters and digits, so that the join is an equality on (user, bucket, run): a message meets only the
    values whose first run it holds, however many the user has.
    """
    micros = lambda t: F.unix_micros(F.col(t).cast("timestamp"))
    bucket = lambda t: F.floor(t.cast("timestamp").cast("double") / ttl_seconds)
    wanted = messages.where("role = 'assistant' and text is not null").select("id", "user_id", "ts", "text")
    spread = issued.select("user_id", "value", "issued_at", F.explode(F.array(bucket(F.col("issued_at")), bucket(F.col("issued_at")) + 1)).alias("_b"))
    lives = (F.col("issued_at") <= F.col("ts")) & (micros("issued_at") > micros("ts") - ttl_seconds * 1_000_000)
    met = token_hits(wanted.withColumn("_b", bucket(F.col("ts"))), spread, ["user_id", "_b"], RUN).where(lives & F.contains("text", "value"))
    values = met.groupBy("id").agg(F.collect_set("value").alias("_values"))

    @F.pandas_udf("struct<text:string,n:int>")
    def replace(texts: pd.Series, values: pd.Series) -> pd.DataFrame:
        rows = []
        for t, v in zip(texts, values, strict=True):
            pattern = "|".join(re.escape(x) for x in sorted(v, key=lambda x: (-len(x), x)))
            rows.append(re.subn(f"{BEFORE}(?:{pattern}){AFTER}", lambda _: marker, t))
        return pd.DataFrame(rows, columns=["text", "n"])

    done = wanted.join(values, "id").withColumn("_m", replace("text", "_values")).select("id", "_m")
    return messages.join(done, "id", "left").select(*messages.columns, F.coalesce("_m.text", "text").alias("masked"), F.coalesce("_m.n", F.lit(0)).alias("replaced"))


def fill(texts: DataFrame, bindings: DataFrame, vault: DataFrame | None = None, escape: str = "markdown", markers: dict[str, str] | None = None, all_denied: str | None = None) -> DataFrame:
    """L9. Adds filled and spans to texts (request_id, text): placeholders become values in one literal pass.

    bindings: request_id, name, expect, status, value; a resolved one gives its value (escaped unless a list, or unless escape
    is none), denied, rejected, empty and error ones their marker. Everything else, as an unknown placeholder, an
    unknown status or a resolved null, gives the marker of rejected. Of several rows of one name the least counts.
    vault (request_id, token, value), if given, restores masked tokens, escaped likewise. all_denied: what a text with a
    placeholder becomes as a whole if the request has bindings and none is resolved. spans tell the text of the model
    from the inserted one.
    """
    markers = {m: f"[{m}]" for m in ("denied", "rejected", "empty", "error")} | (markers or {})
    shown = lambda c: markdown_escape(c) if escape == "markdown" else c
    value = F.when(F.col("status") == "resolved", F.when(F.col("expect") == "list", F.col("value")).otherwise(shown(F.col("value"))))
    for status, marker in markers.items():
        value = value.when(F.col("status") == status, F.lit(marker))
    pairs = bindings.select("request_id", "name", F.coalesce(value, F.lit(markers["rejected"])).alias("out"), F.coalesce(F.col("status") == "resolved", F.lit(False)).alias("good"))
    if vault is not None:
        pairs = pairs.unionByName(vault.select("request_id", F.col("token").alias("name"), shown(F.col("value")).alias("out"), F.lit(None).cast("boolean").alias("good")))
    single = pairs.where("name is not null and out is not null").groupBy("request_id", "name").agg(F.min("out").alias("out"), F.max("good").alias("good"))
    maps = single.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "out"))).alias("_map"), F.max("good").alias("_good"))
    unknown, message = markers["rejected"], all_denied

    @F.pandas_udf("struct<text:string,spans:array<struct<start:int,end:int,source:string,binding:string>>>")
    def put(texts: pd.Series, names: pd.Series, good: pd.Series) -> pd.DataFrame:
        rows = []
        for t, known, some in zip(texts, names, good, strict=True):
            if message and some is False and re.search(PLACEHOLDER, t or ""):
                rows.append((message, [{"start": 0, "end": len(message), "source": "gateway", "binding": None}]))
                continue
            known, out, spans, at, length = dict(known) if known is not None else {}, [], [], 0, 0
            for m in re.finditer(r"\{x\d+\}|\[[A-Z]+_\d+\]", t or ""):
                new = known.get(m[0], unknown if m[0][0] == "{" else None)
                if new is None:
                    continue
                for piece, source, name in ((t[at : m.start()], "model", None), (new, "gateway", m[0])):
                    if piece:
                        spans.append({"start": length, "end": length + len(piece), "source": source, "binding": name})
                        out.append(piece)
                        length += len(piece)
                at = m.end()
            if rest := (t or "")[at:]:
                spans.append({"start": length, "end": length + len(rest), "source": "model", "binding": None})
                out.append(rest)
            rows.append(("".join(out), spans))
        return pd.DataFrame(rows, columns=["text", "spans"])

    return texts.join(maps, "request_id", "left").withColumn("_f", put("text", "_map", "_good")).select(*texts.columns, F.col("_f.text").alias("filled"), F.col("_f.spans").alias("spans"))

