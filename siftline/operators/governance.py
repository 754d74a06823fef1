"""Data governance: policy tables joined to principals, access logs, queries, tool calls and inventories.

All decisions fail closed: a missing grant denies, an unknown label is sensitive, an unknown user has no principal.
"""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written
from .leaks import ASCII_RUN, token_hits
from .scan import redacted_text

#: Labels from the freest to the strictest.
LABELS = ("public", "internal", "sensitive")
#: Modules whose import is safe, prefixes and name parts that never are.
SAFE_MODULES = ("torch", "numpy", "collections", "_codecs")
PLACEHOLDER = r"\{x\d+\}"
#: Fixed value: what counts as a value in the text of a query: strings in either quotes, and words of hex digits with a digit.
VALUES_IN_SQL = r"'(?:[^']|'')*+'?|\"(?:[^\"]|\"\")*+\"?|[0-9A-Fa-f]*[0-9][0-9A-Fa-f]*"


def label_rank(label: Column) -> Column:
    """0 to 2; anything unknown ranks as sensitive."""
    return F.when(label == "public", 0).when(label == "internal", 1).otherwise(2)


def label_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), rank)


def principals(requests: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """G1. requests (api_key, ...) with user_id, role, department and ai_data_policy; nulls for an unknown key.

    users: user_id, api_key_hash (hex SHA-256), role, department, ai_data_policy; roles: role, max_ai_data_policy.
    The policy is 'allow' only where both the user and the role allow.
    """
    who = users.join(roles.select("role", "max_ai_data_policy"), "role", "left").select(
        "api_key_hash", "user_id", "role", "department",
        F.when((F.col("ai_data_policy") == "allow") & (F.col("max_ai_data_policy") == "allow"), "allow").otherwise("deny").alias("ai_data_policy"),
    )
    return requests.withColumn("api_key_hash", F.sha2(F.col("api_key").cast("binary"), 256)).join(who, "api_key_hash", "left").drop("api_key_hash", "api_key")


def governed_view(table: DataFrame, name: str, grants: list[dict], role: str, user_id: str, department: str | None, owner_column: str | None = None, department_column: str | None = None) -> DataFrame:
    """G2, G3. The granted columns of the rows in the role's scope. grants: dicts of role, table, scope, columns or None.

    Raises PermissionError where the role has no grant, ValueError where a scope lacks its column.
    """
    grant = next((g for g in grants if g["role"] == role and g["table"].lower() == name.lower()), None)
    if grant is None:
        raise PermissionError(f"{role} has no grant on {name}")
    rows = table
    if grant["scope"] != "all":
        column, value = {"self": (owner_column, user_id), "department": (department_column, department)}[grant["scope"]]
        if column is None:
            raise ValueError(f"{name} has no column for the scope {grant['scope']}")
        rows = rows.where(F.col(column) == F.lit(value))
    return rows if grant["columns"] is None else rows.select([c for c in table.columns if c.lower() in {g.lower() for g in grant["columns"]}])


def scoped_rows(table: DataFrame, people: DataFrame, owner_column: str, department_column: str) -> DataFrame:
    """G3 for many principals at once: (user_id, table's columns) of the rows that each may see.

    people: user_id, department, scope. Each scope is an equality join on its own column; 'all' pairs every row with
    the people who see all, whose number the policy bounds.
    """
    own = table.join(people.where("scope = 'self'").select("user_id"), F.col(owner_column).cast("string") == F.col("user_id"))
    dept = table.join(people.where("scope = 'department'").select("user_id", "department"), F.col(department_column).cast("string") == F.col("department")).drop("department")
    every = table.join(people.where("scope = 'all'").select("user_id"), how="cross")
    return reduce(DataFrame.unionByName, [own, dept, every]).select("user_id", *table.columns)


def denied_bindings(reads: DataFrame, grants: DataFrame) -> DataFrame:
    """G4. (binding_id, missing): queries with a read column that their role wasn't granted.

    reads: binding_id, role, table, column; grants: role, table, column.
    """
    missing = reads.join(grants.select("role", "table", "column").distinct(), ["role", "table", "column"], "left_anti")
    return missing.groupBy("binding_id").agg(F.array_sort(F.collect_set(F.concat("table", F.lit("."), "column"))).alias("missing"))


def binding_labels(reads: DataFrame, labels: DataFrame) -> DataFrame:
    """G5. (binding_id, label): the strictest label over what a query reads; a column's own label or else its table's.

    reads: binding_id, table, column (null: the table is read without a column); labels: table, column or null, label.
    """
    columns = labels.where("column is not null").select("table", "column", F.col("label").alias("own"))
    tables = labels.where("column is null").select("table", F.col("label").alias("whole"))
    ranked = reads.join(columns, ["table", "column"], "left").join(tables, "table", "left").select("binding_id", label_rank(F.coalesce("own", "whole")).alias("r"))
    return ranked.groupBy("binding_id").agg(F.max("r").alias("r")).select("binding_id", label_name(F.col("r")).alias("label"))


def unrecorded_reads(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """G6. Actual reads (binding_id, table, column) that the query's declared list lacks."""
    return actual.join(declared.select("binding_id", "table", "column").distinct(), ["binding_id", "table", "column"], "left_anti")


def disclosure(bindings: DataFrame) -> DataFrame:
    """G7. Adds disclosed and reason, the first condition that fails.

    bindings: status, ai_data_policy, label, max_label, trust, clean (the value passes the phrase and signature scans).
    """
    failing = (
        F.when(F.coalesce(F.col("status") != "resolved", F.lit(True)), "not resolved")
        .when(F.coalesce(F.col("ai_data_policy") != "allow", F.lit(True)), "AI data policy")
        .when(~F.coalesce(F.col("label").isin(*LABELS) & (label_rank(F.col("label")) <= label_rank(F.col("max_label"))) & F.col("max_label").isin(*LABELS), F.lit(False)), "label above the role's limit")
        .when(F.coalesce((F.col("trust") != "local") & (F.col("label") == "sensitive"), F.lit(True)), "sensitive value and remote model")
        .when(~F.coalesce(F.col("clean"), F.lit(False)), "value matches a scan")
    )
    return bindings.withColumn("reason", failing).withColumn("disclosed", F.col("reason").isNull())


def _folded(name: str) -> str:
    """A name without case, width and punctuation, for spotting look-alike argument names."""
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", name).casefold()))


@F.pandas_udf(T.StringType())
def folded_name(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else _folded(x))


#: Fixed value: JSON arguments nested deeper than this are malformed.
MOST_DEPTH = 32
_TEXTS = lambda *names: [T.StructField(n, T.StringType()) for n in names]
_DECODED = T.StructType([
    T.StructField("ok", T.BooleanType()), T.StructField("leaves", T.ArrayType(T.StructType(_TEXTS("arg", "text")))),
    T.StructField("top", T.ArrayType(T.StructType([*_TEXTS("arg", "folded", "kind", "text"), T.StructField("number", T.DoubleType())]))),
])
#: The same for Arrow.
_TEXT_FIELDS = lambda *names: [(n, pa.string()) for n in names]
_DECODED_ARROW = pa.struct([("ok", pa.bool_()), ("leaves", pa.list_(pa.struct(_TEXT_FIELDS("arg", "text")))), ("top", pa.list_(pa.struct([*_TEXT_FIELDS("arg", "folded", "kind", "text"), ("number", pa.float64())])))])


@F.arrow_udf(_DECODED)
def decoded_arguments(arguments: pa.Array) -> pa.Array:
    """A call's JSON object with escapes resolved. leaves: each key, string and number with the argument it lies in (none
    for the arguments' own names); top: each argument's folded name, kind (text, number, other) and value. Not ok: no
    object, or one nested too deep. Blank arguments are an empty object. Half a surrogate pair becomes a question mark."""
    folds: dict[str, str] = {}

    def walk(value, arg: str, depth: int, leaves: list) -> bool:
        if isinstance(value, dict | list):
            if depth > MOST_DEPTH:
                return False
            inner = value.items() if isinstance(value, dict) else ((None, x) for x in value)
            for k, x in inner:
                if k is not None:
                    leaves.append((arg, k))
                if not walk(x, arg, depth + 1, leaves):
                    return False
        elif isinstance(value, str | int | float) and not isinstance(value, bool):
            leaves.append((arg, str(value)))
        return True

    def whole(value):
        """The value with all its texts fit for UTF-8."""
        if isinstance(value, str):
            return value.encode("utf-8", "replace").decode()
        return [whole(x) for x in value] if isinstance(value, list) else tuple(map(whole, value)) if isinstance(value, tuple) else value

    def one(text: str | None):
        if text is not None and not text.strip():
            return True, [], []
        try:
            found = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return False, [], []
        if not isinstance(found, dict):
            return False, [], []
        leaves, top = [], []
        for k, v in found.items():
            leaves.append((None, k))
            number = None
            if isinstance(v, int | float) and not isinstance(v, bool):
                try:
                    number = float(v)
                except OverflowError:  # beyond all limits
                    number = float("inf")
            kind = "text" if isinstance(v, str) else "other" if number is None else "number"
            if k not in folds:
                folds[k] = _folded(k)
            top.append((k, folds[k], kind, v if kind == "text" else None, number))
            if not walk(v, k, 2, leaves):
                return False, [], []
        return whole((True, leaves, top)) if "\\u" in text else (True, leaves, top)

    return pa.array([one(t) for t in arguments.to_pylist()], _DECODED_ARROW)


def authorize_calls(calls: DataFrame, listed: DataFrame, rules: DataFrame, bindings: DataFrame, tool_labels: DataFrame) -> DataFrame:
    """G8, G9. (call_id, verdict, rule): the first rule that a client's tool call breaks.

    calls: call_id, request_id, role, tool, arguments (a JSON text); listed: role, tool; rules: role, tool, arg, rule
    (allow_pattern, deny_pattern, max), value; bindings: request_id, name, status, label, disclosed, value; tool_labels:
    role, tool, max_label. Order: not_listed, malformed_arguments, argument_name, then argument by argument, in the order of the rules'
    column n if there is one, egress of a placeholder and its own checks, and at last egress of query results: a placeholder anywhere, or a disclosed value
    that was copied, needs a resolved binding with a label within the tool's max_label. Without one nothing may pass.
    listed, rules and tool_labels are policy tables and go to all tasks: where all calls have one role and tool, a join by
    these has no key left to deal rows out by, and Spark would send the calls to all tasks instead.
    """
    # an argument stands where its first rule does
    places = rules.groupBy("role", "tool", "arg").agg(F.min("n" if "n" in rules.columns else F.lit(0)).cast("long").alias("place"))
    ruled = rules.select("role", "tool", "arg", "rule", "value").join(F.broadcast(places), ["role", "tool", "arg"]).withColumn("folded", folded_name("arg"))
    of_tool = ruled.groupBy("role", "tool").agg(F.collect_list(F.struct("arg", "folded", "rule", "value", "place")).alias("_rules"))
    rows = calls.select("call_id", "request_id", "role", "tool", decoded_arguments("arguments").alias("d"))
    rows = rows.join(F.broadcast(listed.select("role", "tool", F.lit(True).alias("ok")).distinct()), ["role", "tool"], "left").join(F.broadcast(of_tool), ["role", "tool"], "left")
    rows = rows.select("call_id", "request_id", "role", "tool", "ok", "_rules", F.col("d.ok").alias("fine"), "d.leaves", "d.top")
    flaw = lambda order, rule, place=F.lit(0): F.struct(F.lit(3 if 3 <= order <= 6 else order).alias("o"), place.cast("long").alias("place"), F.lit(order).alias("k"), rule.alias("rule"))

    def broken(r: Column) -> Column:
        """The flaw of the call's arguments by one rule, or null."""
        lookalike = F.exists("top", lambda t: (t["arg"] != r["arg"]) & (t["folded"] == r["folded"]))
        v = F.get(F.filter("top", lambda t: t["arg"] == r["arg"]), F.lit(0))
        there, is_text = v.isNotNull(), F.coalesce(v["kind"] == "text", F.lit(False))
        placed = F.exists("leaves", lambda x: F.coalesce(x["arg"] == r["arg"], F.lit(False)) & x["text"].rlike(PLACEHOLDER))
        matches = F.coalesce(F.rlike(v["text"], F.concat(F.lit("^(?:"), r["value"], F.lit(r")\z"))), F.lit(False))
        limit = r["value"].try_cast("double")
        within = F.coalesce((v["kind"] == "number") & ~F.isnan(v["number"]) & (F.abs(v["number"]) < float("inf")) & (v["number"] <= limit), F.lit(False))
        of = lambda order, rule: flaw(order, F.lit(rule), r["place"])
        return (
            F.when(lookalike, flaw(2, F.lit("argument_name"))).when(placed, of(3, "egress"))
            .when((r["rule"] == "allow_pattern") & ~(is_text & matches), of(4, "allow_pattern"))
            .when((r["rule"] == "deny_pattern") & there & ~(is_text & ~F.coalesce(F.rlike(v["text"], r["value"]), F.lit(True))), of(5, "deny_pattern"))
            .when((r["rule"] == "max") & there & ~within, of(6, "max"))
        )

    own = F.when(F.col("ok").isNull(), flaw(0, F.lit("not_listed"))).when(~F.col("fine"), flaw(1, F.lit("malformed_arguments"))).otherwise(F.array_min(F.array_compact(F.transform("_rules", broken))))
    names = F.array_distinct(F.flatten(F.transform("leaves", lambda x: F.regexp_extract_all(x["text"], F.lit(rf"({PLACEHOLDER})"), F.lit(1)))))
    # arguments are decoded once; query results are looked for only where nothing else is broken, as they come last
    rows = rows.withColumn("f", own)
    rows = written(rows.select("call_id", "request_id", "role", "tool", "f", F.when(F.col("f").isNull(), names).alias("names"), F.when(F.col("f").isNull(), F.transform("leaves", lambda x: x["text"])).alias("texts")), "decoded-calls")
    sent = rows.where("f is null")
    named = sent.select("call_id", "request_id", "role", "tool", F.explode("names").alias("name"))
    text = F.trim(F.col("value").cast("string"))
    # a whole number of a floating-point column may be written without its '.0'
    shown = F.regexp_replace(text, r"^(-?[0-9]+)\.0$", "$1(?:\\\\.0)?")
    quoted = F.when(text.rlike(r"^-?[0-9]+\.0$"), shown).otherwise(F.concat(F.lit(r"\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")))
    token = F.concat(F.lit(r"(?iu)(?<![0-9A-Za-z])"), quoted, F.lit(r"(?![0-9A-Za-z])"))
    held = bindings.where("disclosed and trim(cast(value as string)) <> ''").select("request_id", "name", text.alias("value"), token.alias("token"))
    parts = sent.select("call_id", "request_id", "role", "tool", F.explode("texts").alias("text"))
    copied = token_hits(parts, held, ["request_id"], ASCII_RUN).where(F.rlike("text", F.col("token"))).select("call_id", "request_id", "role", "tool", "name").distinct()
    carried = named.unionByName(copied).join(bindings.select("request_id", "name", "status", "label"), ["request_id", "name"], "left").join(F.broadcast(tool_labels), ["role", "tool"], "left")
    may = (F.col("status") == "resolved") & F.col("label").isin(*LABELS) & F.col("max_label").isin(*LABELS) & (label_rank(F.col("label")) <= label_rank(F.col("max_label")))
    egress = carried.where(~F.coalesce(may, F.lit(False))).select("call_id", flaw(7, F.lit("egress")).alias("f"))
    first = rows.select("call_id", "f").unionByName(egress).where("f is not null").groupBy("call_id").agg(F.min("f").alias("f"))
    return rows.select("call_id").join(first, "call_id", "left").select("call_id", F.when(F.col("f").isNull(), "allow").otherwise("deny").alias("verdict"), "f.rule")


def approved_arguments(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """G15. (call_id, args): string arguments that fully match their allow_pattern and hold no placeholder."""
    args = F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,string>")
    each = calls.join(rules.where("rule = 'allow_pattern'"), ["role", "tool"]).withColumn("v", F.try_element_at(args, F.col("arg")))
    fine = each.where(F.rlike("v", F.concat(F.lit("^(?:"), F.col("value"), F.lit(r")\z"))) & ~F.col("v").rlike(PLACEHOLDER))
    return fine.groupBy("call_id").agg(F.array_sort(F.collect_set("arg")).alias("args"))


def resolve_models(requests: DataFrame, allowed: DataFrame, default: str | None = None) -> DataFrame:
    """G10. Adds resolved and verdict: a listed model as it is; another is replaced by the default, if one is given that is
    itself listed (verdict log), or blocked."""
    if default is not None and allowed.where(F.col("model") == default).isEmpty():
        default = None
    rows = requests.join(allowed.select("model", F.lit(True).alias("listed")).distinct(), "model", "left")
    return rows.withColumns({
        "resolved": F.when(F.col("listed"), F.col("model")).otherwise(F.lit(default)),
        "verdict": F.when(F.col("listed"), "allow").otherwise("block" if default is None else "log"),
    }).drop("listed")


def pin_states(models: DataFrame, pins: DataFrame, installed: DataFrame | None) -> DataFrame:
    """G11. (name, status): unpinned, mismatch, unverified (no inventory), missing or ok, per model.

    A name without a tag also stands for name:latest, on both sides. Digests compare in lower case without 'sha256:';
    a pin that isn't 64 hex digits never matches.
    """
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^sha256:", "")

    def found(rows: DataFrame, other: DataFrame, out: str) -> DataFrame:
        exact = other.select("name", clean(F.col("digest")).alias("d1"))
        latest = other.select(F.col("name").alias("latest"), clean(F.col("digest")).alias("d2"))
        tagged = rows.withColumn("latest", F.when(~F.contains("name", F.lit(":")), F.concat("name", F.lit(":latest"))))
        return tagged.join(exact, "name", "left").join(latest, "latest", "left").withColumn(out, F.coalesce("d1", "d2")).drop("d1", "d2", "latest")

    rows = found(models.select("name").distinct(), pins, "pin")
    if installed is None:
        return rows.select("name", F.when(F.col("pin").isNull(), "unpinned").when(~F.col("pin").rlike("^[0-9a-f]{64}$"), "mismatch").otherwise("unverified").alias("status"))
    rows = found(rows, installed, "have")
    return rows.select("name", F.when(F.col("pin").isNull(), "unpinned").when(~F.col("pin").rlike("^[0-9a-f]{64}$"), "mismatch").when(F.col("have").isNull(), "missing").when(F.col("pin") != F.col("have"), "mismatch").otherwise("ok").alias("status"))


def unsafe_imports(imports: DataFrame, denied_prefixes: list[str], denied_names: list[str]) -> DataFrame:
    """G12. (file, safe, blocked): a file is safe if each of its imports (file, module, name) is allowed."""
    module = F.col("module")
    known = reduce(lambda a, b: a | b, [(module == m) | module.startswith(f"{m}.") for m in SAFE_MODULES])
    denied = reduce(lambda a, b: a | b, [(module == m) | module.startswith(f"{m}.") for m in denied_prefixes], F.lit(False))
    parts = F.arrays_overlap(F.split("name", r"\."), F.array(*map(F.lit, denied_names))) if denied_names else F.lit(False)
    allowed = F.coalesce(known & ~denied & ~parts & F.col("name").isNotNull(), F.lit(False))
    return imports.withColumn("ok", allowed).groupBy("file").agg(F.bool_and("ok").alias("safe"), F.count_if(~F.col("ok")).alias("blocked"))


def scrub_sql(sql: Column) -> Column:
    """G13. Quoted strings (an unclosed one to the end), and words of hex digits with a digit, become [VALUE]; secrets and
    personal data that are left are redacted (T6)."""
    return redacted_text(F.regexp_replace(sql, VALUES_IN_SQL, "[VALUE]"))


def query_requests(calls: DataFrame, cap: int) -> DataFrame:
    """G14. Adds name ({x1}, {x2} ... within a request, by call order), status (accepted, invalid, rejected) to calls
    (request_id, n, arguments): invalid arguments get no number; queries beyond cap are rejected."""
    v = F.try_parse_json("arguments")
    field = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    good = (F.schema_of_variant(v).startswith("OBJECT")) & (F.length(F.trim(field("sql"))) > 0) & field("purpose").isNotNull() & field("expect").isin("scalar", "row", "list")
    rows = calls.withColumn("_good", F.coalesce(good, F.lit(False)))
    k = F.when(F.col("_good"), F.sum(F.col("_good").cast("int")).over(Window.partitionBy("request_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("_k", k).withColumns({
        "name": F.when(F.col("_good"), F.concat(F.lit("{x"), F.col("_k").cast("string"), F.lit("}"))),
        "status": F.when(~F.col("_good"), "invalid").when(F.col("_k") > cap, "rejected").otherwise("accepted"),
    }).drop("_good", "_k")
