"""Governance, leak, text and relational queries over the given tables, each with its DuckDB SQL where SQL can say it.

Customers stand for employees (owner c_custkey, department c_nationkey, sensitive c_acctbal), orders and parts for
further governed tables, documents, pages and conversations for texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import governance as G
from ..operators import injection, leaks, messages, scan, signatures
from ..sources.policy import column_values, shaped
from .audit_queries import calls
from .audit_view import table

GRANTS = [
    {"role": "sales", "table": "customer", "scope": "department", "columns": ["c_custkey", "c_name", "c_nationkey"]},
    {"role": "hr", "table": "customer", "scope": "all", "columns": None},
    {"role": "self", "table": "customer", "scope": "self", "columns": ["c_custkey", "c_name", "c_acctbal"]},
    {"role": "sales", "table": "part", "scope": "all", "columns": ["p_partkey", "p_name", "p_retailprice"]},
]
_COLUMNS = [("customer", c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")] + [("orders", "o_totalprice"), ("part", "p_retailprice"), ("part", "p_name")]
_LABELS = [("customer", None, "internal"), ("customer", "c_acctbal", "sensitive"), ("part", None, "public"), ("orders", None, "internal"), ("orders", "o_totalprice", "sensitive")]
_FEED = [
    {"id": "T-001", "category": "markup", "severity": "high", "applies_to": ["tool_result"], "type": "regex", "pattern": r"track\(\d*[05]\)"},
    {"id": "T-002", "category": "link", "severity": "medium", "applies_to": ["url"], "type": "substring", "pattern": "EXAMPLE.COM/FR"},
    {"id": "T-003", "category": "markup", "severity": "low", "applies_to": ["tool_result", "input"], "type": "substring", "pattern": "&AMP;"},
]
_GRANTED = [(g["role"], g["table"], c) for g in GRANTS for c in (g["columns"] or [c for t, c in _COLUMNS if t == g["table"]])]


def _granted(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_GRANTED, "role string, table string, column string")


def _labels(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_LABELS, "table string, column string, label string")


def _reads(s: SparkSession, d: str) -> DataFrame:
    """events as column reads: one per event and table column that its k picks."""
    k = F.get_json_object("props", "$.k").cast("int")
    cols = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column")) for t, c in _COLUMNS])
    return table(s, d, "events").select(F.col("event_id").alias("binding_id"), F.when(k % 2 == 0, "sales").otherwise("hr").alias("role"), F.explode(F.slice(cols, k % 8 + 1, F.lit(2))).alias("x")).select("binding_id", "role", "x.*")


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("pos"), "role", "text")


def _bindings(s: SparkSession, d: str) -> DataFrame:
    """Customers as values of data queries that their nation's conversations may show."""
    return table(s, d, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "denied").otherwise("resolved").alias("status"), F.when(F.col("c_custkey") % 5 == 0, "deny").otherwise("allow").alias("ai_data_policy"),
        F.when(F.col("c_acctbal") < 0, "sensitive").when(F.col("c_nationkey") % 2 == 0, "internal").otherwise("public").alias("label"), F.when(F.col("c_nationkey") < 12, "internal").otherwise("sensitive").alias("max_label"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "remote").otherwise("local").alias("trust"), (F.col("c_custkey") % 7 != 0).alias("clean"),
    )


def s7_texts(s: SparkSession, d: str) -> DataFrame:
    """Turns as messages with a content, with parts, or with tool calls, in turn."""
    turn, text = F.col("turn"), F.col("text")
    parts = F.when(turn % 3 == 1, F.array(F.struct(F.lit("text").alias("type"), F.lit("see").alias("text")), F.struct(F.lit("text").alias("type"), text.alias("text"))))
    call = lambda name, arguments: F.struct(F.lit("1").alias("id"), F.lit("function").alias("type"), F.struct(F.lit(name).alias("name"), arguments.cast("string").alias("arguments")).alias("function"))
    calls = F.when(turn % 3 == 2, F.array(call("mail", text), call("note", F.lit(""))))
    role = F.when(turn % 2 == 0, " Tool ").otherwise("user")
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("request_id"), "turn", role.alias("role"), F.when(turn % 3 == 0, text).alias("content"), parts.alias("parts"), F.col("role").alias("name"), calls.alias("tool_calls"))
    return messages.client_texts(rows).select("request_id", "turn", "path", "surface", F.length("text").alias("n"))


def l3_index(s: SparkSession, d: str) -> DataFrame:
    tables = {"customer": table(s, d, "customer").select("c_acctbal"), "orders": table(s, d, "orders").select("o_totalprice")}
    schema = s.createDataFrame(_COLUMNS, "table string, column string")
    protected = leaks.protected_columns(schema, s.createDataFrame([("sales",), ("hr",)], "role string"), _granted(s), _labels(s))
    return leaks.protected_index(tables, protected)


def l4_numbers(s: SparkSession, d: str) -> DataFrame:
    """Numbers of documents that are keys of orders: ends of telephone numbers and the like."""
    index = leaks.protected_index({"orders": table(s, d, "orders").select("o_orderkey")}, s.createDataFrame([("r", "orders", "o_orderkey")], "role string, table string, column string"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("r").alias("role"), "text")
    return leaks.find_protected(docs, index).groupBy("id").agg(F.count("*").alias("n"))


def t7_mask(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("source").alias("request_id"), F.col("doc_id").alias("pos"), "text")
    masked, findings, _ = scan.mask_requests(docs)
    return masked.select("request_id", "pos", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def t8_decisions(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("request_id"), F.lit(0).alias("pos"), "text")
    return scan.masking_decisions(scan.mask_requests(docs)[1], docs)


def l8_remask(s: SparkSession, d: str) -> DataFrame:
    """Assistant turns with the first word of each user turn as a value issued a minute before."""
    turns = table(s, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn") * 60)
    issued = turns.where("role = 'user'").select(F.col("conv_id").alias("user_id"), F.regexp_extract("text", r"^(\p{L}{3,})", 1).alias("value"), at.alias("issued_at")).where("value <> ''")
    rows = turns.select(F.struct("conv_id", "turn").alias("id"), F.col("conv_id").alias("user_id"), "role", at.alias("ts"), "text")
    return leaks.remask_history(rows, issued, 150).select("id.conv_id", "id.turn", F.col("replaced").cast("long").alias("replaced"))


#: What authors of queries may see: no names of clerks, no comments, no addresses.
AUTHOR = [
    {"role": "author", "table": t, "scope": "all", "columns": c}
    for t, c in {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], "nation": ["n_nationkey", "n_name", "n_regionkey"]}.items()
]


def author_views(s: SparkSession, d: str, names: list[str]) -> dict[str, DataFrame]:
    return {t: G.governed_view(table(s, d, t), t, AUTHOR, "author", "u", None) for t in names}


def q_sql(text: str):
    """A query of the surface open to authors, over governed views of the tables."""

    def run(s: SparkSession, d: str) -> DataFrame:
        names = [t for t in ("customer", "orders", "nation") if f"{{{t}}}" in text]
        return s.sql(text, **author_views(s, d, names))

    return run


def q10_parameters(s: SparkSession, d: str) -> DataFrame:
    """A parametrised query over what one department may see: the scope holds whatever the query asks for."""
    mine = G.governed_view(table(s, d, "customer"), "customer", GRANTS, "sales", "u", "7", "c_custkey", "c_nationkey")
    return s.sql("SELECT c_custkey, :role AS role FROM {customer} WHERE c_nationkey >= :department", args={"role": "sales", "department": 5}, customer=mine)


_Q = {
    "q1_where": "SELECT c_custkey, c_name, c_acctbal * 2 AS twice FROM {customer} WHERE (c_acctbal BETWEEN 100 AND 900 OR c_nationkey IN (1, 2)) AND NOT c_name LIKE '%7' AND c_mktsegment IS NOT NULL",
    "q2_joins": "SELECT n.n_name, count(o.o_orderkey) AS n FROM {nation} n LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY n.n_name",
    "q3_semi": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)",
    "q4_subqueries": "WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM {orders} GROUP BY o_custkey) SELECT c_custkey, (SELECT max(top) FROM big) AS best, b.top FROM {customer} c JOIN big b ON b.o_custkey = c.c_custkey WHERE b.top > (SELECT avg(o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "q5_aggregates": "SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(avg(c_acctbal), 2) AS mean FROM {customer} GROUP BY c_mktsegment HAVING count(*) > 10",
    "q6_case": "SELECT c_custkey, CASE WHEN c_acctbal > (SELECT avg(c_acctbal) FROM {customer}) THEN 'above' ELSE 'below' END AS side FROM {customer}",
    "q7_union": "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal < 0 UNION SELECT n_nationkey AS k FROM {nation} WHERE n_regionkey = 2",
    "q8_order_limit": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "q9_functions": "SELECT c_custkey, round(abs(c_acctbal), 1) AS a, coalesce(nullif(c_nationkey, 3), -1) AS k, lower(c_name) AS l, upper(c_mktsegment) AS u, length(c_name) AS n, CAST(floor(c_acctbal) AS BIGINT) AS w FROM {customer}",
}

QUERIES = {
    "g2_governed_projection": lambda s, d: G.governed_view(table(s, d, "part"), "part", GRANTS, "sales", "u", None),
    "g3_department_scope": lambda s, d: G.governed_view(table(s, d, "customer"), "customer", GRANTS, "sales", "u", "7", "c_custkey", "c_nationkey"),
    "g3_scopes_of_many": lambda s, d: G.scoped_rows(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_name"), s.createDataFrame([("5", "x", "self"), ("b", "3", "department"), ("c", "4", "department"), ("boss", None, "all")], "user_id string, department string, scope string"), "c_custkey", "c_nationkey"),
    "g4_denied_bindings": lambda s, d: G.denied_bindings(_reads(s, d), _granted(s)).select("binding_id", F.array_join("missing", ",").alias("missing")),
    "g5_binding_labels": lambda s, d: G.binding_labels(_reads(s, d), _labels(s)),
    "g6_unrecorded_reads": lambda s, d: G.unrecorded_reads(_reads(s, d).drop("role"), _reads(s, d).where("binding_id % 3 > 0").drop("role")),
    "g7_disclosure": lambda s, d: G.disclosure(_bindings(s, d)).select("id", "disclosed", "reason"),
    "g10_models": lambda s, d: G.resolve_models(calls(s, d).select("id", "model"), s.createDataFrame([("m0",), ("m2",)], "model string"), "m0"),
    "g13_scrub_sql": lambda s, d: table(s, d, "orders").select("o_orderkey", G.scrub_sql(F.concat(
        F.lit("SELECT * FROM t WHERE p > "), F.floor("o_totalprice").cast("string"), F.lit(" AND s = '"), "o_orderpriority", F.lit("' OR q = \""), "o_orderpriority", F.lit("\" OR h = 0xAB12 OR m = a.b@corp.com OR u = 'it''s open "), "o_orderpriority")).alias("sql")),
    "g14_query_requests": lambda s, d: G.query_requests(table(s, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("n"), F.when(F.col("event_type") == "error", "{\"sql\": \" \"}").otherwise("{\"sql\": \"SELECT 1\", \"purpose\": \"p\", \"expect\": \"row\"}").alias("arguments")), 5).select("n", "name", "status"),
    "l2_protected_columns": lambda s, d: leaks.protected_columns(column_values({t: table(s, d, t) for t in ("customer", "orders", "part")}, _COLUMNS).select("table", "column").distinct(), s.createDataFrame([("sales",), ("hr",)], "role string"), _granted(s), _labels(s)),
    "l3_protected_index": l3_index,
    "l4_protected_numbers": l4_numbers,
    "l8_remask_history": l8_remask,
    "s4_column_values": lambda s, d: column_values({"customer": table(s, d, "customer")}, [("customer", "c_mktsegment"), ("customer", "c_custkey")]).groupBy("table", "column", "value").agg(F.count("*").alias("n")),
    "s7_client_texts": s7_texts,
    "s8_shaped_result": lambda s, d: shaped(table(s, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey"), "list", 5),
    "t1_sensitive_spans": lambda s, d: scan.with_spans(table(s, d, "documents")).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*"),
    "t3_card_numbers": lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([0-9]{16})\b"), F.lit(1))).alias("number")).select("doc_id", "number", checks.card_ok(F.col("number")).alias("ok")),
    "t4_pesel_numbers": lambda s, d: table(s, d, "orders").select("o_orderkey", checks.pesel_ok(F.lpad((F.col("o_orderkey") * 1234577 + 44051401358).cast("string"), 11, "0")).alias("ok")),
    "t5_iban_numbers": lambda s, d: table(s, d, "customer").select("c_custkey", checks.iban_ok(F.concat(F.lit("XX"), F.lpad((F.col("c_custkey") % 97 + 2).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 7919 + 100000000000).cast("string"), 12, "0"))).alias("ok")),
    "t6_redacted": lambda s, d: scan.redacted(table(s, d, "documents")).select("doc_id", F.size(F.regexp_extract_all("redacted", F.lit(r"(\[REDACTED:[a-z_]+\])"), F.lit(1))).alias("n")),
    "t7_mask_requests": t7_mask,
    "t8_masking_decisions": t8_decisions,
    "t10_injection": lambda s, d: injection.check_injection(_texts(s, d)).select("request_id", "pos", "injection", "injection_verdict"),
    "t11_signatures": lambda s, d: signatures.match_signatures(table(s, d, "pages"), _FEED, F.lit("tool_result"), "log", "html").select("page_id", "signature_verdict", "signature_ids"),
    "t14_new_content": lambda s, d: messages.new_content(_texts(s, d).withColumnRenamed("pos", "turn")).select("request_id", "turn"),
    "t15_review_batch": lambda s, d: messages.review_batch(table(s, d, "documents").select("doc_id", "text"), 1000).select("doc_id", F.length("review").alias("n"), F.sha2(F.col("review").cast("binary"), 256).alias("sha")),
    **{k: q_sql(v) for k, v in _Q.items()},
    "q10_parameters": q10_parameters,
}

_READS = "cols AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{c}')" for i, (t, c) in enumerate(_COLUMNS)) + ") x(i, t, c)), reads AS (SELECT event_id AS binding_id, CASE WHEN k % 2 = 0 THEN 'sales' ELSE 'hr' END AS role, t, c FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) JOIN cols ON i >= k % 8 AND i < k % 8 + 2)"
_GRANTED_SQL = "granted(role, t, c) AS (VALUES " + ", ".join(f"('{r}', '{t}', '{c}')" for r, t, c in _GRANTED) + ")"
_LABEL_SQL = "lab(t, c, r) AS (VALUES " + ", ".join(f"('{t}', '{c}', {('public', 'internal', 'sensitive').index(label)})" for t, c, label in [(t, c, next((x for a, b, x in _LABELS if (a, b) == (t, c)), next(x for a, b, x in _LABELS if (a, b) == (t, None)))) for t, c in _COLUMNS]) + ")"
_FORM = "rtrim(rtrim(printf('%.6f', abs(v)), '0'), '.')"

SQL = {
    "g2_governed_projection": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "g3_department_scope": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7",
    "g3_scopes_of_many": "SELECT '5' AS user_id, c_custkey, c_nationkey, c_name FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'b', c_custkey, c_nationkey, c_name FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'c', c_custkey, c_nationkey, c_name FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'boss', c_custkey, c_nationkey, c_name FROM customer",
    "g4_denied_bindings": f"WITH {_READS}, {_GRANTED_SQL} SELECT binding_id, string_agg(DISTINCT t || '.' || c, ',' ORDER BY t || '.' || c) AS missing FROM reads r WHERE NOT EXISTS (SELECT 1 FROM granted g WHERE g.role = r.role AND g.t = r.t AND g.c = r.c) GROUP BY binding_id",
    "g5_binding_labels": f"WITH {_READS}, {_LABEL_SQL} SELECT binding_id, ['public','internal','sensitive'][1 + max(r)] AS label FROM reads JOIN lab USING (t, c) GROUP BY binding_id",
    "g6_unrecorded_reads": f"WITH {_READS} SELECT binding_id, t AS \"table\", c AS \"column\" FROM reads WHERE binding_id % 3 = 0",
    "g7_disclosure": "SELECT id, why IS NULL AS disclosed, why AS reason FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'not resolved' WHEN c_custkey % 5 = 0 THEN 'AI data policy' WHEN c_acctbal < 0 AND c_nationkey < 12 THEN 'label above the role''s limit' WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN 'sensitive value and remote model' WHEN c_custkey % 7 = 0 THEN 'value matches a scan' END AS why FROM customer)",
    "g10_models": "SELECT event_id AS id, 'm' || (k % 4) AS model, CASE WHEN k % 4 IN (0, 2) THEN 'm' || (k % 4) ELSE 'm0' END AS resolved, CASE WHEN k % 4 IN (0, 2) THEN 'allow' ELSE 'log' END AS verdict FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)",
    "g13_scrub_sql": "SELECT o_orderkey, 'SELECT * FROM t WHERE p > [VALUE] AND s = [VALUE] OR q = [VALUE] OR h = [VALUE]x[VALUE] OR m = [REDACTED:email] OR u = [VALUE]' AS sql FROM orders",
    "g14_query_requests": "SELECT n, CASE WHEN good THEN '{x' || k || '}' END AS name, CASE WHEN NOT good THEN 'invalid' WHEN k > 5 THEN 'rejected' ELSE 'accepted' END AS status FROM (SELECT event_id AS n, event_type <> 'error' AS good, sum(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)",
    "l2_protected_columns": f"WITH {_GRANTED_SQL}, {_LABEL_SQL} SELECT DISTINCT r.role, lab.t AS \"table\", lab.c AS \"column\" FROM (VALUES ('sales'), ('hr')) r(role), lab WHERE lab.r = 2 OR NOT EXISTS (SELECT 1 FROM granted g WHERE g.role = r.role AND g.t = lab.t AND g.c = lab.c)",
    "l3_protected_index": f"SELECT DISTINCT role, form FROM (SELECT {_FORM} AS form FROM (SELECT c_acctbal AS v FROM customer UNION ALL SELECT o_totalprice FROM orders)), (VALUES ('sales'), ('hr')) r(role) WHERE length(replace(form, '.', '')) >= 4",
    "s4_column_values": "SELECT 'customer' AS \"table\", 'c_mktsegment' AS \"column\", c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 3 UNION ALL SELECT 'customer', 'c_custkey', CAST(c_custkey AS VARCHAR), count(*) FROM customer GROUP BY 3",
    "s7_client_texts": """WITH c AS (SELECT *, turn % 3 AS m, CASE WHEN turn % 2 = 0 THEN 'tool_result' ELSE 'input' END AS surface FROM conversations), x AS (
      SELECT *, 'content' AS path, text AS t FROM c WHERE m = 0 UNION ALL SELECT *, 'parts[0]', 'see' FROM c WHERE m = 1 UNION ALL SELECT *, 'parts[1]', text FROM c WHERE m = 1 UNION ALL SELECT *, 'name', role FROM c
      UNION ALL SELECT *, 'tool_calls[0].name', 'mail' FROM c WHERE m = 2 UNION ALL SELECT *, 'tool_calls[0].arguments', text FROM c WHERE m = 2 UNION ALL SELECT *, 'tool_calls[1].name', 'note' FROM c WHERE m = 2)
      SELECT conv_id AS request_id, turn, path, surface, length(t) AS n FROM x WHERE t <> ''""",
    "s8_shaped_result": "SELECT 'resolved' AS status, '| c_custkey | c_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || ' |', chr(10) ORDER BY c_custkey) AS value, 5 AS \"rows\", true AS truncated FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)",
    "t3_card_numbers": r"SELECT doc_id, number, regexp_full_match(number, '[2-6][0-9]{15}') AND length(replace(number, number[1], '')) > 0 AND list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(number[i] AS INT) WHEN CAST(number[i] AS INT) > 4 THEN CAST(number[i] AS INT) * 2 - 9 ELSE CAST(number[i] AS INT) * 2 END)) % 10 = 0 AS ok FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b([0-9]{16})\b', 1)) AS number FROM documents)",
    "t4_pesel_numbers": "SELECT o_orderkey, length(s) = 11 AND (10 - list_sum(list_transform(range(1, 11), lambda i: CAST(s[i] AS INT) * [1,3,7,9,1,3,7,9,1,3][i])) % 10) % 10 = CAST(s[11] AS INT) AND CAST(s[3:4] AS INT) % 20 BETWEEN 1 AND 12 AND CAST(s[5:6] AS INT) BETWEEN 1 AND 31 AS ok FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 1234577 + 44051401358 AS VARCHAR), 11, '0') AS s FROM orders)",
    "t5_iban_numbers": "SELECT c_custkey, CAST(CAST(lpad(CAST(c_custkey * 7919 + 100000000000 AS VARCHAR), 12, '0') || '3333' || lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') AS HUGEINT) % 97 AS INT) = 1 AS ok FROM customer",
    "t11_signatures": r"SELECT page_id, CASE WHEN h1 THEN 'block' WHEN h2 OR h3 THEN 'log' ELSE 'allow' END AS signature_verdict, concat_ws(', ', CASE WHEN h1 THEN 'T-001' END, CASE WHEN h2 THEN 'T-002' END, CASE WHEN h3 THEN 'T-003' END) AS signature_ids FROM (SELECT page_id, regexp_matches(html, 'track\(\d*[05]\)') AS h1, len(list_filter(regexp_extract_all(html, '(?i)https?://[^\s''\"<>()\[\]{}`]+'), lambda u: contains(lower(u), 'example.com/fr'))) > 0 AS h2, contains(lower(html), '&amp;') AS h3 FROM pages)",
    "t14_new_content": "SELECT conv_id AS request_id, turn FROM (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER w AS u, max(turn) FILTER (WHERE role = 'assistant') OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id)) WHERE turn >= greatest(coalesce(u, -1), coalesce(a, -2) + 1)",
    "t15_review_batch": "SELECT doc_id, length(r) AS n, sha256(r) AS sha FROM (SELECT doc_id, '<<<TEXT' || chr(10) || replace(replace(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 500) || chr(10) || '[... ' || (length(text) - 1000) || ' characters omitted ...]' || chr(10) || right(text, 500) END, '<<<', ' '), '>>>', ' ') || chr(10) || 'TEXT>>>' AS r FROM documents)",
    **{k: v.replace("{", "").replace("}", "") for k, v in _Q.items()},
    "q10_parameters": "SELECT c_custkey, 'sales' AS role FROM customer WHERE c_nationkey = 7",
}


def sql() -> dict[str, str]:
    return SQL
