"""The policy as small tables, governed tables by name, and the shape of a query's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The strictest values, for what a role leaves out.
STRICT = {"max_ai_data_policy": "deny", "max_label_to_model": "public"}


def policy_tables(spark: SparkSession, policy: dict) -> dict[str, DataFrame]:
    """S6. users, roles, grants, labels, table_meta, tool_rules, tool_labels, limits and prices of a policy.

    policy: the parsed file, a small tree that the driver holds; one table per kind of statement comes of it.
    """
    roles, tables = policy.get("roles", {}), policy.get("data", {}).get("tables", {})
    rows = {
        "users": ("user_id string, api_key_hash string, role string, department string, ai_data_policy string", [
            (k, u.get("api_key_hash"), u.get("role"), u.get("department"), u.get("ai_data_policy", "deny")) for k, u in policy.get("users", {}).items()]),
        "roles": ("role string, max_ai_data_policy string, max_label_to_model string", [(r, *(v.get(k, d) for k, d in STRICT.items())) for r, v in roles.items()]),
        "grants": ("role string, table string, scope string, column string", [
            (r, t.lower(), g.get("scope", "self"), c) for r, v in roles.items() for t, g in v.get("tables", {}).items() for c in (g["columns"] if g.get("columns") is not None else [None])]),
        "labels": ("table string, column string, label string", [
            x for t, m in tables.items() for x in [(t.lower(), None, m.get("label", "sensitive")), *((t.lower(), c.lower(), label) for c, label in (m.get("columns") or {}).items())]]),
        "table_meta": ("table string, owner_column string, department_column string, identity_columns array<string>", [
            (t.lower(), m.get("owner_column"), m.get("department_column"), m.get("identity_columns") or []) for t, m in tables.items()]),
        "tool_rules": ("role string, tool string, arg string, rule string, value string", [
            (r, t, a, k, str(x)) for r, v in roles.items() for t, d in v.get("tools", {}).items() for a, checks in d.get("args", {}).items() for k, x in checks.items()]),
        "tool_labels": ("role string, tool string, max_label string", [(r, t, d.get("max_label", "public")) for r, v in roles.items() for t, d in v.get("tools", {}).items()]),
        "limits": ("role string, key string, value double", [
            (r, k, float(x)) for r, own in [("default", policy.get("budgets", {}).get("default", {})), *policy.get("budgets", {}).get("roles", {}).items()] for k, x in own.items()]),
        "prices": ("model string, usd_per_1k double", [(m, float(p)) for m, p in policy.get("pricing", {}).items()]),
    }
    return {k: spark.createDataFrame(data, schema) for k, (schema, data) in rows.items()}


def column_values(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """S4. (table, column, value as text): every value of the named columns, all rows; unknown names raise KeyError."""
    out = None
    for t, c in columns:
        if t not in tables or c not in tables[t].columns:
            raise KeyError(f"{t}.{c}")
        rows = tables[t].select(F.lit(t).alias("table"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def shaped(result: DataFrame, expect: str, max_rows: int = 50) -> DataFrame:
    """S8. One row (status, value, rows, truncated): a query's result as a scalar, a row or a markdown list.

    Reads max_rows + 1 rows at most, which tells whether the result was cut; the limit is the feature.
    """
    escape = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([\\|])", r"\\$1")
    few = result.limit(max_rows + 1).withColumn("_k", F.monotonically_increasing_id())
    cells = {
        "scalar": F.col(result.columns[0]).cast("string"),
        "row": F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in result.columns]),
        "list": F.concat(F.lit("| "), F.concat_ws(" | ", *[escape(c) for c in result.columns]), F.lit(" |")),
    }[expect]
    lines = few.agg(F.array_sort(F.collect_list(F.struct("_k", cells.alias("v")))).alias("x")).select(F.transform("x", lambda r: r["v"]).alias("x"))
    n = F.size("x")
    head = f"| {' | '.join(result.columns)} |\n| {' | '.join('---' for _ in result.columns)} |\n"
    value = F.concat(F.lit(head), F.array_join(F.slice("x", 1, max_rows), "\n")) if expect == "list" else F.get("x", F.lit(0))
    empty = (n == 0) | (F.lit(expect == "scalar") & F.get("x", F.lit(0)).isNull())
    return lines.select(F.when(empty, "empty").otherwise("resolved").alias("status"), F.when(~empty, value).alias("value"), F.least(n, F.lit(max_rows)).alias("rows"), (n > max_rows).alias("truncated"))
