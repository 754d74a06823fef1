"""Governance, leak detection, consumption and the request log."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import analytics, consumption, governance, leaks
from siftline.plans.audit_view import audit_view
from siftline.schemas import AUDIT
from siftline.sources import audit_log, policy

T0 = dt.datetime(2026, 1, 1, 12, 0, 0)


def sec(n):
    return T0 + dt.timedelta(seconds=n)


def test_principals(spark):
    import hashlib

    users = spark.createDataFrame([("u", hashlib.sha256(b"k").hexdigest(), "r", "d", "allow"), ("v", hashlib.sha256(b"l").hexdigest(), "s", "d", "allow")], "user_id string, api_key_hash string, role string, department string, ai_data_policy string")
    roles = spark.createDataFrame([("r", "allow"), ("s", "deny")], "role string, max_ai_data_policy string")
    got = {r.n: (r.user_id, r.ai_data_policy) for r in governance.principals(spark.createDataFrame([(1, "k"), (2, "l"), (3, "?")], "n int, api_key string"), users, roles).collect()}
    assert got == {1: ("u", "allow"), 2: ("v", "deny"), 3: (None, None)}


def test_governed_view_fails_closed(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, dep string, pay int")
    grants = [{"role": "r", "table": "t", "scope": "department", "columns": ["id"]}, {"role": "s", "table": "t", "scope": "all", "columns": None}]
    assert governance.governed_view(rows, "t", grants, "r", "u", "a", "id", "dep").collect() == [(1,)]
    assert governance.governed_view(rows, "t", grants, "s", "u", None).count() == 2
    with pytest.raises(PermissionError):
        governance.governed_view(rows, "t", grants, "x", "u", "a")
    with pytest.raises(ValueError):
        governance.governed_view(rows, "t", grants, "r", "u", "a", "id")


def test_tool_calls(spark):
    calls = [
        (1, "q", "r", "mail", '{"to": "a@corp.com"}'), (2, "q", "r", "shell", "{}"), (3, "q", "r", "mail", "[1]"), (4, "q", "r", "mail", '{"To": "a@corp.com", "to": "a@corp.com"}'), (5, "q", "r", "mail", '{"to": "{x1}"}'),
        (6, "q", "r", "mail", '{"to": "a@evil.com"}'), (7, "q", "r", "mail", '{"to": "a@corp.com", "n": 9}'), (8, "q", "r", "mail", '{"to": "a@corp.com", "n": 2, "body": "drop table"}'), (9, "q", "r", "mail", '{"to": "a@corp.com", "n": 2, "body": "pay 6200 now"}'), (10, "q", "r", "mail", '{"to": "a@corp.com", "n": 2, "body": "{x2}"}'),
        (11, "q", "r", "mail", '{"to": "a@corp.com", "n": 2, "body": "pay 62001 now"}'), (12, "q", "r", "mail", '{"to": "a@corp.com", "n": "x"}'),
    ]
    rules = [("r", "mail", "to", "allow_pattern", r"[a-z]+@corp\.com"), ("r", "mail", "n", "max", "5"), ("r", "mail", "body", "deny_pattern", "drop")]
    calls += [(20 + k, "q", "r", tool, a) for k, (tool, a) in enumerate([
        ("mail", '{"to": "a@corp.com", "b": "{x9}"}'), ("mail", '{"to": "a@corp.com", "b": "{x1}"}'), ("note", '{"b": "{x1}"}'), ("mail", '{"to": "a@corp.com", "b": "\\u007bx9}"}'), ("mail", '{"to": "a@corp.com", "b": {"\\u0041nna Kowal": [1]}}'),
        ("mail", '{"to": 5}'), ("mail", '{"to": "a@corp.com", "n": true}'), ("mail", '{"\uff54o": "a@corp.com", "to": "a@corp.com"}'), ("note", '{"b": ' + "[" * 40 + "]" * 40 + "}"), ("mail", '{"to": "a@corp.com"}'), ("mail", '{"to": "a@corp.com", "b": 6200}'),
        ("note", '{"b": ' + "[" * 30 + "]" * 30 + "}"), ("note", " "), ("mail", '{"to": "a@corp.com", "b": "{x4}"}'), ("note", '{"b": "62000"}')])]
    bindings = [("q", "{x1}", "resolved", "public", False, "1"), ("q", "{x2}", "resolved", "sensitive", False, "77"), ("q", "{x3}", "resolved", "sensitive", True, "6200.0"), ("q", "{x4}", "denied", "public", False, None), ("q", "{x5}", "resolved", "sensitive", True, "Anna Kowal")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.call_id: r.rule for r in governance.authorize_calls(
        frame(calls, "call_id int, request_id string, role string, tool string, arguments string"), frame([("r", "mail"), ("r", "note")], "role string, tool string"), frame(rules, "role string, tool string, arg string, rule string, value string"),
        frame(bindings, "request_id string, name string, status string, label string, disclosed boolean, value string"), frame([("r", "mail", "internal")], "role string, tool string, max_label string")).collect()}
    assert got[2] == "not_listed" and got[3] == "malformed_arguments" and got[4] == "argument_name" and got[5] == "egress" and got[6] == "allow_pattern"
    assert got[7] == "max" and got[8] == "deny_pattern" and got[9] == "egress" and got[10] == "egress" and got[11] is None and got[12] == "max"
    # unbound; public; no limit set; escaped; a name as a key, escaped; a number for a pattern; true for a number; a wide
    # look-alike; too deep; an absent number; a number copied; deep enough; blank; not resolved; within a longer number
    assert [got[20 + k] for k in range(15)] == ["egress", None, "egress", "egress", "egress", "allow_pattern", "max", "argument_name", "malformed_arguments", None, "egress", None, None, "egress", None]
    fine = {r.call_id: r.args for r in governance.approved_arguments(frame(calls, "call_id int, request_id string, role string, tool string, arguments string"), frame(rules, "role string, tool string, arg string, rule string, value string")).collect()}
    assert fine[1] == ["to"] and 6 not in fine and 5 not in fine


def test_pins_and_imports(spark):
    good, other = "a" * 64, "b" * 64
    models = spark.createDataFrame([("m",), ("n:1",), ("o",), ("p",), ("q",)], "name string")
    pins = spark.createDataFrame([("m:latest", f"sha256:{good}"), ("n:1", good), ("o", "short"), ("p", good)], "name string, digest string")
    have = spark.createDataFrame([("m:latest", good.upper()), ("n:1", other), ("o", good)], "name string, digest string")
    assert {r.name: r.status for r in governance.pin_states(models, pins, have).collect()} == {"m": "ok", "n:1": "mismatch", "o": "mismatch", "p": "missing", "q": "unpinned"}
    assert {r.name: r.status for r in governance.pin_states(models, pins, None).collect()} == {"m": "unverified", "n:1": "unverified", "o": "mismatch", "p": "unverified", "q": "unpinned"}
    imports = [("a", "torch._utils", "_rebuild"), ("a", "numpy", "ndarray"), ("b", "os", "system"), ("c", "torch.hub", "x"), ("d", "torch", "x.load"), ("e", None, "x"), ("f", "torchx", "y")]
    got = {r.file: (r.safe, r.blocked) for r in governance.unsafe_imports(spark.createDataFrame(imports, "file string, module string, name string"), ["torch.hub"], ["load", "system"]).collect()}
    assert got == {"a": (True, 0), **{k: (False, 1) for k in "bcdef"}}


def test_query_requests(spark):
    q = '{"sql": "SELECT 1", "purpose": "p", "expect": "row"}'
    rows = spark.createDataFrame([("r", 0, q), ("r", 1, "[]"), ("r", 2, q.replace("row", "rows")), ("r", 3, q), ("r", 4, q), ("r", 5, None)], "request_id string, n int, arguments string")
    got = [(r.name, r.status) for r in governance.query_requests(rows, 2).orderBy("n").collect()]
    assert got == [("{x1}", "accepted"), (None, "invalid"), (None, "invalid"), ("{x2}", "accepted"), ("{x3}", "rejected"), (None, "invalid")]


@pytest.mark.parametrize(("raw", "forms"), [("6200", {"6200"}), ("48.000", {"48000", "48"}), ("1,234.50", {"1234.5"}), ("48 000", {"48000"}), ("0012", {"12"}), ("x1", set()), ("7.5", {"7.5"}), ("1,234", {"1234", "1.234"})])
def test_number_forms(raw, forms):
    assert leaks.text_number_forms(raw) == forms


def test_protected_numbers(spark):
    tables = {"pay": spark.createDataFrame([(1, 6200.0, "x"), (2, 7499.5, "48000")], "id int, salary double, note string")}
    protected = spark.createDataFrame([("r", "pay", "salary"), ("r", "pay", "note")], "role string, table string, column string")
    index = leaks.protected_index(tables, protected)
    assert {r.form for r in index.collect()} == {"6200", "7499.5", "48000"}
    texts = spark.createDataFrame([(1, "r", "earns 6,200 or 7499,50"), (2, "r", "48000 100 glued"), (3, "r", "62001"), (4, "other", "6200"), (5, "r", None)], "id int, role string, text string")
    got = {}
    for r in leaks.find_protected(texts, index).collect():
        got.setdefault(r.id, set()).add((r.start, r.end))
    assert got == {1: {(6, 11), (15, 22)}, 2: {(0, 9)}}


def test_output_filter(spark):
    schema = "id int, role string, text string, spans array<struct<start:int,end:int,source:string,binding:string>>"
    rows = spark.createDataFrame([
        (1, "r", "it is 6200", []), (2, "r", "it is 6200", [(6, 10, "gateway", "x1")]), (3, "r", "evil@ex.com", [(0, 4, "gateway", "x1")]), (4, "r", "left {x3} over", []), (5, "r", "fine", [])], schema)
    index = spark.createDataFrame([("r", "6200")], "role string, form string")
    got = {r.id: (r.filtered, r.verdict) for r in leaks.filter_answers(rows, index).collect()}
    assert got == {1: ("it is [REDACTED]", "redact"), 2: ("it is 6200", "allow"), 3: ("[REDACTED]", "redact"), 4: ("left [unavailable] over", "redact"), 5: ("fine", "allow")}
    assert {r.verdict for r in leaks.filter_answers(rows, None).collect()} == {"block"}
    assert {r.id: r.filtered for r in leaks.filter_answers(rows, index, "block").collect()}[1] == ""
    calls = spark.createDataFrame([(1, '{"a": ["x@example.com", 4111111111111111], "ok": "y@example.com"}'), (2, "{}")], "call_id int, arguments string")
    done = {r.call_id: r for r in leaks.filter_arguments(calls, spark.createDataFrame([(1, ["ok"])], "call_id int, args array<string>")).collect()}
    assert json.loads(done[1].filtered) == {"a": ["[REDACTED]", "[REDACTED]"], "ok": "y@example.com"} and done[1].changed and not done[2].changed


def test_placeholder_within_a_finding(spark):
    """A placeholder beside what is redacted is marked by itself; one within goes with it."""
    assert leaks.cleaned("password={x1}abc1 {x2}", [], [])[0].endswith("[unavailable]")
    assert leaks.cleaned("a {x1} b@c.de", [], []) == ("a [unavailable] [REDACTED]", ["email"], 1)
    assert leaks.cleaned("b@c.de", [{"start": 0, "end": 6, "source": "gateway"}], []) == ("b@c.de", [], 0)
    assert leaks.cleaned("", [], []) == ("", [], 0)


def test_arguments_with_protected_numbers(spark):
    index = spark.createDataFrame([("r", "6200"), ("r", "7499.5")], "role string, form string")
    calls = spark.createDataFrame([(1, "r", '{"a": [6200, 1, "pays 7,499.50"], "6.200": "{x1}", "ok": "6200"}'), (2, "s", '{"a": 6200}'), (3, "r", None), (4, "r", "no json 6200")], "call_id int, role string, arguments string")
    got = {r.call_id: r.filtered for r in leaks.filter_arguments(calls, spark.createDataFrame([(1, ["ok"])], "call_id int, args array<string>"), index).collect()}
    assert json.loads(got[1]) == {"a": ["[REDACTED]", 1, "pays [REDACTED]"], "[REDACTED]": "[unavailable]", "ok": "6200"}
    assert json.loads(got[2]) == {"a": 6200} and got[3] is None and got[4] == "no json [REDACTED]"


def test_models_and_scrubbed_sql(spark):
    rows = spark.createDataFrame([("a",), ("z",)], "model string")
    allowed = spark.createDataFrame([("a",)], "model string")
    of = lambda default: {r.model: (r.resolved, r.verdict) for r in governance.resolve_models(rows, allowed, default).collect()}
    assert of("a") == {"a": ("a", "allow"), "z": ("a", "log")} and of("b")["z"] == of(None)["z"] == (None, "block")
    cases = ["x = 'it''s' AND y = 'Anna Kowal", 'n = "Anna"', "h = 0xAB12", "m = a@b.co", None]
    got = [r.s for r in spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, sql string").select("k", governance.scrub_sql(F.col("sql")).alias("s")).orderBy("k").collect()]
    assert got == ["x = [VALUE] AND y = [VALUE]", "n = [VALUE]", "h = [VALUE]x[VALUE]", "m = [REDACTED:email]", None]


def test_author_sql_stays_within_grants(spark, sf):
    from pyspark.errors import AnalysisException

    from siftline.plans import governed_queries

    with pytest.raises(AnalysisException):
        governed_queries.q_sql("SELECT o_orderdate FROM {orders}")(spark, sf).collect()
    assert governed_queries.q10_parameters(spark, sf).count() == spark.read.parquet(f"{sf}/customer.parquet").where("c_nationkey = 7").count()


def test_audit_guard(spark):
    row = {"request_id": "q", "timestamp": "2026-01-01T00:00:00Z", "prompt_text": "hello", "decisions": [{"stage": "s", "control": "c", "verdict": "allow", "reason": "pays 6,200 each", "latency_ms": 1.0}], "bindings": [], "tool_decisions": []}
    records = spark.createDataFrame([json.dumps(row), json.dumps(row | {"request_id": "p"})], "string").select(F.from_json("value", AUDIT).alias("r")).select("r.*")
    values = spark.createDataFrame([("q", "binding", "6200"), ("p", "binding", "62"), ("p", "vault", "absent")], "request_id string, kind string, value string")
    assert [(r.request_id, r.paths) for r in leaks.leaking_records(records, values).collect()] == [("q", ["decisions[0].reason"])]
    got = {r.request_id: r for r in leaks.guard_records(records, values).collect()}
    assert got["q"].prompt_text is None and got["q"].decisions[0].control == "audit.guard" and got["p"].prompt_text == "hello"


def test_issued_values_and_history(spark):
    b = spark.createDataFrame([("u", "resolved", False, "scalar", "Ann_Lee", sec(0)), ("u", "resolved", False, "scalar", "Ann", sec(50)), ("u", "resolved", True, "scalar", "seen", sec(0)), ("u", "denied", False, "scalar", "no", sec(0)), ("w", "resolved", False, "list", "Bo_b", sec(0))], "user_id string, status string, disclosed boolean, expect string, value string, ts timestamp")
    issued = leaks.issued_values(b)
    assert {(r.user_id, r.value) for r in issued.collect()} == {("u", "Ann_Lee"), ("u", "Ann\\_Lee"), ("u", "Ann"), ("w", "Bo_b")}
    assert {r.value for r in leaks.issued_values(b, 1).where("user_id = 'u'").collect()} == {"Ann"}
    m = spark.createDataFrame([(1, "u", "assistant", sec(60), "Ann_Lee, Ann and Annex"), (2, "u", "assistant", sec(100), "Ann_Lee and Ann"), (3, "u", "user", sec(60), "Ann"), (4, "x", "assistant", sec(60), "Ann"), (5, "u", "assistant", sec(99), "Ann_Lee")], "id int, user_id string, role string, ts timestamp, text string")
    got = {r.id: (r.masked, r.replaced) for r in leaks.remask_history(m, issued, 100, "#").collect()}
    assert got == {1: ("#, # and Annex", 2), 2: ("#_Lee and #", 2), 3: ("Ann", 0), 4: ("Ann", 0), 5: ("#", 1)}


def test_fill(spark):
    texts = spark.createDataFrame([("q", "Is {x1} and {x2} or {x9}; [EMAIL_1]")], "request_id string, text string")
    b = spark.createDataFrame([("q", "{x1}", "scalar", "resolved", "a*b"), ("q", "{x2}", "scalar", "denied", None)], "request_id string, name string, expect string, status string, value string")
    r = leaks.fill(texts, b).first()
    assert r.filled == "Is a\\*b and [denied] or [rejected]; [EMAIL_1]"
    assert "".join(r.filled[s.start : s.end] for s in r.spans) == r.filled and {r.filled[s.start : s.end] for s in r.spans if s.source == "gateway"} == {"a\\*b", "[denied]", "[rejected]"}
    vault = spark.createDataFrame([("q", "[EMAIL_1]", "x@y.zz")], "request_id string, token string, value string")
    assert leaks.fill(texts, b, vault).first().filled.endswith("x@y.zz")


def admitted(times, limit):
    held, out = [], []
    for t in times:
        held = [h for h in held if h > t - 60]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


def test_admission(spark):
    import random

    rng = random.Random(1)
    rows, want = [], {}
    for u in range(6):
        times = sorted(rng.randint(0, 400) for _ in range(10 * (u + 1)))
        for k, (t, ok) in enumerate(zip(times, admitted(times, 3), strict=True)):
            rows.append((u * 1000 + k, f"u{u}", sec(t)))
            want[u * 1000 + k] = ok
    frame = spark.createDataFrame(rows, "id long, user_id string, ts timestamp")
    for parts in (1, 7):
        assert {r.id: r.admitted for r in consumption.admission(frame.repartition(parts), 3).collect()} == want
    assert consumption.admission(frame.limit(0), 3).count() == 0


def test_budget_edges(spark):
    prices = spark.createDataFrame([("m", 1.0)], "model string, usd_per_1k double")
    limits = spark.createDataFrame([("default", 20_000, 100.0)], "role string, tokens_per_day long, cost_per_day_usd double")
    day = dt.datetime(2026, 1, 1, 23, 59, 59)
    calls = [(1, "u", "r", T0, "m", 50, 19_950), (2, "u", "r", sec(1), "m", 50, 0), (3, "u", "r", sec(2), "m", 51, 0), (4, "u", "r", day, "m", 51, 0), (5, "u", "r", day + dt.timedelta(seconds=1), "m", 20_000, 0), (6, "v", "r", T0, "m", 20_001, 0)]
    got = {r.id: r.verdict for r in consumption.budget_check(spark.createDataFrame(calls, "id int, user_id string, role string, ts timestamp, model string, estimate long, tokens long"), prices, limits).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block"}


def test_log_round_trip(spark, tmp_path):
    good = {"request_id": "a", "timestamp": "2026-01-02T00:00:00Z", "verdict": "block", "prompt_text": "=1+1", "total_latency_ms": 1.23456, "decisions": [{"stage": "s", "control": "c", "verdict": "block", "reason": "r", "latency_ms": 0.12345}]}
    lines = [json.dumps(good), "{not json", json.dumps({"request_id": "b"}), json.dumps(good | {"request_id": "c", "timestamp": "2026-01-03T00:00:00Z"}), json.dumps(good | {"request_id": "d", "timestamp": "never"})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = audit_log.read_audit(spark, str(tmp_path / "log.jsonl"))
    assert {r.request_id for r in log.collect()} == {"a", "c"}
    assert [r.request_id for r in audit_log.in_range(log, dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 3)).collect()] == ["a"]
    row = audit_log.csv_table(log).where("request_id = 'a'").first()
    assert len(row) == 21 and row.prompt_text == "'=1+1" and row.decisions == "s/c: block" and row.role == ""
    audit_log.write_audit(log.unionByName(log), str(tmp_path / "out"), "one", log_prompt_text=False)
    back = audit_log.read_audit(spark, str(tmp_path / "out"))
    assert back.count() == 2 and {r.prompt_text for r in back.collect()} == {None} and {r.total_latency_ms for r in back.collect()} == {1.235}


def test_nearest_rank_and_hour_edge(spark, sf):
    rows = spark.createDataFrame([("s", float(k)) for k in range(1, 21)], "step string, ms double")
    assert analytics.nearest_rank(rows, ["step"], "ms").first() == ("s", 20, 10.0, 19.0)
    log = spark.createDataFrame([("1", dt.datetime(2026, 1, 1, 10, 59, 59), "block"), ("2", dt.datetime(2026, 1, 1, 11, 1), "block")], "request_id string, ts timestamp, verdict string")
    grid = analytics.over_time(log, T0).collect()
    assert len(grid) == 60 and sum(r.blocks for r in grid) == 1 and grid[0].blocks == 1
    view = audit_view(spark, sf)
    assert analytics.latency_by_step_approx(view).count() == 3
    states = analytics.control_states(spark.createDataFrame([("a.b.c", "1", "file"), ("a.x", "1", "file"), ("z", "1", "file")], "control string, value string, source string"), spark.createDataFrame([("a.b",), ("z",)], "control string"))
    assert {r.control: r.status for r in states.collect()} == {"a.b.c": "off", "a.x": "on", "z": "off"}


def test_policy_tables(spark):
    tree = {
        "users": {"u": {"role": "r", "department": "d"}}, "roles": {"r": {"tables": {"T": {"scope": "all", "columns": ["a"]}}, "tools": {"mail": {"args": {"to": {"allow_pattern": "x"}}}}}},
        "data": {"tables": {"T": {"label": "internal", "columns": {"A": "sensitive"}}}}, "budgets": {"default": {"tokens_per_day": 5}, "roles": {"r": {"tokens_per_day": 9}}}, "pricing": {"m": 0.5},
    }
    got = {k: v.collect() for k, v in policy.policy_tables(spark, tree).items()}
    assert got["users"] == [("u", None, "r", "d", "deny")] and got["roles"] == [("r", "deny", "public")] and got["grants"] == [("r", "t", "all", "a")]
    assert got["labels"] == [("t", None, "internal"), ("t", "a", "sensitive")] and got["tool_labels"] == [("r", "mail", "public")] and got["prices"] == [("m", 0.5)]
    limits = analytics.effective_limits(spark.createDataFrame(got["limits"], "role string, key string, value double"), spark.createDataFrame([("r",), ("s",)], "role string"))
    assert {(r.role, r.value) for r in limits.collect()} == {("r", 9.0), ("s", 5.0)}
    frame = spark.createDataFrame([(1, "a|b")], "id int, v string")
    assert policy.shaped(frame, "row").first().value == "id: 1, v: a|b" and policy.shaped(frame.limit(0), "row").first().status == "empty"
    assert "a\\|b" in policy.shaped(frame, "list").first().value and policy.shaped(frame, "scalar").first().value == "1"
    with pytest.raises(KeyError):
        policy.column_values({"t": frame}, [("t", "nope")])


def test_protected_number_within_many_groups(spark):
    table = " ".join(["111"] * 40 + ["123", "456", "789", "012", "345"] + ["000"] * 40)
    texts = spark.createDataFrame([(1, "r", f"a {table} b"), (2, "r", " ".join(["111"] * 90)), (3, "r", " ".join(["000"] * 3000 + ["123", "456", "789", "012", "345"]))], "id long, role string, text string")
    index = spark.createDataFrame([("r", "123456789012345")], "role string, form string")
    assert sorted(r.id for r in leaks.find_protected(texts, index).collect()) == [1, 3]
    assert leaks.find_protected(texts, index.limit(0)).count() == 0
    every = {f for a in range(85) for b in range(a + 1, 86) for f in leaks.text_number_forms("".join(table.split(" ")[a:b]))}
    assert every <= leaks.token_forms(table)
    assert {f for f in every if len(f) <= 15} == {f for f in leaks.token_forms(table, 15) if len(f) <= 15}


def test_records_are_numbered_without_one_task(spark):
    rows = [(None if k % 50 == 0 else dt.datetime(2024, 1, 1 + k % 3, 5, k % 7, k % 11, k % 5 * 1000), str(k)) for k in range(400)]
    log = spark.createDataFrame(rows, "ts timestamp, request_id string")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = analytics.numbered(log)
    assert [r.request_id for r in got.orderBy("n").collect()] == [x for _, x in want]
    assert sorted(r.n for r in got.collect()) == list(range(1, 401))


def test_latency_by_kind_reads_the_whole_log(spark, tmp_path):
    from siftline.plans import audit_queries

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("ts >= '2024-01-03'").write.parquet(f"{tmp_path}/events.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.kind: r["count"] for r in audit_queries.QUERIES["a15_latency_by_kind"](spark, str(tmp_path)).collect()}
    late = spark.read.parquet(f"{tmp_path}/events.parquet").count()
    assert late > 0 and got["all"] == items.where(F.col("item_id") < late).count()
