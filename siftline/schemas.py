"""Schemas of the records that the jobs read and write."""

DECISION = "struct<stage:string,control:string,verdict:string,reason:string,latency_ms:double>"
BINDING = (
    "struct<name:string,sql:string,purpose:string,status:string,label:string,disclosed:boolean,reason:string,"
    "tables:array<string>,columns:array<string>,rows:int,truncated:boolean,latency_ms:double>"
)
TOOL_DECISION = "struct<tool:string,verdict:string,rule:string,reason:string>"
#: One row per request. Lists keep the order in which things happened.
AUDIT = (
    "request_id string, timestamp string, policy_version string, feed_version string, verdict string, user_id string, role string, department string, "
    f"ai_data_policy string, answer_model string, judge_model string, decisions array<{DECISION}>, bindings array<{BINDING}>, tool_decisions array<{TOOL_DECISION}>, "
    "tool_iterations int, disabled_controls array<string>, prompt_tokens bigint, completion_tokens bigint, judge_tokens bigint, cost_usd double, "
    "step_latency_ms map<string,double>, total_latency_ms double, prompt_text string"
)
SIGNATURE = "struct<id:string,category:string,severity:string,applies_to:array<string>,type:string,pattern:string,reference:string>"
FEED = f"version string, source string, sha256 string, signatures array<{SIGNATURE}>"
MESSAGE = (
    "request_id string, user_id string, ts timestamp, turn int, role string, content string, parts array<struct<type:string,text:string>>, name string, "
    "tool_call_id string, tool_calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
)
