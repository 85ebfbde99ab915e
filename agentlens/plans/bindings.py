"""The library's record sets as views of the test tables: the same columns in Spark and, as text, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_attempts": """
SELECT p.p_brand AS repo, lpad(CAST(l_partkey AS VARCHAR(20)),8,'0') AS sha,
 'arm' || CAST(l_suppkey % 5 AS VARCHAR(20)) AS arm, CASE WHEN l_linestatus='O' THEN 'blind' ELSE 'feedback' END AS cond,
 l_linenumber AS rep, l_orderkey AS run_key, (l_returnflag='R') AS resolved, l_quantity*60 AS secs,
 (l_quantity>=45 AND l_returnflag<>'R') AS timed_out, CAST(CASE WHEN l_orderkey % 2=0 THEN 2700 ELSE 5400 END AS DOUBLE) AS limit_s,
 CASE WHEN l_suppkey % 5=0 THEN l_extendedprice/100000 END AS cost_usd, l_shipdate AS committed,
 'm' || CAST((l_suppkey % 5) % 2 AS VARCHAR(20)) AS machine
 FROM lineitem JOIN part p ON p.p_partkey=l_partkey""",
    "v_decisions": """
SELECT event_id AS id, ts, CAST(user_id AS VARCHAR(20)) AS task_id,
 'b' || CAST(user_id % 9 AS VARCHAR(20)) AS bucket, 'agent' || CAST(event_id % 4 AS VARCHAR(20)) AS selected_agent,
 'agent' || CAST(event_id % 3 AS VARCHAR(20)) AS bandit_pick, CASE WHEN event_type='view' THEN NULL WHEN event_type='error' THEN 0 ELSE 1 END AS success,
 CASE WHEN event_type='view' THEN NULL ELSE least(value/100, CAST(1 AS DOUBLE)) END AS reward, value/10 AS latency_s,
 CASE WHEN event_type='purchase' THEN value/1000 ELSE CAST(0 AS DOUBLE) END AS cost_usd,
 CAST(CASE WHEN event_type='click' THEN 1 WHEN event_type='error' THEN 0 END AS DOUBLE) AS correctness,
 CASE WHEN event_type='purchase' THEN 'cloud' END AS escalated_to, CAST({k} AS INTEGER) AS k,
 CASE WHEN event_id % 2=0 THEN 'linucb' ELSE 'static' END AS strategy, event_type, user_id
 FROM events""",
    "v_task_metrics": """
SELECT l_orderkey AS task_id, CASE WHEN l_suppkey % 3=0 THEN 'cloud:a' ELSE 'local:m' || CAST(l_suppkey % 3 AS VARCHAR(20)) END AS agent_name,
 p.p_type AS capability_bucket, l_quantity*1000 AS wall_time_ms, CAST(floor(l_extendedprice/100) AS BIGINT) AS tokens_generated,
 CAST(l_quantity*10 AS BIGINT) AS prompt_tokens, CASE WHEN l_returnflag='N' THEN NULL WHEN l_returnflag='R' THEN 1 ELSE 0 END AS success,
 1-l_discount*5 AS quality_score, l_tax*10 AS reward_score, CASE WHEN l_suppkey % 3=0 THEN l_extendedprice/100000 ELSE CAST(0 AS DOUBLE) END AS cost_usd, l_shipdate AS ts,
 l_orderkey * 10 + l_linenumber AS id
 FROM lineitem JOIN part p ON p.p_partkey=l_partkey""",
    "v_cost_ledger": """
SELECT o_custkey AS user_id, o_orderkey AS mission_id, 'model-' || l_returnflag AS model, CAST(l_quantity*100 AS BIGINT) AS input_tokens,
 CAST(l_quantity*20 AS BIGINT) AS output_tokens, l_extendedprice/100000 AS cost_usd, o_orderdate AS created_at
 FROM orders JOIN lineitem ON l_orderkey=o_orderkey""",
    "v_results": """
SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS output, 'agent' || CAST(u.conv_id % 3 AS VARCHAR(20)) AS agent, CASE WHEN u.conv_id % 2=0 THEN 'research' ELSE 'plan' END AS bucket
 FROM conversations u JOIN conversations a ON a.conv_id=u.conv_id AND a.turn=u.turn+1 AND u.role='user' AND a.role='assistant'""",
    "v_cases": """
SELECT o_orderkey AS case_id, (o_orderstatus='F') AS local_passed, (o_orderpriority<>'5-LOW') AS cloud_passed,
 CASE WHEN o_orderkey % 11=0 THEN NULL ELSE (o_orderkey % 3=0) END AS judge_verdict, o_totalprice/1000000 AS cloud_cost FROM orders""",
    "v_episodes": """
SELECT vec_id, embedding, 'agent' || CAST(vec_id % 4 AS VARCHAR(20)) AS agent, CAST(label AS DOUBLE)/10 AS reward FROM embeddings""",
    "v_verdicts": "SELECT doc_id, quality, toxic FROM labels",
}
JSON_K = {"spark": "get_json_object(props,'$.k')", "duckdb": "json_extract_string(props,'$.k')"}


def sql_text(name: str, engine: str) -> str:
    return VIEWS[name].replace("{k}", JSON_K[engine])


def _tables(text: str) -> list[str]:
    known = ("lineitem", "part", "orders", "events", "conversations", "embeddings", "labels")
    return [t for t in known if f"FROM {t}" in text or f"JOIN {t}" in text]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = sql_text(name, "spark")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(text)}
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text.replace("VARCHAR(20)", "STRING"), **frames)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL with the named views as common table expressions before ``body``, which may begin with more."""
    views = ", ".join(f"{n} AS ({sql_text(n, 'duckdb')})" for n in names)
    body = body.strip()
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"
