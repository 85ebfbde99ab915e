"""Sources and streams as queries: streams read the events table as a growing folder and run to its end."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from agentlens.operators import observe
from agentlens.plans import bindings, decisions_queries, learning_queries  # noqa: F401  the oracles of their batch twins
from agentlens.plans.registry import ORACLES, QUERIES, query
from agentlens.sources import logs
from agentlens.sources.paths import shared_path
from agentlens.streaming import trackers

D = "v_decisions"


def _stream(spark, sf_dir: str):
    """The decision log as a stream of the events table."""
    path = f"{sf_dir}/events.parquet"
    # A file source wants a folder or a pattern; this pattern names the table alone, be it a file or a folder.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
    text = bindings.sql_text("v_decisions", "spark").replace("VARCHAR(20)", "STRING").replace("FROM events", "FROM {events}")
    return spark.sql(text, events=events).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_query(name: str, oracle_of: str | None, sql: str | None = None, digits: int = 6):
    def wrap(f):
        def run(spark, sf_dir: str):
            out = f(_stream(spark, sf_dir))
            return out.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        QUERIES[name] = run
        if oracle_of or sql:
            ORACLES[name] = re.sub(r",\d+\) AS", f",{digits}) AS", ORACLES[oracle_of]) if oracle_of else bindings.oracle(sql, D)
        return f

    return wrap


@stream_query("t01_funnel_by_day", None, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (WHERE event_type='purchase') AS delegated, count(*) FILTER (WHERE event_type<>'purchase' AND k%3<>1) AS candidates FROM v_decisions GROUP BY 1")
def funnel_by_day(d):
    e = d.select("ts", F.when(F.col("event_type") == "purchase", "delegated").otherwise("inline").alias("event"), (F.col("k") % 3 != 1).alias("candidate"))
    return trackers.run_to_table(trackers.funnel_by_day(e), "complete").withColumn("day", F.col("day").cast("timestamp_ntz"))


@stream_query("t02_machine_state", None, "WITH s AS (SELECT latency_s*10 AS c, date_trunc('hour', ts) + INTERVAL 10 MINUTE * (extract('minute' FROM ts)::INTEGER // 10) - INTERVAL 10 MINUTE * i AS start FROM v_decisions, range(0,6) t(i)) SELECT start::TIMESTAMP AS start, count(*) AS samples, round(avg(c),6) AS cpu_avg, round(avg((c>=80)::INT::DOUBLE),6) AS hot_share, CASE WHEN avg((c>=80)::INT::DOUBLE)>=0.2 THEN 'strained' ELSE 'fine' END AS level FROM s GROUP BY start")
def machine_state(d):
    s = d.select("ts", (F.col("latency_s") * 10).alias("cpu_percent"))
    return trackers.run_to_table(trackers.machine_state(s), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@stream_query("t03_retry_tracker", "w08_retry_signal")
def retry_tracker(d):
    kind = F.when(F.col("event_type").isin("purchase", "error"), "complete").otherwise("submit")
    e = d.select(F.col("user_id").cast("long").alias("user_id"), "id", "ts", kind.alias("kind"), (F.col("k") % 3).alias("hash"), F.col("event_type").alias("task_id"))
    return trackers.run_to_table(trackers.retry_tracker(e, 30000, 60000))


@stream_query("t04_drift_tracker", "w03_drift_alerts", digits=9)
def drift_tracker(d):
    return trackers.run_to_table(trackers.drift_tracker(d, sigma=0.2))


@stream_query("t05_quarantine_tracker", None)
def quarantine_tracker(d):
    return trackers.run_to_table(trackers.quarantine_tracker(learning_queries.quarantine_events(d)))


@stream_query("t06_budget_tracker", "w04_budget_pacer", digits=12)
def budget_tracker(d):
    return trackers.run_to_table(trackers.budget_tracker(d, 0.012, "bucket"))


@stream_query("t07_cap_tracker", "w09_daily_cap")
def cap_tracker(d):
    return trackers.run_to_table(trackers.cap_tracker(d.filter("escalated_to IS NOT NULL").select("id", "ts"))).groupBy("passes").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@stream_query("j01_outcome_stream", None, "WITH o AS (SELECT id AS outcome_id, task_id, ts FROM v_decisions WHERE event_type='purchase'), d AS (SELECT id, task_id, ts FROM v_decisions WHERE event_type<>'purchase') SELECT outcome_id, max_by(d.id, (d.ts, d.id)) AS decision_id FROM o JOIN d ON d.task_id=o.task_id AND d.ts<=o.ts AND d.ts>=o.ts - INTERVAL 6 HOUR GROUP BY outcome_id")
def outcome_stream(d):
    bought = F.col("event_type") == "purchase"
    # Marks of no task, long after: with them the watermark passes all that is there, as it does on a log that goes on.
    mark = lambda of: d.filter("event_type = 'error'").select("id", F.lit(f"no task of {of}").alias("task_id"), (F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
    decisions = d.filter(~bought).select("id", "task_id", "ts").unionByName(mark("decisions"))
    outcomes = d.filter(bought).select("id", "task_id", "ts").unionByName(mark("outcomes")).withColumnRenamed("id", "outcome_id")
    return trackers.run_to_table(trackers.outcomes_attached(decisions, outcomes, "6 hours")).select("outcome_id", "decision_id")


@stream_query("t08_ingest_once", None, "SELECT id, event_type FROM v_decisions")
def ingest_once(d):
    again = d.filter("k % 5 = 0")
    events = d.unionByName(again).select(F.col("id").alias("event_id"), "ts", "event_type")
    return trackers.run_to_table(trackers.once(events)).select(F.col("event_id").alias("id"), "event_type")


@query("a27_session_sketches", D, "SELECT bucket, count(DISTINCT task_id) AS sessions, count(DISTINCT CAST(ts AS DATE)) AS days, true AS near FROM v_decisions GROUP BY bucket")
def session_sketches(d):
    days = observe.daily_sketches(d.withColumn("day", F.to_date("ts")), ["bucket", "day"], "task_id")
    exact = d.groupBy("bucket").agg(F.count_distinct("task_id").alias("sessions"))
    merged = observe.merged_distinct(days, ["bucket"], "sketched").join(days.groupBy("bucket").agg(F.count(F.lit(1)).alias("days")), "bucket")
    return exact.join(merged, "bucket").select("bucket", "sessions", "days", (F.abs(F.col("sketched") - F.col("sessions")) <= F.greatest(F.lit(1.0), 4 * observe.SKETCH_ERROR * F.col("sessions"))).alias("near"))


@query("s06_markdown", "documents", "SELECT CASE WHEN doc_id%4=0 THEN 'Head ' || doc_id ELSE (CASE WHEN doc_id%2=0 THEN '2024-05-0' || (1+doc_id%9) || '-' ELSE '' END) || 'd' || doc_id END AS title, CASE WHEN doc_id%2=0 THEN '2024-05-0' || (1+doc_id%9) ELSE '' END AS date, CASE WHEN doc_id%3=0 THEN '' ELSE coalesce(lang,'und') END AS kind, length(text) + CASE WHEN doc_id%4=0 THEN length('# Head ' || doc_id) + 3 ELSE 0 END AS n_chars FROM documents WHERE (doc_id%4=0 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') AND NOT regexp_matches(text, '(^|\\n)#\\s')")
def markdown(docs):
    path = shared_path(docs.sparkSession, "notes")
    n = F.col("doc_id").cast("string")
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.coalesce("lang", F.lit("und")), F.lit("/"))), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2024-05-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("-"))).otherwise(""), F.lit("d"), n, F.lit(".md"))
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("# Head "), n, F.lit(" \n\n"), "text")).otherwise(F.col("text"))
    logs.write_files(docs.filter(~F.col("text").rlike(r"(^|\n)#\s")).select(name.alias("name"), body.alias("body")), path)
    return logs.markdown_corpus(docs.sparkSession, path).select("title", "date", "kind", F.length("body").cast("long").alias("n_chars"))


@query("s03_attempt_files", "customer", "SELECT c_mktsegment AS arm, count(*) FILTER (WHERE c_acctbal>=0) AS n, round(sum(CASE WHEN c_nationkey>=5 THEN c_acctbal/100 ELSE 0 END) FILTER (WHERE c_acctbal>=0),4) AS cost, count(*) FILTER (WHERE c_acctbal<0) AS torn FROM customer GROUP BY 1", 4)
def attempt_files(c):
    path = shared_path(c.sparkSession, "attempt-files")
    whole = F.to_json(F.struct(F.lit("r").alias("repo"), F.col("c_mktsegment").alias("arm"), F.when(F.col("c_nationkey") >= 5, F.col("c_acctbal") / 100).alias("cost_usd"), F.lit("x").alias("unknown")))
    # Rows are short and each makes a file, so they are dealt to all cores, however few parts the table has.
    c = c.repartition(4 * c.sparkSession.sparkContext.defaultParallelism)
    # A negative balance stands for an attempt whose file was cut off.
    logs.write_files(c.withColumn("whole", whole).select(F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("name"), F.when(F.col("c_acctbal") < 0, F.expr("substring(whole, 1, length(whole) - 7)")).otherwise(F.col("whole")).alias("body")), path)
    rows = logs.attempt_files(c.sparkSession, path, "arm string, cost_usd double, tier string", {"cost_usd": 0.0})
    arm = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return rows.groupBy(arm.alias("arm")).agg(F.count_if(~F.col("torn")).alias("n"), F.sum(F.when(~F.col("torn"), F.col("cost_usd"))).alias("cost"), F.count_if("torn").alias("torn"))


@query("s01_decision_log", "events", "SELECT event_id AS id, 1.0::DOUBLE AS importance_weight, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS k FROM events")
def decision_log(e):
    rows = e.select(F.col("event_id").alias("id"), "ts", F.col("props").alias("predictions"))
    return logs.decision_log(rows).select("id", "importance_weight", F.try_element_at("predictions", F.lit("k")).alias("k"))


@query("s02_jsonl", D, "SELECT id, selected_agent AS agent, round(latency_s,6) AS latency_s FROM v_decisions WHERE id%10<>0")
def jsonl(d):
    line = F.to_json(F.struct("id", F.when(F.col("id") % 2 == 0, F.col("selected_agent")).alias("actual_agent"), F.when(F.col("id") % 2 == 1, F.col("selected_agent")).alias("requested_agent"), "latency_s"))
    torn = F.when(F.col("id") % 20 == 0, F.lit("# a comment")).when(F.col("id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line)
    path = shared_path(d.sparkSession, "jsonl")
    d.select(torn.alias("value")).write.text(path)
    return logs.read_jsonl(d.sparkSession, path, "id long, actual_agent string, agent string, requested_agent string, latency_s double").select("id", logs.result_agent().alias("agent"), "latency_s")


@query("s03_attempts", "v_attempts", "SELECT arm, count(*) AS n, count(*) FILTER (WHERE rep=2) AS second, round(sum(coalesce(cost_usd,0)),3) AS cost FROM v_attempts GROUP BY arm", 3)
def attempts(a):
    path = shared_path(a.sparkSession, "attempts")
    a.select("repo", "sha", "arm", "rep", "resolved", "cost_usd", F.lit("x").alias("unknown")).write.json(path)
    # One file for each attempt in life; here a file for each partition, so lines are read one by one.
    rows = logs.attempts(a.sparkSession, path, "arm string, rep int, resolved boolean, cost_usd double, tier string", {"cost_usd": 0.0, "tier": "test-verified"}, multi_line=False)
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rep") == 2).alias("second"), F.sum("cost_usd").alias("cost"))


@query("s04_export_rows", "v_attempts", "SELECT arm, cond, sha, rep, repo, 'm' || (run_key%3) AS host FROM v_attempts WHERE (repo, sha) IN (SELECT (repo, sha) FROM v_attempts WHERE resolved)")
def export_rows(a):
    rows = a.withColumn("run_id", F.col("run_key") % 3).drop("committed")
    tasks = a.filter("resolved").groupBy("repo", "sha").agg(F.min("committed").alias("committed"))
    runs = rows.select("run_id").distinct().withColumn("host", F.concat(F.lit("m"), F.col("run_id").cast("string")))
    return logs.export_rows(rows, tasks, runs).select("arm", "cond", "sha", "rep", "repo", "host")


@query("s05_csv", D, "SELECT CAST(id AS VARCHAR) AS id, coalesce(printf('%.4f', reward),'') AS reward, printf('%.3f', latency_s) AS latency_s, coalesce(escalated_to,'') AS escalated_to FROM v_decisions")
def csv(d):
    path = shared_path(d.sparkSession, "csv")
    logs.write_csv(d.select("id", "reward", "latency_s", "escalated_to"), path, {"reward": "%.4f", "latency_s": "%.3f"})
    back = d.sparkSession.read.option("header", True).schema("id string, reward string, latency_s string, escalated_to string").csv(path)
    return back.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("reward", "latency_s", "escalated_to")])


@query("s07_replace_scope", D, "SELECT bucket AS scope_value, selected_agent AS agent, CASE WHEN bucket='b1' THEN 2 ELSE 1 END AS version, count(*) AS n FROM v_decisions GROUP BY ALL")
def replace_scope(d):
    path = shared_path(d.sparkSession, "rankings")
    g = d.groupBy(F.col("bucket").alias("scope_value"), F.col("selected_agent").alias("agent")).agg(F.count(F.lit(1)).alias("n")).withColumn("scope_type", F.lit("bucket"))
    logs.replace_scope(g.withColumn("version", F.lit(1)), path)
    logs.replace_scope(g.filter("scope_value = 'b1'").withColumn("version", F.lit(2)), path)
    return d.sparkSession.read.parquet(path).select("scope_value", "agent", "version", "n")


@query("s08_run_ledger", "orders", "SELECT o_orderkey AS run_id, o_orderstatus AS mode FROM orders WHERE o_orderstatus='F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def run_ledger(o):
    path = shared_path(o.sparkSession, "runs")
    rows = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("mode"), F.col("o_orderdate").alias("started"))
    for status in ("F", "O", "P"):
        logs.log_run(rows.filter(F.col("mode") == status), path)
    return logs.newest_runs(o.sparkSession, path, "F", 20).select("run_id", "mode")

