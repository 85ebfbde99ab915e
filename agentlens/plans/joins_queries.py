"""Queries of joins and of test-outcome sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlens.operators import joins
from agentlens.plans.registry import query

D = "v_decisions"
OUT = "o AS (SELECT CAST(c_custkey AS VARCHAR) AS task_id, CASE WHEN c_custkey%2=0 THEN 1 ELSE 0 END AS s, CAST(c_custkey AS DOUBLE)/2000 AS r FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"


@query("j01_attach_outcomes", D + " customer", f"WITH {OUT}, l AS (SELECT task_id, max(id) AS id FROM v_decisions WHERE user_id % 10<>0 GROUP BY task_id), d AS (SELECT v.id, v.success, v.reward, CASE WHEN user_id%10=0 THEN NULL ELSE v.task_id END AS t FROM v_decisions v) SELECT d.id, CASE WHEN l.id IS NOT NULL AND o.s IS NOT NULL THEN o.s ELSE d.success END AS success, round(CASE WHEN l.id IS NOT NULL AND o.s IS NOT NULL THEN o.r ELSE d.reward END,6) AS reward FROM d LEFT JOIN l ON l.id=d.id LEFT JOIN o ON o.task_id=l.task_id")
def attach_outcomes(d, c):
    d = d.withColumn("task_id", F.when(F.col("user_id") % 10 != 0, F.col("task_id")))
    o = c.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").cast("string").alias("task_id"), (1 - F.col("c_custkey") % 2).cast("int").alias("success"), (F.col("c_custkey") / 2000).alias("reward"))
    return joins.attach_outcomes(d, o).select("id", "success", "reward")


@query("j02_attach_implicit", D, "WITH l AS (SELECT task_id, max(id) AS id FROM v_decisions WHERE success IS NULL GROUP BY task_id) SELECT v.id, CASE WHEN l.id IS NOT NULL AND v.selected_agent='agent' || (v.user_id % 4) THEN 0.6::DOUBLE END AS implicit FROM v_decisions v LEFT JOIN l ON l.id=v.id")
def attach_implicit(d):
    labels = d.select("task_id", F.concat(F.lit("agent"), (F.col("user_id") % 4).cast("string")).alias("agent"), F.lit(0.6).alias("label")).distinct()
    return joins.attach_implicit(d, labels).select("id", "implicit")


@query("j03_latest_decision", D, "SELECT task_id, max(id) AS id, arg_max(selected_agent, id) AS selected_agent FROM v_decisions GROUP BY task_id")
def latest_decision(d):
    return joins.latest_decision(d).select("task_id", "id", "selected_agent")


@query("j04_metrics_of_run", "v_task_metrics orders", "SELECT agent_name, count(*) AS n FROM v_task_metrics WHERE task_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='F') GROUP BY agent_name")
def of_run(m, o):
    return joins.of_run(m, o.withColumnRenamed("o_orderkey", "task_id"), F.col("o_orderstatus") == "F").groupBy("agent_name").agg(F.count(F.lit(1)).alias("n"))


PRICES = [("model", 1.0, 2.0, 0.1), ("model-R", 3.0, 15.0, 0.3), ("other", 9.0, 9.0, 0.9)]
PRICE_SQL = "p AS (SELECT * FROM (VALUES ('model',1.0::DOUBLE,2.0::DOUBLE),('model-R',3.0,15.0),('other',9.0,9.0)) v(known,i,o))"


def _prices(df):
    return df.sparkSession.createDataFrame(PRICES, "known string, input double, output double, cache_read double")


@query("j08_price_rows", "v_cost_ledger", f"WITH {PRICE_SQL}, m AS (SELECT DISTINCT CASE WHEN model='model-A' THEN 'zzz' ELSE model || '-x' END AS model FROM v_cost_ledger) SELECT model, coalesce((SELECT known FROM p WHERE starts_with(m.model, known) ORDER BY length(known) DESC LIMIT 1), 'other') AS known FROM m")
def price_rows(c):
    m = c.select(F.when(F.col("model") == "model-A", "zzz").otherwise(F.concat("model", F.lit("-x"))).alias("model"))
    return joins.price_rows(m, _prices(c), "other").select("model", "known")


@query("p19_token_cost", "v_cost_ledger", f"WITH {PRICE_SQL} SELECT model, round(sum(CASE WHEN mission_id%2=0 THEN cost_usd ELSE round((input_tokens*i+output_tokens*o)/1000000,6) END),4) AS cost FROM v_cost_ledger JOIN p ON known=CASE WHEN model='model-R' THEN 'model-R' ELSE 'model' END GROUP BY model", 4)
def token_cost(c):
    return joins.costed(c.withColumn("cost_usd", F.when(F.col("mission_id") % 2 == 0, F.col("cost_usd"))), _prices(c), "other").groupBy("model").agg(F.sum("cost").alias("cost"))


LOWER = "WITH u AS (SELECT p_type AS vendor, p_partkey AS plan, CAST(p_size AS INTEGER) AS capacity, p_retailprice AS price, p_partkey%3<>0 AS verified FROM part) SELECT a.vendor, a.plan, a.capacity, (SELECT b.plan FROM u b WHERE b.vendor=a.vendor AND b.capacity<a.capacity AND b.verified ORDER BY b.capacity DESC, b.plan DESC LIMIT 1) AS lower, (SELECT round(b.price,6) FROM u b WHERE b.vendor=a.vendor AND b.capacity<a.capacity AND b.verified ORDER BY b.capacity DESC, b.plan DESC LIMIT 1) AS lower_price FROM u a"


@query("j09_lower_plan", "part", LOWER)
def lower_plan(p):
    return joins.lower_plan(p.select(F.col("p_type").alias("vendor"), F.col("p_partkey").alias("plan"), F.col("p_size").cast("int").alias("capacity"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 3 != 0).alias("verified")))


@query("p20_under_budget", "v_cases", "WITH a AS (SELECT case_id, 'cloud' AS agent, cloud_cost AS cost FROM v_cases UNION ALL SELECT case_id, 'mid', cloud_cost/2 FROM v_cases), m AS (SELECT *, min(cost) OVER (PARTITION BY case_id) AS lo FROM a) SELECT agent, count(*) AS n FROM m WHERE cost<=0.05 OR (lo>0.05 AND cost=lo) GROUP BY agent")
def under_budget(c):
    a = c.select("case_id", F.lit("cloud").alias("agent"), F.col("cloud_cost").alias("cost")).unionByName(c.select("case_id", F.lit("mid").alias("agent"), (F.col("cloud_cost") / 2).alias("cost")))
    return joins.under_budget(a, "case_id", 0.05).groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


@query("p22_served", "v_cases", "SELECT case_id, coalesce(NOT judge_verdict,false) AS escalated, CASE WHEN judge_verdict=false THEN cloud_passed ELSE local_passed END AS final_passed, round(0.001+CASE WHEN judge_verdict=false THEN cloud_cost ELSE 0 END,9) AS total_cost FROM v_cases", 9)
def served(c):
    return joins.served(c.withColumn("judge_cost", F.lit(0.001))).select("case_id", "escalated", "final_passed", "total_cost")


BANK = "b AS (SELECT DISTINCT prompt, length(prompt) AS size FROM v_results WHERE bucket='research')"


@query("j06_with_bank", "v_results", f"WITH {BANK} SELECT agent, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM v_results JOIN b USING (prompt) GROUP BY agent")
def with_bank(r):
    bank = r.filter("bucket = 'research'").select("prompt", F.length("prompt").alias("size")).distinct()
    return joins.with_bank(r, bank).groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("j06_unmatched", "v_results", f"WITH {BANK} SELECT count(*) AS n FROM v_results WHERE prompt NOT IN (SELECT prompt FROM b)")
def unmatched(r):
    return joins.unmatched_results(r, r.filter("bucket = 'research'").select("prompt").distinct()).agg(F.count(F.lit(1)).alias("n"))


@query("j12_cloud_costs", "v_task_metrics orders", "SELECT task_id, round(avg(cost_usd),9) AS cost FROM v_task_metrics WHERE agent_name='cloud:a' AND task_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='F') GROUP BY task_id", 9)
def cloud_costs(m, o):
    return joins.cloud_costs(o.withColumnRenamed("o_orderkey", "task_id"), m, F.col("o_orderstatus") == "F", "cloud:a")


MATRIX = "x AS (SELECT id, CAST(user_id*10+k%7 AS VARCHAR) AS prompt, selected_agent AS agent, CASE WHEN id%4=0 THEN NULL ELSE latency_s END AS latency_s FROM v_decisions), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt, agent ORDER BY latency_s IS NULL, id) AS rn FROM x) WHERE rn=1), w AS (SELECT prompt FROM o GROUP BY prompt HAVING count(*)=(SELECT count(DISTINCT agent) FROM o)), f AS (SELECT *, avg(latency_s) OVER (PARTITION BY agent) AS m FROM o WHERE prompt IN (SELECT prompt FROM w))"


@query("j13_full_matrix", D, f"WITH {MATRIX} SELECT agent, prompt, id, round(coalesce(latency_s,m),6) AS latency_s FROM f")
def full_matrix(d):
    x = d.select("id", (F.col("user_id") * 10 + F.col("k") % 7).cast("string").alias("prompt"), F.col("selected_agent").alias("agent"), F.when(F.col("id") % 4 != 0, F.col("latency_s")).alias("latency_s"))
    return joins.full_matrix(x).select("agent", "prompt", "id", "latency_s")


@query("j14_schedule", "v_results", "SELECT a AS agent, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS INTEGER) AS last FROM (SELECT DISTINCT prompt FROM v_results), (SELECT unnest(['x','y']) AS a), range(1,4) GROUP BY a")
def schedule(r):
    return joins.schedule(r.select("prompt").distinct(), ["x", "y"], 3, 7).groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))


NUMSTAT = "n AS (SELECT * FROM (SELECT l_orderkey AS sha, 1+(l_orderkey%5=0)::INTEGER AS parents, min(l_shipdate) OVER (PARTITION BY l_orderkey) AS committed, CASE l_linenumber WHEN 2 THEN 'test_module' WHEN 6 THEN 'test_module' WHEN 5 THEN 'test_file' WHEN 3 THEN 'text' ELSE 'source' END AS kind, CAST(l_quantity AS BIGINT) AS lines FROM lineitem) WHERE lines<>13)"


@query("p17_candidate_commits", "lineitem", f"WITH {NUMSTAT}, g AS (SELECT sha, committed, max(parents) AS parents, bool_or(kind='test_module') AS t, CAST(sum(CASE WHEN kind='source' THEN lines ELSE 0 END) AS BIGINT) AS src_lines FROM n GROUP BY sha, committed) SELECT sha, src_lines FROM g WHERE parents=1 AND t AND src_lines BETWEEN 1 AND 60 ORDER BY committed DESC, sha LIMIT 500")
def candidate_commits(li):
    first = li.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("committed"))
    path = F.element_at(F.array(*map(F.lit, ["src/a.py", "tests/test_a.py", "doc/x.md", "pkg/tests/helper.py", "pkg/conftest.py", "test/tests_b.py", "tests_c.py"])), F.col("l_linenumber").cast("int"))
    rows = li.join(first, "l_orderkey").select(F.col("l_orderkey").alias("sha"), (1 + (F.col("l_orderkey") % 5 == 0).cast("int")).alias("parents"), "committed", path.alias("path"), F.when(F.col("l_quantity") != 13, F.col("l_quantity")).cast("long").alias("lines"))
    return joins.candidate_commits(rows, 60, 500).select("sha", "src_lines")


RUNS = "r AS (SELECT l_suppkey AS task, CASE l_linenumber%3 WHEN 0 THEN 'base' WHEN 1 THEN 'commit' ELSE 'fix' END AS phase, l_partkey%40 AS test, CASE l_linenumber%3 WHEN 1 THEN true WHEN 0 THEN l_partkey%3=0 ELSE l_orderkey%9<>0 END AS passed FROM lineitem), s AS (SELECT task, phase, test, count(*) AS runs, count(*) FILTER (WHERE passed) AS passes FROM r GROUP BY ALL)"


def _runs(li):
    phase = F.when(F.col("l_linenumber") % 3 == 0, "base").when(F.col("l_linenumber") % 3 == 1, "commit").otherwise("fix")
    ok = F.when(F.col("l_linenumber") % 3 == 1, True).when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey") % 3 == 0).otherwise(F.col("l_orderkey") % 9 != 0)
    return li.select(F.col("l_suppkey").alias("task"), phase.alias("phase"), (F.col("l_partkey") % 40).alias("test"), ok.alias("passed"))


@query("u01_steady", "lineitem", f"WITH {RUNS} SELECT task, phase, test, runs, passes, runs=passes AS steady, passes>0 AND passes<runs AS flaky FROM s")
def steady(li):
    return joins.steady(_runs(li))


@query("u02_gate_sets", "lineitem", f"WITH {RUNS}, t AS (SELECT task, test, bool_or(phase='commit' AND runs=passes) AS c, bool_or(phase='base' AND runs=passes) AS b, bool_or(phase='fix' AND runs=passes) AS x, bool_or(passes>0 AND passes<runs) AS f FROM s GROUP BY ALL), g AS (SELECT task, count(*) FILTER (WHERE c AND NOT b AND NOT f) AS f2p, count(*) FILTER (WHERE b AND x) AS p2p, count(*) FILTER (WHERE f) AS flaky, count(*) FILTER (WHERE c AND NOT x AND NOT f) AS gold_fails FROM t GROUP BY task) SELECT *, CASE WHEN f2p=0 THEN 'no failing test' WHEN gold_fails>0 THEN 'fix fails' WHEN p2p=0 THEN 'nothing passes' END AS dropped FROM g")
def gate_sets(li):
    return joins.gate_sets(_runs(li)).drop("f2p_tests")


@query("u03_grade", "lineitem", "WITH e AS (SELECT l_suppkey AS task, l_partkey%40 AS test, CASE WHEN l_partkey%40<10 THEN 'f2p' ELSE 'p2p' END AS kind FROM lineitem GROUP BY ALL), o AS (SELECT l_suppkey AS task, l_partkey%40 AS test, bool_and(l_discount<0.1) AS ok FROM lineitem WHERE l_returnflag='R' AND l_quantity>=25 GROUP BY ALL), j AS (SELECT e.*, coalesce(ok,false) AS ok FROM e LEFT JOIN o USING (task,test)) SELECT task, count(*) FILTER (WHERE kind='f2p') AS f2p_total, count(*) FILTER (WHERE kind='f2p' AND ok) AS f2p_pass, count(*) FILTER (WHERE kind='p2p' AND NOT ok) AS regressions, count(*) FILTER (WHERE kind='f2p')=count(*) FILTER (WHERE kind='f2p' AND ok) AND count(*) FILTER (WHERE kind='p2p' AND NOT ok)=0 AND task IN (SELECT task FROM o) AS resolved FROM j GROUP BY task")
def grade(li):
    t, x = F.col("l_suppkey").alias("task"), (F.col("l_partkey") % 40).alias("test")
    expected = li.select(t, x).distinct().withColumn("kind", F.when(F.col("test") < 10, "f2p").otherwise("p2p"))
    return joins.grade(expected, li.filter("l_returnflag = 'R' AND l_quantity >= 25").select(t, x, (F.col("l_discount") < 0.1).alias("passed"))).drop("first")


@query("u04_live_only", "lineitem", "SELECT count(*) AS n, count(extra) AS extras FROM (SELECT l_suppkey AS task, NULL AS extra FROM lineitem UNION ALL SELECT l_suppkey, 1 FROM lineitem WHERE l_linenumber=1) WHERE task IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag='R' AND l_quantity>=45)")
def live_only(li):
    a = li.select(F.col("l_suppkey").alias("task"))
    b = li.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("task"), F.lit(1).alias("extra"))
    return joins.live_only([a, b], li.filter("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_suppkey").alias("task"))).agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("extras"))
