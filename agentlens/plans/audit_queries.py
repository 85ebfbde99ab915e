"""Queries over attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlens.functions.stats import half_up, time_bound, wilson, wilson_ranking
from agentlens.operators import audit
from agentlens.plans.registry import query

#: Wilson's interval in DuckDB over k and n.
_CEN = "((k/n + 1.959964*1.959964/(2*n)) / (1 + 1.959964*1.959964/n))"
_HALF = "(1.959964*sqrt((k/n)*(1-k/n)/n + 1.959964*1.959964/(4.0*n*n)) / (1 + 1.959964*1.959964/n))"
LO, HI = f"greatest(0.0, {_CEN}-{_HALF})", f"least(1.0, {_CEN}+{_HALF})"
RATE = f"""t AS (SELECT {{by}}, repo, sha, avg(CAST(resolved AS DOUBLE)) AS p, count(*) AS c FROM v_attempts {{where}} GROUP BY {{by}}, repo, sha),
u AS (SELECT {{by}}, sum(p) AS k, count(*) AS n, sum(c) AS c FROM t GROUP BY {{by}}),
r AS (SELECT {{by}}, k/n AS point, {LO} AS lo, {HI} AS hi, n AS tasks, CAST(c AS BIGINT) AS attempts FROM u)"""


def rate(by: str, where: str = "") -> str:
    return RATE.format(by=by, where=where)


EV = rate("arm, cond") + """, m AS (SELECT arm, cond, median(secs)/60 AS median_minutes, count(*) FILTER (WHERE NOT resolved) AS failed, count(*) FILTER (WHERE timed_out) AS timed_out,
 count(DISTINCT machine) AS machines FROM v_attempts GROUP BY arm, cond),
e AS (SELECT *, timed_out >= 3 AND 2*timed_out >= failed AS time_bound FROM r JOIN m USING (arm, cond))"""
ROUND_EV = "arm, cond, round(point,6) AS point, round(lo,6) AS lo, round(hi,6) AS hi, tasks, attempts, round(median_minutes,6) AS median_minutes, failed, timed_out, machines, time_bound"
BY = ["arm", "cond"]


_K = "SELECT repo, arm, CAST(count(*) FILTER (WHERE resolved) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM v_attempts GROUP BY repo, arm"


@query("a01_wilson", "v_attempts", f"""WITH x AS ({_K}), y AS (SELECT repo, arm, k, n, {LO} AS lo, {HI} AS hi FROM x), z AS (SELECT repo, arm, {LO.replace("1.959964", "1.96")} AS low, {HI.replace("1.959964", "1.96")} AS high FROM x)
SELECT repo, arm, round(lo,6) AS lo, round(hi,6) AS hi, round(low,6) AS low, round(high,6) AS high FROM y JOIN z USING (repo, arm)""")
def intervals(rows):
    counts = rows.groupBy("repo", "arm").agg(F.count_if("resolved").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    both = counts.withColumns({"w": wilson(F.col("k"), F.col("n")), "r": wilson_ranking(F.col("k"), F.col("n"))})
    return both.select("repo", "arm", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), F.col("r.lo").alias("low"), F.col("r.hi").alias("high"))


@query("a07_time_bound", "v_attempts", """WITH x AS (SELECT repo, arm, cond, count(*) FILTER (WHERE timed_out) AS timed_out, count(*) FILTER (WHERE NOT resolved) AS failed FROM v_attempts GROUP BY ALL)
SELECT *, timed_out >= 3 AND 2*timed_out >= failed AS time_bound FROM x""")
def bound_by_time(rows):
    counts = rows.groupBy("repo", *BY).agg(F.count_if("timed_out").alias("timed_out"), F.count_if(~F.col("resolved")).alias("failed"))
    return counts.withColumn("time_bound", time_bound(F.col("timed_out"), F.col("failed")))


@query("a02_task_rate", "v_attempts", f"WITH {rate('arm, cond')} SELECT arm, cond, round(point,6) AS point, round(lo,6) AS lo, round(hi,6) AS hi, tasks, attempts FROM r")
def task_rate(rows):
    return audit.task_rate(rows, BY)


@query("p10_slice_rate", "v_attempts", f"""WITH {rate('arm', "WHERE cond='blind' AND machine='m0' AND committed >= TIMESTAMP '1995-01-01' AND committed < TIMESTAMP '1997-01-01'")}
SELECT arm, round(point,6) AS point, round(lo,6) AS lo, round(hi,6) AS hi, tasks, attempts FROM r""")
def slice_rate(rows):
    return audit.task_rate(audit.select_slice(rows, cond="blind", machine="m0", since="1995-01-01", until="1997-01-01"), ["arm"])


@query("p11_stands_at", "v_attempts", "SELECT arm, count(*) AS n, count(*) FILTER (WHERE limit_s < 5400) AS shorter FROM v_attempts WHERE limit_s = 5400 OR (limit_s < 5400 AND NOT timed_out) GROUP BY arm")
def stands(rows):
    return audit.select_slice(rows, limit_s=5400.0).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("limit_s") < 5400).alias("shorter"))


@query("j05_tasks_of", "v_attempts", "SELECT arm, count(*) AS n FROM v_attempts a WHERE arm <> 'arm0' AND EXISTS (SELECT 1 FROM v_attempts b WHERE b.arm='arm0' AND b.cond='blind' AND b.repo=a.repo AND b.sha=a.sha) GROUP BY arm")
def shared_tasks(rows):
    return audit.tasks_of(rows.filter("arm <> 'arm0'"), audit.select_slice(rows, arm="arm0", cond="blind")).groupBy("arm").agg(F.count(F.lit(1)).alias("n"))


@query("a03_arm_summary", "v_attempts", """WITH t AS (SELECT arm, cond, repo, sha, count(*) AS r, bool_or(resolved) AS ever, bool_and(resolved) AS always FROM v_attempts GROUP BY ALL),
x AS (SELECT arm, cond, count(*) AS tasks, count(*) FILTER (WHERE ever) AS solved_ever, count(*) FILTER (WHERE always) AS solved_always, max(r) AS repeats FROM t GROUP BY ALL),
y AS (SELECT arm, cond, count(*) AS n, count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE timed_out) AS timed_out, round(median(secs)/60,6) AS median_minutes FROM v_attempts GROUP BY arm, cond)
SELECT * FROM y JOIN x USING (arm, cond)""")
def arm_summary(rows):
    return audit.arm_summary(rows, BY)


@query("p07_outcome_counts", "v_attempts", "SELECT arm, cond, CASE WHEN resolved THEN 'resolved' WHEN timed_out THEN 'timed-out' ELSE 'failed' END AS outcome, count(*) AS n FROM v_attempts GROUP BY ALL")
def outcome_counts(rows):
    return audit.outcome_counts(rows, BY)


@query("a04_outcome_matrix", "v_attempts", """WITH c AS (SELECT repo, sha, arm, CASE WHEN resolved THEN 'resolved' WHEN timed_out THEN 'timed-out' ELSE 'failed' END AS o, count(*) AS c FROM v_attempts GROUP BY ALL),
g AS (SELECT repo, sha, arm, sum(c) AS n, coalesce(sum(c) FILTER (WHERE o='resolved'),0) AS k, (list(o ORDER BY c DESC, o))[1] AS o, max(c) AS m FROM c GROUP BY ALL)
SELECT repo, sha, arm, CASE WHEN n=1 THEN o WHEN k>0 THEN CAST(k AS BIGINT) || '/' || CAST(n AS BIGINT) || ' resolved' ELSE o || ' x' || m END AS cell FROM g""")
def outcome_matrix(rows):
    return audit.outcome_matrix(rows)


@query("a05_ledger", "v_attempts", "SELECT arm, CASE WHEN timed_out THEN 'time' WHEN limit_s=2700 THEN 'short' ELSE 'counted' END AS reason, count(*) AS n FROM v_attempts GROUP BY ALL")
def ledger(rows):
    return audit.ledger(rows, F.when(F.col("timed_out"), F.concat(F.lit("time: "), F.col("secs").cast("string"))).when(F.col("limit_s") == 2700, F.lit("short : half")))


@query("a06_evidence", "v_attempts", f"WITH {EV} SELECT {ROUND_EV} FROM e")
def evidence(rows):
    return audit.require_single(audit.evidence(rows, BY), "machines")


PAIRED = """s AS (SELECT arm, repo, sha, (list(resolved ORDER BY run_key, rep))[1] AS resolved FROM v_attempts WHERE arm IN ('arm0','arm1') GROUP BY ALL),
c AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE a.resolved) AS a_solved, count(*) FILTER (WHERE b.resolved) AS b_solved, count(*) FILTER (WHERE a.resolved AND NOT b.resolved) AS only_a,
 count(*) FILTER (WHERE b.resolved AND NOT a.resolved) AS only_b FROM (SELECT * FROM s WHERE arm='arm1') a JOIN (SELECT * FROM s WHERE arm='arm0') b ON a.repo=b.repo AND a.sha=b.sha)"""


def _pairs(rows):
    one = lambda arm: audit.one_per_task(audit.select_slice(rows, arm=arm))
    return audit.pair_by_prefix(one("arm1"), one("arm0").withColumn("sha", F.concat("sha", F.lit("f0"))))


@query("j07_prefix_pairs", "v_attempts", f"WITH {PAIRED} SELECT pairs, a_solved, b_solved, only_a, only_b FROM c")
def prefix_pairs(rows):
    return audit.paired_counts(_pairs(rows))


@query("a08_paired_test", "v_attempts", f"""WITH {PAIRED} SELECT *, round(least(1.0, 2*(SELECT sum(exp(lgamma(only_a+only_b+1)-lgamma(i+1)-lgamma(only_a+only_b-i+1)-(only_a+only_b)*ln(2.0))) FROM range(0, CAST(least(only_a,only_b)+1 AS BIGINT)) t(i))),6) AS p_value FROM c""")
def paired_test(rows):
    return audit.paired_test(audit.paired_counts(_pairs(rows)))


@query("a09_capability", "v_attempts", None)
def capability(rows):
    return audit.capability(audit.paired_counts(_pairs(rows)))


@query("a10_cloud_side", "v_attempts", """WITH l AS (SELECT repo, sha, avg(CAST(resolved AS DOUBLE)) AS lp FROM v_attempts WHERE arm='arm1' GROUP BY ALL),
c AS (SELECT repo, sha, avg(CAST(resolved AS DOUBLE)) AS cp, avg(cost_usd) AS c FROM v_attempts WHERE arm='arm0' GROUP BY ALL)
SELECT count(*) AS tasks, round(sum(cp),6) AS resolved, round(sum(lp*(1-cp)),6) AS only_local, round(avg(c),6) AS usd_per_task, round(sum(lp*c)/sum(lp),6) AS usd_saved, round(sum((1-lp)*c)/sum(1-lp),6) AS usd_rest FROM l JOIN c USING (repo, sha)""")
def cloud_side(rows):
    return audit.cloud_side(rows.filter("arm = 'arm1'"), rows.filter("arm = 'arm0'"))


@query("j10_missing_tasks", "v_attempts", "SELECT DISTINCT repo, sha FROM v_attempts a WHERE arm='arm1' AND NOT EXISTS (SELECT 1 FROM v_attempts b WHERE b.arm='arm0' AND b.repo=a.repo AND b.sha=a.sha)")
def missing_tasks(rows):
    return audit.missing_tasks(rows.filter("arm = 'arm1'"), rows.filter("arm = 'arm0'"))


def _api_sql(price: str, triage: str) -> str:
    local, tri = "(0.018*median_minutes/60)", f"({triage}/60.0*60)"
    net = lambda p: f"200.0*({p}*{price} - {local} - (1-{p})*{tri})"
    return f"""round({net('lo')},6) AS net_lo, round({net('point')},6) AS net, round({net('hi')},6) AS net_hi, round(({local}+{tri})/({price}+{tri}),6) AS breakeven_rate,
 round(({local}+(1-point)*{tri})/nullif(point,0),6) AS breakeven_cost, CASE WHEN tasks<20 THEN 'stay' WHEN {net('point')} >= 10 THEN 'split' ELSE 'stay' END AS call,
 CASE WHEN tasks<20 THEN false WHEN {net('lo')}>=10 THEN true WHEN {net('point')}>=10 THEN false ELSE {net('hi')}<10 AND NOT time_bound END AS confident"""


@query("a11_api_verdict", "v_attempts", f"WITH {EV} SELECT {ROUND_EV}, {_api_sql('0.75', '5')} FROM e")
def api_verdict(rows):
    return audit.api_verdict(audit.evidence(rows, BY), F.lit(0.75))


@query("a12_subscription_verdict", "v_attempts", f"""WITH {EV}, n AS (SELECT *, (CASE WHEN lo>=1.0 THEN 80 ELSE 0.0 END) - 200*0.018*median_minutes/60 - 200.0*(1-lo)*5 AS nl, (CASE WHEN point>=1.0 THEN 80 ELSE 0.0 END) - 200*0.018*median_minutes/60 - 200.0*(1-point)*5 AS nm FROM e)
SELECT {ROUND_EV}, 1.0::DOUBLE AS p_down, round(nl,6) AS net_lo, round(nm,6) AS net, CASE WHEN tasks>=20 AND ((lo>=1.0 AND nl>0) OR (point>=1.0 AND nm>0)) THEN 'split' ELSE 'stay' END AS call,
 CASE WHEN tasks<20 THEN false WHEN lo>=1.0 AND nl>0 THEN true WHEN point>=1.0 AND nm>0 THEN false ELSE NOT time_bound END AS confident FROM n""")
def subscription_verdict(rows):
    return audit.subscription_verdict(audit.evidence(rows, BY))


@query("a13_verdict_curve", "v_attempts", f"WITH {EV} SELECT arm, cond, price, triage, {_api_sql('price', 'triage').split(', round((')[0]}, {'CASE' + _api_sql('price', 'triage').split('CASE', 1)[1]} FROM e, (SELECT unnest([0.05,0.25,0.75,2.0])::DOUBLE AS price) g1, (SELECT unnest([0.0,1.0,5.0])::DOUBLE AS triage) g2")
def verdict_curve(rows):
    found = audit.verdict_curve(audit.evidence(rows, BY), [0.05, 0.25, 0.75, 2.0], [0.0, 1.0, 5.0])
    return found.select("arm", "cond", "price", "triage", "net_lo", "net", "net_hi", "call", "confident")


@query("a14_sample_plan", "v_attempts", f"""WITH {EV}, q AS (SELECT arm, cond, tasks, point, median_minutes, (SELECT min(i) FROM range(1, 3001) s(i), LATERAL (SELECT point*i AS k, i AS n) z WHERE ({HI} - {LO})/2 <= 0.05) AS need FROM e)
SELECT arm, cond, tasks, need AS tasks_needed, greatest(need-tasks,0)*10 AS attempts_needed, CAST(ceil(greatest(need-tasks,0)*10 / greatest(1.0, floor(480/greatest(median_minutes,0.1)))) AS BIGINT) AS nights FROM q""")
def sample_plan(rows):
    need = audit.tasks_needed(audit.evidence(rows, BY), 0.05)
    return audit.plan_nights(need, 10, F.col("median_minutes")).select("arm", "cond", "tasks", "tasks_needed", "attempts_needed", "nights")


@query("a15_bench_list", "v_attempts", "SELECT repo, count(*) AS attempts, count(DISTINCT sha) AS tasks, string_agg(DISTINCT arm, ',' ORDER BY arm) AS arms, string_agg(DISTINCT cond, ',' ORDER BY cond) AS conds, max(committed) AS last FROM v_attempts GROUP BY repo")
def bench_list(rows):
    return audit.bench_list(rows)


@query("j11_open_cells", "v_attempts", """WITH t AS (SELECT DISTINCT repo, sha FROM v_attempts), a AS (SELECT DISTINCT arm, cond FROM v_attempts), d AS (SELECT DISTINCT repo, sha, arm, cond, rep FROM v_attempts),
o AS (SELECT t.*, a.*, CAST(r AS INTEGER) AS rep FROM t, a, range(1,4) s(r)) SELECT arm, cond, rep, count(*) AS n FROM (SELECT repo, sha, arm, cond, rep FROM o EXCEPT SELECT repo, sha, arm, cond, rep FROM d) GROUP BY ALL""")
def open_cells(rows):
    return audit.open_cells(rows, 3).groupBy("arm", "cond", "rep").agg(F.count(F.lit(1)).alias("n"))


@query("w02_running_rate", "v_attempts", f"""WITH t AS (SELECT arm, repo, sha, avg(CAST(resolved AS DOUBLE)) AS p FROM v_attempts WHERE cond='blind' GROUP BY ALL),
w AS (SELECT arm, repo, sha, sum(p) OVER (PARTITION BY arm ORDER BY repo, sha ROWS UNBOUNDED PRECEDING) AS k, count(*) OVER (PARTITION BY arm ORDER BY repo, sha ROWS UNBOUNDED PRECEDING) AS n FROM t)
SELECT arm, repo, sha, n AS after, round(k/n,6) AS rate, round({LO},6) AS lo, round({HI},6) AS hi FROM w""")
def running_rate(rows):
    return audit.running_rate(audit.per_task(rows.filter("cond = 'blind'"), ["arm"]), ["arm"], ["repo", "sha"])


@query("a40_claim_metrics", "v_attempts", None)
def claim_metrics(rows):
    return audit.claim_metrics(audit.select_slice(rows, arm="arm1", cond="blind"), audit.select_slice(rows, arm="arm0", cond="blind"))


@query("a41_check_claims", "v_attempts", """WITH m AS (SELECT arm AS claim, 'rate' AS metric, avg(CAST(resolved AS DOUBLE)) AS value FROM v_attempts GROUP BY arm), c AS (SELECT * FROM (VALUES ('arm0','rate','0.3'),('arm1','rate','0.25'),('arm2','rate','0.9'),('arm9','rate','0.1')) v(claim, metric, published))
SELECT claim, metric, published, round(value,6) AS value, coalesce(CASE length(split_part(published,'.',2)) WHEN 1 THEN CAST(round(CAST(value AS DECIMAL(30,12)),1) AS DOUBLE) ELSE CAST(round(CAST(value AS DECIMAL(30,12)),2) AS DOUBLE) END = CAST(published AS DOUBLE), false) AS passes FROM c LEFT JOIN m USING (claim, metric)""")
def check_claims(rows):
    metrics = rows.groupBy(F.col("arm").alias("claim")).agg(F.avg(F.col("resolved").cast("double")).alias("value")).withColumn("metric", F.lit("rate"))
    claims = rows.sparkSession.createDataFrame([("arm0", "rate", "0.3"), ("arm1", "rate", "0.25"), ("arm2", "rate", "0.9"), ("arm9", "rate", "0.1")], "claim string, metric string, published string")
    return audit.check_claims(claims, metrics)


@query("a53_settings_grid", "v_attempts", """WITH t AS (SELECT limit_s, repo, sha, count(*) AS n FROM v_attempts GROUP BY ALL), e AS (SELECT repo, sha, max(n) AS most FROM t GROUP BY ALL)
SELECT limit_s, count(*) AS tasks, CAST(sum(n) AS BIGINT) AS attempts, bool_and(n=most) AND count(*) = (SELECT count(*) FROM e) AS complete FROM t JOIN e USING (repo, sha) GROUP BY limit_s""")
def settings_grid(rows):
    return audit.settings_grid(rows, "limit_s")


@query("k06_first_specimen", "v_attempts", "SELECT arm, repo, sha, rep, run_key, resolved FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY committed, repo, sha, rep, run_key) AS k FROM v_attempts) WHERE k=1")
def first_specimen(rows):
    return audit.first_specimen(rows)


@query("a41_half_up", "v_attempts", "SELECT arm, CAST(round(CAST(avg(secs) AS DECIMAL(30,12)),2) AS DOUBLE) AS secs FROM v_attempts GROUP BY arm")
def rounded(rows):
    return rows.groupBy("arm").agg(F.avg("secs").alias("s")).select("arm", half_up(F.col("s"), 2).cast("double").alias("secs"))
