"""Queries of multi-level reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlens.functions.stats import pearson
from agentlens.operators import joins, reports
from agentlens.plans.registry import query

M, C, D = "v_task_metrics", "v_cases", "v_decisions"
LIVE = "l AS (SELECT agent_name AS agent, capability_bucket AS bucket, success, reward_score AS reward, wall_time_ms/1000 AS latency_s FROM v_task_metrics ORDER BY id DESC LIMIT 5000), g AS (SELECT {key} agent, count(*) AS n, CAST(sum(success) AS DOUBLE) AS k, avg(reward) AS mean_reward, median(latency_s) AS median_latency FROM l WHERE success IS NOT NULL GROUP BY ALL), r AS (SELECT *, k/n AS live, greatest(0.0, (k/n + 1.96*1.96/(2*n) - 1.96*sqrt((k/n)*(1-k/n)/n + 1.96*1.96/(4.0*n*n)))/(1+1.96*1.96/n)) AS lo FROM g)"


def _live(m):
    return m.select("id", F.col("agent_name").alias("agent"), F.col("capability_bucket").alias("bucket"), "success", F.col("reward_score").alias("reward"), (F.col("wall_time_ms") / 1000).alias("latency_s"))


@query("a29_rankings", M, f"WITH {LIVE.format(key='')}, h AS (SELECT 'cloud:a' AS agent, 0.9::DOUBLE AS h UNION ALL SELECT 'new', 0.5), j AS (SELECT coalesce(r.agent,h.agent) AS agent, n, mean_reward, median_latency, lo, coalesce(0.7*live+0.3*h, live, h) AS rate FROM r FULL JOIN h ON r.agent=h.agent) SELECT agent, n, round(mean_reward,6) AS mean_reward, round(median_latency,6) AS median_latency, round(lo,6) AS lo, round(rate,6) AS rate, CAST(row_number() OVER (ORDER BY rate DESC NULLS LAST, lo DESC NULLS LAST, n DESC NULLS LAST, agent) AS INTEGER) AS rank FROM j")
def rankings(m):
    h = m.sparkSession.createDataFrame([("cloud:a", 0.9), ("new", 0.5)], "agent string, success_rate double")
    return reports.rankings([_live(m).drop("bucket")], h, [])


@query("a29_rankings_by_bucket", M, f"WITH {LIVE.format(key='bucket,')} SELECT bucket, agent, n, round(mean_reward,6) AS mean_reward, round(median_latency,6) AS median_latency, round(lo,6) AS lo, round(live,6) AS rate, CAST(row_number() OVER (PARTITION BY bucket ORDER BY live DESC, lo DESC, n DESC, agent) AS INTEGER) AS rank FROM r")
def rankings_by_bucket(m):
    return reports.rankings([_live(m)], None, ["bucket"])


CELL = "round(avg(CAST(success AS DOUBLE)),6) AS success_rate, round(avg(quality_score),6) AS mean_quality, round(avg(reward_score),6) AS mean_reward, round(avg(wall_time_ms),6) AS mean_ms"


@query("a30_compatibility", M, f"SELECT capability_bucket, agent_name, count(*) AS n, {CELL} FROM v_task_metrics GROUP BY GROUPING SETS ((capability_bucket, agent_name),(agent_name),(capability_bucket))")
def compatibility(m):
    return reports.compatibility(m)


@query("a30_best_agents", M, "WITH c AS (SELECT capability_bucket, agent_name, avg(wall_time_ms) AS v FROM v_task_metrics GROUP BY ALL HAVING count(*)>=10) SELECT capability_bucket, agent_name AS best, round(v,6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY capability_bucket ORDER BY v, agent_name) AS rn FROM c) WHERE rn=1")
def best_agents(m):
    return reports.best_agents(reports.compatibility(m), "mean_ms", lower=True, least=10)


@query("a31_cost_report", M, "WITH r AS (SELECT capability_bucket, cost_usd AS a, agent_name LIKE 'cloud%' AS c, (prompt_tokens*3.0+tokens_generated*15.0)/1000000::DOUBLE AS w, success, prompt_tokens FROM v_task_metrics) SELECT capability_bucket, round(sum(a),3) AS actual, round(sum(CASE WHEN c THEN a ELSE w END),3) AS all_cloud, round(sum(CASE WHEN NOT c THEN w-a END),3) AS avoided, round(sum(CASE WHEN NOT c AND success=1 THEN w-a END),3) AS avoided_success, round(avg(CASE WHEN c THEN 0.0::DOUBLE ELSE 1 END),3) AS local_share, count(*) FILTER (WHERE prompt_tokens IS NULL) AS unpriced FROM r GROUP BY ROLLUP(capability_bucket)", 3)
def cost_report(m):
    return reports.cost_report(m, 3.0, 15.0)


AB = "s AS (SELECT 'run' || (id%2) AS run_id, success, reward, latency_s FROM v_decisions), q AS (SELECT run_id, latency_s, row_number() OVER (PARTITION BY run_id ORDER BY latency_s)-1 AS i, count(*) OVER (PARTITION BY run_id) AS c FROM s), g AS (SELECT run_id, count(*) AS n, avg(CAST(success AS DOUBLE)) AS success_rate, avg(reward) AS mean_reward, (SELECT latency_s FROM q WHERE q.run_id=s.run_id AND i=floor(c*0.5)) AS latency_p50, (SELECT latency_s FROM q WHERE q.run_id=s.run_id AND i=floor(c*0.9)) AS latency_p90 FROM s GROUP BY run_id)"


def _ab(d):
    return reports.ab_summary(d.withColumn("run_id", F.concat(F.lit("run"), (F.col("id") % 2).cast("string"))))


@query("a33_ab_summary", D, f"WITH {AB} SELECT run_id, n, round(success_rate,6) AS success_rate, round(mean_reward,6) AS mean_reward, round(latency_p50,6) AS latency_p50, round(latency_p90,6) AS latency_p90 FROM g")
def ab_summary(d):
    return _ab(d)


@query("a33_ab_delta", D, f"WITH {AB} SELECT round(a.success_rate-b.success_rate,6) AS delta_success_rate, round(a.mean_reward-b.mean_reward,6) AS delta_mean_reward, round(a.latency_p50-b.latency_p50,6) AS delta_latency_p50 FROM (SELECT * FROM g WHERE run_id='run1') a, (SELECT * FROM g WHERE run_id='run0') b")
def ab_delta(d):
    return reports.ab_delta(_ab(d), "run1", "run0")


@query("a34_batch_summary", D, "SELECT selected_agent AS agent, count(*) AS n, round(avg(CASE WHEN event_type<>'error' AND k<=90 THEN 1.0::DOUBLE ELSE 0 END),6) AS answered, count(*) FILTER (WHERE event_type='error') AS errors, count(*) FILTER (WHERE k>90) AS timeouts, round(avg(latency_s) FILTER (WHERE event_type<>'error' AND k<=90),6) AS mean_latency, CAST(sum(k) FILTER (WHERE event_type<>'error' AND k<=90) AS BIGINT) AS tokens, round(sum(k) FILTER (WHERE event_type<>'error' AND k<=90)/sum(latency_s) FILTER (WHERE event_type<>'error' AND k<=90),6) AS tokens_per_s FROM v_decisions GROUP BY 1")
def batch_summary(d):
    return reports.batch_summary(d.select(F.col("selected_agent").alias("agent"), F.when(F.col("event_type") == "error", "e").alias("error"), (F.col("k") > 90).alias("timed_out"), F.col("latency_s").alias("elapsed_s"), F.col("k").alias("tokens")))


@query("a35_speed_by_tier", M, 'SELECT agent_name, round(avg(wall_time_ms) FILTER (WHERE task_id%3=0),6) AS "0", round(avg(wall_time_ms) FILTER (WHERE task_id%3=1),6) AS "1", round(avg(wall_time_ms) FILTER (WHERE task_id%3=2),6) AS "2" FROM v_task_metrics GROUP BY agent_name')
def speed_by_tier(m):
    return reports.speed_by_tier(m.withColumn("tier", F.col("task_id") % 3), [0, 1, 2])


def _graded(r):
    return r.select("conv_id", "turn", "bucket", "agent", "output", (F.length("output") % 3 != 0).alias("passed"), (F.length("prompt") % 10 / 10).alias("heuristic"))


GRADED = "g AS (SELECT conv_id, turn, bucket, agent, output, length(output)%3<>0 AS passed, (length(prompt)%10)/10.0::DOUBLE AS heuristic FROM v_results)"


@query("a37_pass_at_1", "v_results", f"WITH {GRADED} SELECT bucket, agent, count(*) AS n, count(*) FILTER (WHERE passed) AS passed, round(avg(CASE WHEN passed THEN 1.0::DOUBLE ELSE 0 END),6) AS pass_at_1, count(*) FILTER (WHERE trim(output)='') AS empty, round(avg(heuristic),6) AS mean_heuristic FROM g GROUP BY GROUPING SETS ((bucket,agent),(agent))")
def pass_at_1(r):
    return reports.pass_at_1(_graded(r))


@query("a37_spearman", "v_results", f"WITH {GRADED}, r AS (SELECT bucket, rank() OVER (PARTITION BY bucket ORDER BY heuristic)+(count(*) OVER (PARTITION BY bucket, heuristic)-1)/2.0::DOUBLE AS a, rank() OVER (PARTITION BY bucket ORDER BY passed)+(count(*) OVER (PARTITION BY bucket, passed)-1)/2.0::DOUBLE AS b FROM g) SELECT bucket, round(1-6*sum((a-b)*(a-b))/(count(*)*(count(*)*count(*)-1.0)),6) AS rho FROM r GROUP BY bucket")
def spearman(r):
    return reports.spearman(_graded(r), "heuristic", "passed", "bucket")


@query("a37_inversions", "v_results", f"WITH {GRADED}, m AS (SELECT bucket, agent, avg(heuristic) AS h, avg(CASE WHEN passed THEN 1.0::DOUBLE ELSE 0 END) AS p FROM g GROUP BY ALL), k AS (SELECT bucket, agent, row_number() OVER (PARTITION BY bucket ORDER BY h DESC, agent)::INTEGER AS rank_x, row_number() OVER (PARTITION BY bucket ORDER BY p DESC, agent)::INTEGER AS rank_y FROM m) SELECT * FROM k WHERE rank_x<>rank_y")
def inversions(r):
    means = reports.pass_at_1(_graded(r)).filter("bucket IS NOT NULL")
    return reports.inversions(means, "mean_heuristic", "pass_at_1").select("bucket", "agent", "rank_x", "rank_y")


SERVED = "s AS (SELECT *, coalesce(NOT judge_verdict,false) AS escalated, CASE WHEN judge_verdict=false THEN cloud_passed ELSE local_passed END AS final_passed, 0.001+CASE WHEN judge_verdict=false THEN cloud_cost ELSE 0 END AS total_cost FROM v_cases)"


@query("a38_routed_metrics", C, f"WITH {SERVED} SELECT count(*) AS n, round(avg(final_passed::INT::DOUBLE),6) AS routed, round(avg(cloud_passed::INT::DOUBLE),6) AS cloud, round(avg(local_passed::INT::DOUBLE),6) AS local, round(avg(escalated::INT::DOUBLE),6) AS escalation_rate, round(count(*) FILTER (WHERE NOT local_passed AND escalated)/count(*) FILTER (WHERE NOT local_passed),6) AS fail_recall, round(avg(total_cost)*1000,6) AS usd_per_1k, round(1-sum(total_cost)/sum(cloud_cost),6) AS cost_reduction FROM s")
def routed_metrics(c):
    return reports.routed_metrics(joins.served(c.withColumn("judge_cost", F.lit(0.001))))


@query("a38_routed_metrics_missing", C, "SELECT count(*) AS n, NULL::DOUBLE AS routed, round(avg(cloud_passed::INT::DOUBLE),6) AS cloud, round(avg(local_passed::INT::DOUBLE),6) AS local, NULL::DOUBLE AS escalation_rate, NULL::DOUBLE AS fail_recall, NULL::DOUBLE AS usd_per_1k, NULL::DOUBLE AS cost_reduction FROM v_cases")
def routed_metrics_missing(c):
    return reports.routed_metrics(c)


@query("a39_graded_metrics", "v_attempts", "WITH g AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE resolved) AS k, count(*) FILTER (WHERE timed_out) AS timeouts FROM v_attempts GROUP BY arm) SELECT arm, n, k AS passed, round(k/n,6) AS pass_at_1, round(((k/n + 1.959964*1.959964/(2*n)) - 1.959964*sqrt((k/n)*(1-k/n)/n + 1.959964*1.959964/(4.0*n*n)))/(1+1.959964*1.959964/n),6) AS lo, round(((k/n + 1.959964*1.959964/(2*n)) + 1.959964*sqrt((k/n)*(1-k/n)/n + 1.959964*1.959964/(4.0*n*n)))/(1+1.959964*1.959964/n),6) AS hi, NULL::BIGINT AS errors, timeouts FROM g")
def graded_metrics(a):
    return reports.graded_metrics(a.select("arm", F.col("resolved").alias("passed"), F.lit(None).cast("boolean").alias("error"), "timed_out"), ["arm"])


CONF = "count(*) FILTER (WHERE {v} AND {t}) AS tp, count(*) FILTER (WHERE {v} AND NOT {t}) AS fp, count(*) FILTER (WHERE NOT {v} AND NOT {t}) AS tn, count(*) FILTER (WHERE NOT {v} AND {t}) AS fn, count(*) FILTER (WHERE {v} IS NULL) AS unparsed"


@query("a42_judge_confusion", C, f"WITH g AS (SELECT {CONF.format(v='judge_verdict', t='local_passed')} FROM v_cases) SELECT *, round((tp+tn)/(tp+tn+fp+fn),6) AS accuracy, round(tn/(tn+fp),6) AS fail_recall FROM g")
def judge_confusion(c):
    return reports.judge_confusion(c, "judge_verdict", "local_passed")


@query("a43_judge_bank", C, "WITH b AS (SELECT 'b' || (case_id%4) AS bucket, 'd' || (case_id%3) AS defect, judge_verdict AS v_ref, CASE WHEN case_id%13=0 THEN NULL ELSE cloud_cost>0.15 END AS v_mut FROM v_cases) SELECT bucket, defect, round(count(*) FILTER (WHERE v_ref)/count(v_ref),6) AS accept_rate, round(count(*) FILTER (WHERE NOT v_mut)/count(v_mut),6) AS catch_rate, round(count(*) FILTER (WHERE v_ref AND NOT v_mut)/count(*),6) AS paired, count(*) FILTER (WHERE v_ref IS NULL OR v_mut IS NULL) AS unparsed FROM b GROUP BY GROUPING SETS ((),(bucket),(defect))")
def judge_bank(c):
    name = lambda p, n: F.concat(F.lit(p), (F.col("case_id") % n).cast("string"))
    return reports.judge_bank(c.select(name("b", 4).alias("bucket"), name("d", 3).alias("defect"), F.col("judge_verdict").alias("v_ref"), F.when(F.col("case_id") % 13 != 0, F.col("cloud_cost") > 0.15).alias("v_mut")))


def _matrix(c):
    key = F.col("case_id").cast("string").alias("prompt")
    cell = lambda a, p, of=c: of.select(key, F.lit(a).alias("agent"), p.alias("passed"))
    return cell("cloud", F.col("cloud_passed")).unionByName(cell("l1", F.col("local_passed"))).unionByName(cell("l2", F.col("case_id") % 5 == 0, c.filter("cloud_cost >= 0.05")))


MAT = "m AS (SELECT case_id AS prompt, 'cloud' AS agent, cloud_passed AS passed FROM v_cases UNION ALL SELECT case_id, 'l1', local_passed FROM v_cases UNION ALL SELECT case_id, 'l2', case_id%5=0 FROM v_cases WHERE cloud_cost>=0.05), p AS (SELECT prompt, bool_or(passed) FILTER (WHERE agent='cloud') AS cloud, bool_or(passed) FILTER (WHERE agent<>'cloud') AS local FROM m GROUP BY prompt), c AS (SELECT case_id AS prompt, cloud_cost AS cost FROM v_cases WHERE cloud_passed), q AS (SELECT p.*, coalesce(cost,(SELECT avg(cost) FROM c)) AS cost, p.prompt%3=0 AS accept FROM p LEFT JOIN c USING (prompt))"


@query("a44_policies", C, f"WITH {MAT} SELECT 'always cloud' AS policy, count(*) AS n, round(avg(cloud::INT::DOUBLE),6) AS pass_rate, round(avg(cost),6) AS cost FROM q UNION ALL SELECT 'always ' || agent, count(*), round(avg(passed::INT::DOUBLE),6), 0.0 FROM m WHERE agent<>'cloud' GROUP BY agent UNION ALL SELECT 'best of local', count(*), round(avg(local::INT::DOUBLE),6), 0.0 FROM q UNION ALL SELECT 'routed', count(*), round(avg(CASE WHEN accept THEN local ELSE cloud END::INT::DOUBLE),6), round(avg(CASE WHEN accept THEN 0.0 ELSE cost END + 0.002),6) FROM q")
def policies(c):
    costs = c.filter("cloud_passed").select(F.col("case_id").cast("string").alias("prompt"), F.col("cloud_cost").alias("cost"))
    return reports.policies(_matrix(c), costs, "cloud", F.col("prompt").cast("long") % 3 == 0, 0.002)


@query("a45_baselines", C, f"WITH {MAT}, s AS (SELECT agent, avg(passed::INT::DOUBLE) AS rate FROM m GROUP BY agent) SELECT 'static ' || agent AS policy, round(rate,6) AS rate FROM s UNION ALL SELECT 'best static', round(max(rate),6) FROM s UNION ALL SELECT 'round robin', round(avg(rate),6) FROM s UNION ALL SELECT 'oracle', round(avg((cloud OR local)::INT::DOUBLE),6) FROM p")
def baselines(c):
    return reports.baselines(_matrix(c))


@query("a45_discriminating", C, f"WITH {MAT} SELECT CAST(prompt AS VARCHAR) AS prompt, max(agent) FILTER (WHERE passed) AS agent FROM m GROUP BY m.prompt HAVING count(*) FILTER (WHERE passed)=1")
def discriminating(c):
    return reports.discriminating(_matrix(c))


@query("a46_quality_correlation", M, "SELECT capability_bucket, round(CASE WHEN count(*)>=10 THEN covar_pop(quality_score, reward_score)/(greatest(stddev_pop(quality_score),1e-9)*greatest(stddev_pop(reward_score),1e-9)) END,6) AS r FROM v_task_metrics GROUP BY capability_bucket")
def correlation(m):
    return m.groupBy("capability_bucket").agg(pearson(F.col("quality_score"), F.col("reward_score")).alias("r"))


SEEDS = "v AS (SELECT bucket AS condition, k%12 AS seed, avg(reward) AS value FROM v_decisions GROUP BY ALL), g AS (SELECT condition, count(*)::INTEGER AS n, avg(value) AS mean, stddev_samp(value) AS std FROM v GROUP BY condition), b AS (SELECT n AS bn, mean AS bm, std AS bs FROM g WHERE condition='b0')"


@query("a47_seed_summary", D, f"WITH {SEEDS} SELECT condition, n, round(mean,6) AS mean, round(std,6) AS std, round(2.201*std/sqrt(n),6) AS ci95, round(mean-bm,6) AS delta, CASE WHEN condition<>'b0' THEN round((mean-bm)/sqrt(std*std/n+bs*bs/bn),6) END AS t FROM g, b")
def seed_summary(d):
    return reports.seed_summary(d.withColumn("seed", F.col("k") % 12).groupBy(F.col("bucket").alias("condition"), "seed").agg(F.avg("reward").alias("value")), "b0")


@query("a49_strategy_summary", D, "WITH t AS (SELECT strategy, selected_agent, count(*) AS n FROM v_decisions GROUP BY ALL), u AS (SELECT strategy, max(n) AS top, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY ALL) SELECT strategy, round(avg(CAST(success AS DOUBLE)),6) AS success_rate, round(avg(reward),6) AS mean_reward, round(avg((cost_usd=0)::INT::DOUBLE),6) AS free_share, round(sum((SELECT max(cost_usd) FROM v_decisions)-cost_usd),6) AS saved, any_value(u.n) AS n, round(any_value(top)/any_value(u.n),6) AS top_share FROM v_decisions JOIN u USING (strategy) GROUP BY strategy")
def strategy_summary(d):
    return reports.strategy_summary(d)


@query("a54_best_settings", D, "WITH g AS (SELECT bucket AS parameter, selected_agent AS value, avg(reward) AS m FROM v_decisions GROUP BY ALL) SELECT parameter, value, round(m,6) AS mean_reward, row_number() OVER (PARTITION BY parameter ORDER BY m DESC, value)::INTEGER AS rank FROM g")
def best_settings(d):
    return reports.best_settings(d.select(F.col("bucket").alias("parameter"), F.col("selected_agent").alias("value"), "reward"))


@query("a55_run_list", "orders", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS machine, o_custkey AS timeout_s, ['m' || (o_orderkey%3)] AS models FROM orders")
def run_list(o):
    m = o.select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("started"), F.struct(F.col("o_orderpriority").alias("name")).alias("machine"),
        F.struct(F.col("o_custkey").alias("timeout_s")).alias("settings"), F.struct(F.create_map(F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")), F.lit("x")).alias("digests")).alias("models"),
    )
    return reports.run_list(m).drop("started")
