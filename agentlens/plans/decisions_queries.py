"""Queries over the decision log, the cost ledger and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlens.operators import observe, sequences
from agentlens.plans.registry import query

D = "v_decisions"


def _overridden():
    return F.col("bandit_pick") != F.col("selected_agent")


@query("p01_within_window", D, "SELECT bucket, count(*) AS n FROM v_decisions WHERE strftime(ts,'%Y-%m-%dT%H:%M:%S') >= '1995-03' AND substr(strftime(ts,'%Y-%m-%dT%H:%M:%S'),1,7) <= '2024-01' GROUP BY bucket")
def within(d):
    return d.filter(observe.within_window(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "1995-03", "2024-01")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("p02_epoch_window", "v_task_metrics", "SELECT agent_name, count(*) AS n FROM v_task_metrics WHERE epoch(ts) >= epoch(TIMESTAMP '1995-02-01 00:00:00') AND epoch(ts) <= epoch(TIMESTAMP '1996-03-15 23:59:59.999999') GROUP BY agent_name")
def epoch_window(m):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return m.filter((at >= observe.epoch("1995-02-01")) & (at <= observe.epoch("1996-03-15", end_of_day=True))).groupBy("agent_name").agg(F.count(F.lit(1)).alias("n"))


@query("p09_selected_entry", D, "SELECT selected_agent, round(avg(CASE WHEN id % 4 < 2 THEN CAST(k AS DOUBLE)/10 END),6) AS mean, count(CASE WHEN id % 4 < 2 THEN k END) AS n FROM v_decisions GROUP BY selected_agent")
def selected_entry(d):
    maps = d.withColumn("m", F.to_json(F.create_map(F.lit("agent0"), F.col("k") / 10, F.lit("agent1"), F.col("k") / 10)))
    return maps.withColumn("p", observe.selected_of(F.col("m"), F.col("selected_agent"))).groupBy("selected_agent").agg(F.avg("p").alias("mean"), F.count("p").alias("n"))


MEANS = "count(*) AS n, count(success) AS n_outcomes, round(avg(CASE WHEN success IS NOT NULL THEN reward END),6) AS mean_reward, round(avg(CAST(success AS DOUBLE)),6) AS mean_success, round(avg(CASE WHEN success IS NOT NULL THEN latency_s END),6) AS mean_latency_s, round(avg(CASE WHEN success IS NOT NULL THEN cost_usd END),6) AS mean_cost_usd"


@query("a16_window_stats", D, f"WITH r AS (SELECT *, row_number() OVER (ORDER BY id DESC) AS rn FROM v_decisions) SELECT 'last_100' AS horizon, {MEANS} FROM r WHERE rn<=100 UNION ALL SELECT 'last_500', {MEANS} FROM r WHERE rn<=500 UNION ALL SELECT 'all', {MEANS} FROM r")
def window_stats(d):
    return observe.window_stats(d)


@query("a17_agent_rollup", D, "SELECT selected_agent, count(*) AS n, count(success) AS n_outcomes, round(avg(CASE WHEN success IS NOT NULL THEN reward END),6) AS mean_reward, round(avg(CAST(success AS DOUBLE)),6) AS success_rate FROM v_decisions GROUP BY selected_agent")
def agent_rollup(d):
    return observe.rollup_by(d, "selected_agent")


@query("a18_filtered_stats", D, "WITH r AS (SELECT * FROM v_decisions WHERE success IS NOT NULL AND strategy='linucb' ORDER BY id DESC LIMIT 300) SELECT count(*) AS total, round(coalesce(avg(CAST(success AS DOUBLE)),0),6) AS success_rate, round(coalesce(avg(reward),0),6) AS mean_reward, round(coalesce(avg(latency_s),0),6) AS mean_latency, round(coalesce(sum(cost_usd),0),6) AS total_cost FROM r")
def filtered_stats(d):
    return observe.filtered_stats(d, strategy="linucb", last_n=300)


@query("a18_filtered_stats_empty", D, "SELECT CAST(0 AS BIGINT) AS total, 0.0::DOUBLE AS success_rate, 0.0::DOUBLE AS mean_reward, 0.0::DOUBLE AS mean_latency, 0.0::DOUBLE AS total_cost")
def filtered_stats_empty(d):
    return observe.filtered_stats(d, strategy="nobody")


@query("a19_composer_split", D, "SELECT count(*) FILTER (WHERE bandit_pick=selected_agent) AS n_yes, count(*) FILTER (WHERE bandit_pick<>selected_agent) AS n_no, round(avg(reward) FILTER (WHERE bandit_pick=selected_agent),6) AS mean_yes, round(avg(reward) FILTER (WHERE bandit_pick<>selected_agent),6) AS mean_no, round(avg(reward) FILTER (WHERE bandit_pick=selected_agent)-avg(reward) FILTER (WHERE bandit_pick<>selected_agent),6) AS delta FROM v_decisions WHERE reward IS NOT NULL")
def composer_split(d):
    return observe.split_means(d, ~_overridden())


@query("a20_escalations", D, "SELECT strategy, count(*) AS n, round(avg(reward),6) AS mean_reward, round(avg(cost_usd),6) AS mean_cost, round(avg(latency_s),6) AS mean_latency, round(count(*)*100.0::DOUBLE/(SELECT count(*) FROM v_decisions),6) AS per_100 FROM v_decisions WHERE escalated_to IS NOT NULL GROUP BY strategy")
def escalations(d):
    return observe.escalations(d)


@query("a21_override_roi", D, "SELECT CASE WHEN bandit_pick<>selected_agent THEN 'overridden' ELSE 'kept' END AS kind, count(*) AS n, round(avg(reward),6) AS mean_reward, round(avg(1+CAST(k AS DOUBLE)/7),6) AS mean_weight, round(min(1+CAST(k AS DOUBLE)/7),6) AS min_weight, round(max(1+CAST(k AS DOUBLE)/7),6) AS max_weight FROM v_decisions GROUP BY 1")
def override_roi(d):
    return observe.override_roi(d, _overridden(), 1 + F.col("k").cast("double") / 7)


@query("a22_calibration", D, "WITH e AS (SELECT selected_agent AS agent, abs(CAST(k % 10 AS DOUBLE)/10 - reward) AS e FROM v_decisions WHERE reward IS NOT NULL AND k IS NOT NULL) SELECT agent, round(avg(e),6) AS mae, count(*) AS n FROM e GROUP BY agent UNION ALL SELECT NULL, round(avg(e),6), count(*) FROM e")
def calibration(d):
    return observe.calibration(d, (F.col("k") % 10).cast("double") / 10)


@query("a23_retrieval", D, "SELECT count(*) FILTER (WHERE k%4>0) AS with_hits, round(avg(CASE WHEN k%4>0 THEN CAST(k%4 AS DOUBLE) END),6) AS mean_hits, round(avg(CASE WHEN k%4>0 THEN latency_s/10 END),6) AS mean_similarity FROM v_decisions")
def retrieval(d):
    return observe.retrieval(d, F.col("k") % 4, F.col("latency_s") / 10)


@query("a24_drift_history", "events", "SELECT event_id, event_type FROM events WHERE event_type='error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def drift_history(e):
    return observe.drift_history(e.filter("event_type = 'error'"), 20).select("event_id", "event_type")


@query("a24_drift_resolve", "events", "SELECT count(*) AS total, count(*) FILTER (WHERE user_id % 3 <> 0 AND event_id NOT IN (1,2,3,4,5,6,7,8)) AS unresolved FROM events WHERE event_type='error'")
def drift_resolve(e):
    rows = e.filter("event_type = 'error'").withColumn("resolution", F.when(F.col("user_id") % 3 == 0, "seen"))
    return observe.drift_counts(observe.resolve(rows, [1, 2, 3, 4, 5, 6, 7, 8], "fixed"), F.col("resolution"))


@query("a25_alerts", D, "WITH r AS (SELECT * FROM v_decisions ORDER BY id DESC LIMIT 100) SELECT 'over budget' AS kind, 'last_100' AS subject, round(avg(cost_usd) FILTER (WHERE success IS NOT NULL),6) AS value FROM r HAVING avg(cost_usd) FILTER (WHERE success IS NOT NULL) > 0.0001 UNION ALL SELECT 'low success', 'last_100', round(avg(CAST(success AS DOUBLE)),6) FROM r HAVING avg(CAST(success AS DOUBLE)) < 0.4 AND count(success)>=10")
def alerts(d):
    return observe.alerts(d, 0.0001)


@query("a26_usage", D, "WITH r AS (SELECT * FROM v_decisions WHERE success IS NOT NULL), u AS (SELECT count(*) AS tasks, count(*) FILTER (WHERE escalated_to IS NULL) AS local, count(escalated_to) AS escalated, count(*) FILTER (WHERE correctness=1) AS accepted, count(*) FILTER (WHERE correctness=0) AS rejected, count(*) FILTER (WHERE correctness IS NULL) AS abstained, sum(CASE WHEN escalated_to IS NOT NULL THEN cost_usd ELSE 0 END) AS spend, avg(cost_usd) FILTER (WHERE escalated_to IS NOT NULL AND cost_usd>0) AS price FROM r) SELECT tasks, local, escalated, accepted, rejected, abstained, round(spend,6) AS spend, round(price,6) AS price, round(local*price,6) AS avoided, round(local*price/(local*price+spend),6) AS reduction FROM u")
def usage(d):
    return observe.usage(d)


@query("a26_usage_by_agent", D, "SELECT selected_agent, count(*) AS n, round(sum(cost_usd),6) AS cost, round(avg(CAST(success AS DOUBLE)),6) AS success_rate FROM v_decisions WHERE success IS NOT NULL GROUP BY selected_agent")
def usage_by_agent(d):
    return observe.usage_by_agent(d)


def _funnel_events(d):
    path = F.element_at(F.array(*map(F.lit, ["d.x/f.py", "f.MD", "a/.py", "f.R", "f.py.hpp"])), (F.col("k") % 5 + 1).cast("int"))
    tool = F.when(F.col("event_type") == "purchase", "run_task").when(F.col("event_type") == "view", "Edit").when(F.col("event_type") != "error", "Write").otherwise("Bash")
    c = observe.funnel_class(tool, path, F.repeat(F.lit("x\n"), (F.col("id") % 320).cast("int")), ["run_task", "run_batch"])
    return d.withColumn("c", c).filter("c IS NOT NULL").select("c.*", F.col("task_id").alias("session"), "ts", "id")


FUNNEL = "WITH c AS (SELECT *, CASE WHEN event_type='purchase' THEN 'delegated' ELSE 'inline' END AS event, CASE WHEN event_type='purchase' THEN '' WHEN event_type='view' THEN 'edit-in-place' WHEN k%5 IN (1,2) THEN 'non-code-file' WHEN id%320<4 THEN 'below-round-trip-threshold' WHEN id%320>=300 THEN 'oversized-for-local-arm' ELSE '' END AS reason FROM v_decisions WHERE event_type<>'error')"


@query("p08_funnel_class", D, FUNNEL + " SELECT event, reason, count(*) AS n FROM c GROUP BY ALL")
def funnel_class(d):
    return _funnel_events(d).groupBy("event", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("a27_funnel", D, FUNNEL + ", f AS (SELECT count(*) FILTER (WHERE event='delegated') AS delegated, count(*) FILTER (WHERE event='inline' AND reason='') AS candidates, count(*) FILTER (WHERE event='inline' AND reason<>'') AS excluded, count(DISTINCT task_id) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts FROM c) SELECT *, round(delegated/(delegated+candidates),6) AS rate, CASE WHEN delegated/(delegated+candidates)<0.1 THEN 'rarely delegated' WHEN delegated/(delegated+candidates)<0.5 THEN 'sometimes delegated' ELSE 'mostly delegated' END AS reading FROM f")
def funnel(d):
    return observe.funnel(_funnel_events(d))


@query("a28_resources", D, "WITH s AS (SELECT CASE WHEN event_type<>'view' THEN latency_s*10 END AS cpu, k FROM v_decisions) SELECT count(*) AS samples, round(sum(cpu)/count(*),6) AS cpu_avg, round(max(cpu),6) AS cpu_max, round(count(*) FILTER (WHERE cpu>=80)/count(*)::DOUBLE,6) AS hot_share, count(*) FILTER (WHERE k>90) AS elevated, CASE WHEN count(*) FILTER (WHERE k>90)>0 THEN 'critical' WHEN count(*) FILTER (WHERE cpu>=80)>=0.2*count(*) THEN 'strained' ELSE 'fine' END AS level FROM s")
def resources(d):
    cpu = F.when(F.col("event_type") != "view", F.col("latency_s") * 10)
    return observe.resources(d.select(cpu.alias("cpu_percent"), F.when(F.col("k") > 90, "elevated").otherwise("none").alias("thermal_level")))


@query("a28_warm_models", D, "SELECT model, count(*) AS n FROM (SELECT unnest([selected_agent, bandit_pick]) AS model FROM v_decisions) GROUP BY model")
def warm_models(d):
    return observe.warm_models(d.select(F.array("selected_agent", "bandit_pick").alias("warm_models")))


@query("a32_cost_by_model", "v_cost_ledger", "SELECT model, round(sum(cost_usd),6) AS cost, count(*) AS n FROM v_cost_ledger GROUP BY model")
def cost_by_model(c):
    return observe.cost_by(c, "model").orderBy(F.desc("cost"))


@query("a32_cost_by_user", "v_cost_ledger", "SELECT user_id, round(sum(cost_usd),6) AS cost, count(*) AS n FROM v_cost_ledger GROUP BY user_id")
def cost_by_user(c):
    return observe.cost_by(c, "user_id")


@query("a32_cost_summary", "v_cost_ledger", "SELECT round(sum(cost_usd),4) AS total, round(sum(cost_usd) FILTER (WHERE created_at >= TIMESTAMP '1996-01-01'),4) AS since, count(DISTINCT user_id) AS users FROM v_cost_ledger", 4)
def cost_summary(c):
    return observe.cost_summary(c, "1996-01-01 00:00:00")


@query("a36_live_report", D, "WITH r AS (SELECT * FROM v_decisions WHERE reward IS NOT NULL), m AS (SELECT avg(reward) AS m, count(*) AS t FROM r), g AS (SELECT selected_agent, count(*) AS n, avg(reward) AS mean_reward, sum(reward) AS reward_sum, count(*)/any_value(t) AS traffic, count(*) FILTER (WHERE reward<0.85*m)/count(*) AS exploration FROM r, m GROUP BY 1) SELECT selected_agent, n, round(mean_reward,6) AS mean_reward, round(reward_sum,6) AS reward_sum, round(traffic,6) AS traffic, round(exploration,6) AS exploration, reward_sum=(SELECT max(reward_sum) FROM g) AS top FROM g")
def live_report(d):
    return observe.live_report(d)


@query("a48_staleness", "v_verdicts", "SELECT count(*) AS labelled, count(*) >= 200*1.5 OR count(*) >= 700 AS stale FROM v_verdicts WHERE quality IS NOT NULL")
def staleness(v):
    return v.filter("quality IS NOT NULL").agg(F.count(F.lit(1)).alias("labelled")).withColumn("stale", observe.staleness(F.col("labelled"), F.lit(200)))


@query("a50_timeline", "events", "SELECT event_id, ts, event_type FROM events WHERE user_id=7")
def timeline(e):
    return observe.timeline(e.unionByName(e.filter("event_id % 5 = 0")), user_id=7).select("event_id", "ts", "event_type")


@query("a51_recent_per_user", D, "SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM v_decisions) WHERE rn<=5")
def recent_per_user(d):
    return observe.newest_per(d, "user_id", ["ts", "id"], 5).select("user_id", "id")


@query("a52_decay", D, "SELECT task_id, round(sum(CASE WHEN epoch(ts) < (SELECT epoch(max(ts)) FROM v_decisions)-864000 THEN latency_s*0.5 ELSE latency_s END),6) AS confidence FROM v_decisions GROUP BY task_id", 4)
def decay(d):
    top = d.agg((F.unix_micros(F.max("ts").cast("timestamp")) / F.lit(1e6)).alias("now")).withColumn("one", F.lit(1))
    rows = d.select("task_id", F.col("latency_s").alias("confidence"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("last_reinforced"), F.lit(1).alias("one")).join(top, "one")
    return observe.decay_stale(rows, F.col("now"), days=10).groupBy("task_id").agg(F.sum("confidence").alias("confidence"))


@query("k01_recent_decisions", D, "SELECT id, bucket, selected_agent FROM v_decisions ORDER BY id DESC LIMIT 50")
def recent_decisions(d):
    return observe.recent_decisions(d, 50).select("id", "bucket", "selected_agent")


@query("w01_rolling_reward", D, "SELECT id, selected_agent, round(avg(coalesce(reward,0)) OVER (PARTITION BY selected_agent ORDER BY id ROWS 19 PRECEDING),6) AS rolling FROM v_decisions")
def rolling_reward(d):
    return sequences.rolling_reward(d)


@query("w03_drift_alerts", D, "WITH r AS (SELECT id, bucket, selected_agent, count(*) OVER w AS n, avg(reward) OVER w AS mean, stddev_samp(reward) OVER w AS std, avg(reward) OVER (PARTITION BY bucket, selected_agent ORDER BY id ROWS 49 PRECEDING) AS recent FROM v_decisions WHERE reward IS NOT NULL WINDOW w AS (PARTITION BY bucket, selected_agent ORDER BY id ROWS UNBOUNDED PRECEDING)) SELECT id, bucket, selected_agent, n, round(mean,6) AS mean, round(std,6) AS std, round(recent,6) AS recent, round((mean-recent)/std,6) AS sigmas FROM r WHERE n>=20 AND n%10=0 AND std>0 AND recent < mean-0.2*std")
def drift_alerts(d):
    return sequences.drift_alerts(d, sigma=0.2)


@query("w04_budget_pacer", D, "WITH m AS (SELECT bucket, id, avg(cost_usd) OVER (PARTITION BY bucket ORDER BY id ROWS 99 PRECEDING) AS mean_cost FROM v_decisions), s AS (SELECT *, sum(0.5*(mean_cost-0.012)) OVER w AS s FROM m WINDOW w AS (PARTITION BY bucket ORDER BY id ROWS UNBOUNDED PRECEDING)) SELECT bucket, id, round(mean_cost,12) AS mean_cost, round(s-least(0.0, min(s) OVER (PARTITION BY bucket ORDER BY id ROWS UNBOUNDED PRECEDING)),12) AS multiplier, round(0.012-mean_cost,12) AS headroom, mean_cost>0.012 AS over FROM s", 12)
def budget_pacer(d):
    return sequences.budget_pacer(d, 0.012, "bucket")


REGRET = "r AS (SELECT bucket, id, greatest(0.0, 1.0 - coalesce(reward,0)) AS regret FROM v_decisions), s AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) AS t, sum(regret) OVER (PARTITION BY bucket ORDER BY id ROWS UNBOUNDED PRECEDING) AS cumulative, avg(regret) OVER (PARTITION BY bucket ORDER BY id ROWS 19 PRECEDING) AS rolling, count(*) OVER (PARTITION BY bucket) AS n FROM r)"


def _regret(d):
    return sequences.regret(d, "bucket", "id", F.lit(1.0), F.coalesce("reward", F.lit(0.0)))


@query("w05_regret", D, f"WITH {REGRET} SELECT bucket, id, round(regret,6) AS regret, CAST(t AS INTEGER) AS t, round(cumulative,6) AS cumulative, round(rolling,6) AS rolling FROM s")
def regret(d):
    return _regret(d)


@query("w05_regret_growth", D, f"WITH {REGRET}, g AS (SELECT bucket, CAST(any_value(n) AS INTEGER) AS n, avg(regret) FILTER (WHERE t <= greatest(1, n//5)) AS first_fifth, avg(regret) FILTER (WHERE t > n - greatest(1, n//5)) AS last_fifth, regr_slope(ln(cumulative), ln(t)) FILTER (WHERE t > n//10 AND cumulative>0) AS growth FROM s GROUP BY bucket) SELECT bucket, n, round(first_fifth,6) AS first_fifth, round(last_fifth,6) AS last_fifth, round(growth,6) AS growth, growth<0.8 AS sublinear FROM g")
def regret_growth(d):
    return sequences.regret_growth(_regret(d), "bucket")


@query("w06_drift_response", D, "WITH s AS (SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY id) AS t, CASE WHEN selected_agent='agent1' THEN 1.0::DOUBLE ELSE 0 END AS hit, id FROM v_decisions), w AS (SELECT *, avg(hit) OVER (PARTITION BY bucket ORDER BY t ROWS 19 PRECEDING) AS share FROM s) SELECT bucket, CAST(min(t) FILTER (WHERE t>200 AND hit>0)-200 AS INTEGER) AS detected, CAST(min(t) FILTER (WHERE t>200 AND share>=0.4)-200 AS INTEGER) AS recovered, round(avg(hit) FILTER (WHERE t<=200),6) AS share_before, round(avg(hit) FILTER (WHERE t>200),6) AS share_after FROM w GROUP BY bucket")
def drift_response(d):
    steps = _regret(d).join(d.select("id", "selected_agent"), "id")
    return sequences.drift_response(steps, "bucket", 200, F.col("selected_agent") == "agent1", recover=0.4)


@query("w07_swap_waste", D, "WITH s AS (SELECT bucket, row_number() OVER w AS t, lag(selected_agent) OVER w <> selected_agent AS swap, avg(CASE WHEN k%5=0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY bucket ORDER BY id ROWS 19 PRECEDING) AS e, count(*) OVER (PARTITION BY bucket ORDER BY id ROWS 19 PRECEDING) AS c FROM v_decisions WINDOW w AS (PARTITION BY bucket ORDER BY id)) SELECT bucket, count(*) FILTER (WHERE swap) AS swaps, CAST(min(t) FILTER (WHERE c=20 AND e<0.15) AS INTEGER) AS settled_at FROM s GROUP BY bucket")
def swap_waste(d):
    return sequences.swap_waste(d, "bucket", F.col("k") % 5 == 0)


W8_KIND = "CASE WHEN event_type IN ('purchase','error') THEN 'complete' ELSE 'submit' END"


@query("w08_retry_signal", D, f"WITH e AS (SELECT user_id, id, ts, {W8_KIND} AS kind, k%3 AS hash, event_type AS task_id FROM v_decisions), r AS (SELECT *, count(*) FILTER (WHERE kind='complete') OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM e), p AS (SELECT * FROM r WHERE kind='complete'), q AS (SELECT s.user_id, p.task_id, s.id AS by_id, s.run, CASE WHEN s.hash=p.hash AND epoch(s.ts)-epoch(p.ts)<=30000 THEN 0.0 WHEN s.hash<>p.hash AND epoch(s.ts)-epoch(p.ts)<=60000 THEN 0.6 END::DOUBLE AS signal, s.ts FROM r s JOIN p ON s.user_id=p.user_id AND s.run=p.run WHERE s.kind='submit') SELECT user_id, task_id, by_id, signal FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, by_id) AS k FROM q WHERE signal IS NOT NULL) WHERE k=1")
def retry_signal(d):
    kind = F.when(F.col("event_type").isin("purchase", "error"), "complete").otherwise("submit")
    events = d.select("user_id", "id", "ts", kind.alias("kind"), (F.col("k") % 3).alias("hash"), F.col("event_type").alias("task_id"))
    return sequences.retry_signal(events, 30000, 60000)


@query("w09_daily_cap", D, "WITH r AS (SELECT id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id)<=25 AS passes FROM v_decisions WHERE escalated_to IS NOT NULL) SELECT passes, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM r GROUP BY passes")
def daily_cap(d):
    return sequences.daily_cap(d.filter("escalated_to IS NOT NULL")).groupBy("passes").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("w10_age_cap", D, "WITH c AS (SELECT count(*) AS n FROM v_decisions), k AS (SELECT CASE WHEN n<=1000 THEN n ELSE 900+(n-1001)%100+1 END AS kept FROM c) SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS r FROM v_decisions), k WHERE r<=kept")
def age_cap(d):
    return sequences.age_cap(d.select("id"), limit=1000)


PTS = "p AS (SELECT o_orderkey AS id, o_totalprice AS x, CAST(o_custkey * 7919 % 1000003 AS DOUBLE) AS y FROM orders), f AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.x<=a.x AND b.y<=a.y AND (b.x<a.x OR b.y<a.y)))"


def _points(o):
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") * 7919 % 1000003).cast("double").alias("y"))


@query("k02_pareto_front", "orders", f"WITH {PTS} SELECT id, round(x,6) AS x, round(y,6) AS y FROM f")
def pareto_front(o):
    return sequences.pareto_front(_points(o), "x", "y").select("id", "x", "y")


@query("k03_knee", "orders", f"WITH {PTS}, r AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM f) SELECT id, round(x,6) AS x, round(y,6) AS y, round(((x-a)/(b-a))**2+((y-c)/(d-c))**2,6) AS d FROM f, r ORDER BY ((x-a)/(b-a))**2+((y-c)/(d-c))**2, id LIMIT 1")
def knee(o):
    return sequences.knee(sequences.pareto_front(_points(o), "x", "y"), "x", "y", "id")
