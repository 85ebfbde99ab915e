"""Queries of rewards, bandits, predictors and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlens.functions import text as X
from agentlens.operators import learning as L
from agentlens.plans.registry import query
from agentlens.plans.text_queries import PARTS

D, E, M = "v_decisions", "v_episodes", "v_task_metrics"
NAMES = ["code", "debug", "plan", "research", "review", "refactor", "security", "test", "other"]
BUCKET = "['" + "','".join(NAMES) + "'][user_id%9+1]"
WEIGHT = lambda i, w: "CASE " + BUCKET + " " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in w.items()) + f" ELSE {w['general'][i]} END::DOUBLE"
REWARD = lambda w: f"CASE WHEN success=1 THEN round(greatest(0.0, least(1.0, {WEIGHT(0, w)}*coalesce(correctness,1)+{WEIGHT(1, w)}*(k/100.0::DOUBLE)+{WEIGHT(2, w)}*exp(-latency_s/5)+{WEIGHT(3, w)}*(1-(exp(2*cost_usd/0.05)-1)/(exp(2*cost_usd/0.05)+1)) - CASE WHEN k*20>500 THEN 0.1*least(k*20/5000.0::DOUBLE,1.0) ELSE 0 END)),4) ELSE 0.0 END"
ALT = {k: (0.25, 0.25, 0.25, 0.25) for k in L.REWARD_WEIGHTS}


def _outcomes(d):
    bucket = F.get(F.array(*map(F.lit, NAMES)), (F.col("user_id") % 9).cast("int"))
    return d.withColumns({"bucket": bucket, "quality": F.col("k") / 100, "agent": F.col("selected_agent")})


@query("m01_reward", D, f"SELECT selected_agent, count(*) AS n, round(sum({REWARD(L.REWARD_WEIGHTS)}),2) AS total FROM v_decisions WHERE success IS NOT NULL GROUP BY 1", 2)
def reward(d):
    r = L.reward(F.col("bucket"), F.col("success"), F.col("quality"), F.col("latency_s"), F.col("cost_usd"), F.col("correctness"), F.col("k") * 20)
    return _outcomes(d).filter("success IS NOT NULL").groupBy("selected_agent").agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("total"))


PLAIN = lambda w: REWARD(w).replace(" - CASE WHEN k*20>500 THEN 0.1*least(k*20/5000.0::DOUBLE,1.0) ELSE 0 END", "")


@query("m02_reweight", D, f"WITH g AS (SELECT {BUCKET} AS bucket, selected_agent AS agent, count(*) AS n, avg({PLAIN(L.REWARD_WEIGHTS)}) AS base, avg({PLAIN(ALT)}) AS alt FROM v_decisions WHERE success IS NOT NULL GROUP BY ALL) SELECT bucket, agent, n, round(base,5) AS base, round(alt,5) AS alt, round(max(base) OVER w - min(base) OVER w,5) AS base_gap, round(max(alt) OVER w - min(alt) OVER w,5) AS alt_gap FROM g WINDOW w AS (PARTITION BY bucket)", 5)
def reweight(d):
    return L.reweight(_outcomes(d), ALT)


VARIANTS = {"base": (0.45, 0.25, 0.2, 0.1), "no length": (0.55, 0.25, 0.2, 0.0), "novelty": (0.0, 1.0, 0.0, 0.0), "structure": (1.0, 0.0, 0.0, 0.0), "no plan": (0.55, 0.35, 0.0, 0.1), "even": (0.25, 0.25, 0.25, 0.25)}
VARIANT_SQL = ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in w)})" for k, w in VARIANTS.items())


@query("m05_quality_variants", "v_results", f"WITH {PARTS}, s AS (SELECT variant, r.bucket, r.agent, length(r.output)::DOUBLE AS tokens, a*structural+b*novelty+p*not_plan+l*length AS score FROM c JOIN v_results r USING (conv_id, turn), (VALUES {VARIANT_SQL}) w(variant,a,b,p,l)), g AS (SELECT variant, bucket, max(m)-min(m) AS gap FROM (SELECT variant, bucket, agent, avg(score) AS m FROM s GROUP BY ALL) GROUP BY ALL) SELECT variant, bucket, round(any_value(gap),6) AS gap, count(*) AS n, round(corr(score, tokens),6) AS r FROM s JOIN g USING (variant, bucket) GROUP BY variant, bucket")
def quality_variants(r):
    c = r.select("bucket", "agent", F.length("output").alias("tokens"), X.prose_components(F.col("prompt"), F.col("output"), F.col("bucket")).alias("c")).select("bucket", "agent", "tokens", "c.*")
    return L.quality_variants(c, VARIANTS)


SOFT = "s AS (SELECT id, selected_agent, bandit_pick, k/100.0::DOUBLE AS a, latency_s/10 AS b, (k%7)/7.0::DOUBLE AS c FROM v_decisions), t AS (SELECT *, greatest(0.05, sqrt(((a-(a+b+c)/3)**2+(b-(a+b+c)/3)**2+(c-(a+b+c)/3)**2)/3)) AS t, greatest(a,b,c) AS m FROM s), e AS (SELECT *, exp((a-m)/t) AS ea, exp((b-m)/t) AS eb, exp((c-m)/t) AS ec FROM t)"


def _scores(d):
    return d.withColumn("scores", F.create_map(F.lit("agent0"), F.col("k") / 100, F.lit("agent1"), F.col("latency_s") / 10, F.lit("agent2"), F.col("k") % 7 / F.lit(7.0)))


@query("m06_importance_weight", D, f"WITH {SOFT} SELECT id, round(CASE WHEN bandit_pick=selected_agent THEN 1.0 ELSE greatest(0.001, coalesce(CASE selected_agent WHEN 'agent0' THEN ea WHEN 'agent1' THEN eb WHEN 'agent2' THEN ec END/(ea+eb+ec), 0.001)) END,6) AS w FROM e")
def importance_weight(d):
    return _scores(d).select("id", L.importance_weight(F.col("bandit_pick"), F.col("selected_agent"), F.col("scores")).alias("w"))


@query("m07_escalation_hint", D, f"WITH {SOFT}, g AS (SELECT id, list_sort([a,b,c],'DESC') AS l, b AS v FROM e) SELECT id, v>0.9 OR l[1]-l[2]<0.05 AS escalate, round(l[1]-l[2],6) AS gap FROM g")
def escalation_hint(d):
    return _scores(d).select("id", L.escalation_hint(F.col("latency_s") / 10, F.col("scores"), high=0.9).alias("h")).select("id", "h.*")


@query("m08_compose", D, f"WITH {SOFT}, p AS (SELECT *, CASE bandit_pick WHEN 'agent0' THEN a WHEN 'agent1' THEN b ELSE c END AS p, CASE WHEN a>=b AND a>=c THEN 'agent0' WHEN b>=c THEN 'agent1' ELSE 'agent2' END AS top FROM e), q AS (SELECT id, CASE WHEN top<>bandit_pick AND m-p>=0.2 THEN top ELSE bandit_pick END AS agent, id%2=0 AND NOT (id%10)/10.0>=0.55 AND NOT p>=0.75 AS escalate, bandit_pick FROM p) SELECT id, agent, escalate, CASE WHEN NOT escalate THEN 'none' WHEN agent<>bandit_pick THEN 'double run' ELSE 'verify' END AS kind FROM q")
def compose(d):
    return _scores(d).select("id", L.compose(F.col("bandit_pick"), F.col("id") % 2 == 0, F.col("scores"), F.col("id") % 10 / F.lit(10.0)).alias("c")).select("id", "c.*")


@query("m09_should_escalate", D, f"SELECT id FROM v_decisions WHERE {BUCKET} IN ('code','test','refactor','debug') AND (k%17=0 OR coalesce(correctness=0,false))")
def should_escalate(d):
    return _outcomes(d).filter(L.should_escalate(F.col("correctness"), F.col("bucket"), F.col("k") % 17 == 0)).select("id")


def _log(d):
    return d.filter("reward IS NOT NULL").withColumns({"agent": F.col("selected_agent"), "x0": F.lit(1.0), "x1": F.col("k") / 100, "x2": F.col("latency_s") / 10})


LIN = "l AS (SELECT selected_agent AS agent, 1.0::DOUBLE AS x0, k/100.0::DOUBLE AS x1, latency_s/10 AS x2, reward, pow(0.98::DOUBLE, row_number() OVER (PARTITION BY selected_agent ORDER BY id DESC)-1) AS g FROM v_decisions WHERE reward IS NOT NULL)"


@query("m10_linucb_state", D, f"WITH {LIN} SELECT agent, count(*) AS n, round(sum(g*x0*x0)+pow(0.98::DOUBLE,count(*)),6) AS a00, round(sum(g*x0*x1),6) AS a01, round(sum(g*x1*x2),6) AS a12, round(sum(g*x2*x2)+pow(0.98::DOUBLE,count(*)),6) AS a22, round(sum(g*reward*x1)+0.5*pow(0.98::DOUBLE,count(*)),6) AS b1 FROM l GROUP BY agent")
def linucb_state(d):
    s = L.linucb_state(_log(d), ["agent"], ["x0", "x1", "x2"], F.lit(1.0))
    return s.select("agent", "n", s.a[0].alias("a00"), s.a[1].alias("a01"), s.a[5].alias("a12"), s.a[8].alias("a22"), s.b[1].alias("b1"))


def _solved(x: tuple[float, float, float]) -> str:
    """Common table expressions from s (bucket, agent, a00 .. a22, b0 .. b2) to v: exploit and variance at x, by cofactors."""
    plus = "a00+1e-9 AS p, a01 AS q, a02 AS r, a11+1e-9 AS u, a12 AS v, a22+1e-9 AS w"
    inverse = {"00": "u*w-v*v", "01": "r*v-q*w", "02": "q*v-r*u", "11": "p*w-r*r", "12": "q*r-p*v", "22": "p*u-q*q"}
    at = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    form = lambda right: " + ".join(f"{x[i]}::DOUBLE*{at(i, j)}*{right(j)}" for i in range(3) for j in range(3))
    return f"""t AS (SELECT *, {plus} FROM s), d AS (SELECT *, p*(u*w-v*v)-q*(q*w-v*r)+r*(q*v-u*r) AS det FROM t),
i AS (SELECT bucket, agent, b0, b1, b2, {', '.join(f'({e})/det AS i{k}' for k, e in inverse.items())} FROM d),
v AS (SELECT bucket, agent, {form(lambda j: f'b{j}')} AS exploit, greatest({form(lambda j: f'{x[j]}::DOUBLE')}, 0) AS variance FROM i)"""


CELL = LIN.replace("PARTITION BY selected_agent", "PARTITION BY bucket, selected_agent").replace("SELECT selected_agent AS agent", "SELECT bucket, selected_agent AS agent")
STATE = lambda own, b: "s AS (SELECT bucket, agent, " + ", ".join(f"sum(g*x{i}*x{j}) + pow(0.98::DOUBLE,count(*))*{own(i, j)} AS a{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"sum(g*reward*x{i}) + pow(0.98::DOUBLE,count(*))*{b(i)} AS b{i}" for i in range(3)) + " FROM l GROUP BY bucket, agent)"
AT, MID = (1.0, 0.5, 0.3), (1.0, 0.5, 0.5)


@query("m10_linucb_scores", D, f"WITH {CELL}, {STATE(lambda i, j: float(i == j), lambda i: 0.5)}, {_solved(AT)} SELECT bucket, agent, round(exploit+sqrt(variance),6) AS ucb, round(exploit,6) AS exploit, round(sqrt(variance),6) AS explore, round(variance,6) AS variance FROM v")
def linucb_scores(d):
    s = L.linucb_state(_log(d), ["bucket", "agent"], ["x0", "x1", "x2"], F.lit(1.0))
    return s.select("bucket", "agent", L.linucb_scores("a", "b", F.array(F.lit(1.0), F.lit(0.5), F.lit(0.3)), F.lit(1.0)).alias("s")).select("bucket", "agent", "s.*")


@query("m11_ucb1", D, "WITH g AS (SELECT selected_agent AS agent, count(reward) AS n, avg(reward) AS mean FROM v_decisions GROUP BY 1), t AS (SELECT sum(n) AS t FROM g) SELECT agent, n, round(mean,6) AS mean, round(1.41421356*sqrt(ln(t)/n),6) AS bonus, round(mean+1.41421356*sqrt(ln(t)/n),6) AS score FROM g, t")
def ucb1(d):
    return L.ucb1(d.withColumn("agent", F.col("selected_agent")))


@query("m12_thompson", D, "SELECT selected_agent AS agent, count(*) FILTER (WHERE reward>0.5)+1 AS alpha, count(*) FILTER (WHERE reward<=0.5)+1 AS beta, round((count(*) FILTER (WHERE reward>0.5)+1)/(count(reward)+2),6) AS mean FROM v_decisions WHERE reward IS NOT NULL GROUP BY 1")
def thompson(d):
    return L.thompson(_log(d))


@query("m12_thompson_draws", D, None)
def thompson_draws(d):
    return L.thompson_draws(L.thompson(_log(d)), 20, 3)


PREFS = {"code": ["agent2", "agent1"], "plan": ["agent3"], "general": ["agent1", "agent0"]}


@query("m13_static_route", D, f"SELECT id, CASE WHEN {BUCKET}='code' THEN CASE WHEN 'agent2' IN (selected_agent,bandit_pick) THEN 'agent2' WHEN 'agent1' IN (selected_agent,bandit_pick) THEN 'agent1' ELSE selected_agent END WHEN {BUCKET}='plan' THEN CASE WHEN 'agent3' IN (selected_agent,bandit_pick) THEN 'agent3' ELSE selected_agent END ELSE CASE WHEN 'agent1' IN (selected_agent,bandit_pick) THEN 'agent1' WHEN 'agent0' IN (selected_agent,bandit_pick) THEN 'agent0' ELSE selected_agent END END AS route FROM v_decisions")
def static_route(d):
    return _outcomes(d).select("id", L.static_route(F.col("bucket"), F.array("selected_agent", "bandit_pick"), PREFS).alias("route"))


WARM = STATE(lambda i, j: f"({float(i == j)}+{2 * MID[i] * MID[j]})", lambda i: f"(0.5+{2 * MID[i]}*avg(reward))")


@query("m14_warm_start_spread", D, f"WITH {CELL}, {WARM}, {_solved(MID)}, w AS (SELECT bucket, max(exploit)-min(exploit) AS spread FROM v GROUP BY bucket) SELECT bucket, round(spread,6) AS spread, (SELECT count(*) FILTER (WHERE spread>0.01)>=3 FROM w) AS passes FROM w")
def warm_start(d):
    log = _log(d)
    pseudo = log.groupBy("bucket", "agent").agg(F.avg("reward").alias("reward")).select("bucket", "agent", "reward", F.lit(1.0).alias("x0"), F.lit(0.5).alias("x1"), F.lit(0.5).alias("x2"), F.lit(2.0).alias("w"))
    s = L.linucb_state(log, ["bucket", "agent"], ["x0", "x1", "x2"], F.lit(1.0), pseudo=pseudo)
    return L.routing_spread(s.select("bucket", L.linucb_scores("a", "b", F.array(F.lit(1.0), F.lit(0.5), F.lit(0.5)), F.lit(1.0))["exploit"].alias("exploit")), least=0.01)


@query("m15_counterfactual", D, "WITH g AS (SELECT bucket, selected_agent AS agent, avg(reward) AS e, count(*) AS n FROM v_decisions WHERE reward IS NOT NULL GROUP BY ALL HAVING count(*)>=5), c AS (SELECT DISTINCT bucket, selected_agent AS agent FROM v_decisions) SELECT bucket, agent, round(coalesce(e,0.5),6) AS estimate, n FROM c LEFT JOIN g USING (bucket, agent)")
def counterfactual(d):
    return L.estimated(d.select("bucket", F.col("selected_agent").alias("agent")).distinct(), L.counterfactual(_log(d)))


@query("m16_replay", D, None)
def replay(d):
    log = _log(d).withColumn("x", F.array("x0", "x1", "x2"))
    return L.replay(log.select("id", "bucket", "agent", "reward", "x", (F.col("user_id") % 8).alias("slice")), L.counterfactual(log).drop("n"), [("base", 1.0, 0.98), ("greedy", 0.1, 0.98)], ["agent0", "agent1", "agent2", "agent3"], "slice")


def _fidelity(d):
    return _outcomes(d).filter("success IS NOT NULL").withColumn("passed", F.col("success") == 1)


@query("m17_reward_fidelity", D, f"WITH r AS (SELECT 'base' AS variant, selected_agent AS agent, success=1 AS passed, {PLAIN(L.REWARD_WEIGHTS)} AS r FROM v_decisions WHERE success IS NOT NULL UNION ALL SELECT 'even', selected_agent, success=1, {PLAIN(ALT)} FROM v_decisions WHERE success IS NOT NULL), a AS (SELECT variant, agent, avg(r) AS m, avg(passed::INT::DOUBLE) AS p FROM r GROUP BY ALL), c AS (SELECT variant, corr(r, passed::INT::DOUBLE) AS r FROM r GROUP BY ALL) SELECT variant, agent, round(m,5) AS mean_reward, round(p,5) AS pass_rate, round(max(m) OVER w - min(m) OVER w,5) AS gap, arg_max(agent,m) OVER w AS leader, round(c.r,5) AS r FROM a JOIN c USING (variant) WINDOW w AS (PARTITION BY variant)", 5)
def reward_fidelity(d):
    return L.reward_fidelity(_fidelity(d), {"base": L.REWARD_WEIGHTS, "even": ALT})


@query("m17_orderings", D, None)
def orderings(d):
    m = _log(d).groupBy(F.lit("base").alias("variant"), F.concat("bucket", F.lit("-"), (F.col("k") % 5).cast("string")).alias("prompt"), "agent").agg(F.avg("reward").alias("reward"))
    whole = m.groupBy("prompt").count().filter("count = 4").select("prompt")
    x = F.array(F.lit(1.0), F.length("prompt") / 10, F.substring("prompt", -1, 1).cast("double") / 5)
    return L.fidelity_verdict(L.orderings(m.join(whole, "prompt", "left_semi").withColumn("x", x), ["agent0", "agent1", "agent2", "agent3"], 6, 11))


@query("m18_learned_weights", D, None)
def learned_weights(d):
    rows = _outcomes(d).filter("success = 1").select("id", "bucket", F.coalesce("correctness", F.lit(1.0)).alias("correctness"), "quality", F.exp(-F.col("latency_s") / 5).alias("speed"), (1 - F.tanh(F.col("cost_usd") / 0.05)).alias("cost"), "reward")
    found = L.learned_weights(rows)
    return found.select("bucket", "n", *[F.col("fitted")[i].alias(f"f{i}") for i in range(4)], *[F.col("blended")[i].alias(f"b{i}") for i in range(4)])


def _training(d):
    log = _log(d).withColumns({"x": F.array("x0", "x1", "x2"), "quality": F.when(F.col("k") % 2 == 0, F.col("k") / 100)})
    return L.training_rows(log, ["agent0", "agent1"], d=3)


@query("m19_training_rows", D, "SELECT id, selected_agent AS agent, CASE WHEN k%2=0 THEN (k>=70)::INTEGER ELSE success END AS label, 5 AS width FROM v_decisions WHERE reward IS NOT NULL AND (k%2=0 OR success IS NOT NULL)")
def training_rows(d):
    return _training(d).select("id", "agent", "label", F.size("features").alias("width"))


@query("m20_predictor", D, None)
def predictor(d):
    rows = _training(d)
    test = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    w = L.logistic(rows.filter(~test), 5)
    return L.evaluation(L.predicted(rows.filter(test), w))


@query("m20_auc", M, "WITH r AS (SELECT capability_bucket, success, rank() OVER (PARTITION BY capability_bucket ORDER BY quality_score)+(count(*) OVER (PARTITION BY capability_bucket, quality_score)-1)/2.0::DOUBLE AS k FROM v_task_metrics WHERE success IS NOT NULL) SELECT capability_bucket, round((sum(k) FILTER (WHERE success=1)-count(*) FILTER (WHERE success=1)*(count(*) FILTER (WHERE success=1)+1)/2.0)/(count(*) FILTER (WHERE success=1)*nullif(count(*) FILTER (WHERE success=0),0))::DOUBLE,6) AS auc FROM r GROUP BY capability_bucket")
def auc(m):
    return L.auc(m.filter("success IS NOT NULL"), "quality_score", "success", ["capability_bucket"])


@query("m21_score_table", D, "SELECT id, agent, round(1/(1+exp(-(0.3+0.5*k/100.0::DOUBLE-0.2*latency_s/10+CASE WHEN agent='agent0' THEN 0.1 ELSE 0 END))),6) AS p FROM v_decisions, (SELECT unnest(['agent0','agent1']) AS agent) WHERE reward IS NOT NULL")
def score_table(d):
    cells = _log(d).withColumn("agent", F.explode(F.array(F.lit("agent0"), F.lit("agent1"))))
    flags = F.array((F.col("agent") == "agent0").cast("double"), (F.col("agent") == "agent1").cast("double"))
    return L.predicted(cells.withColumn("features", F.concat(F.array("x1", "x2"), flags)), [0.5, -0.2, 0.1, 0.0, 0.3]).select("id", "agent", "p")


NEAR = "q AS (SELECT vec_id AS query, embedding AS q FROM v_episodes WHERE vec_id%50=0), n AS (SELECT query, vec_id, {d} AS distance FROM q, v_episodes), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM n)"
SQ = "round(list_sum(list_transform(list_zip(q::DOUBLE[], embedding::DOUBLE[]), lambda x: (x[1]-x[2])*(x[1]-x[2]))),9)"
IP = "round(1-list_sum(list_transform(list_zip(q::DOUBLE[], embedding::DOUBLE[]), lambda x: x[1]*x[2])),9)"


def _queries(e):
    return e.filter("vec_id % 50 = 0")


@query("k04_nearest_l2", E, f"WITH {NEAR.format(d=SQ)} SELECT query, vec_id, round(distance,6) AS distance, rank::INTEGER AS rank FROM r WHERE rank<=10")
def nearest_l2(e):
    return L.nearest(e, _queries(e), 10)


@query("k05_nearest_dot", E, f"WITH {NEAR.format(d=IP)} SELECT query, vec_id, round(distance,6)+0.0 AS distance, rank::INTEGER AS rank FROM r WHERE rank<=5")
def nearest_dot(e):
    return L.nearest(e, _queries(e), 5, inner=True)


BIAS = NEAR.format(d=SQ) + ", b AS (SELECT query, agent, sum(exp(-distance)*reward)/sum(exp(-distance)) AS bias, count(*) AS n FROM r JOIN v_episodes USING (vec_id) WHERE rank<=10 GROUP BY query, agent HAVING count(*)>=3)"


@query("m22_memory_bias", E, f"WITH {BIAS} SELECT query, agent, round(bias,6) AS bias, n, round(least(n/5,1.0),6) AS confidence FROM b")
def memory_bias(e):
    return L.memory_bias(L.nearest(e, _queries(e), 10), e)


@query("m23_blended_pick", E, f"WITH {BIAS}, s AS (SELECT query, agent, ((query+length(agent)+ascii(right(agent,1)))%10)/10.0::DOUBLE AS ucb FROM q, (SELECT DISTINCT agent FROM v_episodes)), v AS (SELECT s.query, s.agent, CASE WHEN bias IS NULL THEN ucb ELSE (1-0.5*least(n/5,1.0))*ucb+0.5*least(n/5,1.0)*bias END AS v FROM s LEFT JOIN b ON b.query=s.query AND b.agent=s.agent) SELECT query, agent, round(v,6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY v DESC, agent) AS k FROM v) WHERE k=1")
def blended_pick(e):
    arms = e.agg(F.collect_set("agent").alias("arms"))
    s = _queries(e).select(F.col("vec_id").alias("query")).join(F.broadcast(arms), how="cross").withColumn("agent", F.explode("arms"))
    s = s.select("query", "agent", ((F.col("query") + F.length("agent") + F.ascii(F.substring("agent", -1, 1))) % 10 / F.lit(10.0)).alias("ucb"))
    return L.blended_pick(s, L.memory_bias(L.nearest(e, _queries(e), 10), e), 0.5)


@query("m24_memory_backfill", D, "SELECT sha256(lower(trim(task_id || '-' || (k%4)))) AS task_hash, selected_agent AS agent, round(avg(reward),6) AS reward, count(*) AS n, round(arg_min(k/100.0::DOUBLE, id),6) AS x1 FROM v_decisions WHERE reward IS NOT NULL GROUP BY ALL HAVING count(*)>=2")
def memory_backfill(d):
    log = _log(d).withColumn("x", F.array("x1"))
    return L.memory_backfill(log, F.concat("task_id", F.lit("-"), (F.col("k") % 4).cast("string")), 2).select("task_hash", "agent", "reward", "n", F.col("x")[0].alias("x1"))


@query("m25_memory_inventory", E, "SELECT agent, count(*) AS n, count(*) FILTER (WHERE vec_id%3<>0) AS embedded FROM v_episodes GROUP BY ROLLUP(agent)")
def memory_inventory(e):
    return L.memory_inventory(e.withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding"))))


@query("m27_consensus", D, "WITH v AS (SELECT CAST(id//4 AS BIGINT) AS task, id%4 AS i, 10.0::DOUBLE+(k%3) AS v FROM v_decisions), c AS (SELECT a.task, a.i, count(*) AS n, count(*) FILTER (WHERE abs(a.v-b.v)/greatest(abs(a.v),abs(b.v),1e-9)<=0.02) AS size, avg(b.v) FILTER (WHERE abs(a.v-b.v)/greatest(abs(a.v),abs(b.v),1e-9)<=0.02) AS mean FROM v a JOIN v b ON a.task=b.task GROUP BY ALL) SELECT task, CASE WHEN size>=2 AND 2*size>n THEN round(mean,6) END AS value FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY size DESC, i) AS k FROM c) WHERE k=1")
def consensus(d):
    return L.consensus(d.select(F.floor(F.col("id") / 4).alias("task"), (F.col("id") % 4).alias("i"), (F.lit(10.0) + F.col("k") % 3).alias("v")), "task")


def quarantine_events(d):
    alert = (F.col("event_type") == "error") & (F.col("k") % 11 == 0)
    return d.select("bucket", "id", F.when(alert, "alert").otherwise("decision").alias("kind"), F.col("selected_agent").alias("agent"), F.when(alert, F.col("latency_s")).otherwise(F.coalesce("reward", F.lit(0.0))).alias("value"))


@query("m28_quarantine_replay", D, None)
def quarantine_replay(d):
    return L.quarantine_replay(quarantine_events(d))


@query("m28_least_bad", D, "SELECT bucket, arg_min(selected_agent, (latency_s, selected_agent)) AS agent FROM v_decisions WHERE event_type='error' GROUP BY bucket")
def least_bad(d):
    return L.least_bad(d.filter("event_type = 'error'").select("bucket", F.col("selected_agent").alias("agent"), F.col("latency_s").alias("deviation")))
