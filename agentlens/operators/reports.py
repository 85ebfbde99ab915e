"""Multi-level reports: rankings, matrices, costs, graded runs, judges, policies, seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions.stats import as_double, share, wilson, wilson_ranking
from agentlens.operators.scans import attached
from agentlens.operators.selection import medians

#: Two-sided 95 % quantiles of Student's t by degrees of freedom; beyond, the normal's.
T_TABLE = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086, 25: 2.060, 29: 2.045}


def newest(rows: DataFrame, n: int, order: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def rankings(sources: list[DataFrame], harness: DataFrame | None, key: list[str], newest_rows: int = 5000, live_weight: float = 0.7) -> DataFrame:
    """Agents ranked by a blend of live and harness success: live sources (agent, success, reward, latency_s and key) are
    read newest first up to a bound, harness rows are (agent, n, success_rate). Without a side the other counts alone.
    Order: blended rate, lower end of the interval, samples, name."""
    live = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [newest(s, newest_rows) for s in sources]).filter("success IS NOT NULL")
    by = live.groupBy(*key, "agent").agg(F.count(F.lit(1)).alias("n"), F.sum("success").alias("k"), F.avg("reward").alias("mean_reward"))
    by = attached(by, medians(live, [*key, "agent"], "latency_s", "median_latency"), [*key, "agent"])
    by = by.withColumn("rate", share(F.col("k"), F.col("n"))).withColumn("lo", wilson_ranking(F.col("k"), F.col("n"))["lo"])
    if harness is not None:
        by = by.join(harness.select("agent", F.col("success_rate").alias("h")), "agent", "full").withColumn("rate", F.coalesce(live_weight * F.col("rate") + (1 - live_weight) * F.col("h"), "rate", "h")).drop("h")
    w = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy(F.desc_nulls_last("rate"), F.desc_nulls_last("lo"), F.desc_nulls_last("n"), "agent")
    return by.withColumn("rank", F.row_number().over(w)).drop("k")


def upper_quantile(rows: DataFrame, key: list[str], value: str, q: float) -> DataFrame:
    """The element at index floor(n * q) of a group's sorted values (for q = 0.5 the upper median), by rank."""
    w = Window.partitionBy(*key).orderBy(value)
    ranked = rows.filter(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    return ranked.filter(F.col("_i") == F.least(F.floor(F.col("_n") * q), F.col("_n") - 1)).select(*key, value)


def compatibility(metrics: DataFrame) -> DataFrame:
    """(bucket, agent), agents alone and buckets alone in one pass: sums per cell are rolled up by grouping sets."""
    cell = metrics.groupBy("capability_bucket", "agent_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("success").alias("k"), F.sum("success").alias("s"), F.sum("quality_score").alias("q"), F.sum("reward_score").alias("r"), F.sum("wall_time_ms").alias("w")
    )
    sets = cell.groupingSets([["capability_bucket", "agent_name"], ["agent_name"], ["capability_bucket"]], "capability_bucket", "agent_name")
    n = F.sum("n")
    return sets.agg(n.alias("n"), share(F.sum("s"), F.sum("k")).alias("success_rate"), share(F.sum("q"), n).alias("mean_quality"), share(F.sum("r"), n).alias("mean_reward"), share(F.sum("w"), n).alias("mean_ms"))


def best_agents(matrix: DataFrame, metric: str, lower: bool = False, least: int = 1) -> DataFrame:
    """Per bucket the agent with the best metric among cells with enough samples; ties by name."""
    v = -F.col(metric) if lower else F.col(metric)
    cells = matrix.filter("capability_bucket IS NOT NULL AND agent_name IS NOT NULL").filter(F.col("n") >= least)
    w = Window.partitionBy("capability_bucket").orderBy(v.desc_nulls_last(), "agent_name")
    return cells.withColumn("k", F.row_number().over(w)).filter("k = 1").select("capability_bucket", F.col("agent_name").alias("best"), F.col(metric).alias("value"))


def cost_report(metrics: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Per bucket and in total: actual cost, what all rows would cost on the cloud (the actual cost where it ran there),
    avoided (all local rows, and only successful ones), local share, rows without tokens to price."""
    cloud = F.startswith("agent_name", F.lit("cloud"))
    would = (F.col("prompt_tokens") * input_price + F.col("tokens_generated") * output_price) / 1e6
    r = metrics.select(
        "capability_bucket", F.col("cost_usd").alias("a"), F.when(cloud, F.col("cost_usd")).otherwise(would).alias("w"), F.when(~cloud, would - F.col("cost_usd")).alias("v"),
        F.when(~cloud & (F.col("success") == 1), would - F.col("cost_usd")).alias("vs"), (~cloud).cast("int").alias("l"), F.col("prompt_tokens").isNull().cast("int").alias("m"),
    )
    return r.rollup("capability_bucket").agg(F.sum("a").alias("actual"), F.sum("w").alias("all_cloud"), F.sum("v").alias("avoided"), F.sum("vs").alias("avoided_success"), share(F.sum("l"), F.count(F.lit(1))).alias("local_share"), F.sum("m").alias("unpriced"))


def ab_summary(rows: DataFrame) -> DataFrame:
    """Per run (run_id; success, reward, latency_s): success rate, mean reward, upper median and index p90 of latency."""
    base = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg(as_double("success")).alias("success_rate"), F.avg("reward").alias("mean_reward"))
    at = lambda q, name: upper_quantile(rows, ["run_id"], "latency_s", q).withColumnRenamed("latency_s", name)
    return base.join(at(0.5, "latency_p50"), "run_id", "left").join(at(0.9, "latency_p90"), "run_id", "left")


def ab_delta(summary: DataFrame, on: str, off: str) -> DataFrame:
    a, b = (summary.filter(F.col("run_id") == r).select(*[F.col(c).alias(f"{p}_{c}") for c in ("success_rate", "mean_reward", "latency_p50")], F.lit(1).alias("one")) for r, p in ((on, "on"), (off, "off")))
    return a.join(b, "one").select(*[(F.col(f"on_{c}") - F.col(f"off_{c}")).alias(f"delta_{c}") for c in ("success_rate", "mean_reward", "latency_p50")])


def batch_summary(results: DataFrame) -> DataFrame:
    """Per agent: answered share, errors, timeouts, mean latency, tokens and tokens a second."""
    ok = F.col("error").isNull() & ~F.col("timed_out")
    return results.groupBy("agent").agg(
        F.count(F.lit(1)).alias("n"), share(F.count_if(ok), F.count(F.lit(1))).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("timed_out").alias("timeouts"),
        F.avg(F.when(ok, F.col("elapsed_s"))).alias("mean_latency"), F.sum(F.when(ok, F.col("tokens"))).alias("tokens"), share(F.sum(F.when(ok, F.col("tokens"))), F.sum(F.when(ok, F.col("elapsed_s")))).alias("tokens_per_s"),
    )


def speed_by_tier(rows: DataFrame, tiers: list) -> DataFrame:
    return rows.groupBy("agent_name").pivot("tier", tiers).agg(F.avg("wall_time_ms"))


def pass_at_1(graded: DataFrame) -> DataFrame:
    """(bucket, agent) and agent alone: cases, passed, pass@1, empty outputs, mean heuristic."""
    cell = graded.groupBy("bucket", "agent").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.count_if(F.trim("output") == "").alias("empty"), F.sum("heuristic").alias("h"))
    n = F.sum("n")
    return cell.groupingSets([["bucket", "agent"], ["agent"]], "bucket", "agent").agg(n.alias("n"), F.sum("passed").alias("passed"), share(F.sum("passed"), n).alias("pass_at_1"), F.sum("empty").alias("empty"), share(F.sum("h"), n).alias("mean_heuristic"))


def spearman(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Per key, 1 - 6 sum d^2 / (n (n^2 - 1)) over average ranks; null under two rows."""
    def rank(c: str) -> Column:
        w = Window.partitionBy(key)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(key, c)) - 1) / 2

    d = rows.select(key, (rank(x) - rank(y)).alias("d"))
    n = F.count(F.lit(1)).cast("double")
    return d.groupBy(key).agg((1 - F.try_divide(6 * F.sum(F.col("d") * F.col("d")), n * (n * n - 1))).alias("rho"))


def inversions(means: DataFrame, x: str, y: str) -> DataFrame:
    """Agents whose rank by one mean is not their rank by the other."""
    w = lambda c: Window.partitionBy("bucket").orderBy(F.desc(c), "agent")
    return means.withColumns({"rank_x": F.row_number().over(w(x)), "rank_y": F.row_number().over(w(y))}).filter("rank_x <> rank_y")


def routed_metrics(cases: DataFrame) -> DataFrame:
    """One row of routed cases; a figure is null where the case table lacks its column."""
    has = set(cases.columns)
    rate = lambda c: share(F.count_if(c), F.count(F.lit(1))) if c in has else F.lit(None).cast("double")
    caught = share(F.count_if(~F.col("local_passed") & F.col("escalated")), F.count_if(~F.col("local_passed"))) if {"local_passed", "escalated"} <= has else F.lit(None).cast("double")
    per_1k = F.avg("total_cost") * 1000 if "total_cost" in has else F.lit(None).cast("double")
    cut = 1 - F.try_divide(F.sum("total_cost"), F.sum("cloud_cost")) if {"total_cost", "cloud_cost"} <= has else F.lit(None).cast("double")
    return cases.agg(F.count(F.lit(1)).alias("n"), rate("final_passed").alias("routed"), rate("cloud_passed").alias("cloud"), rate("local_passed").alias("local"), rate("escalated").alias("escalation_rate"), caught.alias("fail_recall"), per_1k.alias("usd_per_1k"), cut.alias("cost_reduction"))


def graded_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, passed, pass@1 with its interval, errors and timeouts (null unless recorded in some row)."""
    known = lambda c: F.when(F.count(c) > 0, F.count_if(F.col(c)))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), known("error").alias("errors"), known("timed_out").alias("timeouts"))
    return g.withColumn("w", wilson(F.col("passed"), F.col("n"))).select(*by, "n", "passed", share(F.col("passed"), F.col("n")).alias("pass_at_1"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), "errors", "timeouts")


def judge_confusion(rows: DataFrame, verdict: str, truth: str, by: list[str] | None = None) -> DataFrame:
    v, t = F.col(verdict), F.col(truth)
    g = rows.groupBy(*(by or [])).agg(F.count_if(v & t).alias("tp"), F.count_if(v & ~t).alias("fp"), F.count_if(~v & ~t).alias("tn"), F.count_if(~v & t).alias("fn"), F.count_if(v.isNull()).alias("unparsed"))
    return g.withColumns({"accuracy": share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "fail_recall": share(F.col("tn"), F.col("tn") + F.col("fp"))})


def judge_bank(bank: DataFrame) -> DataFrame:
    """bank: bucket, defect, v_ref, v_mut (null = unparsed). Reference accept rate, mutant catch rate, both right: in
    total, by bucket and by defect."""
    r, m = F.col("v_ref"), F.col("v_mut")
    cell = bank.groupBy("bucket", "defect").agg(F.count("v_ref").alias("nr"), F.count_if(r).alias("ar"), F.count("v_mut").alias("nm"), F.count_if(~m).alias("cm"), F.count_if(r & ~m).alias("both"), F.count(F.lit(1)).alias("n"), F.count_if(r.isNull() | m.isNull()).alias("u"))
    sets = cell.groupingSets([[], ["bucket"], ["defect"]], "bucket", "defect")
    return sets.agg(share(F.sum("ar"), F.sum("nr")).alias("accept_rate"), share(F.sum("cm"), F.sum("nm")).alias("catch_rate"), share(F.sum("both"), F.sum("n")).alias("paired"), F.sum("u").alias("unparsed"))


def policies(matrix: DataFrame, costs: DataFrame, cloud: str, gate: Column, gate_cost: float = 0.0) -> DataFrame:
    """matrix (prompt, agent, passed), costs (prompt, cost; a missing one is the mean): policy, n, pass rate, cost a task.
    Always cloud, always one local arm (on its own prompts), the best of the local arms, and a cascade that serves the
    best local answer where ``gate`` (over local, the prompt's row) accepts it."""
    per = matrix.groupBy("prompt").agg(F.bool_or(F.when(F.col("agent") == cloud, F.col("passed"))).alias("cloud"), F.bool_or(F.when(F.col("agent") != cloud, F.col("passed"))).alias("local"))
    mean = costs.agg(F.avg("cost").alias("mean")).withColumn("one", F.lit(1))
    p = per.join(costs, "prompt", "left").withColumn("one", F.lit(1)).join(mean, "one").withColumn("cost", F.coalesce("cost", "mean")).withColumn("accept", gate)
    row = lambda df, name, ok, cost: df.agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("pass_rate"), F.avg(cost).alias("cost")).select(F.lit(name).alias("policy"), "n", "pass_rate", "cost")
    both = p.filter("cloud IS NOT NULL AND local IS NOT NULL")
    single = matrix.filter(F.col("agent") != cloud).groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate")).select(F.concat(F.lit("always "), "agent").alias("policy"), "n", "pass_rate", F.lit(0.0).alias("cost"))
    return (
        row(p.filter("cloud IS NOT NULL"), "always cloud", F.col("cloud"), F.col("cost")).unionByName(single).unionByName(row(p.filter("local IS NOT NULL"), "best of local", F.col("local"), F.lit(0.0)))
        .unionByName(row(both, "routed", F.when(F.col("accept"), F.col("local")).otherwise(F.col("cloud")), F.when(F.col("accept"), 0.0).otherwise(F.col("cost")) + gate_cost))
    )


def baselines(matrix: DataFrame) -> DataFrame:
    """static per arm, best static (ties by name), round robin (mean of the arms) and an oracle, over a full matrix."""
    static = matrix.groupBy("agent").agg(F.avg(F.col("passed").cast("double")).alias("rate"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("rate"), "agent")
    best = static.withColumn("k", F.row_number().over(w)).filter("k = 1").select(F.lit("best static").alias("policy"), "rate")
    oracle = matrix.groupBy("prompt").agg(F.bool_or("passed").alias("o")).agg(F.avg(F.col("o").cast("double")).alias("rate")).select(F.lit("oracle").alias("policy"), "rate")
    return static.select(F.concat(F.lit("static "), "agent").alias("policy"), "rate").unionByName(best).unionByName(static.agg(F.avg("rate").alias("rate")).select(F.lit("round robin").alias("policy"), "rate")).unionByName(oracle)


def discriminating(matrix: DataFrame) -> DataFrame:
    """Prompts that exactly one arm passes, and which."""
    return matrix.groupBy("prompt").agg(F.count_if("passed").alias("k"), F.max(F.when(F.col("passed"), F.col("agent"))).alias("agent")).filter("k = 1").select("prompt", "agent")


def seed_summary(results: DataFrame, baseline: str) -> DataFrame:
    """results (condition, seed, value): mean, sample deviation, 95 % half width by the t table, difference to the baseline
    with an approximate t."""
    table = F.create_map(*[F.lit(x) for kv in T_TABLE.items() for x in kv])
    g = results.groupBy("condition").agg(F.count(F.lit(1)).cast("int").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    se = F.col("std") / F.sqrt(F.col("n").cast("double"))
    g = g.withColumn("ci95", F.coalesce(F.try_element_at(table, F.col("n") - 1), F.lit(1.96)) * se).withColumn("one", F.lit(1))
    b = g.filter(F.col("condition") == baseline).select("one", F.col("n").alias("bn"), F.col("mean").alias("bm"), F.col("std").alias("bs"))
    t = F.try_divide(F.col("mean") - F.col("bm"), F.sqrt(F.col("std") * F.col("std") / F.col("n") + F.col("bs") * F.col("bs") / F.col("bn")))
    return g.join(b, "one", "left").select("condition", "n", "mean", "std", "ci95", (F.col("mean") - F.col("bm")).alias("delta"), F.when(F.col("condition") != baseline, t).alias("t"))


def strategy_summary(rows: DataFrame) -> DataFrame:
    """Per strategy: success, reward, share of its commonest agent, share of free picks, saved against the dearest pick."""
    dear = rows.agg(F.max("cost_usd").alias("dear")).withColumn("one", F.lit(1))
    picks = rows.groupBy("strategy", "selected_agent").agg(F.count(F.lit(1)).alias("n")).groupBy("strategy").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    g = rows.withColumn("one", F.lit(1)).join(dear, "one").groupBy("strategy").agg(F.avg(as_double("success")).alias("success_rate"), F.avg("reward").alias("mean_reward"), F.avg((F.col("cost_usd") == 0).cast("double")).alias("free_share"), F.sum(F.col("dear") - F.col("cost_usd")).alias("saved"))
    return g.join(picks, "strategy").withColumn("top_share", share(F.col("top"), F.col("n"))).drop("top")


def best_settings(rows: DataFrame) -> DataFrame:
    """rows (parameter, value, reward): the best value of each parameter by mean reward; ties by value."""
    g = rows.groupBy("parameter", "value").agg(F.avg("reward").alias("mean_reward"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("parameter").orderBy(F.desc("mean_reward"), "value")))


def run_list(manifests: DataFrame) -> DataFrame:
    """Nested run manifests as a list, newest first by the instant they started (offsets count)."""
    return manifests.select("run_id", F.to_timestamp("started").alias("started"), F.col("machine.name").alias("machine"), F.col("settings.timeout_s").alias("timeout_s"), F.map_keys("models.digests").alias("models")).orderBy(F.desc("started"), "run_id")
