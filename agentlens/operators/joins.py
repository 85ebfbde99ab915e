"""Joins of records: outcomes to decisions, prices to models, results to banks, matrices and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_outcomes(decisions: DataFrame, outcomes: DataFrame, key: str = "task_id") -> DataFrame:
    """Each outcome (key, success, reward; one a key) goes to the latest decision of its task, others keep their own.
    Decisions without a key are set aside before the shuffle, since they would all meet in one task."""
    keyed, loose = decisions.filter(F.col(key).isNotNull()), decisions.filter(F.col(key).isNull())
    latest = keyed.groupBy(key).agg(F.max("id").alias("id"))
    found = latest.join(outcomes.select(key, F.col("success").alias("_s"), F.col("reward").alias("_r")), key).drop(key)
    fill = keyed.join(found, "id", "left").withColumns({"success": F.coalesce("_s", "success"), "reward": F.coalesce("_r", "reward")}).drop("_s", "_r")
    return fill.select(*decisions.columns).unionByName(loose)


def attach_implicit(decisions: DataFrame, labels: DataFrame, key: str = "task_id") -> DataFrame:
    """Implicit labels (key, agent, label; one a key) go to the latest unlabelled decision of the task, if it chose that
    agent; explicit outcomes win. Adds implicit."""
    latest = decisions.filter(F.col("success").isNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("id").alias("id"), F.max_by("selected_agent", "id").alias("_a"))
    found = latest.join(labels.select(key, F.col("agent").alias("_l"), F.col("label").alias("implicit")), key).filter("_a = _l").select("id", "implicit")
    return decisions.join(found, "id", "left")


def latest_decision(decisions: DataFrame, key: str = "task_id") -> DataFrame:
    """The latest decision of each task, whole."""
    return decisions.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in decisions.columns if c != key]), "id").alias("d")).select(key, "d.*")


def of_run(metrics: DataFrame, decisions: DataFrame, run: Column) -> DataFrame:
    """Metrics of tasks that a run decided on."""
    return metrics.join(decisions.filter(run).select("task_id").distinct(), "task_id", "left_semi")


def price_rows(models: DataFrame, prices: DataFrame, default: str) -> DataFrame:
    """The price row of each distinct model: its own, else that of the longest known id that begins it, else the default's.
    prices: known, input, output, cache_read (dollars a million). Models are few next to facts, so the prefix join is made
    on them and the result is joined back by equality."""
    distinct = models.select("model").distinct()
    # Candidates by equality: every prefix of a model, so no theta join is needed.
    prefixes = distinct.withColumn("known", F.explode(F.transform(F.sequence(F.lit(1), F.length("model")), lambda n: F.substring(F.col("model"), F.lit(1), n))))
    best = prefixes.join(prices, "known").groupBy("model").agg(F.max_by(F.struct("known", "input", "output", "cache_read"), F.length("known")).alias("p"))
    other = prices.filter(F.col("known") == default).select(F.struct("known", "input", "output", "cache_read").alias("d"), F.lit(1).alias("one"))
    return distinct.withColumn("one", F.lit(1)).join(best, "model", "left").join(other, "one", "left").withColumn("p", F.coalesce("p", "d")).select("model", "p.*")


def token_cost(price: Column, inputs: Column, outputs: Column, read: Column | None = None, written: Column | None = None) -> Column:
    """Dollars for tokens; writing the cache costs 1.25 times the input price."""
    zero = F.lit(0)
    million = price["input"] * inputs + price["output"] * outputs + price["cache_read"] * (zero if read is None else read) + price["input"] * 1.25 * (zero if written is None else written)
    return F.round(million / 1_000_000, 6)


def costed(ledger: DataFrame, prices: DataFrame, default: str) -> DataFrame:
    """A recorded cost wins over the computed one."""
    by = price_rows(ledger, prices, default).select("model", F.struct("input", "output", "cache_read").alias("price"))
    return ledger.join(by, "model").withColumn("cost", F.coalesce("cost_usd", token_cost(F.col("price"), F.col("input_tokens"), F.col("output_tokens"))))


def lower_plan(plans: DataFrame) -> DataFrame:
    """Each plan's next lower one: same vendor, verified and priced, the largest capacity below its own. An ordered
    window over a vendor's plans, not a range join."""
    usable = F.col("price").isNotNull() & F.col("verified")
    w = Window.partitionBy("vendor").orderBy("capacity").rangeBetween(Window.unboundedPreceding, -1)
    below = F.max(F.when(usable, F.struct("capacity", "plan", "price"))).over(w)
    return plans.withColumn("b", below).select("vendor", "plan", "capacity", F.col("b.plan").alias("lower"), F.col("b.price").alias("lower_price"))


def under_budget(agents: DataFrame, key: str, limit: float) -> DataFrame:
    """Agents of each task whose cost is within the limit (free ones only at 0); where none is, the cheapest stays (ties by
    name)."""
    least = agents.groupBy(key).agg(F.min(F.struct("cost", "agent")).alias("m"))
    ok = F.col("cost") <= limit
    some = agents.groupBy(key).agg(F.bool_or(ok).alias("some"))
    return agents.join(least, key).join(some, key).filter(ok | (~F.col("some") & (F.struct("cost", "agent") == F.col("m")))).select(*agents.columns)


def served(c: DataFrame) -> DataFrame:
    """Routed cases: escalated when the judge rejects the local answer; who serves, whether that passed, and what it cost
    (the judge's cost, and the cloud's when escalated)."""
    up = F.col("judge_verdict") == F.lit(False)
    up = F.coalesce(up, F.lit(False))
    return c.select("*", up.alias("escalated"), F.when(up, F.col("cloud_passed")).otherwise(F.col("local_passed")).alias("final_passed"), (F.coalesce("judge_cost", F.lit(0.0)) + F.when(up, F.col("cloud_cost")).otherwise(0.0)).alias("total_cost"), F.when(up, "cloud").otherwise("local").alias("server"))


def with_bank(results: DataFrame, bank: DataFrame) -> DataFrame:
    """Results of prompts in the bank; ``unmatched_results`` has the others. The long text moves as a hash, and equality is
    checked on it."""
    b = bank.select(F.xxhash64("prompt").alias("_h"), F.col("prompt").alias("_p"), *[c for c in bank.columns if c != "prompt"])
    return results.withColumn("_h", F.xxhash64("prompt")).join(b, "_h").filter("prompt = _p").drop("_h", "_p")


def unmatched_results(results: DataFrame, bank: DataFrame) -> DataFrame:
    b = bank.select(F.xxhash64("prompt").alias("_h"), F.col("prompt").alias("_p"))
    r = results.withColumn("_h", F.xxhash64("prompt"))
    return r.join(b, (r["_h"] == b["_h"]) & (r["prompt"] == b["_p"]), "left_anti").drop("_h")


def cloud_costs(decisions: DataFrame, metrics: DataFrame, run: Column, agent: str) -> DataFrame:
    """Cost per task of one arm in one run."""
    return decisions.filter(run).select("task_id").distinct().join(metrics.filter(F.col("agent_name") == agent).groupBy("task_id").agg(F.avg("cost_usd").alias("cost")), "task_id")


def full_matrix(results: DataFrame) -> DataFrame:
    """(prompt, agent) once each, a timed row first; only prompts that every arm has; a missing latency is the arm's mean."""
    w = Window.partitionBy("prompt", "agent").orderBy(F.col("latency_s").isNull(), "id")
    once = results.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    arms = once.agg(F.count_distinct("agent").alias("_arms")).withColumn("_one", F.lit(1))
    whole = once.groupBy("prompt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1)).join(arms, "_one").filter("_n = _arms").select("prompt")
    kept = once.join(whole, "prompt", "left_semi")
    means = kept.groupBy("agent").agg(F.avg("latency_s").alias("_mean"))
    return kept.join(means, "agent").withColumn("latency_s", F.coalesce("latency_s", "_mean")).drop("_mean")


def schedule(prompts: DataFrame, agents: list[str], repeats: int, seed: int, whole: bool = False) -> DataFrame:
    """prompts x agents x repeats with a place: agent by agent in a seeded order inside each block, or over the whole set.
    The agents and repeats are literals."""
    cells = prompts.withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.lit(a).alias("agent")) for i, a in enumerate(agents)]))).select("*", "c.*").drop("c").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    key = F.xxhash64(F.lit(seed), "prompt", "agent", "repeat")
    w = Window.partitionBy(*([F.lit(0)] if whole else ["block"])).orderBy(key, "prompt", "repeat")
    return cells.withColumn("place", F.row_number().over(w))


def candidate_commits(numstat: DataFrame, most_lines: int = 250, newest: int | None = None) -> DataFrame:
    """numstat: sha, parents, committed, path, lines (null for a binary file, which does not count). Commits with one parent
    that touch a test module and 1 to most_lines lines of Python sources that are no tests, the newest first. A test is what
    lies in a top folder test or tests, conftest.py, test_* and *_test.py; a module of it is a .py named test_*, tests_* or
    *_test."""
    name = F.substring_index("path", "/", -1)
    test = F.substring_index("path", "/", 1).isin("tests", "test") | (name == "conftest.py") | name.rlike(r"^test_|_test\.py$")
    module = test & name.rlike(r"^tests?_.*\.py$|_test\.py$")
    by = numstat.filter("lines IS NOT NULL AND path <> ''").groupBy("sha", "committed").agg(F.max("parents").alias("parents"), F.bool_or(module).alias("tests"), F.sum(F.when(~test & F.endswith("path", F.lit(".py")), F.col("lines")).otherwise(0)).alias("src_lines"))
    out = by.filter((F.col("parents") == 1) & F.col("tests") & (F.col("src_lines") > 0) & (F.col("src_lines") <= most_lines))
    return out.orderBy(F.desc("committed"), "sha").limit(newest) if newest else out


def steady(results: DataFrame) -> DataFrame:
    """Tests over repeated runs: (task, phase, test, passed) -> runs, passes; steady passed in all, flaky in some."""
    r = results.groupBy("task", "phase", "test").agg(F.count(F.lit(1)).alias("runs"), F.count_if("passed").alias("passes"))
    return r.withColumns({"steady": F.col("runs") == F.col("passes"), "flaky": (F.col("passes") > 0) & (F.col("passes") < F.col("runs"))})


def gate_sets(results: DataFrame) -> DataFrame:
    """Per task from phases commit, base and fix: f2p = passed at the commit, not steady at the base, never flaky; p2p =
    steady at base and fix; counts of both, of flaky tests and of failures with the fix; why a task is dropped."""
    s = steady(results)
    at = lambda phase, flag: F.bool_or((F.col("phase") == phase) & F.col(flag))
    t = s.groupBy("task", "test").agg(at("commit", "steady").alias("c"), at("base", "steady").alias("b"), at("fix", "steady").alias("x"), F.bool_or("flaky").alias("f"))
    g = t.groupBy("task").agg(
        F.count_if(F.col("c") & ~F.col("b") & ~F.col("f")).alias("f2p"), F.count_if(F.col("b") & F.col("x")).alias("p2p"), F.count_if("f").alias("flaky"), F.count_if(F.col("c") & ~F.col("x") & ~F.col("f")).alias("gold_fails"),
        F.array_sort(F.collect_list(F.when(F.col("c") & ~F.col("b") & ~F.col("f"), F.col("test")))).alias("f2p_tests"),
    )
    return g.withColumn("dropped", F.when(F.col("f2p") == 0, "no failing test").when(F.col("gold_fails") > 0, "fix fails").when(F.col("p2p") == 0, "nothing passes"))


def grade(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """expected (task, test, kind f2p or p2p), observed (task, test, passed): resolved iff every f2p test passes, no p2p
    test fails and the suite ran; counts and the first 20 regressions."""
    j = expected.join(observed.groupBy("task", "test").agg(F.bool_and("passed").alias("ok")), ["task", "test"], "left")
    ran = observed.select("task").distinct().withColumn("ran", F.lit(True))
    ok, f2p, p2p = F.coalesce("ok", F.lit(False)), F.col("kind") == "f2p", F.col("kind") == "p2p"
    g = j.groupBy("task").agg(F.count_if(f2p).alias("f2p_total"), F.count_if(f2p & ok).alias("f2p_pass"), F.count_if(p2p & ~ok).alias("regressions"), F.slice(F.array_sort(F.collect_list(F.when(p2p & ~ok, F.col("test")))), 1, 20).alias("first"))
    return g.join(ran, "task", "left").withColumn("resolved", (F.col("f2p_pass") == F.col("f2p_total")) & (F.col("regressions") == 0) & F.col("ran").isNotNull()).drop("ran")


def live_only(sources: list[DataFrame], live: DataFrame) -> DataFrame:
    """All sources' rows of tasks that still exist."""
    whole = sources[0]
    for s in sources[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    return whole.join(live.select("task").distinct(), "task", "left_semi")
