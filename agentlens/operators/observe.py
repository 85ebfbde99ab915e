"""The decision log: health, usage, costs, calibration, retrieval, drift history and live traffic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions.stats import as_double, share


def within_window(ts: Column, since: str | None = None, until: str | None = None) -> Column:
    """Inclusive by text prefix: a date or a part of one bounds all instants that begin with it. An empty or null text
    passes only without bounds."""
    tests = ([ts >= since] if since else []) + ([F.substring(ts, 1, len(until)) <= until] if until else [])
    return reduce(lambda a, b: a & b, [F.coalesce(ts, F.lit("")) != "", *tests]) if tests else F.lit(True)


def epoch(iso: str, end_of_day: bool = False) -> Column:
    """Seconds of an ISO date or instant (naive is UTC); a bare date as an upper bound means its last microsecond."""
    text = iso.replace("Z", "+00:00")
    day = len(text) == 10
    instant = f"{text}T23:59:59.999999" if day and end_of_day else text
    return F.unix_micros(F.to_timestamp(F.lit(instant if "+" in instant[10:] else instant + ("T00:00:00+00:00" if len(instant) == 10 else "+00:00")))) / F.lit(1e6)


def selected_of(json_map: Column, agent: Column, kind: str = "double") -> Column:
    """The selected agent's entry of a JSON map; null without it."""
    return F.try_element_at(F.from_json(json_map, f"map<string,{kind}>"), agent)


def numbered(decisions: DataFrame, horizons: dict[str, int | None]) -> DataFrame:
    """Rows of the newest N decisions per horizon, tagged. Each horizon with an N is a top-N, so no task sorts the log."""
    parts = [(decisions if n is None else decisions.orderBy(F.desc("id")).limit(n)).withColumn("horizon", F.lit(h)) for h, n in horizons.items()]
    return reduce(DataFrame.unionByName, parts)


def window_stats(decisions: DataFrame) -> DataFrame:
    """Per horizon (last 100, last 500, all): n, n with outcome, means of those; null means without outcomes."""
    known = F.col("success").isNotNull()
    mean = lambda c: F.avg(F.when(known, as_double(c))).alias(f"mean_{c}")
    return numbered(decisions, {"last_100": 100, "last_500": 500, "all": None}).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_outcomes"), mean("reward"), mean("success"), mean("latency_s"), mean("cost_usd")
    )


def rollup_by(decisions: DataFrame, key: str) -> DataFrame:
    known = F.col("success").isNotNull()
    return decisions.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_outcomes"), F.avg(F.when(known, as_double("reward"))).alias("mean_reward"), F.avg(as_double("success")).alias("success_rate")
    )


def filtered_stats(decisions: DataFrame, strategy: str | None = None, agent: str | None = None, last_n: int | None = None) -> DataFrame:
    """One row; zeros where there is nothing."""
    rows = decisions.filter("success IS NOT NULL")
    rows = rows.filter(F.col("strategy") == strategy) if strategy else rows
    rows = rows.filter(F.col("selected_agent") == agent) if agent else rows
    rows = rows.orderBy(F.desc("id")).limit(last_n) if last_n else rows
    zero = lambda c, name: F.coalesce(F.avg(as_double(c)), F.lit(0.0)).alias(name)
    return rows.agg(F.count(F.lit(1)).alias("total"), zero("success", "success_rate"), zero("reward", "mean_reward"), zero("latency_s", "mean_latency"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"))


def split_means(decisions: DataFrame, flag: Column) -> DataFrame:
    """Mean reward where a flag holds and where it doesn't, and the difference."""
    yes, no = F.avg(F.when(flag, F.col("reward"))), F.avg(F.when(~flag, F.col("reward")))
    return decisions.filter("reward IS NOT NULL").agg(F.count_if(flag).alias("n_yes"), F.count_if(~flag).alias("n_no"), yes.alias("mean_yes"), no.alias("mean_no"), (yes - no).alias("delta"))


def escalations(decisions: DataFrame) -> DataFrame:
    """Escalations by strategy with their means, and per 100 decisions of all."""
    total = decisions.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1))
    by = decisions.filter("escalated_to IS NOT NULL").groupBy(F.coalesce("strategy", F.lit("none")).alias("strategy")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"), F.avg("cost_usd").alias("mean_cost"), F.avg("latency_s").alias("mean_latency")
    )
    return by.withColumn("one", F.lit(1)).join(total, "one").select("strategy", "n", "mean_reward", "mean_cost", "mean_latency", (share(F.col("n"), F.col("total")) * 100).alias("per_100"))


def override_roi(decisions: DataFrame, overridden: Column, weight: Column) -> DataFrame:
    return decisions.groupBy(F.when(overridden, "overridden").otherwise("kept").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"), F.avg(weight).alias("mean_weight"), F.min(weight).alias("min_weight"), F.max(weight).alias("max_weight")
    )


def calibration(decisions: DataFrame, predicted: Column) -> DataFrame:
    """Mean absolute error of the predicted probability against the reward, over all (agent null) and per agent; rows
    without either are left out."""
    rows = decisions.select("selected_agent", F.abs(predicted - F.col("reward")).alias("e")).filter("e IS NOT NULL")
    sums = rows.groupBy("selected_agent").agg(F.sum("e").alias("s"), F.count("e").alias("n"))
    return sums.rollup("selected_agent").agg((F.sum("s") / F.sum("n")).alias("mae"), F.sum("n").alias("n")).withColumnRenamed("selected_agent", "agent")


def retrieval(decisions: DataFrame, hits: Column, similarity: Column) -> DataFrame:
    some = hits > 0
    return decisions.agg(F.count_if(some).alias("with_hits"), F.avg(F.when(some, hits.cast("double"))).alias("mean_hits"), F.avg(F.when(some, similarity)).alias("mean_similarity"))


def alerts(decisions: DataFrame, ceiling: float, low: float = 0.4, least: int = 10, silent: int = 5) -> DataFrame:
    """kind, subject, value: low success in the last 100; agents with more than ``silent`` decisions and no outcome; mean
    cost of the last 100 over the ceiling."""
    last = window_stats(decisions).filter("horizon = 'last_100'")
    return (
        last.filter((F.col("n_outcomes") >= least) & (F.col("mean_success") < low)).select(F.lit("low success").alias("kind"), F.lit("last_100").alias("subject"), F.col("mean_success").alias("value"))
        .unionByName(rollup_by(decisions, "selected_agent").filter((F.col("n") > silent) & (F.col("n_outcomes") == 0)).select(F.lit("no outcomes").alias("kind"), F.col("selected_agent").alias("subject"), F.col("n").cast("double").alias("value")))
        .unionByName(last.filter(F.col("mean_cost_usd") > ceiling).select(F.lit("over budget").alias("kind"), F.lit("last_100").alias("subject"), F.col("mean_cost_usd").alias("value")))
    )


def usage(decisions: DataFrame) -> DataFrame:
    """One row over finished rows: served locally, escalated, the judge's three answers, spend, the measured price of
    priced escalations, what local rows would have cost at it, and the reduction."""
    done = decisions.filter("success IS NOT NULL")
    up, cost = F.col("escalated_to").isNotNull(), F.col("cost_usd")
    r = done.agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(~up).alias("local"), F.count_if(up).alias("escalated"), F.count_if(F.col("correctness") == 1).alias("accepted"),
        F.count_if(F.col("correctness") == 0).alias("rejected"), F.count_if(F.col("correctness").isNull()).alias("abstained"), F.sum(F.when(up, cost).otherwise(0.0)).alias("spend"),
        F.avg(F.when(up & (cost > 0), cost)).alias("price"),
    )
    return r.withColumn("avoided", F.col("local") * F.col("price")).withColumn("reduction", F.try_divide(F.col("avoided"), F.col("avoided") + F.col("spend")))


def usage_by_agent(decisions: DataFrame) -> DataFrame:
    return decisions.filter("success IS NOT NULL").groupBy("selected_agent").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost"), F.avg(as_double("success")).alias("success_rate"))


# Suffixes of files whose writing may be delegated, and why an inline edit is no candidate.
CODE_EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".kt", ".rb", ".php", ".c", ".h", ".cpp", ".hpp", ".cs", ".swift", ".scala", ".sh", ".bash", ".zsh", ".sql", ".lua", ".r", ".jl")
IN_PLACE, NO_CODE, SMALL, LARGE = "edit-in-place", "non-code-file", "below-round-trip-threshold", "oversized-for-local-arm"


def funnel_class(tool: Column, path: Column, text: Column, delegating: list[str], least: int = 5, most: int = 300) -> Column:
    """Struct (event, ext, lines, chars, candidate, reason) of a tool's use; null for tools that are no funnel traffic.

    ``text`` is the prompt of a delegating tool (delegated, a candidate without lines), what Write puts into a file
    (inline, a candidate iff it is a code file of least to most lines) or what Edit puts in place (inline, never one)."""
    delegated, edit = tool.isin(*delegating), tool == "Edit"
    name, body = F.substring_index(F.coalesce(path, F.lit("")), "/", -1), F.coalesce(text, F.lit(""))
    ext = F.when(delegated, "").otherwise(F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1)))
    lines = F.when(delegated | (body == ""), 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1)
    reason = F.when(delegated, "").when(edit, IN_PLACE).when(~ext.isin(*CODE_EXTENSIONS), NO_CODE).when(lines < least, SMALL).when(lines > most, LARGE).otherwise("")
    record = F.struct(F.when(delegated, "delegated").otherwise("inline").alias("event"), ext.alias("ext"), lines.alias("lines"), F.length(body).alias("chars"), (reason == "").alias("candidate"), reason.alias("reason"))
    return F.when(delegated | edit | (tool == "Write"), record)


def funnel(events: DataFrame) -> DataFrame:
    """One row of events (event, candidate, session, ts): delegated, candidates, distinct sessions, first and last, rate
    (null without delegable work) and how to read it."""
    r = events.agg(
        F.count_if(F.col("event") == "delegated").alias("delegated"), F.count_if((F.col("event") == "inline") & F.col("candidate")).alias("candidates"), F.count_if((F.col("event") == "inline") & ~F.col("candidate")).alias("excluded"),
        F.count_distinct("session").alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    rate = share(F.col("delegated"), F.col("delegated") + F.col("candidates"))
    return r.withColumn("rate", rate).withColumn("reading", F.when(rate.isNull(), "no delegable work").when(rate < 0.1, "rarely delegated").when(rate < 0.5, "sometimes delegated").otherwise("mostly delegated"))


#: Relative standard error of the sketches below (2 ** 12 registers).
SKETCH_ERROR = 1.04 / 2**6


def daily_sketches(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A sketch of the different values for each key (a day among them): small, and mergeable with any other."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(F.col(value).cast("string"), F.lit(12)).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many different values the sketches of a group have seen together, about."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


def excluded_reasons(events: DataFrame) -> DataFrame:
    return events.filter("event = 'inline' AND NOT candidate").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def resources(samples: DataFrame) -> DataFrame:
    """One row of samples (cpu_percent, thermal_level): samples, mean cpu and share of 80 and over (a sample without a
    figure counts as 0; null without samples), largest cpu (0 at least), samples of elevated heat; unknown without samples,
    critical (any elevated heat), strained (a fifth of the samples hot) or fine."""
    n, cpu = F.count(F.lit(1)), F.col("cpu_percent")
    r = samples.agg(
        n.alias("samples"), F.try_divide(F.coalesce(F.sum(cpu), F.lit(0.0)), n).alias("cpu_avg"), F.greatest(F.lit(0.0), F.coalesce(F.max(cpu), F.lit(0.0))).alias("cpu_max"),
        F.try_divide(F.count_if(cpu >= 80).cast("double"), n).alias("hot_share"), F.count_if(F.col("thermal_level") == "elevated").alias("elevated"),
    )
    return r.withColumn("level", F.when(F.col("samples") == 0, "unknown").when(F.col("elevated") > 0, "critical").when(F.col("hot_share") >= 0.2, "strained").otherwise("fine"))


def warm_models(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode("warm_models").alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def cost_by(ledger: DataFrame, *keys: str) -> DataFrame:
    return ledger.groupBy(*keys).agg(F.sum("cost_usd").alias("cost"), F.count(F.lit(1)).alias("n"))


def cost_summary(ledger: DataFrame, since: str) -> DataFrame:
    """One row: all, since an instant, and how many users."""
    later = F.col("created_at") >= F.lit(since).cast("timestamp_ntz")
    return ledger.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.when(later, F.col("cost_usd"))), F.lit(0.0)).alias("since"), F.count_distinct("user_id").alias("users"))


def live_report(decisions: DataFrame) -> DataFrame:
    """Per agent: n, mean reward, reward sum, share of the traffic, share of explored picks (reward under 0.85 of the mean
    of all), and whether its reward sum is the largest (ties by name)."""
    rows = decisions.filter("reward IS NOT NULL")
    mean = rows.agg(F.avg("reward").alias("m"), F.count(F.lit(1)).alias("t")).withColumn("one", F.lit(1))
    by = rows.withColumn("one", F.lit(1)).join(mean, "one").groupBy("selected_agent").agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"), F.sum("reward").alias("reward_sum"), F.count_if(F.col("reward") < 0.85 * F.col("m")).alias("explored"), F.first("t").alias("t")
    )
    top = by.agg(F.max_by("selected_agent", F.struct("reward_sum", F.translate("selected_agent", "0123456789", "9876543210"))).alias("top")).withColumn("one", F.lit(1))
    return by.withColumn("one", F.lit(1)).join(top, "one").select(
        "selected_agent", "n", "mean_reward", "reward_sum", share(F.col("n"), F.col("t")).alias("traffic"), share(F.col("explored"), F.col("n")).alias("exploration"), (F.col("selected_agent") == F.col("top")).alias("top")
    )


def staleness(labelled_now: Column, labelled_then: Column, ratio: float = 1.5, more: int = 500) -> Column:
    return (labelled_now >= labelled_then * ratio) | (labelled_now >= labelled_then + more)


def timeline(events: DataFrame, **by) -> DataFrame:
    """The events of a run, task or type, oldest first, each id once."""
    rows = reduce(lambda d, k: d.filter(F.col(k) == by[k]), by, events)
    return rows.dropDuplicates(["event_id"]).orderBy("ts", "event_id")


def newest_per(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The n newest rows of each key; a window with a limit on its rank, which Spark applies before the shuffle too."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def decay_stale(adaptations: DataFrame, now: Column, days: float = 30, factor: float = 0.5) -> DataFrame:
    """Confidence times a factor where the last reinforcement is older than some days."""
    old = F.col("last_reinforced") < now - days * 86400
    return adaptations.withColumn("confidence", F.when(old, F.col("confidence") * factor).otherwise(F.col("confidence")))


def recent_decisions(decisions: DataFrame, n: int) -> DataFrame:
    """The newest n, oldest first."""
    return decisions.orderBy(F.desc("id")).limit(n).orderBy("id")


def drift_history(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def drift_counts(events: DataFrame, resolution: Column) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total"), F.count_if(resolution.isNull()).alias("unresolved"))


def resolve(events: DataFrame, ids: list[int], how: str, column: str = "resolution") -> DataFrame:
    """Marks unresolved events; resolved ones keep their resolution."""
    return events.withColumn(column, F.when(F.col("event_id").isin(*ids) & F.col(column).isNull(), F.lit(how)).otherwise(F.col(column)))
