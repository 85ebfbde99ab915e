"""Ordered work over logs: rolling means, drift, budgets, caps, regret, fronts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.operators.scans import BLOCK, blocked, last_rows, own, placed, running_min, running_moments, running_sums

ALL = Window.unboundedPreceding
#: A step of the pacer's walk: up to 20 digits before the point, rounded to 18 behind it.
STEP = "decimal(38,18)"


def rolling_reward(decisions: DataFrame, n: int = 20, least: int = 3, block: int = BLOCK) -> DataFrame:
    """Mean of an agent's last n rewards after each decision; null rewards count as 0, agents with few rows are left out."""
    rows = placed(decisions.select("id", "selected_agent", "reward"), ["selected_agent"], ["id"]).filter(F.col("n") >= least)
    mean = F.avg(F.coalesce("reward", F.lit(0.0))).over(last_rows(["selected_agent"], n))
    return own(blocked(rows, block, n - 1).withColumn("rolling", mean)).select("id", "selected_agent", "rolling")


def drift_alerts(decisions: DataFrame, sigma: float = 2.0, window: int = 50, least: int = 20, every: int = 10, block: int = BLOCK) -> DataFrame:
    """Alerts per (bucket, agent) at every ``every``-th outcome from the ``least``-th on: the mean of the last ``window``
    rewards is more than sigma sample deviations under the mean of all so far (the row included)."""
    key = ["bucket", "selected_agent"]
    rows = placed(decisions.filter("reward IS NOT NULL").select("id", *key, "reward"), key, ["id"]).drop("n")
    rows = running_moments(blocked(rows, block, window - 1).withColumn("recent", F.avg("reward").over(last_rows(key, window))), key, "reward")
    rows = own(rows).select("id", *key, F.col("t").alias("n"), "mean", "std", "recent")
    # A deviation of nothing but rounding is none.
    return rows.filter((F.col("n") >= least) & (F.col("n") % every == 0) & (F.col("std") > 1e-12) & (F.col("recent") < F.col("mean") - sigma * F.col("std"))).withColumn("sigmas", (F.col("mean") - F.col("recent")) / F.col("std"))


def budget_pacer(decisions: DataFrame, ceiling: float, key: str, eta: float = 0.5, window: int = 100, block: int = BLOCK) -> DataFrame:
    """The pacer's multiplier after each decision. The recursion max(0, last + step) is a reflected walk: the running sum
    of the steps less its running minimum (0 at most), so two scans give it. The steps are decimals, as the sum moves away
    from 0 for as long as the tenant stays under its ceiling: what came before the minimum cancels out whole, where doubles
    would leave their rounding. ``key`` is the tenant; tenants are paced apart."""
    rows = placed(decisions.select(key, "id", "cost_usd"), [key], ["id"]).drop("n")
    rows = own(blocked(rows, block, window - 1).withColumn("mean_cost", F.avg("cost_usd").over(last_rows([key], window))))
    step = (eta * (F.col("mean_cost") - ceiling)).cast(STEP)
    rows = running_min(running_sums(rows, [key], {"s": step}), [key], "s", "low")
    lam = (F.col("s") - F.least(F.lit(0), F.col("low"))).cast("double")
    return rows.select(key, "id", "mean_cost", lam.alias("multiplier"), (F.lit(ceiling) - F.col("mean_cost")).alias("headroom"), (F.col("mean_cost") > ceiling).alias("over"))


def regret(rows: DataFrame, key: str, order: str, oracle: Column, actual: Column, n: int = 20, block: int = BLOCK) -> DataFrame:
    """Per step of a sequence: regret, its running sum and its rolling mean."""
    r = placed(rows.select(key, order, F.greatest(F.lit(0.0), oracle - actual).alias("regret")), [key], [order])
    r = own(blocked(r, block, n - 1).withColumn("rolling", F.avg("regret").over(last_rows([key], n))))
    return running_sums(r, [key], {"cumulative": F.col("regret")}).select(key, order, "regret", F.col("t").cast("int").alias("t"), "cumulative", "rolling")


def regret_growth(steps: DataFrame, key: str, least: int = 20, sublinear: float = 0.8) -> DataFrame:
    """Exponent of the running regret against time from the tenth on, by the slope of logs; means of the first and last
    fifth. Null under ``least`` steps."""
    n = steps.groupBy(key).agg(F.max("t").alias("n"))
    rows = steps.join(n, key)
    late = (F.col("t") > F.floor(F.col("n") / 10)) & (F.col("cumulative") > 0)
    slope = F.regr_slope(F.when(late, F.log("cumulative")), F.when(late, F.log(F.col("t").cast("double"))))
    fifth = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    out = rows.groupBy(key).agg(
        F.first("n").alias("n"), slope.alias("slope"), F.avg(F.when(F.col("t") <= fifth, F.col("regret"))).alias("first_fifth"), F.avg(F.when(F.col("t") > F.col("n") - fifth, F.col("regret"))).alias("last_fifth")
    )
    return out.withColumn("growth", F.when(F.col("n") >= least, F.col("slope"))).drop("slope").withColumn("sublinear", F.col("growth") < sublinear)


def drift_response(steps: DataFrame, key: str, change: int, target: Column, recover: float = 0.8, block: int = BLOCK) -> DataFrame:
    """Of sequences with a change at a step: steps until the target is first picked after it, until its rolling share is
    back, and its share before and after."""
    hits = blocked(steps.select(key, "t", target.cast("double").alias("hit")), block, 19)
    rows = own(hits.withColumn("share", F.avg("hit").over(last_rows([key], 20)))).withColumn("after", F.col("t") > change)
    return rows.groupBy(key).agg(
        (F.min(F.when(F.col("after") & (F.col("hit") > 0), F.col("t"))) - change).alias("detected"), (F.min(F.when(F.col("after") & (F.col("share") >= recover), F.col("t"))) - change).alias("recovered"),
        F.avg(F.when(~F.col("after"), F.col("hit"))).alias("share_before"), F.avg(F.when(F.col("after"), F.col("hit"))).alias("share_after"),
    )


def swap_waste(decisions: DataFrame, key: str, explored: Column, n: int = 20, settled: float = 0.15, block: int = BLOCK) -> DataFrame:
    """Per sequence: changes of agent from one decision to the next, and the first step with a full window of n in which
    fewer than ``settled`` are explored."""
    rows = placed(decisions.select(key, "id", "selected_agent", explored.cast("double").alias("x")), [key], ["id"])
    w, recent = Window.partitionBy(key, "block").orderBy("t"), last_rows([key], n)
    rows = blocked(rows.withColumn("t", F.col("t").cast("int")), block, max(n - 1, 1)).withColumns({"swap": F.lag("selected_agent").over(w) != F.col("selected_agent"), "e": F.avg("x").over(recent), "c": F.count(F.lit(1)).over(recent)})
    return own(rows).groupBy(key).agg(F.count_if("swap").alias("swaps"), F.min(F.when((F.col("c") == n) & (F.col("e") < settled), F.col("t"))).alias("settled_at"))


def retry_signal(events: DataFrame, retry_s: float = 300, accept_s: float = 600) -> DataFrame:
    """events: user_id, id, ts, kind ('complete' or 'submit'), task_id, hash. For each completion, until the next one, the
    first later submission that says something: the same hash within retry_s is a retry (0.0), another within accept_s
    an acceptance (0.6)."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    done = F.col("kind") == "complete"
    rows = events.withColumn("run", F.count_if(done).over(w.rowsBetween(ALL, 0)))
    pending = rows.filter(done).select("user_id", "run", F.col("ts").alias("done_ts"), F.col("hash").alias("done_hash"), F.col("task_id").alias("done_task"))
    later = rows.filter(~done & (F.col("run") > 0)).join(pending, ["user_id", "run"])
    gap = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.col("done_ts").cast("timestamp")) / 1e6
    signal = F.when((F.col("hash") == F.col("done_hash")) & (gap <= retry_s), 0.0).when((F.col("hash") != F.col("done_hash")) & (gap <= accept_s), 0.6)
    best = later.withColumn("signal", signal).filter("signal IS NOT NULL").groupBy("user_id", "run").agg(F.min_by(F.struct("done_task", "id", "signal"), F.struct("ts", "id")).alias("s"))
    return best.select("user_id", F.col("s.done_task").alias("task_id"), F.col("s.id").alias("by_id"), F.col("s.signal").alias("signal"))


def daily_cap(rows: DataFrame, cap: int = 25) -> DataFrame:
    """``passes``: the row is among the day's first ``cap`` (UTC); no cap at 0 or less. Ranking is by day, and a day's rows
    beyond the cap need no order, so only the first ``cap`` of each partition are compared."""
    if cap <= 0:
        return rows.withColumn("passes", F.lit(True))
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "id")
    return rows.withColumn("passes", F.row_number().over(w) <= cap)


def age_cap(episodes: DataFrame, limit: int = 10_000, drop_share: float = 0.1) -> DataFrame:
    """The memory as it stands after all inserts in id order when, at the cap, the oldest tenth is dropped first: the
    newest rows, as many as the rule leaves. It is a top-N, not a sort."""
    n, drop = episodes.count(), int(limit * drop_share)
    kept = n if n <= limit else limit - drop + (n - limit - 1) % drop + 1
    return episodes.orderBy(F.desc("id")).limit(kept)


def pareto_front(points: DataFrame, x: str, y: str, bins: int = 1024) -> DataFrame:
    """Points that no other point beats in one cost without losing in the other; equal points stay together.

    Two levels: x is cut into bins, the least y of all earlier bins is carried into each (a window over the bins only),
    and points are swept inside their bin. A point that the carry already beats leaves before the sweep."""
    ends = points.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).withColumn("_one", F.lit(1))
    at = F.coalesce(F.floor(F.try_divide((F.col(x) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(0))
    placed = points.withColumn("_one", F.lit(1)).join(ends, "_one").withColumn("_bin", at).drop("_one", "_lo", "_hi")
    by_bin = placed.groupBy("_bin").agg(F.min(y).alias("_m"))
    carry = by_bin.select("_bin", F.min("_m").over(Window.orderBy("_bin").rowsBetween(ALL, -1)).alias("_carry"))
    left = placed.join(carry, "_bin").filter(F.col("_carry").isNull() | (F.col(y) < F.col("_carry")))
    least = left.groupBy("_bin", x).agg(F.min(y).alias("_least"))
    before = F.min("_least").over(Window.partitionBy("_bin").orderBy(x).rowsBetween(ALL, -1))
    front = least.withColumn("_b", before).filter("_b IS NULL OR _least < _b").select("_bin", x, "_least")
    return left.join(front, ["_bin", x]).filter(F.col(y) == F.col("_least")).drop("_least", "_bin", "_carry")


def knee(front: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """The front's point nearest to the origin once both costs are scaled to 0 to 1; ties by name."""
    r = front.agg(*[f(c).alias(f"{k}_{c}") for c in (x, y) for k, f in (("lo", F.min), ("hi", F.max))]).withColumn("one", F.lit(1))
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0))
    scaled = front.withColumn("one", F.lit(1)).join(r, "one").withColumn("d", unit(x) * unit(x) + unit(y) * unit(y))
    return scaled.agg(F.min_by(F.struct(name, x, y, "d"), F.struct("d", name)).alias("k")).select("k.*")
