"""Attempts of agents on mined commits: slices, rates, pairs, prices and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions.stats import Z95, mcnemar_exact, paired_difference, share, standing, time_bound, wilson
from agentlens.operators.selection import medians

SLICE_KEYS = {"arm", "cond", "repos", "machine", "since", "until", "limit_s"}


def stands_at(limit: float) -> Column:
    """The attempt says what it would have done under ``limit`` seconds: it ran under that limit, or under a shorter one
    and ended on its own."""
    return (F.col("limit_s") == limit) | ((F.col("limit_s") < limit) & ~F.col("timed_out"))


def select_slice(rows: DataFrame, **spec) -> DataFrame:
    """Rows by arm, cond, repos (list), machine, commit dates (since inclusive, until exclusive, first ten characters)
    and attempt limit. An unknown key is an error."""
    if unknown := set(spec) - SLICE_KEYS:
        raise ValueError(f"unknown slice keys: {sorted(unknown)}")
    day = F.substring(F.col("committed").cast("string"), 1, 10)
    tests = {
        "arm": lambda v: F.col("arm") == v, "cond": lambda v: F.col("cond") == v, "machine": lambda v: F.col("machine") == v,
        "repos": lambda v: F.col("repo").isin(*v), "since": lambda v: day >= v, "until": lambda v: day < v, "limit_s": stands_at,
    }
    return reduce(lambda df, k: df.filter(tests[k](spec[k])), spec, rows)


def tasks_of(rows: DataFrame, other: DataFrame) -> DataFrame:
    """The rows on tasks that the other slice attempted too."""
    return rows.join(other.select("repo", "sha").distinct(), ["repo", "sha"], "left_semi")


def per_task(rows: DataFrame, by: list[str]) -> DataFrame:
    """Each task's share of resolved attempts, and its attempts."""
    return rows.groupBy(*by, "repo", "sha").agg(F.avg(F.col("resolved").cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))


def task_rate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Task-weighted rate with its interval over tasks: point, lo, hi, tasks, attempts."""
    pooled = per_task(rows, by).groupBy(*by).agg(F.sum("p").alias("k"), F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("attempts"))
    return pooled.withColumn("w", wilson(F.col("k"), F.col("tasks"))).select(*by, share(F.col("k"), F.col("tasks")).alias("point"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), "tasks", "attempts")


def outcome() -> Column:
    """What happened in an attempt with columns resolved, edited, touched_tests (arrays), hit_gold_file, regressions,
    suite_crashed, f2p_pass, f2p_total."""
    no_edit = F.size(F.array_except("edited", "touched_tests")) == 0
    broke = (F.col("regressions") > 0) | F.col("suite_crashed")
    return (
        F.when(F.col("resolved"), "resolved")
        .when(no_edit, "no-edit")
        .when(~F.col("hit_gold_file"), "wrong-file")
        .when(broke & (F.col("f2p_pass") == F.col("f2p_total")), "broke-other")
        .when(broke, "partial+broke")
        .when(F.col("f2p_pass") > 0, "partial")
        .otherwise("wrong-fix")
    )


def attempt_outcome() -> Column:
    """The outcome that export rows still tell: resolved, timed out or failed."""
    return F.when(F.col("resolved"), "resolved").when(F.col("timed_out"), "timed-out").otherwise("failed")


def median_minutes(rows: DataFrame, by: list[str], approximate: bool) -> DataFrame:
    return medians(rows, by, "secs", "_secs", approximate).select(*by, (F.col("_secs") / 60).alias("median_minutes"))


def arm_summary(rows: DataFrame, by: list[str], approximate: bool = False) -> DataFrame:
    """Per arm: attempts, resolved, timed out, median minutes (exact, or ``approximate``), tasks, tasks solved ever and
    always, most repeats."""
    tasks = rows.groupBy(*by, "repo", "sha").agg(F.count(F.lit(1)).alias("r"), F.bool_or("resolved").alias("ever"), F.bool_and("resolved").alias("always"))
    across = tasks.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), F.count_if("ever").alias("solved_ever"), F.count_if("always").alias("solved_always"), F.max("r").alias("repeats"))
    plain = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("resolved"), F.count_if("timed_out").alias("timed_out"))
    return plain.join(median_minutes(rows, by, approximate), by, "left").join(across, by)


def outcome_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """How often each outcome, long: by, outcome, n."""
    return rows.groupBy(*by, attempt_outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def outcome_matrix(rows: DataFrame) -> DataFrame:
    """Cell text per task and arm: the outcome of a single attempt, "k/n resolved" if any of several resolved, else the
    commonest failure with its count (ties by name)."""
    counted = rows.groupBy("repo", "sha", "arm", attempt_outcome().alias("o")).agg(F.count(F.lit(1)).alias("c"))
    best = F.max_by("o", F.struct("c", F.translate("o", "abcdefghijklmnopqrstuvwxyz-", "zyxwvutsrqponmlkjihgfedcba~")))
    cells = counted.groupBy("repo", "sha", "arm").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("o") == "resolved", F.col("c"))), F.lit(0)).alias("k"), best.alias("o"), F.max("c").alias("c"))
    text = F.when(F.col("n") == 1, F.col("o")).when(F.col("k") > 0, F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" resolved"))).otherwise(F.concat(F.col("o"), F.lit(" x"), F.col("c").cast("string")))
    return cells.select("repo", "sha", "arm", text.alias("cell"))


def ledger(attempts: DataFrame, reason: Column) -> DataFrame:
    """Per arm: counted attempts, and excluded ones by reason (the text before the first colon); reason null = counted."""
    normal = F.coalesce(F.trim(F.substring_index(reason, ":", 1)), F.lit("counted"))
    return attempts.groupBy("arm", normal.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def evidence(rows: DataFrame, by: list[str], approximate: bool = False) -> DataFrame:
    """A slice's pooled rate, median minutes, failed, timed out, time-bound flag, and how many machines it mixes (more
    than one is refused by ``require_single``)."""
    more = rows.groupBy(*by).agg(F.count_if(~F.col("resolved")).alias("failed"), F.count_if("timed_out").alias("timed_out"), F.count_distinct("machine").alias("machines"))
    return task_rate(rows, by).join(median_minutes(rows, by, approximate), by, "left").join(more, by).withColumn("time_bound", time_bound(F.col("timed_out"), F.col("failed")))


def require_single(found: DataFrame, column: str) -> DataFrame:
    """The frame; raises when a row of it is computed whose ``column`` is over 1."""
    return found.filter(F.when(F.col(column) > 1, F.raise_error(F.concat(F.lit(f"{column}: "), F.col(column).cast("string"))).isNull()).otherwise(F.lit(True)))


def one_per_task(rows: DataFrame) -> DataFrame:
    """Each task's attempt with the smallest run_key (then repeat)."""
    return rows.groupBy("repo", "sha").agg(F.min_by(F.struct("resolved", "cost_usd"), F.struct("run_key", "rep")).alias("a")).select("repo", "sha", "a.resolved", "a.cost_usd")


def pair_by_prefix(this: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of two slices, task by task: same repo, and either sha is a prefix of the other. Columns of both sides come with
    a_ and b_.

    The longer sha is cut to every length that shas of the other side have (few, as a sha has few lengths), and the cuts
    meet the other side's whole shas: a join of equal values, in which a short sha meets only what begins with it."""
    one, two = (df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns]) for df, p in ((this, "a_"), (other, "b_")))

    def cut(longer: DataFrame, p: str, shorter: DataFrame, q: str, equal: bool) -> DataFrame:
        lengths = F.array(*[F.lit(r["k"]) for r in shorter.select(F.length(f"{q}sha").alias("k")).filter("k IS NOT NULL").distinct().collect()]).cast("array<int>")
        n = F.length(f"{p}sha")
        cuts = longer.withColumn("_k", F.explode(F.filter(lengths, lambda k: (k <= n) if equal else (k < n)))).withColumn("_cut", F.expr(f"substring({p}sha, 1, _k)"))
        same = (F.col(f"{p}repo") == F.col(f"{q}repo")) & (F.col("_cut") == F.col(f"{q}sha"))
        return cuts.join(shorter, same).select(*one.columns, *two.columns)

    return cut(one, "a_", two, "b_", True).unionByName(cut(two, "b_", one, "a_", False))


def paired_counts(pairs: DataFrame) -> DataFrame:
    """One row: pairs, each side's resolved, resolved by one side only. The test is added by ``paired_test``."""
    a, b = F.col("a_resolved"), F.col("b_resolved")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(a).alias("a_solved"), F.count_if(b).alias("b_solved"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))


def paired_test(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p_value", mcnemar_exact("only_a", "only_b"))


def capability(counts: DataFrame, margin: float = 0.10) -> DataFrame:
    """The gap b minus a with its interval and standing."""
    return counts.withColumn("d", paired_difference("only_b", "only_a", "pairs")).select("*", F.col("d.gap").alias("gap"), F.col("d.lo").alias("gap_lo"), F.col("d.hi").alias("gap_hi"), standing(F.col("d.lo"), F.col("d.hi"), margin).alias("standing")).drop("d")


def cloud_side(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """One row: what the cloud arm did and cost on the tasks both ran, cost weighted by how often local resolved."""
    mine = per_task(local, []).select("repo", "sha", F.col("p").alias("lp"))
    theirs = cloud.groupBy("repo", "sha").agg(F.avg(F.col("resolved").cast("double")).alias("cp"), F.avg("cost_usd").alias("c"))
    lp, cp, c = F.col("lp"), F.col("cp"), F.col("c")
    return mine.join(theirs, ["repo", "sha"]).agg(
        F.count(F.lit(1)).alias("tasks"), F.sum(cp).alias("resolved"), F.sum(lp * (1 - cp)).alias("only_local"), F.avg(c).alias("usd_per_task"),
        F.coalesce(F.try_divide(F.sum(lp * c), F.sum(lp)), F.avg(c)).alias("usd_saved"), F.coalesce(F.try_divide(F.sum((1 - lp) * c), F.sum(1 - lp)), F.avg(c)).alias("usd_rest"),
    )


def missing_tasks(ran: DataFrame, other: DataFrame) -> DataFrame:
    """Tasks of ``ran`` that ``other`` never attempted."""
    return ran.select("repo", "sha").distinct().join(other.select("repo", "sha").distinct(), ["repo", "sha"], "left_anti")


def api_verdict(ev: DataFrame, cloud: Column, monthly: float = 200.0, tasks_per_month: float = 400.0, deferrable: float = 0.5, triage_minutes: float | Column = 5.0, hourly: float = 60.0, watts: float = 60.0, kwh: float = 0.3, min_tasks: int = 20, min_saving: float = 5.0, saving_share: float = 0.05) -> DataFrame:
    """Stay or split (or switch) for a bill by use, per row of evidence: net at the rate's ends, break-even rate and
    cloud cost, call and confidence. ``cloud`` is the price per task. A stay read off a time-bound rate is not sure."""
    local = F.lit(watts / 1000 * kwh) * F.col("median_minutes") / 60
    triage = (triage_minutes if isinstance(triage_minutes, Column) else F.lit(float(triage_minutes))) / 60 * hourly
    queued, bar = tasks_per_month * deferrable, max(min_saving, saving_share * monthly)
    net = lambda p: F.lit(queued) * (p * cloud - local - (1 - p) * triage)
    lo, mid, hi = (net(F.col(c)) for c in ("lo", "point", "hi"))
    few, switch = F.col("tasks") < min_tasks, F.lit(deferrable >= 0.9) & (F.col("lo") >= 0.8)
    call = F.when(few, "stay").when(switch, "switch").when(mid >= bar, "split").otherwise("stay")
    sure = F.when(few, False).when(switch, True).when(lo >= bar, True).when(mid >= bar, False).otherwise((hi < bar) & ~F.col("time_bound"))
    return ev.select(
        "*", lo.alias("net_lo"), mid.alias("net"), hi.alias("net_hi"), F.try_divide(local + triage, cloud + triage).alias("breakeven_rate"),
        F.try_divide(local + (1 - F.col("point")) * triage, F.when(F.col("point") > 0, F.col("point"))).alias("breakeven_cost"), call.alias("call"), sure.alias("confident"),
    )


def subscription_verdict(ev: DataFrame, plan_price: float = 100.0, plan_capacity: float = 5.0, lower_price: float = 20.0, lower_capacity: float = 1.0, usage: float = 0.4, tasks_per_month: float = 400.0, deferrable: float = 0.5, triage_minutes: float = 5.0, hourly: float = 60.0, watts: float = 60.0, kwh: float = 0.3, min_tasks: int = 20) -> DataFrame:
    """The same for a flat plan: whether local work makes the next lower plan fit, else headroom under the cap."""
    queued = tasks_per_month * deferrable
    run = F.lit(queued * watts / 1000 * kwh) * F.col("median_minutes") / 60
    p_down, saving = (1 - lower_capacity / (usage * plan_capacity)) / deferrable, plan_price - lower_price
    net = lambda p: F.when(p >= p_down, saving).otherwise(0.0) - run - queued * (1 - p) * (triage_minutes / 60 * hourly)
    lo, mid = F.col("lo"), F.col("point")
    sure_split, split = (lo >= p_down) & (net(lo) > 0), (mid >= p_down) & (net(mid) > 0)
    headroom = F.lit(usage >= 1) & (deferrable * lo >= 0.10)
    few, fits = F.col("tasks") < min_tasks, F.lit(p_down <= 0)
    call = F.when(few | fits, "stay").when(sure_split | split | headroom, "split").otherwise("stay")
    sure = F.when(few, False).when(fits, True).when(sure_split, True).when(split, False).when(headroom, True).otherwise(~F.col("time_bound"))
    return ev.select("*", F.lit(p_down).alias("p_down"), net(lo).alias("net_lo"), net(mid).alias("net"), call.alias("call"), sure.alias("confident"))


def verdict_curve(ev: DataFrame, prices: list[float], triage: list[float], **how) -> DataFrame:
    """The verdict over a grid of prices and triage minutes: each row of evidence times the grid, which is a literal."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("price"), F.lit(float(t)).alias("triage")) for p in prices for t in triage]))
    return api_verdict(ev.withColumn("g", grid).select("*", "g.price", "g.triage").drop("g"), F.col("price"), triage_minutes=F.col("triage"), **how)


def tasks_needed(rates: DataFrame, half_width: float) -> DataFrame:
    """Fewest tasks whose interval at each rate is no wider than +-half_width: the width solved for n, a quadratic, and
    the first of the numbers around the root that satisfies it (rounding)."""
    p, z, h = F.col("point"), Z95 * Z95, half_width * half_width
    b = z * p * (1 - p) - 2 * h * z
    root = F.ceil((b + F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * h * (h - 0.25) * z * z))) / (2 * h))
    w = lambda k: wilson(p * k, k)
    around = F.sequence(F.greatest(F.lit(1).cast("long"), root - 1), F.greatest(F.lit(1).cast("long"), root + 1))
    return rates.withColumn("tasks_needed", F.get(F.filter(around, lambda k: (w(k)["hi"] - w(k)["lo"]) / 2 <= half_width), 0))


def plan_nights(needed: DataFrame, cells: int, minutes: Column, night_hours: float = 8.0) -> DataFrame:
    """New attempts for the missing tasks, and nights of back-to-back attempts."""
    new = F.greatest(F.col("tasks_needed") - F.col("tasks"), F.lit(0)) * cells
    per_night = F.greatest(F.lit(1), F.floor(F.lit(night_hours * 60) / F.greatest(minutes, F.lit(0.1))))
    return needed.withColumn("attempts_needed", new).withColumn("nights", F.ceil(new / per_night))


def open_cells(attempts: DataFrame, reps: int) -> DataFrame:
    """Cells rep x arm x cond x task without a recorded attempt. The pairs of arm and condition are a short list by nature: one
    row, which comes to each task as an array."""
    pairs = attempts.agg(F.collect_set(F.struct("arm", "cond")).alias("_pairs"))
    tasks = attempts.select("repo", "sha").distinct().join(F.broadcast(pairs), how="cross")
    cells = tasks.withColumn("_pair", F.explode("_pairs")).select("repo", "sha", "_pair.arm", "_pair.cond").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return cells.join(attempts.select("repo", "sha", "arm", "cond", F.col("rep").cast("int").alias("rep")).distinct(), ["repo", "sha", "arm", "cond", "rep"], "left_anti")


def bench_list(rows: DataFrame) -> DataFrame:
    """Per repo: attempts, tasks, arms and conditions (sorted, comma-joined), last activity."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("sha").alias("tasks"), names("arm").alias("arms"), names("cond").alias("conds"), F.max("committed").alias("last"))


def running_rate(tasks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rate and interval after each task in order. Columns p (share resolved) and those named."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    k, n = F.sum("p").over(w), F.count(F.lit(1)).over(w)
    return tasks.withColumns({"k": k, "after": n}).withColumn("w", wilson(F.col("k"), F.col("after"))).select(*by, *order, "after", share(F.col("k"), F.col("after")).alias("rate"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))


def claim_metrics(rows: DataFrame, versus: DataFrame) -> DataFrame:
    """Evidence of a slice next to its paired comparison with another, in one row."""
    pairs = capability(paired_test(paired_counts(pair_by_prefix(one_per_task(rows), one_per_task(versus)))))
    one = F.lit(1)
    return evidence(rows.withColumn("one", one), ["one"]).join(pairs.withColumn("one", one), "one").drop("one")


def check_claims(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """claims (claim, metric, published text) against metrics (claim, metric, value): the value, rounded half up to the
    published digits, is the published number; a missing or null value fails."""
    digits = F.length(F.regexp_extract("published", r"\.(\d+)$", 1))
    joined = claims.join(metrics, ["claim", "metric"], "left")
    # Decimal text keeps the comparison exact; digits vary by row, so the scale is done by powers of ten.
    scaled = F.round(F.col("value").cast("string").cast("decimal(38,12)") * F.pow(F.lit(10), digits).cast("decimal(18,0)"), 0)
    wanted = F.round(F.col("published").cast("decimal(38,12)") * F.pow(F.lit(10), digits).cast("decimal(18,0)"), 0)
    return joined.withColumn("passes", F.coalesce(scaled == wanted, F.lit(False)))


def settings_grid(rows: DataFrame, setting: str) -> DataFrame:
    """Per setting: tasks, attempts, rate; ``complete`` says that it ran every task of the grid as often as the others."""
    tasks = rows.groupBy(setting, "repo", "sha").agg(F.count(F.lit(1)).alias("n"))
    every = tasks.groupBy("repo", "sha").agg(F.max("n").alias("most"))
    total = every.agg(F.count(F.lit(1)).alias("all_tasks")).withColumn("one", F.lit(1))
    by = tasks.join(every, ["repo", "sha"]).groupBy(setting).agg(F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("attempts"), F.bool_and(F.col("n") == F.col("most")).alias("even")).withColumn("one", F.lit(1))
    return by.join(total, "one").drop("one").withColumn("complete", F.col("even") & (F.col("tasks") == F.col("all_tasks"))).drop("even", "all_tasks")


def first_specimen(rows: DataFrame) -> DataFrame:
    """Per arm, the first counted attempt by position: first task in commit order, its first repeat."""
    best = F.min_by(F.struct("repo", "sha", "rep", "run_key", "resolved"), F.struct("committed", "repo", "sha", "rep", "run_key"))
    return rows.groupBy("arm").agg(best.alias("s")).select("arm", "s.*")
