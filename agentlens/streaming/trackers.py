"""Stateful trackers over growing logs. Each equals its batch operator on the same rows, whatever the micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from agentlens.operators.learning import QUARANTINE_SCHEMA, quarantine_step
from agentlens.sources.paths import shared_path


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what its sink holds. A complete result goes to a new folder with each
    batch, so that a failure on the way leaves the one before whole."""
    spark = stream.sparkSession
    path, check = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    writer = stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        batches: list[int] = []

        def keep(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{path}/batch-{batch}")
            batches.append(batch)

        writer = writer.outputMode(mode).foreachBatch(keep)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path if mode == "append" else f"{path}/batch-{batches[-1]}") if mode == "append" or batches else spark.createDataFrame([], stream.schema)


def funnel_by_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """events (ts timestamp, event, candidate) -> counts per day."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    return w.agg(F.count_if(F.col("event") == "delegated").alias("delegated"), F.count_if((F.col("event") == "inline") & F.col("candidate")).alias("candidates")).select(F.col("window.start").alias("day"), "delegated", "candidates")


def machine_state(samples: DataFrame, late: str = "1 hour") -> DataFrame:
    """samples (ts, cpu_percent) -> mean, share of hot samples, level per sliding hour."""
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", "1 hour", "10 minutes"))
    hot = F.avg((F.col("cpu_percent") >= 80).cast("double"))
    return w.agg(F.count(F.lit(1)).alias("samples"), F.avg("cpu_percent").alias("cpu_avg"), hot.alias("hot_share")).select(F.col("window.start").alias("start"), "samples", "cpu_avg", "hot_share", F.when(F.col("hot_share") >= 0.2, "strained").otherwise("fine").alias("level"))


def _sorted(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by)


def retry_tracker(events: DataFrame, retry_s: float = 300, accept_s: float = 600, late: str = "1 hour") -> DataFrame:
    """events (user_id, id, ts, kind, task_id, hash) -> user_id, task_id, by_id, signal. The state is the user's pending
    completion; it ends when a submission has used it up or none can: with the first event too late for it, or when the
    watermark has passed the last instant at which one could come. Events later than ``late`` are left out."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending = state.get if state.exists else None
        out = []
        for r in _sorted(batches, ["ts", "id"]).itertuples():
            at = r.ts.timestamp()
            if r.kind == "complete":
                pending = (at, int(r.hash), r.task_id)
            elif pending is not None:
                gap, same = at - pending[0], int(r.hash) == pending[1]
                if gap <= (retry_s if same else accept_s):
                    out.append((key[0], pending[2], r.id, 0.0 if same else 0.6))
                    pending = None
                elif gap > accept_s:
                    pending = None
        ends = int((pending[0] + max(retry_s, accept_s)) * 1000) + 1 if pending is not None else 0
        if ends > state.getCurrentWatermarkMs():
            state.update(pending)
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "task_id", "by_id", "signal"])

    rows = events.withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, task_id string, by_id long, signal double", "at double, hash int, task string", "append", GroupStateTimeout.EventTimeTimeout)


def outcomes_attached(decisions: DataFrame, outcomes: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """decisions (id, task_id, ts), outcomes (outcome_id, task_id, ts, ...) as streams -> every outcome once, with decision_id:
    its task's latest decision of the time ``within`` before it. A join of two streams over an interval of time: decisions
    leave the state when no outcome can reach back to them, outcomes when the watermark says that no earlier decision is
    still to come. Outcomes without a decision are left out."""
    d = decisions.select(F.col("task_id").alias("_task"), F.col("ts").alias("_at"), F.col("id").alias("_id")).withWatermark("_at", late)
    o = outcomes.withWatermark("ts", late)
    near = (F.col("task_id") == F.col("_task")) & (F.col("_at") <= F.col("ts")) & (F.col("_at") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    return o.join(d, near).groupBy(*outcomes.columns).agg(F.max_by("_id", F.struct("_at", "_id")).alias("decision_id"))


def drift_tracker(decisions: DataFrame, sigma: float = 2.0, window: int = 50, least: int = 20, every: int = 10) -> DataFrame:
    """decisions (id, bucket, selected_agent, reward) -> alerts. State: count, mean, squared deviations, last rewards."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, last = state.get if state.exists else (0, 0.0, 0.0, [])
        last, out = list(last), []
        for r in _sorted(batches, ["id"]).itertuples():
            n += 1
            d = r.reward - mean
            mean += d / n
            m2 += d * (r.reward - mean)
            last = [*last, r.reward][-window:]
            if n >= least and n % every == 0 and m2 > 0:
                std, recent = (m2 / (n - 1)) ** 0.5, sum(last) / len(last)
                if recent < mean - sigma * std:
                    out.append((r.id, *key, n, mean, std, recent, (mean - recent) / std))
        state.update((n, mean, m2, last))
        yield pd.DataFrame(out, columns=["id", "bucket", "selected_agent", "n", "mean", "std", "recent", "sigmas"])

    rows = decisions.filter("reward IS NOT NULL").select("id", "bucket", "selected_agent", "reward")
    return rows.groupBy("bucket", "selected_agent").applyInPandasWithState(step, "id long, bucket string, selected_agent string, n long, mean double, std double, recent double, sigmas double", "n long, mean double, m2 double, last array<double>", "append", GroupStateTimeout.NoTimeout)


def quarantine_tracker(events: DataFrame, **how) -> DataFrame:
    """events (bucket, id, kind, agent, value) -> what happens to agents; the state is the bucket's machine as JSON."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = json.loads(state.get[0]) if state.exists else {"ticks": 0, "agents": {}}
        out = quarantine_step(machine, _sorted(batches, ["id"]), **how)
        state.update((json.dumps(machine),))
        yield pd.DataFrame(out, columns=["bucket", "id", "agent", "event"])

    return events.groupBy("bucket").applyInPandasWithState(step, QUARANTINE_SCHEMA, "machine string", "append", GroupStateTimeout.NoTimeout)


def _pace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, tenant: str, ceiling: float, eta: float, window: int) -> Iterator[pd.DataFrame]:
    value, last = state.get if state.exists else (0.0, [])
    last, out = list(last), []
    for r in _sorted(batches, ["id"]).itertuples():
        last = [*last, r.cost_usd][-window:]
        mean = sum(last) / len(last)
        value = max(0.0, value + eta * (mean - ceiling))
        out.append((key[0], r.id, mean, value, ceiling - mean, mean > ceiling))
    state.update((value, last))
    yield pd.DataFrame(out, columns=[tenant, "id", "mean_cost", "multiplier", "headroom", "over"])


def budget_tracker(decisions: DataFrame, ceiling: float, tenant: str, eta: float = 0.5, window: int = 100) -> DataFrame:
    """decisions (tenant, id, cost_usd) -> the pacer's multiplier after each. State: multiplier, last costs."""
    step = partial(_pace, tenant=tenant, ceiling=ceiling, eta=eta, window=window)
    rows = decisions.select(tenant, "id", "cost_usd")
    return rows.groupBy(tenant).applyInPandasWithState(step, f"{tenant} string, id long, mean_cost double, multiplier double, headroom double, over boolean", "value double, last array<double>", "append", GroupStateTimeout.NoTimeout)


def cap_tracker(rows: DataFrame, cap: int = 25, late: str = "1 day") -> DataFrame:
    """rows (id, ts timestamp) -> id, passes: the day's first ``cap``. A day's count is dropped once the watermark has left
    the day behind."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, out = (state.get[0] if state.exists else 0), []
        for r in _sorted(batches, ["ts", "id"]).itertuples():
            out.append((r.id, n < cap))
            n += 1
        state.update((n,))
        end = int(pd.Timestamp(key[0]).timestamp() * 1000) + 86_400_000
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame(out, columns=["id", "passes"])

    dated = rows.withWatermark("ts", late).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return dated.groupBy("day").applyInPandasWithState(step, "id long, passes boolean", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by id once, though they may arrive again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
