"""Streams over logs that arrive in several batches: equal to their batch twins, with state that ends."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from agentlens.operators import observe, sequences
from agentlens.sources import logs
from agentlens.sources.paths import shared_path
from agentlens.streaming import trackers

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def arriving(spark, batches, schema):
    """A stream that reads one of the batches at a time."""
    path = shared_path(spark, "arriving")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b={i:03}")
    # Folders by batch, oldest first, as a file source takes files in the order in which they were written.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def cut(rows, k, seed):
    rng = random.Random(seed)
    ends = sorted(rng.sample(range(1, len(rows)), k - 1))
    return [rows[a:b] for a, b in zip([0, *ends], [*ends, len(rows)], strict=True)]


EVENT = "user_id long, id long, ts timestamp, kind string, task_id string, hash int"


@pytest.mark.parametrize("seed", [1, 2])
def test_retries_in_batches(spark, seed):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(120):
        t += rng.randrange(1, 400)
        rows.append((rng.randrange(3), i, at(t), rng.choice(["complete", "submit"]), f"t{i}", rng.randrange(2)))
    want = {tuple(r) for r in sequences.retry_signal(spark.createDataFrame(rows, EVENT)).collect()}
    got = trackers.run_to_table(trackers.retry_tracker(arriving(spark, cut(rows, 5, seed), EVENT)))
    assert {(r.user_id, r.task_id, r.by_id, r.signal) for r in got.collect()} == want and len(want) > 10


def state_rows(stream):
    query = stream.writeStream.format("noop").option("checkpointLocation", shared_path(stream.sparkSession, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_pending_completions_expire(spark):
    done = [(u, u, at(u), "complete", f"t{u}", 0) for u in range(50)]
    kept = trackers.retry_tracker(arriving(spark, [done], EVENT), late="10 seconds")
    assert state_rows(kept) == 50
    later = trackers.retry_tracker(arriving(spark, [done, [(99, 999, at(10_000), "submit", "x", 1)], [(99, 1000, at(10_001), "submit", "x", 1)]], EVENT), late="10 seconds")
    assert state_rows(later) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_meet_decisions_in_batches(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(150):
        rows.append((i, f"t{rng.randrange(6)}", at(i * 100 + rng.randrange(90)), bool(i % 3)))
    rows += [(1000 + i, "end", at(10**6 + i), bool(i % 2)) for i in range(4)]  # closes what is before
    want = {}
    for i, task, ts, decision in rows[:150]:
        if not decision:
            before = [(t, j) for j, k, t, d in rows[:150] if d and k == task and t <= ts and (ts - t).total_seconds() <= 3600]
            want |= {i: max(before)[1]} if before else {}
    log = arriving(spark, [*cut(rows[:150], 4, seed), rows[150:152], rows[152:]], "id long, task_id string, ts timestamp, decision boolean")
    found = trackers.outcomes_attached(log.filter("decision").select("id", "task_id", "ts"), log.filter("NOT decision").select(F.col("id").alias("outcome_id"), "task_id", "ts"), "1 hour", "5 minutes")
    assert {r.outcome_id: r.decision_id for r in trackers.run_to_table(found).filter("outcome_id < 1000").collect()} == want and len(want) > 20


def test_events_arrive_once(spark):
    rows = [(i, at(i * 60), "a") for i in range(40)]
    batches = [rows[:20], rows[15:30], [rows[3], *rows[25:]], rows[:5]]
    got = trackers.run_to_table(trackers.once(arriving(spark, batches, "event_id long, ts timestamp, event_type string"))).collect()
    assert sorted(r.event_id for r in got) == list(range(40))


def test_budget_and_drift_in_batches(spark):
    rng = random.Random(4)
    rows = [(i, f"b{rng.randrange(2)}", "a", rng.random() if i % 7 else None, rng.random() * 0.03) for i in range(200)]
    schema = "id long, bucket string, selected_agent string, reward double, cost_usd double"
    df = spark.createDataFrame(rows, schema)
    stream = lambda: arriving(spark, cut(rows, 4, 3), schema)
    paced = trackers.run_to_table(trackers.budget_tracker(stream(), 0.014, "bucket", window=9))
    want = {r.id: r.multiplier for r in sequences.budget_pacer(df, 0.014, "bucket", window=9).collect()}
    assert {r.id: pytest.approx(r.multiplier, abs=1e-9) for r in paced.collect()} == want
    drift = trackers.run_to_table(trackers.drift_tracker(stream(), sigma=0.1, window=8, least=6, every=3))
    alerts = {r.id: r.sigmas for r in sequences.drift_alerts(df, sigma=0.1, window=8, least=6, every=3).collect()}
    assert {r.id: pytest.approx(r.sigmas) for r in drift.collect()} == alerts and alerts


def test_sketches_merge(spark):
    rows = [(g, day, f"s{(day * 37 + i) % 3000}") for g in "ab" for day in range(6) for i in range(900 if g == "a" else 5)]
    df = spark.createDataFrame(rows, "g string, day int, s string")
    days = observe.daily_sketches(df, ["g", "day"], "s")
    got = {r.g: r.n for r in observe.merged_distinct(days.filter("day < 4"), ["g"], "n").collect()}
    exact = {g: len({s for h, d, s in rows if h == g and d < 4}) for g in "ab"}
    assert all(abs(got[g] - exact[g]) <= max(1, 4 * observe.SKETCH_ERROR * exact[g]) for g in "ab")


def test_small_files_and_torn_ones(spark):
    path = shared_path(spark, "files")
    rows = [(f"x/{i}.json", '{"arm": "a%d", "cost_usd": null, "more": 1}' % (i % 3) if i % 5 else '{"arm": "a') for i in range(60)] + [("y/list.json", "[1, 2"), ("y/empty.json", "")]
    assert logs.write_files(spark.createDataFrame(rows, "name string, body string"), path) == len(rows)
    got = logs.attempt_files(spark, path, "arm string, cost_usd double", {"cost_usd": 0.5}, files_per_task=20)
    assert got.rdd.getNumPartitions() <= 4
    found = got.collect()
    assert len(found) == len(rows) - 1 and {r.path.rsplit("/", 1)[1] for r in found if r.torn} >= {f"{i}.json" for i in range(0, 60, 5)} | {"list.json"}
    assert {(r.arm, r.cost_usd) for r in found if not r.torn and r.arm} == {(f"a{i}", 0.5) for i in range(3)}


def test_attempt_files_are_listed_by_tasks(spark):
    path = shared_path(spark, "files")
    names = [f"r{i % 7}/s {i % 3}/{i}.json" for i in range(90)] + ["top.json", ".hidden/x.json", "_hidden/x.json", "r1/_x.json", "r1/k=1/_k=1.json", "r1/50%.json", "r1/empty.json"]
    logs.write_files(spark.createDataFrame([(n, "" if "empty" in n else '{"arm": "%s"}' % n) for n in names], "name string, body string"), path)
    got = logs.attempt_files(spark, path, "arm string", {}, files_per_task=40)
    # The driver's plan holds the table that the tasks made of the folders, not one entry a file.
    assert not any(f.endswith(".json") for f in got.inputFiles()) and got.rdd.getNumPartitions() == 3
    plain = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("_metadata.file_path", "value").collect()
    assert sorted((r.path, '{"arm": "%s"}' % r.arm) for r in got.collect()) == sorted(map(tuple, plain)) and len(plain) == 93
    for single in (f"{path}/r*", f"{path}/top.json"):
        assert logs.attempt_files(spark, single, "arm string", {}).count() == (92 if "*" in single else 1)


def test_markdown_is_listed_by_tasks(spark):
    path = shared_path(spark, "notes")
    bodies = {"en/2024-05-01-a.md": "text", "en/deep/b.md": "x\n# Head \n", "c.md": "\u00e9", "en/readme.md": "no", "en/d.txt": "no", "en/blank.md": " \n", "e.md": ""}
    logs.write_files(spark.createDataFrame(list(bodies.items()), "name string, body string"), path)
    got = logs.markdown_corpus(spark, path)
    assert not any(f.endswith(".md") for f in got.inputFiles())
    assert {(r.title, r.date, r.kind, r.body) for r in got.collect()} == {("2024-05-01-a", "2024-05-01", "en", "text"), ("Head", "", "en", "x\n# Head \n"), ("c", "", "", "\u00e9")}
