"""Hand-computed cases, and helpers against a plain second method."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agentlens.functions import stats
from agentlens.functions import text as X
from agentlens.operators import audit, joins, learning, observe, reports, sequences


def one(df):
    return df.collect()[0]


def test_wilson_conventions(spark):
    r = one(spark.range(1).select(stats.wilson(F.lit(0), F.lit(0)).alias("a"), stats.wilson_ranking(F.lit(0), F.lit(0)).alias("b"), stats.wilson(F.lit(17), F.lit(47)).alias("c")))
    assert tuple(r.a) == (0, 1) and tuple(r.b) == (0, 0)
    assert (round(r.c.lo, 2), round(r.c.hi, 2)) == (0.24, 0.50)


def test_mcnemar_exact_values(spark):
    df = spark.createDataFrame([(7, 1), (1, 7), (5, 5), (0, 0)], "a int, b int").select(stats.mcnemar_exact("a", "b").alias("p"))
    p = [r.p for r in df.collect()]
    assert p == pytest.approx([18 / 256, 18 / 256, 1.0, 1.0])


def test_paired_difference_inverts_its_test(spark):
    r = one(spark.createDataFrame([(30, 0, 47)], "a int, b int, n int").select(stats.paired_difference("a", "b", "n").alias("d"))).d
    assert r.gap == pytest.approx(30 / 47) and (round(r.lo, 2), round(r.hi, 2)) == (0.50, 0.76)
    for end, sign in ((r.lo, 1), (r.hi, -1)):
        z = stats._score(np.array([30.0]), np.array([0.0]), np.array([47.0]), np.array([end]))[0]
        assert z * sign == pytest.approx(stats.Z95, abs=1e-5)


def test_half_up(spark):
    r = one(spark.range(1).select(stats.half_up(F.lit(0.125), 2).alias("a"), stats.half_up(F.lit(2.675), 2).alias("b")))
    assert float(r.a) == 0.13 and float(r.b) == 2.68


def test_slice_refuses_unknown_keys(spark):
    with pytest.raises(ValueError):
        audit.select_slice(spark.range(1), colour="red")


def test_standing(spark):
    df = spark.createDataFrame([(-0.2, -0.1), (-0.1, 0.05), (0.2, 0.3), (0.0, 0.2)], "lo double, hi double").select(stats.standing(F.col("lo"), F.col("hi")).alias("s"))
    assert [r.s for r in df.collect()] == ["ahead", "caught up", "behind", "open"]


def test_outcome_labels(spark):
    rows = [(True, ["a"], [], True, 0, False, 1, 1), (False, ["t"], ["t"], True, 0, False, 0, 1), (False, ["a"], [], False, 0, False, 0, 1), (False, ["a"], [], True, 2, False, 1, 1), (False, ["a"], [], True, 2, False, 0, 1), (False, ["a"], [], True, 0, False, 1, 2), (False, ["a"], [], True, 0, False, 0, 2)]
    df = spark.createDataFrame(rows, "resolved boolean, edited array<string>, touched_tests array<string>, hit_gold_file boolean, regressions int, suite_crashed boolean, f2p_pass int, f2p_total int")
    assert [r.o for r in df.select(audit.outcome().alias("o")).collect()] == ["resolved", "no-edit", "wrong-file", "broke-other", "partial+broke", "partial", "wrong-fix"]


def test_verdict_is_zero_at_break_even(spark):
    ev = spark.createDataFrame([(0.5, 0.4, 0.6, 50, 30.0, False)], "point double, lo double, hi double, tasks int, median_minutes double, time_bound boolean")
    price = one(audit.api_verdict(ev, F.lit(1.0))).breakeven_cost
    assert one(audit.api_verdict(ev, F.lit(price))).net == pytest.approx(0, abs=1e-9)


def test_prefix_pairs_both_ways(spark):
    a = spark.createDataFrame([("r", "abcd1234", True), ("r", "ffff0000", False)], "repo string, sha string, resolved boolean")
    b = spark.createDataFrame([("r", "abcd1234beef", False), ("r", "ffff", True), ("q", "abcd1234", True)], "repo string, sha string, resolved boolean")
    assert sorted((r.a_sha, r.b_sha) for r in audit.pair_by_prefix(a, b).collect()) == [("abcd1234", "abcd1234beef"), ("ffff0000", "ffff")]


def test_window_bounds(spark):
    df = spark.createDataFrame([("2025-01-31T10",), ("2025-02-01",), ("",), (None,)], "ts string")
    keep = lambda *b: [r.ts for r in df.filter(observe.within_window(F.col("ts"), *b)).collect()]
    assert keep("2025-01-01", "2025-01-31") == ["2025-01-31T10"] and len(keep()) == 4


def test_price_by_longest_prefix(spark):
    prices = spark.createDataFrame([("m", 1.0, 1.0, 0.1), ("m-large", 2.0, 2.0, 0.1), ("base", 9.0, 9.0, 0.1)], "known string, input double, output double, cache_read double")
    models = spark.createDataFrame([("m-large-2024",), ("m-small",), ("zz",), ("m",)], "model string")
    assert {r.model: r.known for r in joins.price_rows(models, prices, "base").collect()} == {"m-large-2024": "m-large", "m-small": "m", "zz": "base", "m": "m"}


def test_null_task_ids_stay_apart(spark):
    d = spark.createDataFrame([(1, None, None, None), (2, "a", None, None), (3, "a", None, None)], "id int, task_id string, success int, reward double")
    o = spark.createDataFrame([("a", 1, 0.5)], "task_id string, success int, reward double")
    assert {r.id: r.success for r in joins.attach_outcomes(d, o).collect()} == {1: None, 2: None, 3: 1}


def test_funnel_rate_is_null_without_work(spark):
    e = spark.createDataFrame([("mcp-alive", False, "s", "t")], "event string, candidate boolean, session string, ts string")
    assert one(observe.funnel(e)).rate is None


def test_resources_levels(spark):
    level = lambda hot, heat: one(observe.resources(spark.createDataFrame([(90.0 if i < hot else None, heat) for i in range(10)], "cpu_percent double, thermal_level string")))
    assert [level(*x).level for x in ((3, "nominal"), (1, None), (0, "elevated"))] == ["strained", "fine", "critical"]
    assert level(3, None).cpu_avg == 27 and level(0, None).cpu_max == 0
    none = one(observe.resources(spark.createDataFrame([], "cpu_percent double, thermal_level string")))
    assert (none.samples, none.cpu_avg, none.hot_share, none.level) == (0, None, None, "unknown")


def test_pacer_is_the_recursion(spark):
    rng = random.Random(1)
    costs = [rng.random() * 0.03 for _ in range(400)]
    df = sequences.budget_pacer(spark.createDataFrame([(i, "t", c) for i, c in enumerate(costs)], "id int, k string, cost_usd double"), 0.012, "k")
    value, want = 0.0, []
    for i in range(len(costs)):
        last = costs[max(0, i - 99) : i + 1]
        value = max(0.0, value + 0.5 * (sum(last) / len(last) - 0.012))
        want.append(value)
    assert [r.multiplier for r in df.orderBy("id").collect()] == pytest.approx(want, abs=1e-9)


def test_constant_reward_never_drifts(spark):
    d = spark.createDataFrame([(i, "b", "a", 0.5) for i in range(100)], "id int, bucket string, selected_agent string, reward double")
    assert sequences.drift_alerts(d).count() == 0


def test_pareto_front_is_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.randrange(60), rng.randrange(60)) for i in range(500)]
    want = {p[0] for p in pts if not any(q[1] <= p[1] and q[2] <= p[2] and (q[1] < p[1] or q[2] < p[2]) for q in pts)}
    assert {r.id for r in sequences.pareto_front(spark.createDataFrame(pts, "id int, x int, y int"), "x", "y", bins=7).collect()} == want


def test_age_cap_is_the_loop(spark):
    for n in (5, 10, 11, 12, 25):
        kept = []
        for i in range(n):
            kept = kept[1:] if len(kept) >= 10 else kept
            kept.append(i)
        assert sorted(r.id for r in sequences.age_cap(spark.range(n), 10).collect()) == kept


def test_verdict_text(spark):
    rows = ['{"correct": true}', "it is FALSE", "true or false", "no idea", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(X.parse_verdict(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [True, False, None, None, None]


def test_numbers_fold_fractions(spark):
    r = one(spark.createDataFrame([("3/12 of $1,200 then 5/0 and -2.5",)], "t string").select(X.ordered_numbers(F.col("t")).alias("n"), X.ordered_numbers(F.col("t"), 2).alias("l")))
    assert r.n == [0.25, 1200.0, -2.5] and r.l == [1200.0, -2.5]


def test_code_blocks(spark):
    rows = ["a\n```py\nx = 1\n```\nb", "```py\nx = 2", " plain \n"]
    assert [r.c for r in spark.createDataFrame([(r,) for r in rows], "t string").select(X.extract_code(F.col("t")).alias("c")).collect()] == ["x = 1", "x = 2", "plain"]


def test_code_score(spark):
    r = one(spark.createDataFrame([("def f():\n    return 1\n", "x = ")], "a string, b string").select(X.code_score(F.col("a")).alias("a"), X.code_score(F.col("b")).alias("b")))
    assert r.a == pytest.approx(0.9) and r.b == pytest.approx(0.55)


def test_softmax_adds_up(spark):
    r = one(spark.range(1).select(learning.softmax(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(0.2), F.lit("c"), F.lit(0.3))).alias("p"))).p
    assert sum(r.values()) == pytest.approx(1) and r["a"] > r["c"] > r["b"]


def test_linucb_state_is_the_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a", float(rng.random()), float(rng.random()), float(rng.random())) for i in range(60)]
    s = one(learning.linucb_state(spark.createDataFrame(rows, "id int, agent string, x0 double, x1 double, reward double"), ["agent"], ["x0", "x1"], F.lit(1.0)))
    a, b = np.eye(2), np.full(2, 0.5)
    for _, _, p, q, r in rows:
        x = np.array([p, q])
        a, b = 0.98 * a + np.outer(x, x), 0.98 * b + r * x
    assert s.a == pytest.approx(a.ravel().tolist()) and s.b == pytest.approx(b.tolist())


def test_simplex_projection():
    rng = np.random.default_rng(2)
    for _ in range(50):
        w = learning.simplex(rng.normal(0.3, 0.5, 4))
        assert w.sum() == pytest.approx(1) and w.min() >= 0.05 - 1e-12


def test_auc_is_pairwise(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(8) / 8, rng.randrange(2)) for _ in range(80)]
    want = [(p > n) + 0.5 * (p == n) for p, a in rows if a for n, b in rows if not b]
    assert one(learning.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y")).auc == pytest.approx(sum(want) / len(want))


def test_logistic_separates(spark):
    rows = [(i, [float(i % 2), 1.0], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, features array<double>, label int")
    assert one(learning.evaluation(learning.predicted(df, learning.logistic(df, 2)))).auc == 1.0


def test_quarantine_life():

    rows = [("b", 0, "alert", "a", 2.5)] + [("b", i, "decision", "x", 0.9) for i in range(1, 151)]
    out = learning.quarantine_step({"ticks": 0, "agents": {}}, pd.DataFrame(rows, columns=["bucket", "id", "kind", "agent", "value"]))
    assert [o[3] for o in out] == ["quarantined", "progressed", "progressed", "released"]


def test_consensus(spark):
    rows = [("a", i, v) for i, v in enumerate([10.0, 10.1, 30.0])] + [("b", 0, 1.0), ("b", 1, 2.0)] + [("c", 0, 5.0)]
    got = {r.k: r.value for r in learning.consensus(spark.createDataFrame(rows, "k string, i int, v double"), "k").collect()}
    assert got["a"] == pytest.approx(10.05) and got["b"] is None and got["c"] is None


def test_policies_on_four_prompts(spark):
    passed = {"cloud": [1, 1, 1, 0], "x": [1, 0, 0, 0], "y": [0, 1, 0, 0]}
    m = spark.createDataFrame([(f"p{i}", a, bool(v)) for a, vs in passed.items() for i, v in enumerate(vs)], "prompt string, agent string, passed boolean")
    c = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate([0.01, 0.02, 0.03, 0.10])], "prompt string, cost double")
    got = {r.policy: (r.n, r.pass_rate, round(r.cost, 4)) for r in reports.policies(m, c, "cloud", F.col("local")).collect()}
    assert got["always cloud"] == (4, 0.75, 0.04) and got["best of local"][1] == 0.5 and got["routed"] == (4, 0.75, 0.0325)


def test_upper_median(spark):
    df = spark.createDataFrame([("r", float(v)) for v in (1, 2, 3, 4)], "k string, v double")
    assert one(reports.upper_quantile(df, ["k"], "v", 0.5)).v == 3.0


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for how in ({}, {"block": 2, "tile": 1}):  # in one block and in several
        got = {(r["query"], r["rank"]): r.vec_id for r in learning.nearest(df, df.filter("vec_id < 5"), 3, **how).collect()}
        assert len(got) == 15
        for q in range(5):
            d = ((v - v[q]) ** 2).sum(1)
            assert [got[(q, k)] for k in (1, 2, 3)] == np.lexsort((np.arange(60), d.round(9)))[:3].tolist()


def test_quarantine_replay_skips_only_ticks(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(900):
        alert = rng.random() < 0.03
        rows.append((f"b{i % 3}", i, "alert" if alert else "decision", f"a{rng.integers(0, 4)}", float(rng.random() + 0.3)))
    whole = pd.DataFrame(rows, columns=["bucket", "id", "kind", "agent", "value"])
    want = [x for _, part in whole.groupby("bucket") for x in learning.quarantine_step({"ticks": 0, "agents": {}}, part, interval=7)]
    got = learning.quarantine_replay(spark.createDataFrame(whole), interval=7).collect()
    assert len(want) > 40 and sorted(map(tuple, got)) == sorted(want)


def test_tasks_needed_has_no_cap(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.01, 0.5, 0.93, 1.0)], "point double")
    for half in (0.3, 0.05, 0.002):
        for r in audit.tasks_needed(df, half).collect():
            z, p = 1.959963984540054, r.point
            n = np.arange(1, 400_000, dtype=float)
            c, h = (p + z * z / (2 * n)) / (1 + z * z / n), z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
            assert r.tasks_needed == int(np.argmax((np.minimum(1, c + h) - np.maximum(0, c - h)) / 2 <= half + 1e-12)) + 1


def test_counterfactual_of_sparse_cells(spark):
    log = spark.createDataFrame([(i, "b", "many", 0.25) for i in range(6)] + [(9, "b", "few", 1.0)], "id long, bucket string, agent string, reward double")
    cells = log.select("bucket", "agent").distinct()
    assert {r.agent: r.estimate for r in learning.estimated(cells, learning.counterfactual(log)).collect()} == {"many": 0.25, "few": 0.5}


def test_markdown_corpus(spark, tmp_path):
    from agentlens.sources import logs

    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "2025-01-02-x.md").write_text("intro\n# Title here\nbody")
    (tmp_path / "plain.md").write_text("no heading")
    (tmp_path / "index.md").write_text("# skipped")
    (tmp_path / "empty.md").write_text("\n")
    got = {r.title: (r.date, r.kind) for r in logs.markdown_corpus(spark, str(tmp_path)).collect()}
    assert got == {"Title here": ("2025-01-02", "notes"), "plain": ("", "")}


def test_stream_in_many_batches_equals_one(spark, tmp_path):
    from agentlens.streaming import trackers

    rng = random.Random(9)
    rows = [(i, f"t{i % 2}", rng.random() * 0.03) for i in range(120)]
    schema = "id long, k string, cost_usd double"
    for j in range(4):
        spark.createDataFrame(rows[30 * j : 30 * j + 30], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{j}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = {r.id: r.multiplier for r in trackers.run_to_table(trackers.budget_tracker(stream, 0.012, "k")).collect()}
    want = {r.id: r.multiplier for r in sequences.budget_pacer(spark.createDataFrame(rows, schema), 0.012, "k").collect()}
    assert got == pytest.approx(want, abs=1e-9) and math.isfinite(sum(got.values()))


def test_linucb_state_keeps_old_rows_at_slow_decay(spark):
    rows = spark.range(2500).selectExpr("id", "'a' agent", "1.0D x0", "1.0D reward")
    for decay in (1.0, 0.999):
        s = one(learning.linucb_state(rows, ["agent"], ["x0"], F.lit(1.0), decay=decay))
        assert abs(s.a[0] - sum(decay**k for k in range(2500)) - decay**2500) < 1e-6 and s.n == 2500
