"""Blocked scans and selections against plain loops, with blocks and bounds far smaller than in use."""

import random
import statistics
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlens.operators import audit, learning, scans, selection, sequences


def one_key(seed, n=160):
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), n)
    return [(i, "b", "a" if j % 9 else None, None if rng.random() < 0.2 else rng.choice([0.1, 0.5, 0.9, rng.random()]), rng.random() * 0.03) for j, i in enumerate(ids)]


@pytest.fixture(scope="module")
def log(spark):
    rows = one_key(1) + [(20_000 + i, "c", "x", 0.3, 0.01) for i in range(30)]
    return rows, spark.createDataFrame(rows, "id long, bucket string, selected_agent string, reward double, cost_usd double")


def groups(rows, *at):
    out = {}
    for r in sorted(rows):
        out.setdefault(tuple(r[i] for i in at), []).append(r)
    return out


def test_places_and_leads(spark, log):
    rows, df = log
    got = scans.placed(df, ["bucket"], ["id"]).collect()
    assert {(r.id, r.t, r.n) for r in got} == {(r[0], t, len(g)) for g in groups(rows, 1).values() for t, r in enumerate(g, 1)}
    led = scans.blocked(scans.placed(df, ["bucket"], ["id"]), 7, 3).collect()
    mine = sorted((r.block, r.lead, r.t) for r in led if r.bucket == "b" and r.block == 2)
    assert mine == [(2, False, t) for t in range(15, 22)] + [(2, True, t) for t in (12, 13, 14)]


@pytest.mark.parametrize("block", [7, 1000])
def test_rolling_and_drift(spark, log, block):
    rows, df = log
    want = {}
    for (a,), g in groups([(r[0], r[2], r[3]) for r in [(r[0], r[1], r[2] or "", r[3]) for r in rows]], 1).items():
        for i in range(len(g)):
            last = [r[2] or 0.0 for r in g[max(0, i - 4) : i + 1]]
            want[g[i][0]] = (a, sum(last) / len(last))
    got = sequences.rolling_reward(df.fillna("", ["selected_agent"]), n=5, block=block).collect()
    assert {r.id: (r.selected_agent, pytest.approx(r.rolling)) for r in got} == want
    alerts = {}
    for g in groups([(r[0], r[1], r[2] or "", r[3]) for r in rows if r[3] is not None], 1, 2).values():
        for i in range(len(g)):
            v = [r[3] for r in g[: i + 1]]
            if len(v) >= 5 and len(v) % 2 == 0 and (s := statistics.stdev(v)) > 1e-12 and (m := sum(v[-6:]) / len(v[-6:])) < (mean := sum(v) / len(v)) - 0.1 * s:
                alerts[g[i][0]] = (len(v), pytest.approx(mean), pytest.approx(s), pytest.approx(m))
    found = sequences.drift_alerts(df.fillna("", ["selected_agent"]), sigma=0.1, window=6, least=5, every=2, block=block).collect()
    assert {r.id: (r.n, r.mean, r.std, r.recent) for r in found} == alerts and len(alerts) > 5


@pytest.mark.parametrize("block", [150, 1000])
def test_pacer_far_under_its_ceiling(spark, block):
    # The sum of the steps is at -60,000 when the costs begin to pass the ceiling by little.
    costs = [0.0] * 300 + [400.0 + (i % 5) / 1024 for i in range(200)]
    df = sequences.budget_pacer(spark.createDataFrame(list(enumerate(["t"] * 500)), "id int, k string").join(spark.createDataFrame(list(enumerate(costs)), "id int, cost_usd double"), "id"), 400.0, "k", eta=0.1, window=3, block=block)
    lam, want = Fraction(0), []
    for i in range(500):
        last = costs[max(0, i - 2) : i + 1]
        lam = max(Fraction(0), lam + Fraction(0.1 * (sum(last) / len(last) - 400.0)))
        want.append(pytest.approx(float(lam), abs=1e-14))
    assert [r.multiplier for r in df.orderBy("id").collect()] == want and lam > 0.03


@pytest.mark.parametrize("block", [7, 1000])
def test_pacer_regret_and_swaps(spark, log, block):
    rows, df = log
    pace, regrets, swaps = {}, {}, {}
    for g in groups(rows, 1).values():
        lam = total = 0.0
        waste, settled = 0, None
        for i, r in enumerate(g):
            last = [x[4] for x in g[max(0, i - 9) : i + 1]]
            lam = max(0.0, lam + 0.5 * (sum(last) / len(last) - 0.014))
            pace[r[0]] = pytest.approx(lam, abs=1e-12)
            loss = [max(0.0, 1.0 - (x[3] or 0.0)) for x in g[max(0, i - 5) : i + 1]]
            total += loss[-1]
            regrets[r[0]] = (i + 1, pytest.approx(total), pytest.approx(sum(loss) / len(loss)))
            if i and g[i - 1][2] is not None and r[2] is not None and g[i - 1][2] != r[2]:
                waste += 1
            recent = [float(x[4] > 0.02) for x in g[max(0, i - 3) : i + 1]]
            if settled is None and len(recent) == 4 and sum(recent) / 4 < 0.3:
                settled = i + 1
        swaps[g[0][1]] = (waste, settled)
    assert {r.id: r.multiplier for r in sequences.budget_pacer(df, 0.014, "bucket", window=10, block=block).collect()} == pace
    steps = sequences.regret(df, "bucket", "id", F.lit(1.0), F.coalesce("reward", F.lit(0.0)), n=6, block=block)
    assert {r.id: (r.t, r.cumulative, r.rolling) for r in steps.collect()} == regrets
    got = sequences.swap_waste(df, "bucket", F.col("cost_usd") > 0.02, n=4, settled=0.3, block=block).collect()
    assert {r.bucket: (r.swaps, r.settled_at) for r in got} == swaps


def test_constant_values_have_no_deviation(spark):
    d = spark.createDataFrame([(i, "b", "a", 0.3) for i in range(100)], "id int, bucket string, selected_agent string, reward double")
    assert sequences.drift_alerts(d, sigma=0.0, block=9).count() == 0


@pytest.mark.parametrize("few,bins", [(1, 2), (3, 4), (10_000, 1024)])
def test_medians_by_selection(spark, few, bins):
    rng = random.Random(2)
    values = {"a": [rng.gauss(0, 1) for _ in range(301)], "b": [float(rng.randrange(3)) for _ in range(200)], "c": [1e300, -1e300, 5.0, 5.0], "d": [7.0], None: [2.0, 4.0], "e": [None], "f": [1e-9 * i for i in range(50)] + [1e9]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: r.m for r in selection.medians(df, ["k"], "v", "m", few=few, bins=bins).collect()}
    assert got == {k: pytest.approx(statistics.median(vs), abs=0) for k, vs in values.items() if vs != [None]}
    tenth = {r.k: (r.n, r.low, r.high) for r in selection.ranked_values(df, ["k"], "v", lambda n: F.floor(n / 10) + 1, few=few, bins=bins).collect()}
    for k, vs in values.items():
        if vs != [None]:
            s, i = sorted(vs), len(vs) // 10
            assert tenth[k] == (len(s), s[i], s[i + 1] if i + 1 < len(s) else None)


def test_bandit_state_is_the_loop(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "a" if i % 5 else "b", float(rng.random()), float(rng.random()), float(rng.random())) for i in rng.permutation(4000).tolist()]
    df = spark.createDataFrame(rows, "id long, agent string, p double, q double, reward double")
    for decay in (0.5, 1.0):
        for r in learning.linucb_state(df, ["agent"], ["p", "q"], F.lit(1.0), decay=decay).collect():
            a, b, n = np.eye(2), np.full(2, 0.5), 0
            for _, g, *x, y in sorted(rows):
                if g == r.agent:
                    a, b, n = decay * a + np.outer(x, x), decay * b + y * np.array(x), n + 1
            assert r.n == n and np.allclose(np.array(r.a).reshape(2, 2), a) and np.allclose(r.b, b)


def test_logistic_is_at_its_optimum(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.6, 4.0] + 0.3)))).astype(float)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "features array<double>, label int")
    w = np.array(learning.logistic(df, 3))
    xb = np.hstack([x, np.ones((400, 1))])
    p = 1 / (1 + np.exp(-xb @ w))
    assert np.abs(xb.T @ (p - y) + 0.5 * np.append(w[:3], 0)).max() < 1e-6
    apart = spark.createDataFrame([([float(i)], int(i > 5)) for i in range(12)], "features array<double>, label int")
    assert 0 < learning.logistic(apart, 1)[0] < 20
    with pytest.raises(ValueError):
        learning.logistic(df.filter("label = 1"), 3)
    assert learning.auc(df.filter("label = 1").withColumn("s", F.lit(0.4)), "s", "label").first().auc == 0.5


def test_consensus_is_pairwise(spark):
    rng, rows = random.Random(5), []
    for task in range(60):
        n = rng.randrange(1, 9)
        base = rng.choice([10.0, -3.0, 0.0, 1e-9, 5e-10, -2e-9])
        rows += [(task, i, base * (1 + rng.choice([0, 0.005, 0.019, 0.03, 0.5])) * rng.choice([1, 1, 1, 1, -1])) for i in range(n)]
    near = lambda a, b: abs(a - b) / max(abs(a), abs(b), 1e-9) <= 0.02
    want = {}
    for task in range(60):
        vs = [v for t, _, v in sorted(rows) if t == task]
        clusters = [[b for b in vs if near(a, b)] for a in vs]
        top = max(clusters, key=len)
        want[task] = pytest.approx(sum(top) / len(top), rel=1e-9, abs=1e-15) if len(top) >= 2 and 2 * len(top) > len(vs) else None
    df = spark.createDataFrame(rows, "task int, i int, v double")
    assert {r.task: r.value for r in learning.consensus(df, "task").collect()} == want


def test_prefix_pairs_with_one_short_sha(spark):
    rng = random.Random(6)
    sha = lambda n: "".join(rng.choice("01") for _ in range(n))
    a = [("r" if i % 3 else "q", sha(rng.choice([4, 8, 12])), bool(i % 2)) for i in range(120)] + [("r", None, True)]
    b = [("r" if i % 2 else "q", sha(rng.choice([6, 8])), True) for i in range(80)] + [("r", "0", False), ("q", "", True)]
    kind = "repo string, sha string, resolved boolean"
    got = sorted((r.a_repo, r.a_sha, r.b_sha) for r in audit.pair_by_prefix(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect())
    assert got == sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[1] is not None and (x[1].startswith(y[1]) or y[1].startswith(x[1])))


def test_open_cells_without_a_product(spark):
    rows = spark.createDataFrame([("r", "s", "a", "x", 1), ("r", "t", "b", "y", 2)], "repo string, sha string, arm string, cond string, rep int")
    got = audit.open_cells(rows, 2)
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {("r", s, *p, i) for s in "st" for p in (("a", "x"), ("b", "y")) for i in (1, 2)} - {("r", "s", "a", "x", 1), ("r", "t", "b", "y", 2)}
