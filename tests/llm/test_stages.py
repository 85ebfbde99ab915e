"""Stages of the pipeline: odd rows, and each against the operator's own decisions or a plain second method."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agentlens.llm import common, decontaminate, mixing, near_dedup, quality, token_files

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
STAGES = dict(corpus_pipeline.STAGES)
CLASH = ("_bit", "_block", "_id", "key", "n", "met", "score", "_d", "_s", "kept")


def odd(spark):
    long = " ".join(f"w{v}" for v in np.random.default_rng(1).integers(0, 4000, 9000))
    texts = [(None, None), (None, "A null id with a plain text."), (1, None), (2, ""), (3, " \n\t"), (4, "One short text."), (5, "Said twice."), (5, "Said twice."), (6, long), (7, "é ß 漢字 \x0b x")]
    rows = [(i, t, None if i == 4 else "en", None if i == 3 else "s", None if i == 2 else 3) for i, t in texts]
    return spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(spark, name):
    d = odd(spark)
    got = STAGES[name](spark, d, SF)
    if name == "token_output":
        ids = [r.doc_id for r in got.collect()]
        assert sorted(ids, key=str) == sorted([r.doc_id for r in d.collect()], key=str)
        return
    assert got.schema.names == d.schema.names and got.dtypes == d.dtypes
    before, after = ([tuple(r) for r in x.collect()] for x in (d, got))
    assert set(after) <= set(before)
    if name in ("near_duplicates", "decontamination"):
        assert sorted(after, key=str) == sorted(before, key=str)


@pytest.mark.parametrize("name", STAGES)
def test_empty_and_clashing(spark, name):
    d = odd(spark).limit(0)
    assert STAGES[name](spark, d, SF).collect() == []
    if name in ("quality", "decontamination"):
        for c in CLASH:
            d = d.withColumn(c, F.lit("x"))
        assert STAGES[name](spark, d, SF).columns == d.columns


def documents(spark):
    d = common.table(spark, SF, "documents")
    twice = d.filter("doc_id < 5")
    return d.unionByName(twice).unionByName(d.filter("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))


def rows_of(d):
    return sorted(map(tuple, d.collect()), key=str)


def test_quality_is_the_classifier(spark):
    d = documents(spark)
    said = {r.doc_id: r.predicted for r in quality.quality(d, common.table(spark, SF, "labels")).filter("doc_id IS NOT NULL").collect()}
    got = STAGES["quality"](spark, d, SF)
    assert rows_of(got.filter("doc_id IS NOT NULL")) == rows_of(d.filter(F.col("doc_id").isin([i for i, p in said.items() if p])))
    assert got.filter("doc_id IS NULL").count() == sum(said[i] for i in range(3))


def test_near_duplicates_are_dropped_only(spark):
    d = documents(spark)
    kept = [r.doc_id for r in near_dedup.near_dedup(d, per_100=80).filter("kept AND doc_id IS NOT NULL").collect()]
    assert rows_of(STAGES["near_duplicates"](spark, d, SF)) == rows_of(d.filter(F.col("doc_id").isin(kept) | F.col("doc_id").isNull()))


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_is_brute_force(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 900, n)]
    items = {i: " ".join(words(12)) for i in range(6)}
    rows = []
    for i in range(60):
        t = list(" ".join(words(30)))
        if i % 2:
            piece = list(items[i % 6])
            for _ in range(int(rng.integers(0, 6))):
                p = int(rng.integers(0, len(piece)))
                piece[p : p + int(rng.integers(0, 2))] = "x" * int(rng.integers(0, 2))
            t[40:40] = [" ", *piece, " "]
        rows.append((i, "".join(t), "en", "s", 0))
    d, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {}
    for i, t, *_ in rows:
        for k, item in items.items():
            n = distance(item, decontaminate.normalised(t))
            if n <= int(len(item) * 0.05):
                want[i, k] = n
    assert {(r.doc_id, r.item_id): r.distance for r in decontaminate.decontaminate(d, bench).collect()} == want and 5 < len(want) < 30
    left = {i for i, *_ in rows} - {i for i, _ in want}
    assert {r.doc_id for r in decontaminate.clean(d, bench).collect()} == left == {r.doc_id for r in decontaminate.clean(d, bench, max_benchmark_chars=150).collect()}


def test_mixture_is_the_schedule(spark):
    d = documents(spark)
    times = {}
    for r in mixing.schedule(d, repeat_limit=4.0).collect():
        times[r.doc_id, r.source] = times.get((r.doc_id, r.source), 0) + 1
    want = [tuple(r) for r in d.collect() for _ in range(times.get((r.doc_id, r.source), 0))]
    assert rows_of(STAGES["mixture"](spark, d, SF)) == sorted(want, key=str) and max(times.values()) <= 5


def test_token_output_is_the_tokenizer(spark):
    from tokenizers import Tokenizer

    d = common.table(spark, SF, "documents").orderBy("doc_id").limit(40)
    whole, start, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for r in d.orderBy("doc_id").collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in STAGES["token_output"](spark, d, SF).collect()) == want


def test_no_text_is_shuffled_by_the_filters(spark):
    d = common.table(spark, SF, "documents")
    for name in ("quality", "decontamination"):
        plan = STAGES[name](spark, d, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Exchange|Join", plan)
