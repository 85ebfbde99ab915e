"""Operators for training text: brute force on small fixtures, odd inputs, round trips."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agentlens.llm import common, decontaminate, exact_dedup, license_scan, mixing, near_dedup, quality, shingles, substring_dedup, token_files, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=()):
    """(id, text[, source]) rows; ``extra`` columns have names that the operators use inside."""
    df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows], DOC)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


def words(seed, n, vocabulary=4000):
    rng = np.random.default_rng(seed)
    return [f"w{v}" for v in rng.integers(0, vocabulary, n)]


LONG = " ".join(words(1, 9000))
ODD = [(None, None), (None, "a null id"), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (7, "é ß 漢字 \x0b x")]
CLASH = ("key", "n", "h", "component", "kept", "score", "size", "words", "_id", "before")


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "a benchmark item that is long enough to match"), (1, None), (None, "x" * 40), (2, "")], "item_id long, text string")
    return {
        "license": license_scan.license_scan, "quality": lambda d: quality.quality(d, labels, per_class=20), "exact": exact_dedup.exact_dedup, "toxicity": lambda d: toxicity.toxicity(d, labels, per_class=20),
        "near": near_dedup.near_dedup, "substring": substring_dedup.repeated_passages, "mixing": mixing.schedule, "tokens": token_files.token_files, "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
    }


NAMES = ["license", "quality", "exact", "toxicity", "near", "substring", "mixing", "tokens", "decontaminate"]
ONE_ROW_EACH = {"license", "quality", "exact", "toxicity", "near", "tokens"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, name):
    got = operators(spark)[name](docs(spark, ODD, CLASH)).collect()
    if name in ONE_ROW_EACH:
        key = lambda x: (x is not None, x)
        assert sorted((r.doc_id for r in got), key=key) == sorted((i for i, _ in ODD), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](docs(spark, [])).collect() == []


def test_exact_dedup_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "ab", "a  b", "", None, " \n", "xyz", "xyzz", "x yz", "é", "é "])]
    rows += [(20 + i, "same long text here " * 9) for i in range(30)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    plain = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    for i, t in rows:
        group = [(-(len(u or "")), j) for j, u in rows if plain[j] == plain[i]]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(group)[1], len(group), min(group)[1] == i)
        assert got[i].text_sha256 == hashlib.sha256(plain[i].encode()).hexdigest()


def test_license_places(spark):
    text = "Under the MIT license, and under THE  mit-license. Licensed under the Apache License, Version 2.0. CC BY-NC 4.0; K K."
    r = license_scan.license_scan(docs(spark, [(1, text), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "under the mit"), (4, "miT licence under the\x80mit license")])).orderBy("doc_id").collect()
    assert (r[0].n_base, r[0].first_word, r[0].base_labels) == (4, 0, "apache-2,cc-by-nc,mit") and r[0].last_word == 17
    assert (r[1].n_base, r[1].base_labels, r[1].labels, r[1].score) == (0, "", "gpl-3", 1.0)
    assert (r[2].n_base, r[2].first_word, r[2].score) == (0, None, 0.0) and r[3].n_base == 0


def test_license_word_over_and_over(spark):
    """A word of many templates that fills a long text: places are told apart in linear time."""
    rows = [(i, f"plain text {i}") for i in range(200)] + [(999, "license " * 20_000 + "under the mit license")]
    r = license_scan.license_scan(docs(spark, rows)).filter("doc_id = 999").first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (20_004, 1, 20_000, 20_000, "mit")


def test_license_scan_is_native(spark):
    plan = license_scan.license_scan(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def jaccard_sets(rows, size=5):
    out = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def test_near_dedup_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for g in range(12):
        base = words(100 + g, 120)
        for _ in range(25 if g == 0 else 4):
            w = list(base)
            for p in rng.integers(0, 120, rng.integers(0, 5)):
                w[p] = f"x{rng.integers(0, 9999)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(900, "A b c"), (901, "a B  c"), (902, "a b d"), (903, ""), (904, None)]
    sets = jaccard_sets(rows)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(docs(spark, rows), per_100=80).collect()}
    assert got == {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def test_blocks_meet_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 80))) for _ in range(40)]
    k = near_dedup.intersections(sets[:25], sets[25:], cells=4000)
    assert all(k[i, j] == len(np.intersect1d(sets[i], sets[25 + j])) for i in range(25) for j in range(15))


def test_odd_sketch_counts_differences():
    a = near_dedup.signature(np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 130)
    b = a.copy()
    b[:10] += np.uint64(1)
    differ = int(np.bitwise_count(near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b)).sum())
    assert 0 < differ <= 20 and near_dedup.most_differing(0.85, 130) == 76


def test_compact_windows_cover_each_stretch_once():
    v = np.random.default_rng(3).integers(0, 40, 60)
    found = substring_dedup.compact_windows(v, 7)
    for i in range(60):
        for j in range(i + 6, 60):
            fit = [c for lo, c, hi in found if lo <= i <= c <= j <= hi]
            assert fit == [i + int(v[i : j + 1].argmin())]


def test_minima_of_stretches_are_those_of_the_windows():
    rng = np.random.default_rng(8)
    for least in (1, 2, 7, 46):
        for n in (0, 1, least - 1, least, 90, 700):
            v = rng.integers(0, (3, 40, 1 << 40)[n % 3], n)
            at = substring_dedup.least_at(v, least)
            assert at.tolist() == [i + int(v[i : i + least].argmin()) for i in range(n - least + 1)]
            assert sorted(set(at.tolist())) == sorted({c for _, c, _ in substring_dedup.compact_windows(v, least)} if n else [])


def test_windows_of_texts_are_those_of_their_stretches(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(map(str, np.repeat(v, rng.integers(1, 9, n)) if i % 3 else v)) for i, n in enumerate((0, 3, 11, 12, 13, 40, 200, 300)) for v in [rng.integers(0, 4 if i % 2 else 900, n)]]
    rows = [(i, t) for i, t in enumerate([*texts, None, "one " * 50])]
    got = {(r.doc_id, r.sides >> 34, r.c, r.key % (1 << 64)) for r in substring_dedup.windows(docs(spark, rows).coalesce(1), 2, 8).collect()}
    want = set()
    for (i, _), s in zip(rows, shingles.sequences([t for _, t in rows], 5), strict=True):
        for f in range(2 if len(s) >= 8 else 0):
            v, (_, at) = shingles.mixed(s ^ shingles.constants(2, 41)[f]), substring_dedup.runs(s)
            for _, k, _ in substring_dedup.compact_windows(v[at[:-1]], 8, at.tolist()):
                want |= {(i, f, int(c), int(v[at[k]])) for c in (at[k], at[k + 1] - 1)}
    assert got == want and {9, 7} < {x[0] for x in want}


def test_places_of_many_documents_and_of_a_long_one(spark):
    rows = [(i, " ".join(words(20 + i, 12_100 if i == 3 else 70, 10**6))) for i in range(8)]
    places = [(3, c) for c in range(12_090)] + [(i, c) for i in range(8) if i != 3 for c in (0, 30, 65, 66, 900)]
    got = {(r.doc_id, r.c): bytes(r.bits) for r in substring_dedup.contexts(spark.createDataFrame(places, "doc_id long, c int"), docs(spark, rows).coalesce(1), 46).collect()}
    s = {i: (x >> np.uint64(32)).astype(np.uint32) for (i, _), x in zip(rows, shingles.sequences([t for _, t in rows], 5), strict=True)}
    assert got == {(i, c): s[i][max(0, c - 56) : c + 57].tobytes() for i, c in places if c < len(s[i])}


def test_places_outside_all_spans(spark):
    rng = np.random.default_rng(6)
    places = sorted({(int(d), int(c)) for d, c in zip(rng.integers(0, 9, 600), rng.integers(0, 5000, 600), strict=True)})
    spans = [(int(d), int(lo), int(lo + n)) for d, lo, n in zip(rng.integers(0, 8, 60), rng.integers(0, 4500, 60), rng.integers(0, 1500, 60), strict=True)]
    out = substring_dedup.outside(spark.createDataFrame([(*p, 1) for p in places] + [(8, 1, 2)], "doc_id long, c int, key int"), spark.createDataFrame(spans, "doc_id long, lo long, hi long"))
    want = [(d, c, 1) for d, c in places if not any(d == e and lo <= c <= hi for e, lo, hi in spans)] + [(8, 1, 2)]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) < len(places)


def test_groups_that_meet_without_a_sort(spark):
    rows = spark.createDataFrame([(i % 1500 if i % 7 else None, i) for i in range(6000)], "key long, doc_id long")
    groups = common.written(rows.filter("key % 3 = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "groups")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, two = (common.met(rows, groups, ["key"], "n", ["doc_id"], hashed=x) for x in (False, True))
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 6000
        plan = two._jdf.queryExecution().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exact_runs_are_the_longest_matches():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint64) for _ in "ab")
        want, i = [], 0
        while i < len(b):
            fits = [(next((k for k in range(min(len(a) - j, len(b) - i)) if a[j + k] != b[i + k]), min(len(a) - j, len(b) - i)), -j) for j in range(len(a))]
            n, j = max(fits)
            want += [(-j, i, n)] if n else []
            i += max(n, 1)
        assert substring_dedup.exact_runs(a, b) == want


def test_repeated_passages(spark):
    shared, near = words(50, 60), words(51, 120)
    edited = list(near)
    edited[40], edited[90] = "changed", "again"
    rows = [(i, " ".join([*words(200 + i, 150), *shared, *words(300 + i, 90)])) for i in range(20)]
    rows += [(40, " ".join([*words(60, 30), *near, *words(61, 10)])), (41, " ".join([*words(62, 70), *edited])), (42, " ".join([*words(63, 80), *shared[:40], *words(64, 80)])), (43, " ".join(words(65, 400)))]
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    found = {r.doc_id: r for r in got if not r.kept}
    assert set(found) == {*range(1, 20), 41} and {r.doc_id for r in got if r.kept} == {0, 40}
    assert all((found[i].first_doc_id, found[i].start_word, found[i].n_words, found[i].similarity) == (0, 150, 60, 1.0) for i in range(1, 20))
    assert found[41].first_doc_id == 40 and found[41].n_words == 120 and 0.8 <= found[41].similarity < 1


def test_repeats_behind_a_head_that_has_less(spark):
    rows = []
    for k in range(30):
        shared = words(1000 + k, 51 + k % 5, 10**6)
        whole = lambda i, n=100: (i, " ".join([*words(5000 + i, n, 10**6), *shared, *words(9000 + i, 100, 10**6)]))  # noqa: B023, E731
        rows += [(10 * k + 1, " ".join([*words(2000 + k, 100, 10**6), *shared[:49], *words(3000 + k, 100, 10**6)])), whole(10 * k + 2), whole(10 * k + 3, 80)]
    got = {r.doc_id: (r.first_doc_id, r.start_word, r.n_words, r.kept) for r in substring_dedup.repeated_passages(docs(spark, rows)).collect()}
    for k in range(30):
        n = 51 + k % 5
        assert 10 * k + 1 not in got and got[10 * k + 2] == (10 * k + 2, 100, n, True) and got[10 * k + 3] == (10 * k + 2, 80, n, False)


def test_repeats_of_a_later_place_in_the_head(spark):
    rows = []
    for k in range(20):
        shared, gap = words(1100 + k, 52, 10**6), words(2100 + k, 300, 10**6)
        rows += [(2 * k, " ".join([*shared[:45], *gap, *shared, *gap[:9]])), (2 * k + 1, " ".join([*words(3100 + k, 60, 10**6), *shared, *words(4100 + k, 60, 10**6)]))]
    got = {r.doc_id: (r.first_start_word, r.start_word, r.n_words) for r in substring_dedup.repeated_passages(docs(spark, rows)).collect()}
    assert all(got[2 * k + 1] == (345, 60, 52) for k in range(20))


def test_crossing_compares_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 4)
    passage = words(77, 60, 10**6)
    texts = {i: [*words(600 + i, 80, 10**6), *(passage[:35] if i < 25 else passage), *words(700 + i, 80, 10**6)] for i in range(30)}
    got = substring_dedup.repeated_passages(docs(spark, [(i, " ".join(t)) for i, t in texts.items()])).collect()
    assert {(r.doc_id, r.first_doc_id, r.n_words) for r in got} == {(i, 25, 60) for i in range(25, 30)}


def test_nearest_is_brute_force(monkeypatch):
    monkeypatch.setattr(substring_dedup, "TILE", 32)
    rng = np.random.default_rng(5)
    base, kinds = rng.integers(0, 1 << 32, 113), []
    for t in range(160):
        s = rng.choice(base[:8], 113).tolist() if t % 8 == 7 else np.repeat(base[:30], 4).tolist() if t % 8 == 6 else base.tolist()
        for _ in range(rng.integers(0, 5)):
            at, new = int(rng.integers(0, 108)), rng.integers(0, 1 << 32, 5).tolist()
            s[at : at + (5 if t % 3 else 4)] = new if t % 3 == 0 else new[:4]
        kinds.append(np.array(s[:113], np.uint32))
    ids = rng.permutation(160)
    got = {b: a for a, b in substring_dedup.nearest(ids, [substring_dedup.Around(k, 46, 0.8) for k in kinds], np.arange(160), np.arange(160), 46, 0.8, {})}
    monkeypatch.setattr(substring_dedup, "places_in", lambda a, b: None)  # the general comparison
    want = {}
    for y in range(160):
        smaller = sorted((x for x in range(160) if ids[x] < ids[y]), key=lambda x: ids[x])
        found = next((x for x in smaller if substring_dedup.passages(kinds[x], kinds[y], 46, 0.8)), None)
        want |= {} if found is None else {y: found}
    assert got == want and 60 < len(want) < 159


def test_runs_of_a_word_stand_at_their_ends(spark):
    rows = [(i, " ".join([*words(7000 + i, 60, 10**6), *["again"] * (60 + i), *words(7100 + i, 60, 10**6)])) for i in range(4)] + [(9, " ".join(["line of five words here"] * 3000))]
    got = {(r.doc_id, r.first_doc_id): (r.start_word, r.n_words) for r in substring_dedup.repeated_passages(docs(spark, rows)).collect()}
    assert {i for i, _ in got} == {0, 1, 2, 3} and all(got[i, 0] == (60, 60) for i in range(4))
    v = np.tile(np.random.default_rng(1).integers(0, 99, 5), 400)
    found = substring_dedup.compact_windows(v, 46)
    assert all([c for lo, c, hi in found if lo <= i <= c <= i + 45 <= hi] == [i + int(v[i : i + 46].argmin())] for i in range(len(v) - 45))


def test_repeats_with_a_word_put_in_or_left_out(spark):
    rows, rng = [], np.random.default_rng(3)
    for k in range(60):
        one = words(1200 + k, 51 + k % 10, 10**6)
        other, at = list(one), len(one) // 2 if k % 3 else int(rng.integers(6, len(one) - 6))
        other[at : at + k % 2] = [] if k % 2 else ["inserted"]
        rows += [(2 * k, " ".join([*words(2200 + k, 90, 10**6), *one, *words(3200 + k, 90, 10**6)])), (2 * k + 1, " ".join([*words(4200 + k, 70, 10**6), *other, *words(5200 + k, 90, 10**6)]))]
    long = {k for k in range(60) if len(rows[2 * k + 1][1].split()) - 160 >= 50}
    assert len(long) > 50 and {r.doc_id for r in substring_dedup.repeated_passages(docs(spark, rows)).collect() if not r.kept} == {2 * k + 1 for k in long}


def test_myers_is_the_table():
    rng = np.random.default_rng(2)
    for _ in range(40):
        item, text = ("".join(rng.choice(list("abc"), n)) for n in (12, 40))
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontaminate.myers(item, decontaminate.char_masks(item), text)[0] == min(row)


def test_decontaminate(spark):
    item = "the quick brown fox jumps over the lazy dog while nobody is watching the garden gate"
    edited = item.replace("quick", "quik").replace("lazy", "lazzy")
    rows = [(1, f"xx {item.upper()}! yy"), (2, f"aa {edited} bb"), (3, item[:50]), (4, None), (5, item.replace("brown fox jumps", "red cat walks"))]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    d = docs(spark, rows)
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.decontaminate(d, bench).collect()} == {(1, 7, 0), (2, 7, 2)}
    assert sorted(r.doc_id for r in decontaminate.clean(d, bench).collect()) == [3, 4, 5]
    parts = decontaminate.decontaminate(d, spark.createDataFrame([(7, item), (6, item + " again and again")], "item_id long, text string"), max_benchmark_chars=100)
    assert {(r.doc_id, r.item_id) for r in parts.collect()} == {(1, 7), (2, 7)}


def test_short_items_match_whole_words(spark):
    d = docs(spark, [(0, "Yes, a short item!"), (1, "a shorter item"), (2, "a short  ITEM"), (3, "前日本語後"), (4, "x a short itemx"), (5, None)])
    bench = spark.createDataFrame([(1, "a short item"), (1, "a short item"), (2, "日本語"), (3, "?!")], "item_id long, text string")
    want = [(0, 1), (2, 1), (3, 2)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.decontaminate(d, bench).collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.decontaminate(d, bench, max_benchmark_chars=5).collect()) == want


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(6)
    for limit in (4, 6, 12):
        w = np.append(rng.zipf(1.4, 14), 0)
        n = token_files.code_lengths(w, limit)
        assert n[-1] == 0 and n.max() <= limit and abs((0.5 ** n[n > 0].astype(float)).sum() - 1) < 1e-12
    import heapq

    heap = [int(x) for x in w[:-1]]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((w * n).sum()) == total
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9), 3)


def test_stretches_encode_like_the_whole(spark):
    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(token_files.default_tokenizer()), token_files.Encoder(token_files.default_tokenizer(), limit=4)
    texts = ["", " ", "a  b", "foo \n bar", " lead", "trail ", "it's  x   y", "<|endoftext|> a<|endoftext|>b c", "tab\t x \x85y\x1c z", "日本 語 ² x", "a​ b 　c", "\n \n x", LONG[:500]]
    texts += ["one\ntwo, three\nfour", "a\n\nb c", "feed\n", "cr\r\nlf x", "zero\0 byte y\nz", "one two", None]
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(b, "<u2").tolist() for b in ours.encode(pa.array(texts, pa.string()), 2).to_pylist()] == want
    assert [(s.start, s.stop) for s in token_files.slices(pa.array([None, "x", "", "y"]))] == [(0, 4)]


def test_words_hashed_together_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(shingles, "PIECE_BYTES", 256)
    rng = np.random.default_rng(3)
    texts = ["", None, " ", "One", "A b\x0bc\x0c\r\nd\x1ce \xa0f", "x" * 700, "y " + "X" * 300 + " z", "w " * 400 + "Q" * 65 + " " + "q" * 65, "é ß 漢字 a b", LONG]
    texts += ["".join(rng.choice(list("aAbB \n\té漢\x85"), i % 60)) for i in range(500)]
    known = {}
    for text, got in zip(texts, shingles.sequences(texts), strict=True):
        words_ = (text or "").encode().lower().split()
        hashes, starts = shingles.hashed((text or "").encode())
        assert len(hashes) == len(words_) and all(known.setdefault(w, h) == h for w, h in zip(words_, hashes.tolist(), strict=True))
        assert all((text or "").encode().lower()[i:].startswith(w) for w, i in zip(words_, starts.tolist(), strict=True))
        assert got.tolist() == (shingles.shingled(hashes).tolist() if len(words_) >= 5 else [])
    assert len(set(known.values())) == len(known)


def test_passages_of_a_repeated_id_with_a_null_text(spark):
    passage = " ".join(words(8, 70))
    rows = [(1, passage), (2, None), (2, "before " + passage), (3, passage + " after")]
    got = substring_dedup.repeated_passages(docs(spark, rows).coalesce(1)).collect()
    assert sorted((r.doc_id, r.first_doc_id, r.n_words) for r in got) == [(1, 1, 70), (2, 1, 70), (3, 1, 70)]


def test_stretches_that_are_no_line_and_marks_cut_off():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.default_tokenizer())
    texts = ["one two", "", None, "three", "\xa0\xa0\xa0four five", "\t\tsix\xa0", "\u3000\u3000seven", "two. one, three!? one... #one# don't. don't' it's", "é. ß!! 漢。漢. 12. 3.4 a1. x<|endoftext|>. x<|endoftext|>", "naïve-- ª. ×. ǅ) а. b\x00c. ", " lone", "."]
    texts += ["".join(np.random.default_rng(i).choice(list("ab.,!?'# \n\té漢1\xa0|<>"), i % 30)) for i in range(600)]
    for limit in (600_000, 5):
        ours = token_files.Encoder(token_files.default_tokenizer(), limit=limit)
        for some in (texts, texts[::-1], *([t] for t in texts[:12])):
            got = [np.frombuffer(x, ours.dtype).tolist() for x in ours.encode(pa.array(some, pa.string()), 2).to_pylist()]
            assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in some]


def test_an_encoder_holds_one_tokenizer_and_leaves_with_its_stage(spark, monkeypatch):
    from unittest.mock import MagicMock

    import tokenizers

    made, real = [], tokenizers.Tokenizer
    monkeypatch.setattr(token_files, "_ENCODERS", {})
    monkeypatch.setattr(tokenizers, "Tokenizer", MagicMock(from_file=lambda p: made.append(real.from_file(p)) or made[-1]))
    path = token_files.default_tokenizer()
    ours = token_files.encoder(path)
    texts = pa.array(["one two", "don't. stop (now) 12 x's", None, "one two three"])
    want = [[*real.from_file(path).encode(t or "", add_special_tokens=False).ids, 2] for t in texts.to_pylist()]
    before = made[0].to_str()
    assert [np.frombuffer(x, ours.dtype).tolist() for x in ours.encode(texts, 2).to_pylist()] == want
    assert len(made) == 1 and made[0].to_str() == before
    # The tasks that count, write and read come after all texts are encoded, in the same workers.
    rows = MagicMock()
    token_files.counts(rows)
    assert token_files._ENCODERS and not list(rows.filter().select().mapInPandas.call_args[0][0](iter([]))) and not token_files._ENCODERS


def test_small_batches_are_gathered(monkeypatch):
    monkeypatch.setattr(token_files, "GATHER_BYTES", 5)
    batches = [pa.record_batch({"text": pa.array(t, pa.string())}) for t in (["ab"], [None, "c"], ["defghijk"], [], ["l"])]
    assert [b["text"].to_pylist() for b in token_files.gathered(iter(batches))] == [["ab", None, "c"], ["defghijk"], ["l"]] and list(token_files.gathered(iter([]))) == []


def test_token_files_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    whole = Tokenizer.from_file(token_files.default_tokenizer())
    rows = [(i, " ".join(words(i, i % 60))) for i in range(90, -1, -1)] + [(6_000_000_000, LONG), (200, None)]
    path = common.new_path(spark, "t")
    manifest = token_files.write_token_files(docs(spark, rows), path)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, path, with_ids=True).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids, got[i].ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(manifest["files"]) > 1 and manifest["ids"] == start


def test_mixture_meets_its_budgets(spark):
    rows = [(i, " ".join(words(i, 20 + i % 30)), "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + [(1000, "a b c d", "tiny"), (1001, "", "empty")]
    d = docs(spark, rows)
    plan = {r.source: r for r in mixing.weights(mixing.source_totals(d.select("source", mixing.word_tokens(F.col("text")).alias("n_tokens"))), repeat_limit=3.0).collect()}
    assert sum(p.weight for p in plan.values()) == pytest.approx(1) and "empty" not in plan
    assert max(p.budget / p.n_tokens for p in plan.values()) == pytest.approx(3, abs=1e-3)
    got = mixing.schedule(d, block_tokens=200, repeat_limit=3.0).collect()
    length = {i: len((t or "").split()) for i, t, *_ in rows}
    for s, p in plan.items():
        mine = [r for r in got if r.source == s]
        assert p.budget - max(length.values()) <= sum(length[r.doc_id] for r in mine) <= p.budget + 1e-6
        copies = {}
        for r in mine:
            copies.setdefault(r.doc_id, []).append(r.epoch)
        assert all(sorted(e) == list(range(len(e))) for e in copies.values() if len(e) > p.budget // p.n_tokens)
        assert all(len(copies.get(r[0], [])) >= p.budget // p.n_tokens for r in rows if r[2] == s)
    flat = mixing.exponent(mixing.source_totals(d.select("source", mixing.word_tokens(F.col("text")).alias("n_tokens"))), 1.0, entropy=1.0)
    assert flat["entropy"] == pytest.approx(1.0, abs=1e-4)


def test_turns_over_ranges_are_those_over_all(spark, monkeypatch):
    sizes = {(s, b): (b * 7 + e) % 11 for s, n, e in (("hot", 40, 1), (None, 9, 2), ("one", 1, 0)) for b in range(n)}
    rows = [(s, b, epoch, size, 100, {"hot": 40, None: 9, "one": 1}[s]) for (s, b), size in sizes.items() for epoch in (0, 1)]
    made = spark.createDataFrame(rows, "source string, b long, epoch long, size long, whole long, n_blocks long")

    def found(n):
        monkeypatch.setattr(mixing, "RANGE_BLOCKS", n)
        return {(r.source, r.b, r.epoch): (r.block, r.before) for r in mixing.turns(made, 17).collect()}

    order = {(r.b, r.epoch): r.h for r in made.select("b", "epoch", F.xxhash64("b", "epoch", F.lit(17)).alias("h")).collect()}
    want = {}
    for s in ("hot", None, "one"):
        for epoch in (0, 1):
            held = epoch * 100
            for k, (_, b) in enumerate(sorted((order[b, epoch], b) for t, b in sizes if t == s)):
                want[s, b, epoch] = (k, held)
                held += sizes[s, b]
    assert found(4096) == found(3) == want


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 5000 + "</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "http://b", "short"), (5, "http://b", "short"), (6, "u", None), (None, "n", big)]
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES), path)
    got = warc.read_warc(spark, path).collect()
    full = {r.page_id: r for r in got}
    assert len(got) == len(rows) and {i: full[i].record_type for i in (1, 2, 3, 4, 5, 6)} == {1: "revisit", 2: "revisit", 3: "response", 4: "response", 5: "response", 6: "response"}
    assert bytes(full[3].payload).decode() == big and full[1].refers_to == 3 and full[None].refers_to == 3 and bytes(full[6].payload) == b""
    assert all(r.payload_digest == hashlib.sha1((dict((x[0], x[2]) for x in rows)[r.page_id] or "").encode()).hexdigest() for r in got)
    only = warc.read_warc(spark, path, payload=False).filter("record_type = 'response' AND target_uri = 'http://b'")
    assert sorted(r.page_id for r in only.collect()) == [4, 5] and "payload" not in only.columns
    assert warc.read_warc(spark, path).filter(F.col("target_uri").startswith("http://a/")).count() == 2


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    def rec(i, body):
        return f"WARC/1.0\r\nWARC-Type: resource\r\nX-Page-ID: {i}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    bodies = [os.urandom(9000 * i) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(rec(i, b)) for i, b in enumerate(bodies)))
    (tmp_path / "b.warc").write_bytes(b"".join(rec(10 + i, b) for i, b in enumerate(bodies)))
    got = {r.page_id: bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path.as_uri())).collect()}
    assert got == {**dict(enumerate(bodies)), **{10 + i: b for i, b in enumerate(bodies)}}
    assert warc.read_warc(spark, str(tmp_path.as_uri()), payload=False).filter("page_id = 2").count() == 1


def test_warc_empty(spark):
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], PAGES), path)


def test_quality_learns(spark):
    good = [(i, " ".join(words(i, 60)).capitalize() + ".", 1) for i in range(0, 160, 2)]
    bad = [(i, "%%% ".join(words(i, 60)), 0) for i in range(1, 160, 2)]
    d, labels = docs(spark, [r[:2] for r in good + bad]), spark.createDataFrame([(r[0], r[2]) for r in good + bad], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(d, labels).collect()}
    out = [(got[i].predicted, y) for i, _, y in good + bad if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in good + bad) and np.mean([p == y for p, y in out]) > 0.95


def test_quality_covers_the_whole_text():
    tables = np.zeros((quality.WIDTH, 256, 1), np.float32)
    tables[0, ord("Z")] = 1.0
    assert quality.pooled(b"a" * (quality.SLICE + 700) + b"Z" + b"aaaa", tables)[0] > 0 and quality.pooled(b"", tables)[0] == 0


def test_toxicity_spares_identity_terms():
    rng = np.random.default_rng(8)
    texts, y = [], []
    for i in range(400):
        w = words(i, 30, 200)
        toxic = i % 2
        w[5] = "scumbag" if toxic else "ok"
        if rng.random() < (0.8 if toxic else 0.1):
            w[6] = "muslim"
        texts.append(" ".join(w[:15]) + ". " + " ".join(w[15:]))
        y.append(toxic)
    def gap(penalty):
        m = toxicity.fit(texts, np.array(y, float), penalty=penalty)
        weights = toxicity.Weights(m["words"])
        return toxicity.logit("the muslim garden", m["bias"], weights) - toxicity.logit("the believer garden", m["bias"], weights), toxicity.logit("you scumbag", m["bias"], weights)

    (with_it, toxic), (without, _) = gap(5.0), gap(0.0)
    assert abs(with_it) < 0.3 * abs(without) and 1 / (1 + np.exp(-toxic)) > 0.7


def test_shingles_of_short_texts():
    c = shingles.Words(limit=3)
    assert len(shingles.shingled(c.of("a b"))) == 1 and len(shingles.shingled(c.of(""))) == 0 and len(shingles.shingled(c.of("a b c d e f"))) == 2
    assert shingles.shingled(c.of("A b"))[0] == shingles.shingled(c.of("a  B"))[0]


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    d = common.table(spark, sf, "documents")
    columns, seen = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, common.written(stage(spark, d, sf), name)
        if name != "token_output":
            assert d.columns == columns
        if name in ("quality", "near_duplicates", "decontamination"):
            assert 0 < d.count() <= seen and d.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            sets = jaccard_sets([(r.doc_id, r.text) for r in d.collect()])
            assert not [1 for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
        if name == "decontamination":
            items = [decontaminate.normalised(r.text) for r in common.table(spark, sf, "benchmark").collect()]
            assert not [1 for r in d.collect() for t in items if len(t) >= 25 and t in decontaminate.normalised(r.text)]
        seen = d.count()
    assert d.count() == before.count() and d.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
