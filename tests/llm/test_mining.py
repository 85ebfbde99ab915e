"""Page text, phrases and filter audits: brute force on small fixtures, odd inputs."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlens.llm import filter_audit, html_text, phrases

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
CLASH = ("f", "k", "mask", "part", "least", "word", "hash", "met", "n", "a")


def docs(spark, rows, extra=()):
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOC)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


# Pages ---------------------------------------------------------------------------------------------------------------

ARTICLE = "<h1>The title</h1><p>First &amp; longest paragraph, with <a href=x>a link</a> and more words in it.</p><p>A second<br>one.</p><ul><li>one<li>two</ul>"
TEXT = ["The title", "First & longest paragraph, with a link and more words in it.", "A second one.", "one", "two"]
NAV = "<ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(6)) + "</ul>"
LONG = "words that go on and on, far longer than anything the article has to say, " * 9
PAGES = {
    "article": f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body><nav>{NAV}</nav><article>{ARTICLE}</article><footer>&copy; us</footer>",
    "comments": f"<body><main>{ARTICLE}</main><section id=comments><article class=comment><p>{LONG}</p></article></section></body>",
    "notice": f"<body><div class='cookie-notice'><p>{LONG}</p></div><div role=banner>{LONG}</div><div class=post>{ARTICLE}</div></body>",
    "inside": f"<article>{ARTICLE}<aside>{LONG}</aside><form><p>{LONG}</p></form><script>'</p>'</script><div class='share-buttons'>share</div></article>",
    "plain": f"<body><div>{NAV}</div><div>{ARTICLE}</div><div><a href=1>Terms</a> <a href=2>Help</a></div></body>",
    "soup": f"<body><DIV CLASS=AdSlot>{LONG}</DIV><div id=content class=no-sidebar>{ARTICLE}</div>",
    "form": f"<form id=all><div class=menu>{NAV}</div><article>{ARTICLE}</article></form>",
    "header": f"<header><a href=/>Site</a><h1>Site</h1></header><article><header><h1>The title</h1></header>{ARTICLE[18:]}</article>",
    "cut": f"<body><nav>{NAV}</nav><article>{ARTICLE}<p",
    "commented": f"<body><!-- <article>{LONG}</article> --><article>{ARTICLE}</article><!-- open {LONG}",
    "quoted": f"<body><article data-x='<p>{LONG}'>{ARTICLE}</article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html_text.blocks(PAGES[name]) == TEXT


def test_text_as_browsers_read_it():
    assert html_text.blocks("<p>a\xa0 b\n\tc &lt;i&gt; &#8364; &am &ampx<p>x < y &nbsp; z") == ["a b c <i> € &am &x", "x < y z"]
    assert html_text.blocks("<table><tr><td>one<td>two<tr><td>three</table>") == ["one", "two", "three"]
    assert html_text.blocks("<div>loose<p>in</p>after</div>") == ["loose", "in", "after"]
    assert html_text.blocks("<p>a <b>b<p>c</b> d") == ["a b", "c d"] and html_text.blocks("no tags") == ["no tags"]
    assert html_text.blocks("") == html_text.blocks(None) == html_text.blocks("<nav>x</nav>") == []


def test_density_sums_by_hand():
    nodes = html_text.tree("<div><a href=1>link</a></div><div><p>" + "x" * 50 + "</p><p>" + "y" * 70 + "</p></div>")
    html_text.weigh(nodes)
    div = next(n for n in nodes if n.name == "div" and len(n.children) == 2)
    assert (div.chars, div.tags, div.link_chars) == (120, 2, 0) and div.sum == sum(c.density for c in div.children)
    assert max(nodes, key=lambda n: n.sum) is div and (nodes[0].chars, nodes[0].link_chars, nodes[0].link_tags) == (124, 4, 1)
    menu = next(n for n in nodes if n.name == "div" and n.link_tags)
    assert menu.density < min(c.density for c in div.children)


def test_large_and_broken_pages_take_linear_time():
    for page in ("<div>" * 60000 + "t", "<b><p>" * 30000, "<p>x</p></div>" * 30000, "<!--" * 30000, '<a href="' * 30000, "<li>" * 30000, "<script>" * 30000):
        html_text.blocks(page)


def test_pages_odd_rows(spark):
    rows = [(None, None, None), (1, None, PAGES["article"]), (1, "u", PAGES["article"]), (2, "u", ""), (3, "u", "<p>" + "é漢 " * 30000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = sorted(html_text.main_text(pages).collect(), key=str)
    assert len(got) == 5 and {(r.page_id, r.n_chars) for r in got} == {(None, 0), (1, len("\n\n".join(TEXT))), (2, 0), (3, 89999)}
    assert html_text.main_text(pages.limit(0)).collect() == []


# Phrases -------------------------------------------------------------------------------------------------------------


def counted(rows, longest):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def best(rows, at_least, per_lang, longest=4):
    f, n = counted(rows, longest)
    by = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2 or a < at_least:
            continue
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))  # noqa: B023, E731
        if any(g == lang and len(v) > len(w) and b >= at_least and 100 * b >= 80 * a and inside(v) for (g, v), b in f.items()):
            continue
        score, _, left, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        by[lang].append((-score, -a, " ".join(w).encode(), left, r))
    return {(g, i, p.decode(), -a, left, r, n[g], -s) for g, found in by.items() for i, (s, a, p, left, r) in enumerate(sorted(found)[:per_lang], 1)}


def random_rows(seed, n, vocabulary=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = [("the", "of", "New", "York", "é", "\xa0", "x\x01", "City,", "a.b")[v] if v < 9 else f"w{v}" for v in rng.zipf(1.3, 40) % vocabulary]
        rows.append((i, " \t"[i % 2].join(w), ("en", "de", None)[i % 3]))
    return rows + [(None, None, "en"), (1, "", "fr"), (2, "?!", None), (3, "one", "und")]


@pytest.mark.parametrize("bits", [3, 20])
def test_collocations_brute_force(spark, bits):
    rows = random_rows(5, 90) + [(900, "new york city hall " * 20, "en")]
    d = docs(spark, rows, CLASH)
    for shard_words in (300, 10**6):
        got = phrases.collocations(d.repartition(3), at_least=8, per_lang=25, shard_words=shard_words, bits=bits).collect()
        assert {tuple(r) for r in got} == best(rows, 8, 25) and len(got) > 25


def test_shard_intervals_are_occurrences():
    ids = np.array([0, *np.random.default_rng(2).integers(0, 5, 300), 0])
    shard = phrases.Shard(phrases.transform(ids, 4), phrases.transform(ids[::-1], 4), np.arange(6, dtype=np.uint64))
    every = [np.full(8, 255, np.uint8)] * 4
    for k, found in enumerate(phrases.enumerated(shard, every, 4), 1):
        want = Counter(tuple(ids[i : i + k]) for i in range(len(ids) - k + 1) if all(ids[i : i + k]))
        assert dict(zip(map(tuple, found["ids"].tolist()), found["size"].tolist(), strict=True)) == want
        if k == 4:
            continue  # the last extension only counts
        # Each interval holds the rows of the phrase in both transforms: what stands before and after it.
        for p, lo, hi, n in zip(map(tuple, found["ids"].tolist()), *found["begin"], found["size"], strict=True):
            at = [i for i in range(len(ids) - k + 1) if tuple(ids[i : i + k]) == p]
            assert sorted(shard.transforms[0][lo : lo + n]) == sorted(ids[i - 1] for i in at)
            assert sorted(shard.transforms[1][hi : hi + n]) == sorted(ids[(i + k) % len(ids)] for i in at)


def test_collocations_empty(spark):
    assert phrases.collocations(docs(spark, [])).collect() == [] and phrases.collocations(docs(spark, [(1, None, None), (2, " . ", "en")]), at_least=1).collect() == []


# Filters -------------------------------------------------------------------------------------------------------------


def audited(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[c] == 1} for c in (0, 1))
    failed, out = [], {}
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = first[t] < i if i is not None else t in first
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": e}
        failed.append((lang or "", {k for k, v in bad.items() if v}, i in good, i in toxic))
    for part in {f[0] for f in failed}:
        mine, credit = [f for f in failed if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            stay = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in stay if x in f[1]]
                stay = [f for f in stay if x not in f[1]]
                credit[x] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), sum(x in f[1] for f in mine) - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(credit[order[step - 1]])
    return out


def test_filter_audit_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        w = [f"w{v}" for v in rng.integers(0, 60 if i % 3 else 4000, rng.integers(0, 220))]
        text = " ".join(w).upper() if i % 7 == 0 else " \n".join(w) + ("#" if i % 5 == 0 else "")
        rows.append((int(rng.integers(0, 100)), text, ("en", "de", None, "")[i % 4]))
    rows += [(200 + i, "the same text " * 50, "en") for i in range(30)] + [(None, "the same text " * 50, None), (None, None, "fr"), (None, None, "fr"), (7, "É" * 20, "x"), (500, None, "en"), (501, "", "de")]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in rng.integers(0, 230, 150)] + [(3, None, 1), (3, 1, None), (None, 1, 1)]
    got = filter_audit.filter_audit(docs(spark, rows, CLASH), spark.createDataFrame(labels, LABEL)).collect()
    assert {(r.part, r.filter_order, r.step): [*r[3:]] for r in got} == audited(rows, labels) and len(got) == 600 * 6


def test_removal_is_the_first_failing_step():
    fails = np.array([[False, False, False], [True, False, True], [False, True, False]])
    orders, places = filter_audit.positions(3)
    steps = filter_audit.removal_steps(fails, places)
    for o, order in enumerate(orders):
        for m in range(3):
            assert steps[m, o] == next((s for s, f in enumerate(order, 1) if fails[m, f]), np.inf)


def test_filter_audit_empty(spark):
    assert filter_audit.filter_audit(docs(spark, []), spark.createDataFrame([], LABEL)).collect() == []
    got = filter_audit.filter_audit(docs(spark, [(1, "Aa", "en")]), spark.createDataFrame([], LABEL)).collect()
    assert len(got) == 600 and {r.kept for r in got} == {0, 1}
