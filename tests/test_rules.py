"""Rules with fixed values: inputs that tell them from near misses."""

import random
import re

import pytest
from pyspark.sql import functions as F

from agentlens.functions import text as X
from agentlens.operators import joins, observe


def each(spark, values, column, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, t {kind}")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


WORDS = " word" * 40


def test_security_score(spark):
    table = {
        "": 0.0, "  \n": 0.0, "four words are few": 0.1, "five words are not few": 0.3, "plain" + WORDS: 0.4,
        "CWE-79 cwe 79 CWE-89 CWE-1" + WORDS: 0.5, "CWE79" + WORDS: 0.45, "xCWE-79 CWE-79b CWE-12345" + WORDS: 0.4,
        "CVE-2021-44228 cve 2021 1" + WORDS: 0.5, "CVE-2021-12345678" + WORDS: 0.4,
        "SANITISE it, escape it" + WORDS: 0.48, "vector payload surface" + WORDS: 0.4, "attacker and attack surface, risk" + WORDS: 0.475,
        "rotate keys with key rotation, least privilege and principle of least privilege" + WORDS: 0.52,
        "tls ssl hash salt csrf xss" + WORDS: 0.6, "threat model, adversary, exploitable, breach, untrusted" + WORDS: 0.5,
        "x\n  #### Risk\n" + WORDS: 0.525, "x\n##### Risk\n" + WORDS: 0.425, "# countermeasures" + WORDS: 0.5, "# Context" + WORDS: 0.4,
    }
    assert each(spark, table, X.security_score) == pytest.approx(list(table.values()))


def test_extract_code(spark):
    table = {
        "a ```py\nx = 1\n``` b ```\ny\n```": "x = 1", "```js\nx = 2": "x = 2", " plain ": "plain", "```c++\nint x;\n```": "int x;", "```objective-c\nid x;\n```  \n": "id x;",
        "```text x\na\n```\nb\n```": "b", "say ```c++\nx\n```": "say ```c++\nx\n```", "``` \ny": "y", "```\n```": "", "": "",
    }
    # The fourth from the end: the fence without a tag that ends the first block opens the second.
    assert each(spark, table, X.extract_code) == list(table.values())


def test_strip_chatter(spark):
    table = {
        "Sure\nbody": "body", "Surely not\nx": "x", "Below you see\nLet me try\nI'll go\nill\nbody": "body", "Okay\nbody": "Okay\nbody", "Absolutely\nbody": "Absolutely\nbody", "here we go\nHeres\nbody": "body",
        "a\nHope this works\n": "a", "a\nhappy tolerance": "a", "a\n\nLet me know\nFEEL FREE\n": "a", "a\nsure\nb": "a\nsure\nb", "Sure\r\n  Of course!\r\nb\r\nHope this": "b", "sure\nlet me know": "", "": "", "x\x0bhope this": "x",
    }
    assert each(spark, table, X.strip_chatter) == list(table.values())


CREDIT = "Generated with [A Tool](https://a.example/tool)"


def test_without_trailers(spark):
    table = {
        "Fix\n\nWhy: x\n\nSigned-off-by: A <a@b>\n  folded\nCc: b c": "Fix\n\nWhy: x", "Fix\n\nFixes: #12\nSigned-off-by: A <a@b>": "Fix\n\nFixes: #12", "Fix it": "Fix it", None: None,
        "Reviewed-by: A\n\nFix": "Reviewed-by: A\n\nFix", "A\n\nCc: b\n\nCO-AUTHORED-BY: c\n\n" + CREDIT: "A", "Cc: b": "", "A\n\nCc:\tb": "A", "A\n\nCc:b": "A\n\nCc:b",
        "A\n\n* " + CREDIT + " ": "A", "A\n\n" + CREDIT + "; keep": "A\n\n" + CREDIT + "; keep", "A\n\nGenerated with protoc 28": "A\n\nGenerated with protoc 28",
        "A\n\nTested-by: b\n folded\nrest\n indented": "A\n\nrest\n indented", "A\n \t\n\n\nB": "A\n\nB", "A\r\n\r\nAcked-by: b\r\n c": "A", "A\n b\n\nx-cc: d": "A\n b\n\nx-cc: d",
    }
    assert each(spark, table, X.without_trailers) == list(table.values())


def test_keyword_summary(spark):
    table = {
        "PostgreSQL and postgresql, via the MiniLM model": "PostgreSQL, MiniLM, model", "snake_case kebab-case _private x1 ab abc": "snake_case, kebab-case, private, abc",
        "please like about shall every mine": "please, like, about", "9lives C3PO": "lives, C3PO", "": "",
    }
    assert each(spark, table, X.keyword_summary) == list(table.values())
    assert each(spark, [" ".join(f"word{i}" for i in range(80))], lambda c: F.size(F.split(X.keyword_summary(c), ", "))) == [50]
    hits = [(0.1, "never", "read"), (0.5, "first", "tie"), (0.9, "Top", "hit"), (0.5, "second", "tie"), (0.5, "third", "tie")]
    df = spark.createDataFrame([(hits,), ([],)], "h array<struct<similarity double, title string, body string>>")
    assert [r.t for r in df.select(X.hits_text(F.col("h")).alias("t")).collect()] == ["Top hit first tie second tie", ""]


def test_keyword_summary_finds_its_words_once(spark, capsys):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["Ab-", "aB_", "THE", "the", "x", "q9"]) + rng.choice(["", "cd", "CD", " - ", "7", "\n"]) for _ in range(n)) for n in (0, 1, 5, 60, 400)] + [" ".join(f"Word{i % 70} word{i % 70}" for i in range(3000)), None]

    def words(text):
        found = {}
        for w in re.findall("[A-Za-z][A-Za-z0-9_-]{2,}", text):
            if w.lower() not in X.SUMMARY_STOPWORDS:
                found.setdefault(w.lower(), w)
        return ", ".join(list(found.values())[:50])

    want = [None if t is None else words(t) for t in texts]
    assert each(spark, texts, X.keyword_summary) == want
    assert each(spark, texts, lambda c: X.augmented(F.lit("p"), X.keyword_summary(c))) == [f"p [{w}]" if w else "p" for w in want]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.augmented(F.col("t"), X.keyword_summary(F.col("t"))).alias("a"))
    capsys.readouterr()
    df.explain()
    assert capsys.readouterr().out.count("regexp_extract_all(") == 1


def test_funnel_class(spark):
    lines = lambda n: "\n".join("x" * n)
    table = {
        ("run", None, "do it"): ("delegated", "", 0, 5, True, ""), ("batch", "a.py", ""): ("delegated", "", 0, 0, True, ""), ("Bash", "a.py", lines(9)): None, ("Read", None, None): None, (None, "a.py", lines(9)): None,
        ("Edit", "a.py", lines(9)): ("inline", ".py", 9, 17, False, "edit-in-place"), ("Edit", "a.py", ""): ("inline", ".py", 0, 0, False, "edit-in-place"),
        ("Write", "x/a.JL", lines(5)): ("inline", ".jl", 5, 9, True, ""), ("Write", "a.py", lines(4)): ("inline", ".py", 4, 7, False, "below-round-trip-threshold"), ("Write", "a.hpp", lines(300)): ("inline", ".hpp", 300, 599, True, ""),
        ("Write", "a.r", lines(301)): ("inline", ".r", 301, 601, False, "oversized-for-local-arm"), ("Write", "a.md", lines(9)): ("inline", ".md", 9, 17, False, "non-code-file"), ("Write", "d.py/Makefile", lines(9)): ("inline", "", 9, 17, False, "non-code-file"),
        ("Write", ".bashrc", lines(9)): ("inline", "", 9, 17, False, "non-code-file"), ("Write", "a.tar.zsh", lines(9)): ("inline", ".zsh", 9, 17, True, ""), ("Write", None, None): ("inline", "", 0, 0, False, "non-code-file"), ("Write", "a.py", None): ("inline", ".py", 0, 0, False, "below-round-trip-threshold"),
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(table)], "i int, tool string, path string, body string")
    got = [r.c for r in df.select("i", observe.funnel_class(F.col("tool"), F.col("path"), F.col("body"), ["run", "batch"]).alias("c")).orderBy("i").collect()]
    assert [g and tuple(g) for g in got] == list(table.values())


def test_candidate_commits(spark):
    commits = {
        "ok": ["tests/test_a.py", "src/a.py"], "nested": ["pkg/test_a.py", "src/a.py"], "suffix": ["pkg/a_test.py", "src/a.py"], "plural": ["test/tests_a.py", "src/a.py"], "deep": ["pkg/tests/helper.py", "tests/test_b.py"],
        "no module": ["tests/helper.py", "src/a.py"], "conftest only": ["conftest.py", "src/a.py"], "plural outside": ["pkg/tests_a.py", "src/a.py"], "no source": ["tests/test_a.py", "tests/b.py"], "no python": ["tests/test_a.py", "README.md"], "data": ["tests/test_data.json", "src/a.py"],
    }
    rows = [(sha, 1, i, p, 10) for i, (sha, paths) in enumerate(commits.items()) for p in paths]
    rows += [("root", 0, 50, p, 10) for p in commits["ok"]] + [("merge", 2, 51, p, 10) for p in commits["ok"]] + [("large", 1, 52, "tests/test_a.py", 1), ("large", 1, 52, "a.py", 251), ("binary", 1, 53, "tests/test_a.py", None), ("binary", 1, 53, "a.py", 5)]
    found = joins.candidate_commits(spark.createDataFrame(rows, "sha string, parents int, committed int, path string, lines int")).collect()
    assert {r.sha: r.src_lines for r in found} == {"ok": 10, "nested": 10, "suffix": 10, "plural": 10, "deep": 10}
