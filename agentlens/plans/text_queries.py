"""Queries over prompts and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlens.functions import text as X
from agentlens.plans.registry import query

R = "v_results"
KEY = ["conv_id", "turn"]


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _alts(words: list[str]) -> str:
    return "(" + "|".join(words) + ")"


BUCKET = "CASE " + " ".join(f"WHEN regexp_matches(lower(prompt), '{_alts(w)}') THEN '{b}'" for b, w in X.BUCKET_WORDS.items()) + " ELSE 'general' END"
WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"
IN = lambda ws: "list_has_any(ws, [" + ",".join(f"'{w}'" for w in ws) + "])::INTEGER::DOUBLE"
FEAT = f"""f AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: w IN ({','.join(f"'{w}'" for w in X.CODE_WORDS)}))) AS code, len(regexp_extract_all(prompt, '\\b[\\w/\\-]+\\.\\w{{1,5}}\\b')) AS files FROM (SELECT *, {WORDS('lower(prompt)')} AS ws FROM v_results)),
g AS (SELECT *, least(n/200.0, 1.0)::DOUBLE AS word_count, code::DOUBLE/greatest(n,1) AS code_density, (rtrim(lower(prompt)) LIKE '%?' OR regexp_matches(lower(prompt), '^({'|'.join(X.QUESTION_STARTS)}) '))::INTEGER::DOUBLE AS question,
 (CASE WHEN n<10 AND code=0 THEN 1 WHEN n>50 OR files>2 THEN 3 ELSE 2 END)/3.0::DOUBLE AS tier, least(files/10.0,1.0)::DOUBLE AS files_n, {IN(X.ERROR_WORDS)} AS error, {IN(X.CREATION_WORDS)} AS creation, {IN(X.RESEARCH_WORDS)} AS research, {IN(X.SECURITY_WORDS)} AS security, {IN(X.REVIEW_WORDS)} AS review,
 regexp_matches(lower(prompt), '{_alts(X.TEST_PHRASES)}')::INTEGER::DOUBLE AS test, regexp_matches(lower(prompt), '{_alts(X.REFACTOR_PHRASES)}')::INTEGER::DOUBLE AS refactor FROM f)"""
FB = "CASE WHEN error>0.5 THEN 'debug' WHEN test>0.5 THEN 'test' WHEN refactor>0.5 THEN 'refactor' WHEN security>0.5 THEN 'security' WHEN review>0.5 THEN 'review' WHEN research>0.5 AND code_density<0.05 THEN 'research' WHEN creation>0.5 AND code_density>0.05 THEN 'code' WHEN tier>0.8 THEN 'plan' WHEN code_density>0.1 THEN 'code' ELSE 'general' END"


@query("p03_bucket", R, f"SELECT conv_id, turn, {BUCKET} AS b, CASE WHEN bucket IN ('research','plan') AND conv_id % 3=0 THEN bucket ELSE {BUCKET} END AS hinted FROM v_results")
def bucket(r):
    return r.select(*KEY, X.bucket_of(F.col("prompt")).alias("b"), X.bucket_of(F.col("prompt"), F.when(F.col("conv_id") % 3 == 0, F.col("bucket"))).alias("hinted"))


@query("p04_features", R, f"WITH {FEAT} SELECT conv_id, turn, round(word_count,6) AS word_count, round(code_density,6) AS code_density, question, round(tier,6) AS tier, round(files_n,6) AS files, error, creation, research, 0.0::DOUBLE AS queue FROM g")
def features(r):
    return r.select(*KEY, X.features(F.col("prompt")).alias("f")).select(*KEY, *[f"f.{c}" for c in ("word_count", "code_density", "question", "tier", "files", "error", "creation", "research", "queue")])


@query("p05_feature_bucket", R, f"WITH {FEAT} SELECT conv_id, turn, {FB} AS b FROM g")
def feature_bucket(r):
    return r.select(*KEY, X.feature_bucket(X.features(F.col("prompt"))).alias("b"))


@query("p06_classification_gate", R, f"WITH {FEAT} SELECT conv_id, turn, bucket, {FB} AS b FROM g WHERE {FB} <> bucket")
def classification_gate(r):
    return r.select(*KEY, "bucket", X.feature_bucket(X.features(F.col("prompt"))).alias("b")).filter("b <> bucket")


REPLY = "CASE conv_id % 6 WHEN 0 THEN '{\"correct\" : TRUE}' || output WHEN 1 THEN 'so \"correct\":false' WHEN 2 THEN 'True, ' || turn WHEN 3 THEN 'FALSE' WHEN 4 THEN 'true or false' ELSE output END"


@query("p12_parse_verdict", R, f"WITH r AS (SELECT conv_id, turn, lower({REPLY}) AS t FROM v_results) SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\"correct\"\\s*:\\s*true') THEN true WHEN regexp_matches(t, '\"correct\"\\s*:\\s*false') THEN false WHEN contains(t,'true') AND NOT contains(t,'false') THEN true WHEN contains(t,'false') AND NOT contains(t,'true') THEN false END AS verdict FROM r")
def verdict(r):
    return r.select(*KEY, X.parse_verdict(F.expr(REPLY.replace("|| turn", "|| CAST(turn AS STRING)"))).alias("verdict"))


NUMS = "'Given $1,' || conv_id || ' and -' || turn || '.5, also 3/' || (turn % 3) || ' or 7 / 4 then ' || length(output)"


@query("p13_ordered_numbers", R, f"WITH r AS (SELECT conv_id, turn, regexp_extract_all(translate({NUMS}, ',$', ''), '-?\\d+(?:\\.\\d+)?\\s*/\\s*-?\\d+(?:\\.\\d+)?|-?\\d+(?:\\.\\d+)?') AS ts FROM v_results), v AS (SELECT conv_id, turn, list_filter([CASE WHEN contains(t,'/') THEN CAST(trim(split_part(t,'/',1)) AS DOUBLE)/nullif(CAST(trim(split_part(t,'/',2)) AS DOUBLE),0) ELSE CAST(t AS DOUBLE) END FOR t IN ts], lambda x: x IS NOT NULL) AS x FROM r) SELECT conv_id, turn, len(x)::INTEGER AS n, round(list_sum(x[-3:]),6) AS last_sum FROM v")
def numbers(r):
    text = F.concat(F.lit("Given $1,"), F.col("conv_id"), F.lit(" and -"), F.col("turn"), F.lit(".5, also 3/"), F.col("turn") % 3, F.lit(" or 7 / 4 then "), F.length(F.col("output")))
    return r.select(*KEY, F.size(X.ordered_numbers(text)).alias("n"), F.aggregate(X.ordered_numbers(text, 3), F.lit(0.0), lambda a, b: a + b).alias("last_sum"))


@query("p14_extract_code", R, "SELECT conv_id, turn, CASE WHEN conv_id % 4=0 THEN 'x=' || turn WHEN conv_id % 4=1 THEN 'y' || chr(10) || 'z' WHEN conv_id % 4=2 THEN 'int x' || turn || ';' ELSE trim(output) END AS code FROM v_results")
def code(r):
    fenced = F.concat(F.lit("Sure\n```py\nx="), F.col("turn"), F.lit("\n```\nmore\n```\nno\n```"))
    kind, tagged = F.col("conv_id") % 4, F.concat(F.lit("```c++\nint x"), F.col("turn"), F.lit(";\n```\n"))
    return r.select(*KEY, X.extract_code(F.when(kind == 0, fenced).when(kind == 1, F.lit("```js\ny\nz")).when(kind == 2, tagged).otherwise(F.col("output"))).alias("code"))


@query("p14_strip_chatter", R, f"WITH l AS (SELECT conv_id, turn, regexp_split_to_array(trim(prompt, {BLANK}), '\r\n|[\n\r\v\f\x1c-\x1e]') AS ls FROM v_results), m AS (SELECT conv_id, turn, ls, [regexp_matches(trim(x, {BLANK}), '(?i){X.PREAMBLES.replace(chr(39), chr(39) * 2)}') FOR x IN ls] AS p, [regexp_matches(trim(x, {BLANK}), '(?i){X.SIGN_OFFS}') FOR x IN ls] AS s FROM l), n AS (SELECT *, coalesce(nullif(list_position(p, false), 0), len(ls)+1) AS a, len(ls) - coalesce(nullif(list_position(list_reverse(s), false), 0), len(ls)+1) + 1 AS b FROM m) SELECT conv_id, turn, trim(array_to_string(ls[a:b], chr(10)), {BLANK}) AS body FROM n")
def chatter(r):
    around = F.concat(F.lit("Sure, here you go\nBELOW is\nI'll show\n"), F.col("prompt"), F.lit("\nLet me know if\nHope this works\n"))
    return r.select(*KEY, X.strip_chatter(around).alias("body"))


@query("p15_text_hash", R, "SELECT conv_id, turn, CASE WHEN conv_id % 7=0 THEN NULL ELSE sha256(lower(trim(prompt))) END AS h FROM v_results")
def text_hash(r):
    return r.select(*KEY, X.text_hash(F.when(F.col("conv_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("prompt"), F.lit(" ")))).alias("h"))


@query("p16_without_trailers", R, f"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(trim(prompt, {BLANK}), '\r?\n[ \t]*\r?\n'), lambda p: trim(p, {BLANK}) <> ''), chr(10) || chr(10)) || CASE WHEN conv_id % 2=0 THEN '' ELSE chr(10) || chr(10) || 'Fixes: #12' END AS body FROM v_results")
def trailers(r):
    who = F.lit("Signed-off-by: A <a@b>\n folded\nCc: x y\n \n* Generated with [Some Tool](https://t.example)\n")
    return r.select(*KEY, X.without_trailers(F.concat(F.col("prompt"), F.lit("\n\n"), F.when(F.col("conv_id") % 2 == 1, "Fixes: #12\n").otherwise(""), who)).alias("body"))


@query("p18_agent_and_model", "v_attempts", "SELECT DISTINCT arm, 'tool' AS agent, 'm:' || arm AS model FROM v_attempts")
def agent_and_model(a):
    return a.select("arm", X.agent_and_model(F.concat(F.lit("tool:m:"), "arm", F.lit("@ctx=32k"))).alias("x")).select("arm", "x.*").distinct()


@query("p21_complexity_tier", R, f"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(agent || ' ' || prompt), '{_alts(X.COMPLEX_PHRASES)}') OR len({WORDS('agent || chr(32) || prompt')}) > 60 THEN 3 ELSE 1 END AS tier FROM v_results")
def tier(r):
    return r.select(*KEY, X.complexity_tier(F.col("agent"), F.col("prompt")).alias("tier"))


TOK = lambda c: f"list_filter(list_distinct([lower(w) FOR w IN regexp_extract_all({c}, '[A-Za-z0-9_]+')]), lambda w: w NOT IN ({','.join(repr(w) for w in X.STOPWORDS)}))"
PARTS = f"""a AS (SELECT *, {WORDS('output')} AS ow, {WORDS('prompt')} AS pw, {TOK('output')} AS ot, {TOK('prompt')} AS pt, list_filter([trim(x) FOR x IN string_split(output, chr(10))], lambda x: x<>'') AS ls FROM v_results),
b AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '^\\d+[.)]\\s')) AS nl FROM a),
c AS (SELECT conv_id, turn, bucket, CASE WHEN len(ow)=0 THEN 0.0 WHEN len(ow)<5 THEN 0.1 ELSE least(0.4+0.25*least(len(ow)/300.0::DOUBLE,1.0)+CASE WHEN len(list_filter(regexp_split_to_array(trim(output),'[.!?]+'), lambda s: len({WORDS('s')})>=3))>0 THEN 0.15 ELSE 0 END+0.10*least(2.0*len(list_distinct([lower(w) FOR w IN ow]))/len(ow),1.0)+CASE WHEN regexp_matches(output,'(?m)^[-*•]\\s|\\d+\\.\\s|^#{{1,3}}\\s') THEN 0.1 ELSE 0 END,1.0) END::DOUBLE AS structural,
 CASE WHEN len(ot)=0 THEN 0.0 ELSE len(list_filter(ot, lambda w: NOT list_contains(pt,w)))/len(ot) END::DOUBLE AS novelty,
 CASE WHEN bucket<>'plan' AND len(ls)>=3 AND len(nl)>=0.6*len(ls) AND list_avg([len({WORDS('x')}) FOR x IN nl])<18 THEN 0.0 ELSE 1.0 END::DOUBLE AS not_plan,
 CASE WHEN len(pw)=0 THEN 0.5 ELSE least(len(ow)::DOUBLE/len(pw)/(CASE bucket WHEN 'research' THEN 10.0 ELSE 2.0 END),1.0) END::DOUBLE AS length FROM b)"""


@query("m03_prose_components", R, f"WITH {PARTS} SELECT conv_id, turn, round(structural,6) AS structural, round(novelty,6) AS novelty, not_plan, round(length,6) AS length FROM c")
def components(r):
    return r.select(*KEY, X.prose_components(F.col("prompt"), F.col("output"), F.col("bucket")).alias("c")).select(*KEY, "c.*")


@query("m03_quality_score", R, f"WITH {PARTS} SELECT conv_id, turn, round(round(least(0.45*structural+0.25*novelty+0.2*not_plan+0.1*length,1.0),4),3) AS score FROM c", 3)
def quality(r):
    return r.select(*KEY, X.quality_score(F.col("prompt"), F.col("output"), F.col("bucket")).alias("score"))


SECURE = ["", " See CWE-79, cwe 79 and CWE-89.", "\n  #### Risk\nxCWE-12 CVE-2021-44228 cve 2021 1", " Sanitise and ESCAPE input; least privilege, TLS, rbac, a salt.", "\n##### Threat\nThe attacker has malicious, untrusted input; the impact is a breach.", "\n## Countermeasures\nCVE2020-1, CWE99999 and the attack surface"]
SECURED = "output || CASE conv_id % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(SECURE)) + " END"
COUNT_OF = lambda ws: " + ".join(f"contains(low, '{w}')::INTEGER" for w in ws)
IDS = lambda p: f"len(list_distinct([upper(x) FOR x IN regexp_extract_all(t, '(?i){p}')]))"


@query("m03_security_score", R, f"WITH r AS (SELECT conv_id, turn, {SECURED} AS t FROM v_results), s AS (SELECT *, lower(t) AS low, len({WORDS('t')}) AS n FROM r) SELECT conv_id, turn, round(CASE WHEN n=0 THEN 0.0 WHEN n<5 THEN 0.1 ELSE least((CASE WHEN n<30 THEN 0.3 ELSE 0.4 END)::DOUBLE + least(0.1, 0.05::DOUBLE*{IDS(r'\bCWE[-\s]?\d{1,4}\b')}) + least(0.1, 0.05::DOUBLE*{IDS(r'\bCVE[-\s]?\d{4}[-\s]?\d{1,7}\b')}) + least(0.2, 0.04::DOUBLE*({COUNT_OF(X.MITIGATION_WORDS)})) + least(0.1, 0.025::DOUBLE*({COUNT_OF(X.THREAT_WORDS)})) + CASE WHEN regexp_matches(t, '(?im)^\\s*#{{1,4}}\\s*({'|'.join(X.SECURITY_HEADERS)})') THEN 0.1 ELSE 0 END, 1.0) END, 3) AS score FROM s", 3)
def security(r):
    kind = F.element_at(F.array(*map(F.lit, SECURE)), (F.col("conv_id") % 6 + 1).cast("int"))
    return r.select(*KEY, X.security_score(F.concat("output", kind)).alias("score"))


@query("m03_code_debug_security", R, None)
def other_scores(r):
    return r.select(*KEY, X.quality_score(F.col("prompt"), F.col("output"), F.lit("code")).alias("code"), X.quality_score(F.col("prompt"), F.col("output"), F.lit("debug")).alias("debug"), X.quality_score(F.col("prompt"), F.col("output"), F.lit("security")).alias("security"))


@query("m04_quality_band", R, f"WITH {PARTS}, s AS (SELECT *, (turn%10)/10.0::DOUBLE*2-1 AS sim FROM c), e AS (SELECT *, CASE WHEN (sim+1)/2<0.35 THEN greatest(0.0,(sim+1)/2/0.35) WHEN (sim+1)/2<=0.8 THEN 1.0 ELSE greatest(0.0,(1-(sim+1)/2)/0.2) END AS embed FROM s) SELECT conv_id, turn, round(embed,6) AS embed, round(round(least(0.35*structural+0.25*novelty+0.2*not_plan+0.1*length+0.1*embed,1.0),4),3) AS score FROM e", 6)
def band(r):
    embed = X.band_score((F.col("turn") % 10) / F.lit(10.0) * 2 - 1)
    return r.select(*KEY, embed.alias("embed"), F.round(X.prose_score(X.prose_components(F.col("prompt"), F.col("output"), F.col("bucket")), embed), 3).alias("score"))


@query("m26_keyword_summary", R, f"WITH t AS (SELECT conv_id, turn, prompt, list_filter(regexp_extract_all(bucket || '-x ' || output || ' ' || agent || ' ' || prompt || ' Which one', '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda w: lower(w) NOT IN ({','.join(repr(w) for w in X.SUMMARY_STOPWORDS)})) AS ts FROM v_results), u AS (SELECT conv_id, turn, prompt, list_filter(ts, lambda w, i: list_position([lower(x) FOR x IN ts], lower(w))=i) AS f FROM t) SELECT conv_id, turn, CASE WHEN len(f)=0 THEN prompt ELSE prompt || ' [' || array_to_string(f[1:50], ', ') || ']' END AS text FROM u")
def keyword_summary(r):
    hit = lambda s, title, body: F.struct(F.lit(s).alias("similarity"), title.alias("title"), body.alias("body"))
    hits = F.array(hit(0.5, F.col("agent"), F.col("prompt")), hit(0.2, F.lit("left"), F.lit("out")), hit(0.9, F.concat("bucket", F.lit("-x")), F.col("output")), hit(0.5, F.lit("Which"), F.lit("one")))
    return r.select(*KEY, X.augmented(F.col("prompt"), X.keyword_summary(X.hits_text(hits))).alias("text"))
