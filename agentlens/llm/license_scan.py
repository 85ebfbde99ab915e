"""Licence scan with a positional index of rare tokens. DataFrame functions only.

A library of templates (short, bounded) is cut into words. From the document frequency of every template word over the
whole corpus come its IDF and so an order of words, rarest first. Of each file, the template words with the highest IDF
are looked up, and of every template the rarest word of its mandatory phrase, so that no complete match can be missed.
A hit at word p of a posting (template, q) proposes that the template starts at p - q: postings are intersected by
relative position. A proposed place counts when each mandatory key phrase stands at its relative position; its share of
equal words is the place's score. All of this happens inside the row: no shuffle, and no file is larger than its task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The gaps between words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``text`` in words; ``key`` is the mandatory phrase inside it, and is the whole text of a base phrase."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(GAP, self.text.lower()) if w]

    @property
    def key_words(self) -> list[str]:
        return [w for w in re.split(GAP, self.key.lower()) if w]

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


# The three base phrases and the opening or naming sentences of common public licences.
TEMPLATES = [
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted free of charge to any person obtaining a copy of this software"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this program is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "under the terms of the gnu affero general public license version 3", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc0", "licensed under cc0 1 0 universal", "cc0 1 0"),
]


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none. Two capitals beyond ASCII that ``lower`` would turn into
    ASCII letters (U+212A, U+0130) are replaced first by another letter beyond ASCII."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("�")), F.lit("İ"), F.lit("�"))
    return F.filter(F.split(F.lower(safe), GAP), lambda w: w != "")


def word_frequencies(docs: DataFrame, templates: list[Template]) -> dict[str, int]:
    """In how many documents each template word stands: at most one row for each word of the library."""
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), words(F.col("text")))).alias("w")).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in rows}


def license_scan(docs: DataFrame, templates: list[Template] = TEMPLATES, lookups: int = 8, max_share: float = 0.05, min_match: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: its columns doc_id and text's counts, base places, labels and score.

    ``lookups``: the file's rarest template words that are looked up; words in more than ``max_share`` of the documents
    are looked up only where they are the rarest of a mandatory phrase. ``min_match``: the least share of a template's
    words that stand at their place (mandatory phrase included). score: the largest share among the file's places, 0
    without any. Empty and null texts have no words, no labels ('') and null first_word and last_word. Repeated rows
    are scanned each by itself. Other columns of ``docs`` are not read.
    """
    n_in = word_frequencies(docs, templates)
    total = docs.count()
    order = sorted({w for t in templates for w in t.words}, key=lambda w: (n_in.get(w, 0), w))
    rare = [w for w in order if n_in.get(w, 0) <= max_share * total]
    anchors = sorted({min(t.key_words, key=order.index) for t in templates}, key=order.index)
    strings = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    postings: dict[str, list[tuple[int, int]]] = {w: [] for w in {*rare, *anchors}}
    for t, template in enumerate(templates):
        for q, w in enumerate(template.words):
            if w in postings:
                postings[w].append((t, q))
    index = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in postings[w]]))])
    library = F.array(*[
        F.struct(strings(t.words).alias("words"), strings(t.key_words).alias("key"), F.lit(t.key_at).alias("key_at"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"))
        for t in templates
    ])
    own = docs.select("doc_id", words(F.col("text")).alias("ws"))
    looked = own.select("doc_id", "ws", F.array_union(F.slice(F.array_intersect(strings(rare), "ws"), 1, lookups), F.array_intersect(strings(anchors), "ws")).alias("look"))
    # Only rows with something to look up build the positions.
    hits = F.when(
        F.size("look") > 0,
        F.filter(F.transform("ws", lambda w, i: F.when(F.array_contains("look", w), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull()),
    )
    # Template and start in one number: Spark finds distinct numbers by hashing, but distinct structs by comparing all.
    start = lambda h, p: F.when(h["i"] >= p["q"], F.shiftleft(p["t"].cast("long"), 32) + h["i"] - p["q"])
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["w"]), lambda p: start(h, p)))))
    placed = looked.select("doc_id", "ws", F.filter(starts, lambda c: c.isNotNull()).alias("starts"))

    def place(c: Column) -> Column:
        t, s = F.get(library, F.shiftright(c, 32).cast("int")), c.bitwiseAND((1 << 32) - 1).cast("int")
        keyed = F.slice("ws", s + t["key_at"] + 1, F.size(t["key"])) == t["key"]
        share = F.size(F.filter(F.zip_with(t["words"], F.slice("ws", s + 1, F.size(t["words"])), lambda a, b: a == b), lambda x: x)) / F.size(t["words"])
        return F.when(keyed, F.struct(t["label"].alias("label"), t["base"].alias("base"), s.cast("long").alias("s"), share.alias("share")))

    kept = placed.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.filter(F.transform("starts", place), lambda p: p.isNotNull() & (p["share"] >= min_match)).alias("places"))
    base = F.filter("places", lambda p: p["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    none = lambda c, instead: F.coalesce(c, F.lit(instead))
    return kept.select(
        "doc_id",
        "n_words",
        F.greatest(none(F.size(base), 0), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["s"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["s"])).alias("last_word"),
        none(joined(base), "").alias("base_labels"),
        none(joined(F.col("places")), "").alias("labels"),
        none(F.array_max(F.transform("places", lambda p: p["share"])), 0.0).alias("score"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    from agentlens.llm.common import table

    found = license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 6))


def _op2_sql() -> str:
    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    values = ",\n".join(f"({lists(t.words)}, {lists(t.key_words)}, {t.key_at}, '{t.label}', {str(t.base).lower()})" for t in TEMPLATES)
    return rf"""
WITH t(words, kw, key_at, label, base) AS (VALUES {values}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d),
c AS (SELECT p.doc_id, t.label, t.base, p.i - t.key_at AS s,
        list_sum([CASE WHEN ws[p.i - t.key_at + k] = words[k] THEN 1 ELSE 0 END FOR k IN range(1, len(words) + 1)]) / len(words) AS share
      FROM p JOIN t ON p.ws[p.i + 1] = t.kw[1] AND p.ws[p.i + 1 : p.i + len(t.kw)] = t.kw AND p.i >= t.key_at),
g AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM c WHERE share >= 0.6 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN g USING (doc_id)
"""


OP2_SQL = _op2_sql()
