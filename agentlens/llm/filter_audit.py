"""How filters of a chain overlap, in every order of the chain: min-plus removal ranks.

Which of the filters a document fails is a mask; documents with one mask fare alike, so a part's documents are counted by
mask (a narrow aggregate with map-side combination) before anything else is asked. In an order of the filters each filter
stands at a position, the inverse permutation. The step that removes a mask is the least position of a filter that it
fails: the product of the matrix of masks (0 where a filter fails, infinity elsewhere) with the matrix of positions in
min-plus algebra, masks x orders in one expression. The steps then drive a scatter of the counts, weighted by documents,
good and toxic ones: what each step of each order removes, keeps and meets again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlens.llm.common import SPACE_CLASS, met, table, written

#: The step of a mask that no filter removes.
STAYS = np.inf
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def positions(n: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of n filters, and as a matrix (orders x filters) the position, from 1, of each filter in each order."""
    orders = list(permutations(range(n)))
    return orders, np.argsort(np.array(orders), axis=1) + 1


def removal_steps(fails: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Min-plus product of masks (masks x filters, true where a filter fails) and places (orders x filters): the step at
    which an order removes a mask, infinity where it stays."""
    return (np.where(fails, 0.0, STAYS)[:, None, :] + places[None, :, :]).min(axis=2)


def audit_of(counts: np.ndarray, names: str) -> pd.DataFrame:
    """The rows of one part. counts: (masks x 3) documents, good and toxic ones by mask; bit f of a mask is filter f."""
    n = len(names)
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1 == 1
    orders, places = positions(n)
    steps = removal_steps(fails, places)
    removed = np.zeros((len(orders), n + 1, 3), np.int64)
    order_of = np.broadcast_to(np.arange(len(orders)), steps.shape)
    slot = np.where(np.isfinite(steps), steps, n + 1).astype(np.int64) - 1
    np.add.at(removed, (order_of, slot), np.broadcast_to(counts[:, None, :], (*steps.shape, 3)))
    # Failing the filter at a step, whether or not an earlier one has removed the document.
    failing = counts[:, 0] @ fails
    alone = np.array([counts[1 << f, 0] for f in range(n)])
    at = np.array(orders)
    credit = np.zeros(n, np.int64)
    np.add.at(credit, at, removed[:, :n, 0])
    return pd.DataFrame({
        "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], n), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
        "kept": (counts[:, 0].sum() - removed[:, :n, 0].cumsum(axis=1)).ravel(), "removed": removed[:, :n, 0].ravel(), "redundant": (failing[at] - removed[:, :n, 0]).ravel(),
        "unique_fails": alone[at].ravel(), "good_lost": removed[:, :n, 1].ravel(), "toxic_lost": removed[:, :n, 2].ravel(), "shapley": credit[at].ravel(),
    })


def audited(masks: DataFrame, names: str) -> DataFrame:
    """For (part, mask, n, good, toxic) counts: one row for each part, order of the filters and step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, *cells in b.itertuples(index=False, name=None):
                yield audit_of(np.array([np.asarray(c) for c in cells], np.int64).T, names).assign(part=part)[OUT_NAMES]

    cell = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(1 << len(names)))).alias(c)
    return masks.groupBy("part").agg(cell("n"), cell("good"), cell("toxic")).mapInPandas(run, OUT)


OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that need no other row; words are what white space separates."""
    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filters A to E over ``docs``, in all 120 orders: one row for each part (lang; null: ''), order and step.

    A: under 100 words. B: under 80 distinct words in 100. C: more than 10 capitals A-Z in 100 code points. D: any of
    #$%&*|. E: the same text has a smaller doc_id, anywhere in the table. kept, removed, redundant (fails the step's
    filter, removed earlier), unique_fails (fails no other), good_lost and toxic_lost (removed here, labelled quality 1,
    toxic 1), shapley (what the filter removes, summed over all orders). Null texts count as empty; a document without
    label is neither good nor toxic, one with several labels is what any of them says. Repeated rows count each, and do
    not fail E by one another; a null id fails E where the text has any id, and has no label. Columns besides doc_id,
    text and lang are not read. An empty table gives none.

    Texts are judged and hashed (SHA-256) where they are read; only narrow rows move. The rows of the commonest texts
    meet their smallest id by broadcast, so that no text's copies meet in one task.
    """
    text = F.coalesce("text", F.lit(""))
    failing = conditions(text)
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(c, 1 << f).otherwise(0) for f, c in enumerate(failing.values())), F.lit(0))
    judged = written(read.select("doc_id", "part", bits.alias("mask"), F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("digest")), "judged")
    copies = written(judged.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND least IS NOT NULL"), "copies")
    repeated = F.coalesce(F.col("doc_id") > F.col("met.least"), F.col("doc_id").isNull() & F.col("met").isNotNull())
    masked = met(judged, copies, ["digest"], "n", ["doc_id"]).select("doc_id", "part", F.when(repeated, F.col("mask").bitwiseOR(F.lit(1 << len(failing)))).otherwise(F.col("mask")).alias("mask"))
    known = labels.select(F.col("doc_id").cast("long"), F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("q"), F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int").alias("t"))
    known = known.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    counts = masked.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("q"), F.lit(0)).alias("good"), F.coalesce(F.sum("t"), F.lit(0)).alias("toxic"))
    return audited(counts, "ABCDE")


def op13(spark, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
     label AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS t FROM labels GROUP BY doc_id),
     f AS (SELECT d.doc_id, d.part, coalesce(q, 0) AS q, coalesce(t, 0) AS t,
             (len(words) < 100) AS a, (100 * len(list_distinct(words)) < 80 * len(words)) AS b,
             (100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text)) AS c,
             regexp_matches(d.text, '[#$%&*|]') AS dd, (d.doc_id > least) AS e
           FROM d JOIN first USING (text) LEFT JOIN label ON label.doc_id = d.doc_id),
     m AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': dd, 'E': e} AS x, q, t, count(*) AS n,
             a::INT + b::INT + c::INT + dd::INT + e::INT AS failed FROM f GROUP BY ALL),
     letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
     orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
                WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
     steps AS (SELECT filter_order, s::INT AS step, substr(filter_order, s::INT, 1) AS l, substr(filter_order, 1, s::INT - 1) AS before
               FROM orders, range(1, 6) r(s)),
     fails AS (SELECT part, q, t, n, failed, l, CASE l WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END AS hit,
                 concat(CASE WHEN x.A THEN 'A' END, CASE WHEN x.B THEN 'B' END, CASE WHEN x.C THEN 'C' END, CASE WHEN x.D THEN 'D' END, CASE WHEN x.E THEN 'E' END) AS mask
               FROM m, letter),
     per AS (SELECT part, filter_order, step, l,
               coalesce(sum(n) FILTER (hit AND fresh), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND NOT fresh), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (hit AND failed = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n * q) FILTER (hit AND fresh), 0)::BIGINT AS good_lost,
               coalesce(sum(n * t) FILTER (hit AND fresh), 0)::BIGINT AS toxic_lost, coalesce(sum(n) FILTER (fresh AND NOT hit), 0)::BIGINT AS kept
             FROM (SELECT *, translate(mask, before, '') = mask AS fresh FROM fails JOIN steps USING (l)) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM per
"""
