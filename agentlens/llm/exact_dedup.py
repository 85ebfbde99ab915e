"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

The first pass over the texts counts lengths and prefix hashes where they are read; a length, then a prefix of it, that no
other row has ends there. What is left is a bitmap of bounded size, which is broadcast: the second pass hashes whole texts
for grouping only where it is set. Texts are never shuffled. All counts are aggregates with map-side combination, so one
group that holds a third of the rows costs one partial row a task; its rows meet its result by broadcast of the largest
groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlens.llm.common import SPACE_CLASS, met, with_bit, written


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def _keyed(docs: DataFrame, prefix_chars: int) -> DataFrame:
    plain = docs.select(
        F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), normalised(F.col("text")).alias("plain")
    )
    return plain.select("doc_id", "n_points", "plain", F.length("plain").alias("n_plain"), F.xxhash64(F.substring("plain", 1, prefix_chars)).alias("prefix_hash"))


def shared_prefixes(docs: DataFrame, prefix_chars: int = 64) -> DataFrame:
    """pair (a hash of length and prefix hash) of each length and prefix that two rows or more share, written."""
    # Rows are counted by length and prefix before they move, so a hot length is a few rows a task.
    counted = written(_keyed(docs, prefix_chars).groupBy("n_plain", "prefix_hash").agg(F.count(F.lit(1)).alias("n")), "counted")
    lengths = counted.groupBy("n_plain").agg(F.sum("n").alias("rows")).filter("rows > 1").select("n_plain")
    return written(counted.filter("n > 1").join(lengths, "n_plain", "left_semi").select(F.xxhash64("n_plain", "prefix_hash").alias("pair")), "shared")


def exact_dedup(docs: DataFrame, prefix_chars: int = 64, all_hashes: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after deleting white space; null and empty texts form one group. Of a group,
    the row with the most code points in the original text stays, then the smallest doc_id (null ids last). A row without
    an equal is its own group of one. Rows that repeat an id together with a text of as many code points count each in
    group_size and are all kept or all dropped. A null id is kept only if its whole group has null ids or its text has
    the most code points. Columns of ``docs`` besides doc_id and text are not read. An empty table gives none.

    Grouping hashes a whole text only where its length and prefix are shared. ``all_hashes``: text_sha256 is wanted of the
    other rows too, as a column and not for grouping; without it theirs is null and their texts are not hashed.
    """
    pairs = shared_prefixes(docs, prefix_chars)
    rows = with_bit(_keyed(docs, prefix_chars).withColumn("pair", F.xxhash64("n_plain", "prefix_hash")), pairs, "pair")
    sha = F.sha2("plain", 256)
    hashed = written(rows.select("doc_id", "n_points", F.col("_bit").alias("shared"), (sha if all_hashes else F.when(F.col("_bit"), sha)).alias("text_sha256")), "hashed")
    # Smaller ids win among equal code points: the least struct of (negated points, null flag, id).
    groups = (
        hashed.filter("shared").groupBy("text_sha256")
        .agg(F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("no"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("text_sha256", F.col("best.doc_id").alias("keep_id"), (-F.col("best.p")).alias("keep_points"), "group_size")
    )
    found = F.col("met").isNotNull()
    return met(hashed.drop("shared"), written(groups, "groups"), ["text_sha256"], "group_size", ["doc_id", "n_points"]).select(
        "doc_id",
        F.when(found, F.col("met.keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("met.group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(found, F.col("doc_id").eqNullSafe(F.col("met.keep_id")) & (F.col("n_points") == F.col("met.keep_points"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def op4(spark, sf_dir: str) -> DataFrame:
    from agentlens.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_points,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS k,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT r.doc_id, b.doc_id AS keep_id, r.group_size, r.k = 1 AS kept, r.text_sha256
FROM r JOIN r AS b ON b.text_sha256 = r.text_sha256 AND b.k = 1
"""
