"""The bounded sample of labelled rows that a classifier may be fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlens.llm.common import held_out


def sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, y: at most ``per_class`` ids of each class, the first by a hash of the id; only rows that are not held out.

    Null ids and labels other than 0 and 1 are left out, and so are ids with two different labels; repeated rows count
    once.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("doc_id")))
    once = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    first = lambda y: once.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return first(0).unionByName(first(1))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, y of the sample, a row for each id: its 2 * per_class ids at most are shipped to the documents, and of rows
    that repeat an id one text counts, the first by hash."""
    ids = sample(labels, label, per_class)
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
