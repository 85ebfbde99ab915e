"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent is bisected (``CUTS``
values at a time, so a few passes over the source totals settle it) to the largest one whose weights have at least a
target entropy, or to the smallest one that repeats no source more often than a limit. A weight times the budget is a
source's budget in tokens. It is realised by block permutations: documents are hashed to blocks of about ``block_tokens``,
each epoch takes a source's blocks in an order of its own, whole epochs while the budget lasts and then blocks up to it;
in the block where it ends, documents in hash order. Documents are never sorted across a source: running sums go over
blocks, and over the documents of one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.llm.common import SPACE_CLASS, table, written

CUTS, ROUNDS = 32, 5
#: Blocks that one window takes, about.
RANGE_BLOCKS = 4096


def word_tokens(text: Column) -> Column:
    """The number of words, the unit where no tokenizer is given."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_CLASS.replace("[", "[^") + "+")).cast("long")


def source_totals(units: DataFrame) -> DataFrame:
    """source, n_tokens, n_docs; sources without tokens have no share and are left out."""
    return units.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs")).filter("n_tokens > 0")


def _at(totals: DataFrame, exponents: list[float]) -> list[dict]:
    """For each exponent the normaliser z, the entropy of the weights and the largest weight over share, in one pass."""
    whole = totals.agg(F.sum("n_tokens").alias("t"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most")).first()
    if not whole["t"]:
        return []
    logs = F.log(F.col("n_tokens") / F.lit(float(whole["t"])))
    aggs = [f(F.exp(F.lit(a) * logs) * x).alias(f"{n}{i}") for i, a in enumerate(exponents) for n, x, f in (("z", F.lit(1.0), F.sum), ("s", logs, F.sum))]
    r = totals.agg(*aggs).first()
    out = []
    for i, a in enumerate(exponents):
        z = r[f"z{i}"]
        rarest = (whole["least"] if a <= 1 else whole["most"]) / whole["t"]
        out.append({"exponent": a, "z": z, "entropy": math.log(z) - a * r[f"s{i}"] / z, "most_over": rarest ** (a - 1) / z})
    return out


def exponent(totals: DataFrame, budget_share: float, repeat_limit: float | None = 4.0, entropy: float | None = None, top: float = 4.0) -> dict:
    """The exponent with its normaliser. With ``entropy``: the largest in [0, top] whose weights have that entropy at
    least (0 if none has). Otherwise the smallest in [0, 1] with weight * budget <= repeat_limit * tokens for each
    source (1 if the budget alone breaks the limit)."""
    lo, hi = (0.0, top) if entropy is not None else (0.0, 1.0)
    # ok falls with the exponent for an entropy and rises with it for a limit; the bracket keeps the change inside.
    fine = (lambda x: x["entropy"] >= entropy) if entropy is not None else (lambda x: x["most_over"] * budget_share <= repeat_limit)
    for _ in range(ROUNDS):
        found = _at(totals, [lo + (hi - lo) * i / CUTS for i in range(CUTS + 1)])
        if not found:
            return {"exponent": 1.0, "z": 1.0}
        good = [i for i, x in enumerate(found) if fine(x)]
        if entropy is not None:
            i = good[-1] if good else 0
            j = min(i + 1, CUTS)
        else:
            i = good[0] if good else CUTS
            j = max(i - 1, 0)
        best = found[i]
        if i == j or not good:
            break
        lo, hi = sorted((best["exponent"], found[j]["exponent"]))
    return best


def weights(totals: DataFrame, budget_tokens: float | None = None, **target) -> DataFrame:
    """source, n_tokens, n_docs, weight, budget (tokens); the weights add up to 1."""
    whole = float(totals.agg(F.sum("n_tokens")).first()[0] or 0)
    budget = whole if budget_tokens is None else float(budget_tokens)
    e = exponent(totals, budget / whole if whole else 1.0, **target)
    weight = F.exp(F.lit(e["exponent"]) * F.log(F.col("n_tokens") / F.lit(whole or 1.0))) / F.lit(e["z"])
    return totals.withColumn("weight", weight).withColumn("budget", F.col("weight") * F.lit(budget))


def turns(rounds: DataFrame, seed: int) -> DataFrame:
    """``block``: a block's place, from 0, in the order of hashes of its source's epoch; ``before``: the tokens before it,
    those of earlier epochs too. A hot source has more blocks than one task should sort, so ranges of the hash are summed
    first, and windows go over the ranges of an epoch and over the blocks of a range."""
    n_ranges = F.ceil(F.col("n_blocks") / RANGE_BLOCKS)
    by = rounds.withColumn("order", F.xxhash64("b", "epoch", F.lit(seed))).withColumn("range", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * n_ranges))
    sums = by.groupBy("source", "epoch", "range").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("source", "epoch").orderBy("range")
    starts = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("range").alias("r"), (F.sum("tokens").over(over) - F.col("tokens")).alias("sum_before"), (F.sum("n").over(over) - F.col("n")).alias("n_before"))
    inside = Window.partitionBy("source", "epoch", "range").orderBy("order", "b")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("range") == F.col("r"))
    before = F.sum("size").over(inside) - F.col("size") + F.col("sum_before") + F.col("epoch") * F.col("whole")
    return by.join(starts, same).drop("s", "e", "r").withColumn("block", F.row_number().over(inside) - 1 + F.col("n_before")).withColumn("before", before)


def schedule(docs: DataFrame, budget_tokens: float | None = None, block_tokens: int = 100_000, seed: int = 17, tokens: Column | None = None, **target) -> DataFrame:
    """One row per copy of a document in the mixture: doc_id, source, n_tokens, epoch, block (its turn in the epoch),
    turn (0 to 1, the copy's place in its source's budget: ordering all copies by it interleaves the sources).

    ``target``: ``repeat_limit`` (default 4) or ``entropy``; ``budget_tokens``: default the tokens of all documents.
    ``tokens``: a column with a text's length, default its words. A source's copies never exceed its budget and fall
    short of it by less than one document of the block where it ends. Rows that repeat an id in one source are one unit
    of their joint length; a null source is a source, null ids of a source are one unit. Documents without tokens cost
    nothing and come once an epoch; sources without any token have no share and no copies. Other columns are not read;
    an empty table gives none.
    """
    length = word_tokens(F.col("text")) if tokens is None else tokens
    units = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), length.alias("n_tokens")).groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens"))
    units = written(units, "units")
    totals = written(source_totals(units), "totals")
    plan = weights(totals, budget_tokens, **target).select(
        F.col("source").alias("s"), F.col("n_tokens").alias("whole"), "budget", F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / block_tokens)).alias("n_blocks"), F.floor(F.col("budget") / F.col("n_tokens")).alias("full")
    )
    # The number of sources is far below that of documents, but has no bound: Spark may broadcast it, nothing forces it.
    dealt = units.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks")))
    blocks = dealt.groupBy("source", "b").agg(F.sum("n_tokens").alias("size"), F.first("whole").alias("whole"), F.first("budget").alias("budget"), F.first("full").alias("full"), F.first("n_blocks").alias("n_blocks"))
    rounds = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    placed = written(turns(rounds, seed).filter("before < budget OR size = 0 AND epoch < full").select(F.col("source").alias("s"), F.col("b").alias("pb"), "epoch", "block", "before", "size"), "blocks")
    copies = dealt.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("pb")))
    fits = F.col("before") + F.col("size") <= F.col("budget")
    columns = ["doc_id", "source", "n_tokens", "epoch", "block", "before", "budget"]
    whole = copies.filter(fits).select(*columns)
    # The blocks where a budget ends: one for each source.
    inside = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64("doc_id", "epoch", F.lit(seed)), "doc_id")
    ended = copies.filter(~fits).withColumn("before", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).filter("before + n_tokens <= budget").select(*columns)
    return whole.unionByName(ended).select("doc_id", "source", "n_tokens", "epoch", F.col("block").cast("long"), (F.col("before") / F.col("budget")).alias("turn"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mixture with all their columns, a row for each copy (null ids and sources match their own)."""
    copies = schedule(docs, **how).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"))
    return docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & docs["source"].cast("string").eqNullSafe(F.col("_s"))).drop("_d", "_s")


def op8(spark, sf_dir: str) -> DataFrame:
    found = schedule(table(spark, sf_dir, "documents"))
    return found.withColumn("turn", F.round("turn", 6))
