"""Prefix scans over ordered sequences of any length, block by block.

A window over a whole sequence sorts all of it in one task. Here a sequence is dealt over ranges of its order, the ranges
are counted, and each row's place follows from the count before its range; blocks of a fixed number of places then carry
what came before: sums and minima from the blocks' own sums and minima (a window over blocks only), and the last rows of the
block before for rolling windows. Nothing that a task holds grows with the sequence, a single one included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.sources.paths import shared_path

#: Places of a block.
BLOCK = 100_000
ALL = Window.unboundedPreceding


def attached(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each of their ``on`` values, nulls too."""
    other = table.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in table.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return rows.join(other, [*same], "left").drop(*[f"_on_{c}" for c in on])


def placed(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with t, the place from 1 in the sequence of their key, and n, the sequence's length.

    Ranges are found by Spark's sampling and written to the shared folder, so that all that follows sees the same ones."""
    path = shared_path(rows.sparkSession, "ranges")
    ranged = rows.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    made = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    over = Window.partitionBy(*key)
    before = F.coalesce(F.sum("_m").over(over.orderBy("_range").rowsBetween(ALL, -1)), F.lit(0))
    starts = made.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_m")).withColumns({"_before": before, "n": F.sum("_m").over(over)}).drop("_m")
    inside = Window.partitionBy(*key, "_range").orderBy(*order)
    return attached(made, starts, [*key, "_range"]).withColumn("t", F.row_number().over(inside) + F.col("_before")).drop("_range", "_before")


def blocked(rows: DataFrame, size: int = BLOCK, lead: int = 0) -> DataFrame:
    """Rows with t, and their block of ``size`` places (more if ``lead`` is more). ``lead``: so many rows before a block
    come with it, marked as lead, for windows that look back; ``own`` takes them away again."""
    size = max(size, lead, 1)
    at = F.floor((F.col("t") - 1) / size)
    if not lead:
        return rows.withColumns({"block": at, "lead": F.lit(False)})
    late = (F.col("t") - 1) % size >= size - lead
    copies = F.filter(F.array(F.struct(at.alias("block"), F.lit(False).alias("lead")), F.when(late, F.struct((at + 1).alias("block"), F.lit(True).alias("lead")))), lambda s: s.isNotNull())
    return rows.withColumn("_in", F.explode(copies)).select(*rows.columns, "_in.block", "_in.lead")


def last_rows(key: list[str], n: int) -> Window:
    """The window of a row and the n - 1 before it, over rows that are blocked with a lead of n - 1."""
    return Window.partitionBy(*key, "block").orderBy("t").rowsBetween(1 - n, 0)


def own(rows: DataFrame) -> DataFrame:
    return rows.filter("NOT lead").drop("lead")


def running_sums(rows: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """Blocked rows without leads, with the sums of ``values`` from the sequence's begin to each row; null values count 0.
    Sums are of the values' type: exact for decimals."""
    rows = rows.withColumns({f"_v_{name}": F.coalesce(v, F.lit(0)) for name, v in values.items()})
    over = Window.partitionBy(*key).orderBy("block").rowsBetween(ALL, -1)
    sums = rows.groupBy(*key, "block").agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
    carry = sums.withColumns({f"_s_{name}": F.coalesce(F.sum(f"_s_{name}").over(over), F.lit(0)) for name in values})
    inside = Window.partitionBy(*key, "block").orderBy("t").rowsBetween(ALL, 0)
    out = attached(rows.withColumns({name: F.sum(f"_v_{name}").over(inside) for name in values}), carry, [*key, "block"])
    return out.withColumns({name: F.col(name) + F.col(f"_s_{name}") for name in values}).drop(*[f"{p}{name}" for name in values for p in ("_v_", "_s_")])


def running_min(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Blocked rows with the least value from the sequence's begin to each row."""
    over = Window.partitionBy(*key).orderBy("block").rowsBetween(ALL, -1)
    carry = rows.groupBy(*key, "block").agg(F.min(value).alias("_m")).withColumn("_least", F.min("_m").over(over)).drop("_m")
    inside = Window.partitionBy(*key, "block").orderBy("t").rowsBetween(ALL, 0)
    out = attached(rows.withColumn(name, F.min(value).over(inside)), carry, [*key, "block"])
    return out.withColumn(name, F.least(name, "_least")).drop("_least")


def running_moments(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Blocked rows (leads too, whose own figures mean nothing) with mean and std (sample deviation; null for one row) of
    the sequence's values up to each row. Blocks carry count, mean and squared deviations, which add up about the mean."""
    plain = rows.filter("NOT lead")
    over = Window.partitionBy(*key).orderBy("block").rowsBetween(ALL, -1)
    by = plain.groupBy(*key, "block").agg(F.count(value).alias("_n"), F.avg(value).alias("_a"), (F.var_pop(value) * F.count(value)).alias("_d"))
    # About the first block's mean, so that little is lost where means are alike.
    by = by.withColumn("_c", F.first("_a").over(Window.partitionBy(*key).orderBy("block").rowsBetween(ALL, 0))).withColumn("_e", F.col("_a") - F.col("_c"))
    n = F.sum("_n").over(over)
    shift = F.sum(F.col("_n") * F.col("_e")).over(over) / n
    spread = F.sum("_d").over(over) + F.greatest(F.lit(0.0), F.sum(F.col("_n") * F.col("_e") * F.col("_e")).over(over) - n * shift * shift)
    carry = by.select(*key, "block", F.coalesce(n, F.lit(0)).alias("_n0"), F.coalesce(F.col("_c") + shift, F.lit(0.0)).alias("_a0"), F.coalesce(spread, F.lit(0.0)).alias("_d0"))
    inside = Window.partitionBy(*key, "block").orderBy("t").rowsBetween(ALL, 0)
    v = F.when(~F.col("lead"), F.col(value))
    local = rows.withColumns({"_n1": F.count(v).over(inside), "_a1": F.avg(v).over(inside), "_d1": F.var_pop(v).over(inside)})
    out = attached(local, carry, [*key, "block"])
    n0, n1, gap = F.col("_n0"), F.col("_n1"), F.when(F.col("_n0") > 0, F.col("_a1") - F.col("_a0")).otherwise(0.0)
    squares = F.col("_d0") + F.col("_d1") * n1 + gap * gap * n0 * n1 / (n0 + n1)
    mean = F.when(n0 > 0, F.col("_a0") + gap * n1 / (n0 + n1)).otherwise(F.col("_a1"))
    return out.withColumns({"mean": mean, "std": F.when(n0 + n1 > 1, F.sqrt(squares / (n0 + n1 - 1)))}).drop("_n0", "_a0", "_d0", "_n1", "_a1", "_d1")
