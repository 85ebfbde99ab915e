"""Order statistics of groups of any size, without a group's values in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.operators.scans import attached
from agentlens.sources.paths import shared_path

#: Values that are sorted at once, and bins of a round.
FEW, BINS = 10_000, 1024


def _written(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_values(rows: DataFrame, keys: list[str], value: str, at: Callable[[Column], Column], few: int = FEW, bins: int = BINS) -> DataFrame:
    """keys, n (values that are not null), low (the value of rank ``at(n)``, from 1, at most n) and high (that of the next
    rank, null behind the last). Groups without a value have no row.

    Every round counts the values of each group that is still too large in bins between its bounds, and goes on in the bin
    that holds the rank; a bin's bounds are values that occur in it, so a round always parts a group. Counts are combined
    before they move. Groups of ``few`` values or less, and what is left of the others, are sorted."""
    v = rows.select(*keys, F.col(value).alias("_v")).filter("_v IS NOT NULL")
    state = v.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = _written(state.withColumns({"_k": F.least(at(F.col("_n")), F.col("_n")).cast("long"), "_m": F.col("_n"), "_after": F.lit(None).cast(dict(v.dtypes)["_v"])}))
    large = (F.col("_m") > few) & (F.col("_lo") < F.col("_hi"))
    while not state.filter(large).isEmpty():
        inside = attached(v, state.filter(large), keys).filter("_v BETWEEN _lo AND _hi")
        # Halves, as the distance of two doubles may be none.
        half = lambda c: F.col(c).cast("double") / 2
        share = (half("_v") - half("_lo")) / (half("_hi") - half("_lo"))
        by = inside.groupBy(*keys, F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_bin")).agg(F.count("_v").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        order = Window.partitionBy(*keys).orderBy("_bin")
        by = by.withColumns({"_before": F.sum("_c").over(order) - F.col("_c"), "_next": F.lead("_least").over(order)})
        held = attached(by, state.filter(large), keys).filter("_before < _k AND _k <= _before + _c")
        narrowed = held.select(*keys, "_n", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_k") - F.col("_before")).alias("_k"), F.col("_c").alias("_m"), F.coalesce("_next", "_after").alias("_after"))
        state = _written(narrowed.unionByName(state.filter(~large)))
    left = attached(v, state.filter("_lo < _hi"), keys).filter("_v BETWEEN _lo AND _hi").groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    found = attached(state, left, keys)
    at_k = lambda i: F.when(F.col("_lo") == F.col("_hi"), F.when(F.col("_k") + i <= F.col("_m"), F.col("_lo"))).otherwise(F.get("_vs", (F.col("_k") + (i - 1)).cast("int")))
    return found.select(*keys, F.col("_n").alias("n"), at_k(0).alias("low"), F.coalesce(at_k(1), F.col("_after")).alias("high"))


def medians(rows: DataFrame, keys: list[str], value: str, name: str, approximate: bool = False, **how) -> DataFrame:
    """keys and the median of each group (the mean of the two in the middle); ``approximate``: by Spark's quantile sketch.
    Groups without a value have no row."""
    if approximate:
        return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), 0.5).alias(name))
    found = ranked_values(rows, keys, value, lambda n: F.floor((n + 1) / 2), **how)
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    return found.select(*keys, F.when(F.col("n") % 2 == 1, low).otherwise((low + high) / 2).alias(name))
