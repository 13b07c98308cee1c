"""Exact medians of many groups and values by distributed selection: counts of value ranges, narrowed to the range that holds the middle rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketspark.sources.snapshots import keep

#: Value ranges that are counted in a round for each group and value; what a task holds does not grow with the distinct values.
RANGES = 1 << 15


def medians(rows: DataFrame, by: list[str], values: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """A row per group of `by` (one row for none) with the median (double) of each whole-number column of `values`, by its name.

    Nulls do not count; the median of an even number of values is the mean of the middle two; a group without any value has null, or no row if
    that holds for all columns. Null is a group of its own. Values of a column must lie within 2^63 of each other.

    The narrow values are written once. A round counts them by range for all groups together, chooses the range in which each group's middle
    rank lies and divides it again, so that amounts up to 10^9 take two rounds whatever their number.
    """
    keys = [f"k{i}" for i in range(len(by))]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("long").alias("v")) for n, v in values.items()])
    numbers = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.inline(pairs)).filter("v is not null")
    numbers = keep(numbers, "medians-values")
    group = [*keys, "name"]
    state = numbers.groupBy(*group).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.expr("(count(*) - 1) div 2").alias("rank"))
    state = keep(state, "medians-ranges")
    while state.filter("high > low").limit(1).count():
        width = F.floor((F.col("high") - F.col("low")) / F.lit(ranges)) + 1
        held = _beside(numbers, state.withColumn("width", width), group).filter("v between low and high")
        counted = held.groupBy(*group, "low", "high", "rank", "width", F.expr("(v - low) div width").alias("range")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy("range"))  # at most `ranges` rows a group
        chosen = counted.withColumn("upto", upto).filter("upto > rank and upto - n <= rank")
        low = F.col("low") + F.col("range") * F.col("width")
        state = keep(chosen.select(*group, low.alias("low"), F.least("high", low + F.col("width") - 1).alias("high"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "medians-ranges")
    middle = F.col("low")
    above = F.min(F.when(F.col("v") > middle, F.col("v")))
    half = _beside(numbers, state, group).groupBy(*group, "low").agg(F.count("*").alias("n"), F.count_if(F.col("v") <= middle).alias("upto"), above.alias("above"))
    value = F.when(F.col("upto") > F.expr("n div 2"), middle.cast("double")).otherwise(middle / 2 + F.col("above") / 2)
    out = half.withColumn("median", value).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in values])
    return out.toDF(*by, *values)


def _beside(numbers: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """numbers with their group's state; one row of state per group, nulls match."""
    other = state.select(*[F.col(g).alias(f"s_{g}") for g in group], *[c for c in state.columns if c not in group])
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"s_{g}"))
    return numbers.join(other, same).drop(*[f"s_{g}" for g in group])
