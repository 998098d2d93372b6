"""Resampling whose draws are columns: a counter-based generator and binomial inversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a distribution reach so many deviations to either side, beyond which no 52-bit number falls.
REACH = 9


def uniform(key: Column, draw: Column, seed: int) -> Column:
    """A number in (0, 1) that depends only on seed, key and draw: 52 bits of a digest, in the middle of their step."""
    told = F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), draw.cast("string"))
    return (F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def binomial_draws(df: DataFrame, key: str, correct: str, total: str, draws: int, seed: int) -> DataFrame:
    """``draws`` draws of the number of successes for each key, by inversion: ``key, total, draw, k``.

    A key's cumulative probabilities, over the numbers that can come up, and its uniform numbers are put in one
    order; a draw is the number of cells before it. Both come from sums of logarithms, so no
    factorial is taken. Nothing depends on partitions. A key has one row; without trials all draws are 0.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(total).cast("long").alias("total"), F.col(correct).cast("double").alias("c"))
    rows = rows.withColumn("p", F.coalesce(F.try_divide(F.col("c"), F.col("total").cast("double")), F.lit(0.0)))
    mean, spread = F.col("total") * F.col("p"), REACH * F.sqrt(F.col("total") * F.col("p") * (1 - F.col("p"))) + REACH
    sure = (F.col("p") <= 0) | (F.col("p") >= 1)
    low = F.when(sure, F.round(mean)).otherwise(F.greatest(F.lit(0), F.floor(mean - spread))).cast("long")
    high = F.when(sure, F.round(mean)).otherwise(F.least(F.col("total"), F.ceil(mean + spread))).cast("long")
    cells = rows.withColumn("low", low).select("key", "total", "p", "low", F.explode(F.sequence("low", high)).alias("k"))
    by, before = Window.partitionBy("key"), Window.partitionBy("key").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("k") > F.col("low"), F.log((F.col("total") - F.col("k") + 1) / F.col("k") * (F.col("p") / (1 - F.col("p"))))).otherwise(0.0)
    cells = cells.withColumn("w", F.sum(step).over(before)).withColumn("w", F.exp(F.col("w") - F.max("w").over(by)))
    cells = cells.select("key", (F.sum("w").over(before) / F.sum("w").over(by)).alias("v"), F.lit(1).alias("cell"), F.lit(None).cast("long").alias("draw"))
    drawn = rows.select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))).alias("draw"))
    drawn = drawn.select("key", uniform(F.col("key"), F.col("draw"), seed).alias("v"), F.lit(0).alias("cell"), "draw")
    order = Window.partitionBy("key").orderBy("v", "cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.unionAll(drawn).withColumn("passed", F.sum("cell").over(order)).filter("cell = 0")
    # The last cell holds what rounding leaves of the sum.
    return placed.join(rows.select("key", "total", low.alias("low"), high.alias("high")), "key").select(
        "key", "total", "draw", F.least(F.col("low") + F.col("passed"), F.col("high")).alias("k")
    )


def bootstrap(df: DataFrame, key: str, correct: str, total: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile interval and standard error of a proportion by binomial draws: ``key, low, high, se``."""
    share = F.coalesce(F.try_divide(F.col("k"), F.col("total").cast("double")), F.lit(0.0))
    rows = binomial_draws(df, key, correct, total, draws, seed).withColumn("share", share)
    return rows.groupBy("key").agg(
        F.percentile("share", 0.025).alias("low"), F.percentile("share", 0.975).alias("high"), F.stddev_samp("share").alias("se")
    )
