"""Statistics that stay exact on groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def cv_from_sums(n: Column, total: Column, squares: Column) -> Column:
    """Population coefficient of variation from a count, a sum and a sum of squares."""
    n, total, squares = (c.cast("double") for c in (n, total, squares))
    spread = F.sqrt(F.greatest(n * squares - total * total, F.lit(0.0)))
    return F.try_divide(spread, total)


def exact_quantile(
    df: DataFrame, keys: list[str], value: str, p: float = 0.5, out: str = "median"
) -> DataFrame:
    """Exact interpolated quantile of ``value`` per key, one row per key.

    ``percentile`` keeps every distinct value of a group in one buffer. Here equal values are
    first counted (map-side), then counts are summed per cell, where a cell is an order-keeping
    bucket of relative width below 2^-15. Only cell counts are cumulated per key, and only the
    values in the one or two cells that hold the wanted ranks are ordered.
    """
    v = F.col("__v")
    size = F.abs(v)
    octave = F.floor(F.log2(size) * 8)
    step = F.floor(size / F.pow(F.lit(2.0), octave / 8) * 65536)
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("__v"))
        .filter(v.isNotNull())
        .withColumn("__c", F.when(v == 0, 0).otherwise(F.signum(v) * (octave + 10000)))
        .withColumn("__f", F.when(v == 0, 0).otherwise(F.signum(v) * step))
        .groupBy(*keys, "__c", "__f", "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ordered = per_key.orderBy("__c", "__f")
    position = (F.col("__total") - 1) * F.lit(float(p))
    targets = (
        counted.groupBy(*keys, "__c", "__f")
        .agg(F.sum("__n").alias("__cell"))
        .withColumn("__cum", F.sum("__cell").over(ordered))
        .withColumn("__total", F.sum("__cell").over(per_key))
        .withColumn("__lo", F.floor(position) + 1)
        .withColumn("__hi", F.ceil(position) + 1)
        .withColumn("__frac", position - F.floor(position))
        .withColumn("__before", F.col("__cum") - F.col("__cell"))
        .filter(
            (F.col("__lo").between(F.col("__before") + 1, F.col("__cum")))
            | (F.col("__hi").between(F.col("__before") + 1, F.col("__cum")))
        )
        .select(*keys, "__c", "__f", "__before", "__lo", "__hi", "__frac")
    )
    on = [*keys, "__c", "__f"]
    seen = F.sum("__n").over(Window.partitionBy(*on).orderBy("__v")) + F.col("__before")
    ranked = (
        counted.join(targets, on)
        .withColumn("__seen", seen)
        .withColumn("__from", F.col("__seen") - F.col("__n") + 1)
    )
    holds = lambda rank: F.when(
        F.col(rank).between(F.col("__from"), F.col("__seen")), F.col("__v")
    )
    low, high, frac = F.col("__low"), F.col("__high"), F.col("__fr")
    picked = ranked.groupBy(*keys).agg(
        F.max(holds("__lo")).alias("__low"),
        F.max(holds("__hi")).alias("__high"),
        F.max("__frac").alias("__fr"),
    )
    value_at = F.when(frac == 0.5, (low + high) / 2).otherwise(low + (high - low) * frac)
    return picked.select(*keys, value_at.alias(out))
