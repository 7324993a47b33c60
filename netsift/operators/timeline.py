"""Gaps and sessions along time, split into time chunks so that one busy key is many tasks.

A window over a key alone would pull a hot key into one task. Rows are therefore ordered only
inside ``(key, chunk)``; the edges of chunks are linked over the chunk summaries, whose number per
key depends on the time span and not on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_US = 60_000_000


def _chunk(ts: str, chunk_us: int) -> Column:
    return F.floor(F.col(ts) / chunk_us)


def _linked_gaps(rows: DataFrame, keys: list[str], ts: str, chunk_us: int):
    """Distinct times with the gap inside their chunk, and chunk summaries with the edge gap."""
    on = [*keys, "__chunk"]
    times = (
        rows.withColumn("__chunk", _chunk(ts, chunk_us))
        .groupBy(*on, ts)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__gap", F.col(ts) - F.lag(ts).over(Window.partitionBy(*on).orderBy(ts)))
    )
    seconds = F.col("__gap") / 1e6
    chunks = (
        times.groupBy(*on)
        .agg(
            F.sum("__n").alias("__rows"),
            F.min(ts).alias("__first"),
            F.max(ts).alias("__last"),
            F.sum(seconds * seconds).alias("__sq"),
        )
        .withColumn(
            "__edge",
            F.col("__first")
            - F.lag("__last").over(Window.partitionBy(*keys).orderBy("__chunk")),
        )
    )
    return times, chunks


def interval_moments(
    rows: DataFrame, keys: list[str], ts: str = "ts_us", chunk_us: int = CHUNK_US
) -> DataFrame:
    """Per key: rows, first, last, mean interval (s) and its population CV, repeats included."""
    _, chunks = _linked_gaps(rows, keys, ts, chunk_us)
    edge = F.col("__edge") / 1e6
    span = (F.col("last_us") - F.col("first_us")) / 1e6
    m = F.col("n") - 1
    out = chunks.groupBy(*keys).agg(
        F.sum("__rows").alias("n"),
        F.min("__first").alias("first_us"),
        F.max("__last").alias("last_us"),
        F.sum(F.coalesce("__sq", F.lit(0.0)) + F.coalesce(edge * edge, F.lit(0.0))).alias("__s"),
    )
    mean = F.try_divide(span, m)
    variance = F.greatest(F.try_divide(F.col("__s"), m) - mean * mean, F.lit(0.0))
    return out.withColumn("mean_interval", mean).withColumn(
        "interval_cv", F.try_divide(F.sqrt(variance), mean)
    ).drop("__s")


def distinct_gaps(
    rows: DataFrame, keys: list[str], ts: str = "ts_us", chunk_us: int = CHUNK_US
) -> DataFrame:
    """One row per gap (µs) between neighbouring distinct times of a key."""
    times, chunks = _linked_gaps(rows, keys, ts, chunk_us)
    inner = times.select(*keys, F.col("__gap").alias("gap_us"))
    edges = chunks.select(*keys, F.col("__edge").alias("gap_us"))
    return inner.unionByName(edges).filter(F.col("gap_us").isNotNull())


def sessions(
    rows: DataFrame,
    keys: list[str],
    aggregates: dict[str, tuple[Column, str]],
    *,
    idle_us: int,
    ts: str = "ts_us",
    end: str | None = None,
    split_at_equal: bool = False,
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """Aggregate the rows of each session of a key; ``session_no`` counts from 0 in time order.

    A row opens a session when it starts more than ``idle_us`` after the latest end seen so far
    (at exactly ``idle_us`` too with ``split_at_equal``). Rows are first cut into pieces inside
    their time chunk and reduced to one row per piece; a piece that no earlier end is far enough
    from joins the session before it. Rows are shuffled once, pieces once.

    ``aggregates`` maps a name to its aggregate over rows and how pieces combine it
    (``sum``, ``min`` or ``max``). ``first_us`` and ``end_us`` are always returned.
    """
    end = end or ts
    on = [*keys, "__chunk"]
    apart = (lambda gap: gap >= idle_us) if split_at_equal else (lambda gap: gap > idle_us)
    order = Window.partitionBy(*on).orderBy(ts)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        rows.withColumn("__chunk", _chunk(ts, chunk_us))
        .withColumn("__gap", F.col(ts) - F.max(end).over(before))
        .withColumn("__piece", F.sum(F.when(apart(F.col("__gap")), 1).otherwise(0)).over(so_far))
        .groupBy(*on, "__piece")
        .agg(
            F.min(ts).alias("first_us"),
            F.max(end).alias("end_us"),
            *[agg.alias(name) for name, (agg, _) in aggregates.items()],
        )
    )
    order = Window.partitionBy(*keys).orderBy("first_us")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    return (
        pieces.withColumn("__gap", F.col("first_us") - F.max("end_us").over(before))
        .withColumn("session_no", F.sum(F.when(apart(F.col("__gap")), 1).otherwise(0)).over(so_far))
        .groupBy(*keys, "session_no")
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("end_us").alias("end_us"),
            *[merge[how](name).alias(name) for name, (_, how) in aggregates.items()],
        )
    )
