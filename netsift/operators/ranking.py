"""Exact positions in a global order without a window over all rows.

Rows are dealt into ranges of the order by sampled bounds (Spark's range partitioning), sorted inside their
range and numbered where they lie. Rows are counted per range, and a range's offset is what the ranges before
it hold, so only one number per range leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.session import materialize

#: ``monotonically_increasing_id`` keeps the place inside a partition in the bits below.
PLACE_BITS = 33


def with_position(df: DataFrame, order: Sequence[str | Column], out: str = "position", ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``, the place of each row from 1 in ``order``.

    Rows equal in ``order`` share a range, in any order among themselves, so the order should end with a
    column that tells rows apart. ``ranges`` (the shuffle partitions of the session, if unset) bounds what
    goes through the driver. The numbered rows are stored, so later reads see the same positions. Nulls come
    first in ascending and last in descending order, as in Spark's sorts. An empty table stays empty."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__at", PLACE_BITS)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    before = [0, *accumulate(r["count"] for r in sizes)]
    offsets = spark.createDataFrame(
        [(r["part"], b) for r, b in zip(sizes, before, strict=False)], "__part bigint, __before bigint"
    )
    place = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    # one row per range
    numbered = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(out, F.col("__before") + place + 1).drop("__at", "__part", "__before")
