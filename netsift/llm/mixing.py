"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Each source's documents are shuffled by a hash. A document's virtual finish time is the number of
words its source has given out up to and including it, divided by the source's target; the mix is the
global order of these times, and it ends where the total budget is used up. Because the targets add up to
the budget, and a queue's words flow evenly in virtual time, that is the moment 1: at it each source has
given out exactly its target. The document in service then is cut there (``taken`` counts words), and a
source whose target is above its size starts a second pass at virtual time size / target.

Targets: the budget is ``budget`` times all words, shared by weight; a source stops at ``repeat`` times its
own words and the excess is shared by weight again until none is above (solved in closed form over the
sources ordered by the level at which each is full).

Running totals inside a source use nested ranges of the shuffle hash, 2^10 and 2^20 per source, so a
source with a third of all rows is many tasks: only rows of one range are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import free_name, n_words
from netsift.session import materialize

WEIGHTS, BUDGET, REPEAT, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 17


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    repeat: float = REPEAT,
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source, null being one.

    Weights go round the sources by code point, null last. The windows see one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    rank = (F.row_number().over(order) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    full = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(repeat)))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("given", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("busy", F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
    # words per unit of weight if all sources before this one are full and this one is not
    s = s.withColumn("level", (F.col("total") - F.col("given")) / F.col("busy"))
    s = s.withColumn("place", F.row_number().over(full))
    open_ = F.col("level") * F.col("weight") <= F.col("limit")
    first = F.min(F.when(open_, F.struct("place", "level"))).over(everything)
    s = s.withColumn("level", first["level"])
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def _share(done: Column, size: Column, target: Column) -> Column:
    """Words of a document served before virtual time 1 when ``done`` words went before it."""
    return F.greatest(F.lit(0), F.least(size, F.floor(target + F.lit(1e-6)) - done))


def mixed(
    documents: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    repeat: float = REPEAT,
    seed: int = SEED,
) -> DataFrame:
    """Per row of ``documents`` (doc_id, text, source): doc_id, source, size, source_size, target,
    finish (virtual finish time of its first pass, null for a source without words) and taken.

    Null text has size 0. Null is a source like any other, and a null doc_id is a document. Rows equal in
    doc_id, source and size are interchangeable, so reruns agree. An empty table gives an empty result.
    """
    slim = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    named = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"))
    h = F.conv(F.substring(F.md5(named), 1, 10), 16, 10).cast("long")
    slim = materialize(slim.withColumn("h", h), "mix-sizes")
    fine = slim.withColumn("coarse", F.shiftright("h", 30)).withColumn("range", F.shiftright("h", 20))
    inner = fine.groupBy("source", "coarse", "range").agg(F.sum("size").alias("words"))
    inner = materialize(inner, "mix-ranges")
    outer = inner.groupBy("source", "coarse").agg(F.sum("words").alias("words"))
    sizes = outer.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, budget, repeat), "mix-targets")

    def before(df: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum("words").over(w), F.lit(0)))

    base = before(outer, ["source"], "coarse", "base").drop("words")
    within = before(inner, ["source", "coarse"], "range", "inside").drop("words")
    ranges = within.join(base.withColumnRenamed("source", "s0").withColumnRenamed("coarse", "c0"), F.col("source").eqNullSafe(F.col("s0")) & (F.col("coarse") == F.col("c0")))
    ranges = ranges.join(targets.withColumnRenamed("source", "t0"), F.col("source").eqNullSafe(F.col("t0")))
    ranges = ranges.select(
        F.col("source").alias("r_source"), F.col("range").alias("r_range"), "source_size", "target",
        (F.col("base") + F.col("inside")).alias("offset"),
    )
    w = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = fine.withColumn("ahead", F.coalesce(F.sum("size").over(w), F.lit(0)))
    # the join follows the window on the same keys
    queued = queued.join(
        ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range"))
    ).withColumn("ahead", F.col("ahead") + F.col("offset"))
    first = _share(F.col("ahead"), F.col("size"), F.col("target"))
    again = _share(F.col("ahead") + F.col("source_size"), F.col("size"), F.col("target"))
    return queued.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.when(F.col("target") > 0, (F.col("ahead") + F.col("size")) / F.col("target")).alias("finish"),
        (first + again).cast("long").alias("taken"),
    )


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``documents`` with the same columns, range-sorted by virtual finish
    time, a document of a second pass coming again. A document cut by the end of the budget comes whole
    if half of it or more is inside, so texts are never cut. Rows without words are not in the mix. Rows
    equal in doc_id, source and size are taken as often as the one of them taken most."""
    names = documents.columns
    key, origin, size, copies, finish, turn = (
        free_name(c, names) for c in ("mix_key", "mix_origin", "mix_size", "mix_copies", "mix_finish", "mix_turn")
    )
    plan = mixed(documents, **how).where("taken > 0").groupBy(
        F.col("doc_id").alias(key), F.col("source").alias(origin), F.col("size").alias(size)
    ).agg(
        F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias(copies),
        F.min("finish").alias(finish),
        F.min(F.col("source_size") / F.col("target")).alias(turn),
    )
    plan = materialize(plan.where(F.col(copies) > 0), "mix-plan")
    match = (
        F.col("doc_id").eqNullSafe(F.col(key))
        & F.col("source").eqNullSafe(F.col(origin))
        & (n_words(F.col("text")) == F.col(size))
    )
    passes = F.transform(F.sequence(F.lit(0), F.col(copies) - 1), lambda k: F.col(finish) + k * F.col(turn))
    rows = documents.join(plan, match).withColumn(finish, F.explode(passes))
    return rows.repartitionByRange(finish, key).sortWithinPartitions(finish, key).select(*names)
