"""Connected components of an edge table by alternating star contraction.

``large star`` links every larger neighbour of a node to the smallest node of its neighbourhood,
``small star`` does the same for the smaller ones; both keep connectivity, and alternating them ends
in stars around the smallest node of each component after O(log^2 n) rounds (a few for shallow
graphs). Every round is two joins whose hub side is salted, the edge list of a round never outgrows
the input, and each round is stored in the shared folder, so plans stay small and a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import salted_join
from netsift.session import materialize


def _neighbourhood_minimum(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with m, the smallest node among u and all its v; a hub is dealt over salts."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return salted_join(arcs, least, ["u"], "v").select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (
        _neighbourhood_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    large = large.where("u <> v").distinct()
    # every arc of ``large`` runs from the larger node to the smaller one
    star = _neighbourhood_minimum(large)
    moved = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        star.select("u", F.col("m").alias("v"))
    )
    return moved.where("u <> v").distinct().select(F.col("v").alias("a"), F.col("u").alias("b"))


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of one type), component being the
    smallest node of it. Loops and edges with a null end are left out; repeated edges do no harm;
    an empty table gives an empty result."""
    a, b = edges.columns[:2]
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    current = materialize(pairs.distinct(), "arcs")
    before = _state(current)
    while before[0]:
        current = materialize(_round(current), "arcs")
        after = _state(current)
        if after == before:
            break
        before = after
    members = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
