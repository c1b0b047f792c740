"""Connected components of an edge table, by alternating stars.

Each round rewires every edge towards the smallest neighbour (large star, then
small star); components become stars in a logarithmic number of rounds.  The
edge table is written to the shared folder each round, so the plan stays short
and a lost executor costs one round.  Minima are combined before the shuffle
and a hub's edges are split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour.  Written, so that the join with the edges
    has nothing but a shuffle on either side, and a hub's edges can be split."""
    return written(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = _least(both)
    return (both.where("b > a").join(least, F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.least("m", "u").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    rest = (edges.join(least, F.col("a") == F.col("u")).where("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return rest.union(least.select("u", "m")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to a smaller one; ``root`` is
    the component's smallest node.  ``edges``: two long columns, any direction."""
    a, b = edges.columns
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                  .where("a != b").distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = written(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
