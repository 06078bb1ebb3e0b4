"""Connected components by repeated contraction, without collecting any part of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of the edges a - b; root: the same for all vertices of a component.

    In a round each vertex is merged into its least neighbour, or itself; ids must be hashes, so that a
    constant share of the vertices goes away in a round.  Minima are summed up before the
    shuffle; the joins leave skew to adaptive execution.

    Defined cases: loops (a = b) and repeated edges count for nothing, so a vertex with loops alone is not listed; edges with a
    null end are left out; no edges give no rows; further columns are ignored.
    """
    both = edges.where("a != b").select("a", "b")
    e = cut(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    steps = []
    while not e.isEmpty():
        step = cut(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        steps.append(step)
        left, right = step.select("a", F.col("m").alias("ma")), step.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        e = cut(e.join(left, "a").join(right, "b").where("ma != mb").select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct())
    if not steps:
        return both.select(F.col("a").alias("vertex"), F.col("b").alias("root")).limit(0)
    out = steps[0].select(F.col("a").alias("vertex"), F.col("m").alias("root"))
    for step in steps[1:]:
        nxt = step.select(F.col("a").alias("root"), F.col("m"))
        out = out.join(nxt, "root", "left").select("vertex", F.coalesce("m", "root").alias("root"))
    return cut(out)
