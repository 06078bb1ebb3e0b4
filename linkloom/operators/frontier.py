"""The crawl frontier: breadth first over a table of edges, to a fixpoint.

Each round joins the last arrivals to the edges, keeps the first arrival of each URL and drops those seen before.  A round's arrivals
are cut with checkpoint(), whose files are shared, so a lost executor costs a read and not the whole history; what was seen is
the union of the rounds, and is never written again but when they have become many.  Beyond some size a round meets it through
a Bloom filter (see seen).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.seen import Seen
from linkloom.session import cut


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int = 5, max_rounds: int = 10_000, filter_from: int = 1_000_000) -> DataFrame:
    """url, depth, parent, role, round and reason of all that seeds (url) reach over edges (src, dst, role, pos).

    Navigation adds 1 to the depth; assets stay at their page's depth, so they are taken to a
    fixpoint before the next depth begins.  Of several arrivals in a round the one with the least (depth, parent, pos) counts.
    Edges may have reason, why their target is refused, and if_role, the role that their source must have been reached in.
    Seeds may have a reason as well.  What is refused, or beyond max_depth (reason "beyond --max-depth"), arrives but leads no further.
    From filter_from URLs on what was seen is met through a filter.
    """
    given = {c: F.col(c) if c in edges.columns else F.lit(None).cast("string") for c in ("reason", "if_role")}
    links = edges.select("src", "dst", "role", "pos", *[c.alias(k) for k, c in given.items()])
    assets, pages = links.where("role != 'navigation'"), links.where("role = 'navigation'")
    none = F.lit(None).cast("string")
    refused = F.col("reason") if "reason" in seeds.columns else none.alias("reason")
    start = seeds.select("url", F.lit(0).alias("depth"), none.alias("parent"), F.lit("navigation").alias("role"), F.lit(0).alias("round"), refused)
    first = cut(start.dropDuplicates(["url"]))
    seen = Seen(first, filter_from)
    fresh, here = first, [first]
    for k in range(1, max_rounds):
        if fresh is not None:  # the closure over assets at this depth
            arrived = _arrivals(fresh, assets, 0, seen, k, max_depth)
            fresh = arrived if seen.add(arrived) else None
            here.append(arrived)
        else:
            arrived = _arrivals(_union(here), pages, 1, seen, k, max_depth)
            if not seen.add(arrived):
                return seen.table()
            fresh, here = arrived, [arrived]
    raise RuntimeError("the frontier did not end")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _arrivals(frontier: DataFrame, links: DataFrame, step: int, seen: Seen, k: int, max_depth: int) -> DataFrame:
    open_rows = frontier.where("reason is null").select("url", "depth", F.col("role").alias("_role"))
    on = (F.col("url") == F.col("src")) & (F.col("if_role").isNull() | (F.col("if_role") == F.col("_role")))
    reached = open_rows.join(links, on).select(F.col("dst").alias("url"), (F.col("depth") + step).alias("depth"), F.col("src").alias("parent"), "pos", "role", "reason")
    # min() sums up before the shuffle, so a page that all others link to is no hot key.
    first = reached.groupBy("url").agg(F.min(F.struct("depth", "parent", "pos", "role", "reason")).alias("f")).select("url", "f.depth", "f.parent", "f.role", "f.reason")
    beyond = F.when((F.col("role") == "navigation") & (F.col("depth") > max_depth), "beyond --max-depth")
    new = seen.new(first).withColumns({"round": F.lit(k), "reason": F.coalesce("reason", beyond)})
    return cut(new.select("url", "depth", "parent", "role", "round", "reason"))
