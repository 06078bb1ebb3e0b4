"""robots.txt rules as a trie join: a path meets only the rules whose literal beginning or end is its own.

A rule is keyed by the text before its first star, or, where that is shorter, by the text after its last one, which ends
the path as patterns with a star or `$` match whole paths.  A path is taken apart at those lengths only that keys of its origin have.  Keys are joined by hash, pairs
verified against the whole pattern, and the longest pattern wins, allow before disallow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.patterns import robots_matches, robots_specificity

_SHARES = 16


def _keys(pattern: Column) -> tuple[Column, Column]:
    """The literals that begin and end all paths that a pattern matches; the end is empty for plain prefixes."""
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    whole = anchored | F.contains(pattern, F.lit("*"))
    return F.substring_index(body, "*", 1), F.when(whole, F.substring_index(body, "*", -1)).otherwise("")


def keyed_rules(rules: DataFrame) -> DataFrame:
    """origin, pattern and allow with end (whether the key is the path's end), n (its length) and key."""
    begin, end = _keys(F.col("pattern"))
    by_end = F.length(end) > F.length(begin)
    keyed = rules.where("pattern != ''").select("origin", "pattern", "allow", by_end.alias("end"), F.when(by_end, end).otherwise(begin).alias("key"))
    return keyed.groupBy("origin", "pattern", "end", "key").agg(F.max("allow").alias("allow")).withColumn("n", F.length("key"))


def allowed_by_trie(rows: DataFrame, rules: DataFrame, origin: str = "origin", path: str = "path", out: str = "allowed", broadcast_rules: int = 100_000) -> DataFrame:
    """As scope.robots_allowed(), for origins with any number of rules.

    Each distinct path is tested once.  Rules counted to be few are broadcast; beyond that keys are dealt over shares, so one that a third of all
    paths begin with is not one task's.  Patterns with a star at both ends are held against all paths of their origin.
    """
    p = F.when(F.col(path) == "", F.lit("/")).otherwise(F.col(path))
    tested = rows.select(F.col(origin).alias("_o"), p.alias("_p")).where("_o is not null and _p is not null").distinct()
    keyed = keyed_rules(rules)
    lengths = keyed.groupBy(F.col("origin").alias("_o")).agg(F.collect_set(F.struct("end", "n")).alias("_lengths"))
    few = rules.count() <= broadcast_rules
    dealt = tested.withColumn("_share", F.lit(0) if few else F.pmod(F.xxhash64("_p"), F.lit(_SHARES)).cast("int"))
    shares = F.array(*[F.lit(k) for k in range(1 if few else _SHARES)])
    hint = F.broadcast if few else lambda df: df
    cut = dealt.join(hint(lengths.withColumn("_share", F.explode(shares))), ["_o", "_share"])
    fits = F.filter("_lengths", lambda x: x["n"] <= F.length("_p"))
    cut = cut.select("_o", "_p", "_share", F.explode(fits).alias("_x"))
    key = F.when(F.col("_x.end"), F.expr("right(_p, _x.n)")).otherwise(F.expr("left(_p, _x.n)"))
    cut = cut.select("_o", "_p", "_share", F.xxhash64("_o", F.col("_x.end"), key).alias("_h"))
    hashed = keyed.select("origin", "pattern", "allow", F.xxhash64("origin", "end", "key").alias("_h"), F.explode(shares).alias("_share"))
    met = cut.join(hint(hashed), ["_h", "_share"]).where((F.col("_o") == F.col("origin")) & robots_matches(F.col("pattern"), F.col("_p")))
    best = met.groupBy("_o", "_p").agg(F.max(F.struct(robots_specificity(F.col("pattern")).alias("n"), F.col("allow").alias("allow"))).alias("_best"))
    told = rows.withColumn("_path", p).join(best, (F.col(origin) == F.col("_o")) & (F.col("_path") == F.col("_p")), "left")
    return told.withColumn(out, F.coalesce("_best.allow", F.lit(True))).drop("_path", "_o", "_p", "_best")
