"""What a crawl may take: scope rules, robots.txt and budgets, as DataFrame predicates."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import url as U
from linkloom.functions.text import computed, human_size, let
from linkloom.functions.patterns import glob_match, needs_python, robots_matches, robots_specificity
from linkloom.operators.globs import first_glob
from linkloom.operators.robots import allowed_by_trie
from linkloom.session import cut

_SHARES = 16
#: Beyond so many globs they are sought by an automaton, and beyond so many rules of an origin by a join on their literals.
MANY_GLOBS, MANY_RULES = 32, 200


@dataclass(frozen=True)
class Scope:
    """The settings that decide what is taken."""

    primary: str = ""
    recursive: bool = True
    max_depth: int = 5
    same_origin: bool = True
    external_assets: bool = True
    download_assets: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    allow_private_hosts: bool = False
    respect_robots: bool = True
    max_files: int = 5000
    max_total_size: int = 2 << 30
    max_file_size: int = 64 << 20


def with_scope(rows: DataFrame, target: str, role: str, depth: str, s: Scope, out: str = "reason") -> DataFrame:
    """rows with why their target is out of scope; null if it is in.  Takes any patterns, and any number of them."""
    found = computed(rows, "_text", U.url_key(F.col(target)))
    if len(s.exclude) + len(s.include) > MANY_GLOBS:
        found = found.withColumns({"_excluded": first_glob(F.col("_text"), s.exclude), "_included": first_glob(F.col("_text"), s.include)})
        reason = scope_reason(F.col(target), F.col(role), F.col(depth), s, first=(F.col("_excluded"), F.col("_included")))
        return computed(found, out, reason).drop("_text", "_excluded", "_included")
    quirky = list(dict.fromkeys(p for p in (*s.exclude, *s.include) if needs_python(p)))
    matched = {p: f"_glob{k}" for k, p in enumerate(quirky)}
    found = found.withColumns({name: glob_match(p, F.col("_text")) for p, name in matched.items()}) if matched else found
    reason = scope_reason(F.col(target), F.col(role), F.col(depth), s, {p: F.col(name) for p, name in matched.items()})
    return computed(found, out, reason).drop("_text", *matched.values())


def scope_reason(target: Column, role: Column, depth: Column, s: Scope, matched: dict[str, Column] | None = None, first: tuple[Column, Column] | None = None) -> Column:
    """Why a target is out of scope, by the first rule that says so; null if it is in.

    matched: whether patterns match, for those with a single star after a doubled one; first: the first pattern of exclude and of
    include that matches.  with_scope() finds them.
    """
    matched = matched or {}
    home = U.parsed(s.primary)

    def of(t: Column) -> Column:
        return let(F.struct(U.url_key(t).alias("text"), F.coalesce(U.same_origin(t, home), F.lit(False)).alias("at_home")), lambda x: reason(t, x["text"], x["at_home"]))

    def reason(t: Column, text: Column, at_home: Column) -> Column:
        out = F.when(~U.is_http(t), "unsupported scheme")
        if not s.allow_private_hosts:
            out = out.when(U.is_private_host(t["host"]), "private or loopback host")
        if first is not None:
            out = out.when(first[0].isNotNull(), F.concat(F.lit("matched --exclude "), first[0]))
        for p in s.exclude if first is None else ():
            out = out.when(matched[p] if p in matched else glob_match(p, text), f"matched --exclude {p}")
        if s.include and first is not None:
            out = out.when(first[1].isNull(), "did not match any --include pattern")
        elif s.include:
            out = out.when(~F.greatest(*[matched[p] if p in matched else glob_match(p, text) for p in s.include], F.lit(False)), "did not match any --include pattern")
        page = role == "navigation"
        if not s.recursive:
            out = out.when(page & (depth > 0), "not recursing (use --recursive)")
        out = out.when(page & (depth > s.max_depth), "beyond --max-depth")
        if s.same_origin:
            out = out.when(page & ~at_home, "different origin")
        if not s.download_assets:
            out = out.when(~page, "--no-assets")
        if not s.external_assets:
            out = out.when(~page & ~at_home, "third-party asset")
        return out

    missing = [p for p in (*s.exclude, *s.include) if first is None and needs_python(p) and p not in matched]
    if missing:
        raise ValueError(f"patterns that with_scope() must match first: {missing}")
    return let(target, of)


def robots_allowed(rows: DataFrame, rules: DataFrame, origin: str = "origin", path: str = "path", out: str = "allowed", broadcast_rules: int = 100_000) -> DataFrame:
    """rows with whether robots rules (origin, pattern, allow) let their path (with its query) be fetched.

    The longest matching pattern decides, allow before disallow; without one all is allowed.  While no origin has over MANY_RULES, its rules are one
    array, so a row meets its own origin's rules only and is never repeated; beyond that paths meet rules by their literals (allowed_by_trie).
    Counted to be few the rules are broadcast; beyond that an origin with a third of all rows is dealt over shares.
    """
    most = rules.groupBy("origin").count().agg(F.max("count")).first()[0] or 0
    if most > MANY_RULES:
        return allowed_by_trie(rows, rules, origin, path, out, broadcast_rules)
    by_origin = rules.groupBy(F.col("origin").alias("_o")).agg(F.collect_list(F.struct("pattern", "allow")).alias("_rules"))
    p = F.when(F.col(path) == "", F.lit("/")).otherwise(F.col(path))
    hit = F.filter("_rules", lambda r: robots_matches(r["pattern"], p))
    best = F.array_max(F.transform(hit, lambda r: F.struct(robots_specificity(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    on = F.col(origin) == F.col("_o")
    if rules.count() <= broadcast_rules:
        joined = rows.join(F.broadcast(by_origin), on, "left")
    else:
        shares = by_origin.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))))
        joined = rows.withColumn("_own", F.pmod(F.xxhash64(path), F.lit(_SHARES)).cast("int")).join(shares, on & (F.col("_own") == F.col("_share")), "left").drop("_own", "_share")
    return joined.withColumn(out, F.coalesce(best["allow"], F.lit(True))).drop("_o", "_rules")


def within_budget(rows: DataFrame, size: str, order: list[str], s: Scope, partition: str | None = None, counts: Column | None = None) -> DataFrame:
    """rows with stop: null, or the budget that earlier rows have used up.  As if one worker took them in order.

    partition: the run that a row is of; without one all rows are one run, which is sorted over all tasks: each range adds the sums of
    those before it.  counts: whether a row counts as a file; sizes of others don't count either.
    """
    counts = F.lit(True) if counts is None else counts
    rows = rows.withColumns({"_file": counts.cast("long"), "_size": F.when(counts, F.col(size)).otherwise(0)})
    if partition:
        w, offset, offset_size = Window.partitionBy(partition), F.lit(0), F.lit(0)
    else:
        rows = cut(rows.orderBy(*order)).withColumn("_part", F.spark_partition_id())
        sums, files, total = [], 0, 0
        for r in sorted(rows.groupBy("_part").agg(F.sum("_file"), F.sum("_size")).collect()):  # a row for each range
            sums.append((r[0], files, total))
            files, total = files + r[1], total + r[2]
        starts = rows.sparkSession.createDataFrame(sums, "_of int, _files long, _total long")
        rows = rows.join(F.broadcast(starts), F.col("_part") == F.col("_of"))
        w, offset, offset_size = Window.partitionBy("_part"), F.col("_files"), F.col("_total")
    w = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = offset + F.coalesce(F.sum("_file").over(w), F.lit(0))
    size_before = offset_size + F.coalesce(F.sum("_size").over(w), F.lit(0))
    stop = F.when(before >= s.max_files, "max_files").when(size_before >= s.max_total_size, "max_total_size")
    return rows.withColumn("stop", stop).drop("_file", "_size", "_part", "_of", "_files", "_total")


def stop_message(stop: Column, s: Scope) -> Column:
    """What a run that stopped early says of it."""
    return F.when(stop == "max_files", f"reached --max-files ({s.max_files})").when(stop == "max_total_size", F.concat(F.lit("reached --max-total-size ("), human_size(F.lit(s.max_total_size)), F.lit(")")))


def from_config(text: str, s: Scope | None = None) -> Scope:
    """s, or the defaults, with the settings of a JSON object; unknown keys and values of another type are passed over."""
    try:
        found = json.loads(text.removeprefix("\ufeff"))
    except ValueError as e:
        raise ValueError("the configuration is not valid JSON") from e
    if not isinstance(found, dict):
        raise ValueError("the configuration must be a JSON object")
    s = s or Scope()
    taken = {}
    for key, value in found.items():
        now = getattr(s, key, None)
        if isinstance(now, bool) and isinstance(value, bool):
            taken[key] = value
        elif isinstance(now, int) and not isinstance(now, bool) and isinstance(value, (int, float)) and not isinstance(value, bool) and value >= 0:
            taken[key] = int(value)
        elif isinstance(now, str) and isinstance(value, str):
            taken[key] = value
        elif isinstance(now, tuple) and isinstance(value, list) and all(isinstance(v, str) for v in value):
            taken[key] = tuple(value)
    return replace(s, **taken)
