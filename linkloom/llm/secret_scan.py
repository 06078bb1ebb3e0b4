"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are found in each whole text, leftmost and non-overlapping for each kind; matches that
fail a kind's test are dropped after they have taken their place.  Starts come from the pieces between
matches, so spans are in code points.

The method adds weak candidates: access identifiers, secrets and endpoints that prove nothing alone.
They are interval-joined within scopes, stretches of half of scope_chars: a weak candidate is in each scope that
it touches and the others in each that they touch when widened by that half on both sides, so that two spans whose
distance is at most half of scope_chars share a scope, however long they are; a weak candidate is reported when spans of
complementary parts lie within that distance: an identifier or endpoint needs a secret, a secret needs an identifier.
Base spans take part as strong identifiers (access) and secrets (assign, hex).

Only spans are shuffled for that, never texts, keyed by doc_id, a hash of the text and the scope.  A scope
is touched by at most 3 / 2 scope_chars spans a kind, whatever the corpus; a span is in as many scopes as its length asks.

Defined cases: a null text is empty; repeated rows are each reported; a null doc_id is a value like any other;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import let
from linkloom.session import cut

# The base kinds, in the order in which spans with one start are listed.
BASE = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs that fall short can't hold a longer match, so the least lengths stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

# The weak kinds, and the part each plays.
WEAK_ID = r"(?:(?i:client|user|account|key|app)_?(?i:id|name))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=_-])"
WEAK_ENDPOINT = r"(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|sftp|ftp)://[A-Za-z0-9._~:/?@%=&-]{4,}"
PART = {"access": "id", "weak_id": "id", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "endpoint"}


@dataclass(frozen=True)
class Scan:
    scope_chars: int = 512


def _running(steps: Column, at: Column) -> Column:
    """The array of (start, end) of steps (gap before a match, its length n) from a position on."""
    zero = F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def _positions(steps: Column) -> Column:
    """_running() from 0 on, in chunks of as many steps as there are chunks, as each step copies what its chunk has so far."""

    def chunked(s: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(s))).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(s), size), lambda i: F.slice(s, i, size))
        return let(parts, placed)

    def placed(parts: Column) -> Column:
        steps_of = F.transform(parts, lambda c: F.struct(F.lit(0).alias("gap"), F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["n"]).alias("n")))
        return F.flatten(F.zip_with(parts, _running(steps_of, F.lit(0)), lambda c, o: _running(c, o["start"])))

    return let(steps, lambda s: F.when(F.size(s) > 0, chunked(s)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))


def spans_of(text: Column, pattern: str, kind: str, guard: Column, ok=None) -> Column:
    """The array of (start, end, kind) of a pattern's matches, of which ok, if given, judges the matched strings."""

    def made(found: Column) -> Column:
        # The pieces around the matches; the lengths before a match give its start.
        lengths = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.transform(F.arrays_zip(F.slice(lengths, 1, F.size(found)).alias("gap"), found.alias("m")), lambda x: F.struct(x["gap"].alias("gap"), F.length(x["m"]).alias("n")))
        where = _positions(steps)
        if ok is not None:
            where = F.transform(F.filter(F.arrays_zip(where.alias("w"), found.alias("m")), lambda x: ok(x["m"])), lambda x: x["w"])
        return F.transform(where, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(guard, let(found, made)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def base_spans(text: Column) -> dict[str, Column]:
    # A cheap test first: most texts hold no keyword, and the patterns are not tried on them.
    low = F.lower(text)
    keyword = F.contains(low, F.lit("pass")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("key"))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    return {
        "assign": spans_of(text, ASSIGN, "assign", keyword & text.rlike(ASSIGN), value),
        "access": spans_of(text, ACCESS, "access", F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS)),
        "hex": spans_of(text, HEX, "hex", text.rlike(HEX)),
    }


def weak_spans(text: Column) -> dict[str, Column]:
    return {
        "weak_id": spans_of(text, WEAK_ID, "weak_id", text.rlike(r"(?i:id|name)[\"']?\x20*[:=]")),
        "weak_secret": spans_of(text, WEAK_SECRET, "weak_secret", text.rlike(r"[A-Za-z0-9+/]{32}")),
        "endpoint": spans_of(text, WEAK_ENDPOINT, "endpoint", F.contains(text, F.lit("://"))),
    }


def listed(spans: Column) -> Column:
    """kind:start:end of each span by start, then base kinds as listed, joined by commas."""
    rank = lambda kind: F.array_position(F.array(*[F.lit(k) for k in (*BASE, "weak_id", "weak_secret", "endpoint")]), kind)
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(spans: DataFrame, s: Scan = Scan()) -> DataFrame:
    """Of (doc_id, text_hash, start, end, kind) rows, the weak ones with complementary parts near, once each."""
    half = s.scope_chars // 2
    part = F.coalesce(*[F.when(F.col("kind") == k, F.lit(p)) for k, p in PART.items()])
    x = spans.withColumn("part", part)
    # Of two spans at most half apart, the one widened by half meets the other, so both touch the scope where they meet.
    touched = lambda by: F.explode(F.sequence(F.floor((F.col("start") - by) / half), F.floor((F.col("end") + by) / half)))
    scoped = x.withColumn("scope", touched(half))
    key = ["doc_id", "text_hash", "scope"]
    weak = x.where(F.col("kind").isin("weak_id", "weak_secret", "endpoint")).withColumn("scope", touched(0)).alias("w")
    other = scoped.select(*key, F.col("part").alias("o_part"), F.col("start").alias("o_start"), F.col("end").alias("o_end")).where(F.col("o_part") != "endpoint").alias("o")
    near = (F.col("o_start") - F.col("end") <= half) & (F.col("start") - F.col("o_end") <= half)
    fits = F.when(F.col("part") == "secret", F.col("o_part") == "id").otherwise(F.col("o_part") == "secret")
    apart = (F.col("o_start") >= F.col("end")) | (F.col("start") >= F.col("o_end"))
    on = F.col("w.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("w.text_hash") == F.col("o.text_hash")) & (F.col("w.scope") == F.col("o.scope")) & near & fits & apart
    return weak.join(other, on, "left_semi").select("doc_id", "text_hash", F.struct("start", "end", "kind").alias("span")).distinct()


def find_secrets(docs: DataFrame, s: Scan = Scan()) -> DataFrame:
    """doc_id, base (spans of the base kinds) and added (weak spans that the linking reports) of each document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    b, w = base_spans(F.col("text")), weak_spans(F.col("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), *[c.alias(k) for k, c in b.items()], *[c.alias(k) for k, c in w.items()])
    rows = cut(rows.select("doc_id", "text_hash", F.concat(*b).alias("base"), F.concat(*w).alias("weak")))  # read thrice below; holds no text
    both = rows.where(F.size("weak") > 0).select("doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("span")).select("doc_id", "text_hash", "span.*").distinct()
    added = linked(both, s).groupBy(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_hash")).agg(F.collect_list("span").alias("added"))
    out = rows.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash")), "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return out.select("doc_id", "base", F.coalesce("added", none).alias("added"))


def secrets(docs: DataFrame, s: Scan = Scan()) -> DataFrame:
    """doc_id, the counts of base spans, the digest of their list, and the list of all spans."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return find_secrets(docs, s).select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
    )
