"""JSON texts: strict parsing, and typed access with a fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.text import let

MAX_DEPTH = 100  # fixed value


def _depth(text: Column) -> Column:
    """The deepest nesting of arrays and objects."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(marks, ""), start, step, lambda acc: acc["most"])


def parse(text: Column) -> Column:
    """The text without a leading byte order mark if it is one valid JSON value of at most MAX_DEPTH levels, else null.

    Accessors below read from it; of keys that repeat in an object the last counts.
    """

    def of(t: Column) -> Column:
        inner = F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string, _corrupt_record string")
        alone = F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))).eqNullSafe(F.lit(1))
        return F.when(inner["_corrupt_record"].isNull() & (F.trim(t) != "") & alone & (_depth(t) <= MAX_DEPTH), t)

    return let(F.regexp_replace(text, "^﻿", ""), of)


def _at(json: Column, keys: tuple[str, ...], kind: str) -> Column:
    schema = kind
    for k in reversed(keys):
        schema = f"struct<`{k}`:{schema}>"
    found = F.from_json(json, schema)
    for k in keys:
        found = found[k]
    return found


def text_at(json: Column, *keys: str, otherwise: str = "") -> Column:
    """The string under the keys; otherwise without one, or where it is of another type."""
    value = _at(json, keys, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(otherwise))).otherwise(F.lit(otherwise))


def number_at(json: Column, *keys: str, otherwise: float = 0.0) -> Column:
    """The number under the keys; otherwise without one, or where it is of another type."""
    return F.coalesce(_at(json, keys, "double"), F.lit(float(otherwise)))


def flag_at(json: Column, *keys: str, otherwise: bool = False) -> Column:
    """The boolean under the keys; otherwise without one, or where it is of another type."""
    return F.coalesce(_at(json, keys, "boolean"), F.lit(otherwise))


def contains(json: Column, *keys: str) -> Column:
    """Whether the object under all keys but the last has the last."""
    raw = F.get_json_object(json, "$" + "".join(f"['{k}']" for k in keys[:-1]))
    return F.coalesce(F.array_contains(F.json_object_keys(raw), keys[-1]), F.lit(False))
