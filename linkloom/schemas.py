"""Struct types from short texts, without a session."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType, "bigint": T.LongType, "long": T.LongType, "string": T.StringType, "boolean": T.BooleanType, "binary": T.BinaryType}


def struct(text: str) -> T.StructType:
    """Of name and simple kind, parted by commas."""
    return T.StructType([T.StructField(n, _KINDS[k]()) for n, k in (x.split() for x in text.split(","))])
