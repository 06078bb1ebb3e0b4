"""Strings, sizes, durations, hashes and dates as Column expressions.

Case folding is that of ASCII alone, and white space is the six ASCII characters: Spark's own lower() and trim()
do more and less.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \t\r\n\f\x0b"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row, here.

    Spark would put the expression in wherever the column is read, filters included; a generator of one row stops that.
    """
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def to_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def to_upper(s: Column) -> Column:
    return F.translate(s, _LOWER, _UPPER)


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACE))


def iequals(a: Column, b: Column) -> Column:
    return to_lower(a) == to_lower(b)


def istarts_with(s: Column, prefix: Column) -> Column:
    return F.startswith(to_lower(s), to_lower(prefix))


def iends_with(s: Column, suffix: Column) -> Column:
    return F.endswith(to_lower(s), to_lower(suffix))


def split_on(s: Column, separator: str, keep_empty: bool = True) -> Column:
    """Parts between single separator characters."""
    parts = F.split(s, f"[{separator}]" if separator not in "^\\]" else f"\\{separator}", -1)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def replace_all(s: Column, old: Column, new: Column) -> Column:
    return F.replace(s, old, new)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def percent_encode(s: Column, extra_safe: str = "") -> Column:
    """Bytes other than letters, digits, - _ . ~ and the extra ones as %XX."""
    safe = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~" + extra_safe
    pairs = F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    allowed = F.create_map(*[F.lit(x) for c in dict.fromkeys(safe) for x in (f"{ord(c):02X}", c)])
    return F.array_join(F.transform(pairs, lambda p: F.coalesce(F.try_element_at(allowed, p), F.concat(F.lit("%"), p))), "")


def percent_decode(s: Column) -> Column:
    """%XX as bytes; anything else, + included, stays.  Bytes that are not UTF-8 become U+FFFD."""
    hexed = lambda x: F.hex(F.encode(x, "UTF-8"))
    parts = F.split(s, "%", -1)
    rest = F.transform(
        F.slice(parts, 2, 1 << 30),
        lambda x: F.when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.substring(x, 1, 2), hexed(F.substring(x, 3, 1 << 30)))).otherwise(F.concat(F.lit("25"), hexed(x))),
    )
    return F.make_valid_utf8(F.unhex(F.concat(hexed(F.element_at(parts, 1)), F.array_join(rest, ""))).cast("string"))


def _quantity(text: Column, units: dict[str, float]) -> Column:
    """A number with a unit, cut to a whole of the least unit; null if it is neither."""
    t = trim(text)
    digits = F.regexp_extract(t, r"^([0-9.]+)", 1)
    # As much of the digits as forms a number: 1.2.3 counts as 1.2.
    value = F.regexp_extract(digits, r"^([0-9]*\.?[0-9]*)", 1)
    unit = to_lower(trim(F.regexp_replace(t, r"^[0-9.]+", "")))
    factor = F.try_element_at(F.create_map(*[F.lit(x) for k, v in units.items() for x in (k, float(v))]), unit)
    amount = F.when(value.isin("", "."), F.lit(0.0)).otherwise(value.cast("double"))
    return F.when(digits != "", F.floor(amount * factor).cast("long"))


_SIZES = {u: 1024.0**k for k, us in enumerate((("", "b"), ("k", "kb", "kib"), ("m", "mb", "mib"), ("g", "gb", "gib"), ("t", "tb", "tib"))) for u in us}
_DURATIONS = {"ms": 1.0, "": 1000.0, "s": 1000.0, "sec": 1000.0, "m": 60000.0, "min": 60000.0, "h": 3600000.0, "hr": 3600000.0}


def parse_size(text: Column) -> Column:
    """Bytes of a size such as 1.5k or 2 MiB; null if it is none."""
    return _quantity(text, _SIZES)


def parse_duration_ms(text: Column) -> Column:
    """Milliseconds of a duration such as 30, 1.5s or 2m; null if it is none."""
    return _quantity(text, _DURATIONS)


def human_size(n: Column) -> Column:
    """B to TB with one decimal, rounded half to even: a quotient by a power of 1024 is exact in binary."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scaled = F.format_string("%.1f", F.bround(n.cast("double") / float(1024**k), 1))
        out = F.when(n >= 1024**k, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def human_duration_ms(ms: pd.Series) -> pd.Series:
    """Nms, N.Ns or Nm Ns; one decimal as C prints it, which Java doesn't."""

    def one(x: float) -> str | None:
        if pd.isna(x):
            return None
        x = int(x)
        return f"{x}ms" if x < 1000 else f"{x / 1000:.1f}s" if x < 60000 else f"{x // 60000}m {x // 1000 % 60}s"

    return ms.map(one)


def short_hash(s: Column) -> Column:
    """The low 32 bits of a 64-bit FNV-1a with its own offset basis, as eight hex digits.

    Only the low half of basis and prime reach the low half of the product, so a fold in 64 bits can't overflow.
    """
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0)), lambda p: F.conv(p, 16, 10).cast("long"))
    basis = 1469598103934665603 & 0xFFFFFFFF  # fixed value
    prime = 1099511628211 & 0xFFFFFFFF  # fixed value
    folded = F.aggregate(codes, F.lit(basis).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(prime).cast("long"), F.lit(1 << 32).cast("long")))
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def format_unix_time(seconds: Column) -> Column:
    """UTC as yyyy-mm-dd hh:mm:ssZ; 0 is unknown."""
    utc = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return F.when(seconds == 0, F.lit("unknown")).otherwise(F.concat(utc, F.lit("Z")))


def semver(text: Column) -> Column:
    """Three numbers of a version; a leading v, and what follows - or +, don't count.  Arrays of these compare as versions do."""
    core = F.regexp_extract(trim(text), r"^[vV]?([^+-]*)", 1)
    parts = F.concat(F.split(core, r"\."), F.array(F.lit("0"), F.lit("0"), F.lit("0")))
    return F.transform(F.slice(parts, 1, 3), lambda x: F.when(x.rlike(r"^[0-9]{1,9}"), F.regexp_extract(x, r"^[0-9]{1,9}", 0).cast("int")).otherwise(0))
