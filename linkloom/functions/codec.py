"""HTML and CSS value codecs: entities, attributes, escapes, srcset and meta refresh."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.text import SPACE, to_lower, trim

# The named entities that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "sol": "/", "colon": ":",
    "equals": "=", "quest": "?", "num": "#", "lpar": "(", "rpar": ")", "comma": ",", "semi": ";", "period": ".",
}
_ENTITY = re.compile(r"&([^;& \t\r\n\f]{1,10});")
_NUMBER = re.compile(r"#(?:[xX](?:0[xX])?([0-9a-fA-F]+)|([0-9]+))")


def _entity(m: re.Match) -> str:
    body = m[1]
    if body[0] != "#":
        return ENTITIES.get(body.lower() if body.isascii() else body, m[0])
    n = _NUMBER.match(body)
    code = int(n[1], 16) if n and n[1] else int(n[2]) if n else 0
    if not code:
        return m[0]
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "" if code > 0x10FFFF else "�"


def decode_entities_text(text: str) -> str:
    """Named entities in any case and numeric ones; anything else keeps its ampersand."""
    return _ENTITY.sub(_entity, text) if "&" in text else text


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else decode_entities_text(x))


def encode_attribute_text(text: str) -> str:
    return text.replace("&", "&amp;").replace('"', "&quot;").replace("'", "&#39;").replace("<", "&lt;").replace(">", "&gt;")


def encode_attribute(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def unescape_css(s: Column) -> Column:
    """Without the backslash before a character; one at the end stays."""
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


def escape_css(s: Column) -> Column:
    return F.regexp_replace(s, r'(["\\])', r"\\$1")


_CANDIDATE = re.compile(r"[ \t\r\n\f,]*([^ \t\r\n\f,]+)[ \t\r\n\f]*([^,]*),?")


def srcset_text(value: str) -> list[tuple[str, str]]:
    """(url, descriptor) of each candidate."""
    return [(m[1], m[2].strip(SPACE)) for m in _CANDIDATE.finditer(value)]


def parse_srcset(s: Column) -> Column:
    """An array of url and descriptor structs."""
    pattern = r"[ \t\r\n\f,]*([^ \t\r\n\f,]+)[ \t\r\n\f]*([^,]*),?"
    urls, rest = (F.regexp_extract_all(s, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(urls, rest, lambda u, d: F.struct(u.alias("url"), trim(d).alias("descriptor")))


def build_srcset(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda c: F.concat_ws(" ", c["url"], F.nullif(c["descriptor"], F.lit("")))), ", ")


_REFRESH = r"(?is)^[^;]*;[ \t\r\n\f]*url[ \t\r\n\f]*=[ \t\r\n\f]*"
_REFRESH_VALUE = re.compile(_REFRESH + r"(?:\"([^\"]*)|'([^']*)|([^ \t\r\n\f\"'][^ \t\r\n\f]*))")


def refresh_text(content: str) -> tuple[int, int] | None:
    """Start and end of the target in a meta refresh."""
    m = _REFRESH_VALUE.match(content)
    k = m and next((k for k in (1, 2, 3) if m[k]), None)
    return m.span(k) if k else None


def meta_refresh(content: Column) -> Column:
    """The raw target of a meta refresh; null if there is none."""
    quoted = F.coalesce(*[F.nullif(F.regexp_extract(content, _REFRESH_VALUE.pattern, k), F.lit("")) for k in (1, 2, 3)])
    return F.when(content.rlike(_REFRESH), quoted)


# What a link's rel token points at, and whether that is fetched.
REL = {
    "stylesheet": ("css", True),
    "icon": ("image", True), "shortcut": ("image", True), "apple-touch-icon": ("image", True),
    "apple-touch-icon-precomposed": ("image", True), "mask-icon": ("image", True), "apple-touch-startup-image": ("image", True),
    "manifest": ("manifest", True),
    "preload": ("other", True), "prefetch": ("other", True), "modulepreload": ("other", True),
    "canonical": ("html", False), "alternate": ("html", False), "next": ("html", False), "prev": ("html", False),
    "author": ("html", False), "help": ("html", False), "license": ("html", False), "search": ("html", False),
}


def rel_text(rel: str) -> tuple[str, bool]:
    return next((REL[t] for t in rel.lower().split(" ") if t in REL), ("other", False))


def link_rel(rel: Column) -> Column:
    """kind and fetch of the first token that tells them."""
    table = F.create_map(*[x for k, (kind, fetch) in REL.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(fetch).alias("fetch")))])
    told = F.filter(F.transform(F.split(to_lower(rel), " "), lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(told, F.lit(1)), F.struct(F.lit("other").alias("kind"), F.lit(False).alias("fetch")))
