"""Globs over URLs, and robots.txt patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def glob_text(pattern: str, text: str) -> bool:
    """* stays within a path segment, ** doesn't, **/ may stand for nothing, ? is any character.

    Each star takes as little as lets the literal after it fit, and isn't reconsidered once the next star is met.
    """
    if not pattern:
        return False
    head, *rest = re.split(r"(\*\*?)", pattern)

    def fits(literal: str, at: int) -> bool:
        return at + len(literal) <= len(text) and all(c in ("?", x) for c, x in zip(literal, text[at:]))

    if not fits(head, 0):
        return False
    at = len(head)
    while rest:
        star, literal, *rest = rest
        if at == len(text):
            return not literal and not "".join(rest).strip("*")
        if star == "**" and literal.startswith("/") and _tail(literal[1:] + "".join(rest), text[at:]):
            return True
        if rest:
            found = next((k for k in range(at, len(text) - len(literal) + 1) if fits(literal, k)), None)
        else:
            found = len(text) - len(literal)
            found = found if found >= at and fits(literal, found) else None
        if found is None or (star == "*" and "/" in text[at:found]):
            return False
        at = found + len(literal)
    return at == len(text)


def _tail(pattern: str, text: str) -> bool:
    return glob_text(pattern, text) if pattern else not text


def needs_python(pattern: str) -> bool:
    """Whether a single star comes after a doubled one."""
    stars = re.findall(r"\*\*?", pattern)
    return "**" in stars and "*" in stars[stars.index("**") :]


def _quoted(literal: str) -> str:
    return "".join("." if c == "?" else c if c.isalnum() or c in "_/" else f"\\{c}" if c.isascii() else c for c in literal)


def glob_regex(pattern: str) -> str | None:
    """A regular expression for whole texts that agrees with a pattern; None if there is none.

    It agrees unless a single star comes after a doubled one: before that, the least a star can take leaves most to the rest, so nothing is
    to be reconsidered.
    """
    if not pattern or needs_python(pattern):
        return None
    parts = re.split(r"(\*\*?)", pattern)
    out = [_quoted(parts[0])]
    for star, literal in zip(parts[1::2], parts[2::2]):
        folders = star == "**" and literal.startswith("/")
        out.append(("(?:.*/)?" if folders else ".*" if star == "**" else "[^/]*") + _quoted(literal[folders:]))
    return f"(?s)^{''.join(out)}\\z"


def glob_match(pattern: str, text: Column) -> Column:
    """Whether texts match a pattern, by a regular expression if one agrees."""
    regex = glob_regex(pattern)
    if regex is not None:
        return text.rlike(regex)
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else glob_text(pattern, x)), T.BooleanType())(text)


@F.pandas_udf(T.BooleanType())
def glob_match_columns(pattern: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or t is None else glob_text(p, t) for p, t in zip(pattern, text)])


def robots_matches(pattern: Column, path: Column) -> Column:
    """A plain pattern is a prefix; one with * or a $ at its end must match the whole path."""
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    quoted = F.replace(F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q"))
    whole = F.rlike(path, F.concat(F.lit("(?s)^\\Q"), quoted, F.lit("\\E\\z")))
    return (pattern != "") & F.when(anchored | F.contains(pattern, F.lit("*")), whole).otherwise(F.startswith(path, pattern))


def robots_specificity(pattern: Column) -> Column:
    return F.octet_length(F.regexp_replace(pattern, r"\$$", ""))
