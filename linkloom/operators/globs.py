"""Thousands of globs at once: an automaton over their literals finds the few that can match a text, and only those are tried."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.patterns import glob_regex, glob_text


@dataclass
class GlobSet:
    """Patterns of which the first that matches is sought.

    A pattern's longest run without * and ? must be in a text that it matches; the automaton tells which of these runs are.  Patterns
    without such a run are always tried.
    """

    patterns: tuple[str, ...]
    always: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.automaton, by_literal = ahocorasick.Automaton(), {}
        for k, p in enumerate(self.patterns):
            if literal := max(re.split(r"[*?]+", p), key=len):
                by_literal.setdefault(self._surely(literal), []).append(k)
            elif p:
                self.always.append(k)
        for literal, which in by_literal.items():
            self.automaton.add_word(literal, which)
        if by_literal:
            self.automaton.make_automaton()
        self.any_literal, self.compiled = bool(by_literal), {}

    @staticmethod
    def _surely(literal: str) -> str:
        """Without a leading slash, which may stand for nothing after a doubled star."""
        return literal[1:] if literal.startswith("/") and len(literal) > 1 else literal

    def matches(self, k: int, text: str) -> bool:
        if k not in self.compiled:
            regex = glob_regex(self.patterns[k])
            self.compiled[k] = regex and re.compile(regex.replace("\\z", "\\Z"))  # Python's name for the end of the text
        found = self.compiled[k]
        return found.match(text) is not None if found else glob_text(self.patterns[k], text)

    def first(self, text: str) -> int | None:
        """The place of the first pattern that matches a text."""
        may = set(self.always)
        if self.any_literal:
            for _, which in self.automaton.iter(text):
                may.update(which)
        return next((k for k in sorted(may) if self.matches(k, text)), None)


@lru_cache(maxsize=8)
def glob_set(patterns: tuple[str, ...]) -> GlobSet:
    """The set of the patterns, built once for a worker."""
    return GlobSet(patterns)


def first_glob(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first of the patterns that matches a text, or null; the plan is of one size for any number of them."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        globs = glob_set(patterns)
        at = (None if t is None else globs.first(t) for t in texts)
        return pd.Series([None if k is None else patterns[k] for k in at], index=texts.index, dtype=object)

    return found(text)
