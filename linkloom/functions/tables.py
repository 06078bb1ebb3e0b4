"""Table functions for SQL: the references of a page, and the rules of a robots.txt, beside each row by LATERAL.

    register(spark)
    spark.sql("SELECT p.url, r.* FROM pages AS p, LATERAL page_references(p.html) AS r")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from linkloom.operators.scan import references, robots


def _text_or_binary(argument: AnalyzeArgument, name: str) -> None:
    if not isinstance(argument.dataType, (StringType, BinaryType)):
        raise ValueError(f"{name} takes a text or binary column")


@F.udtf(useArrow=True)
class PageReferences:
    """nth (of the link), part (in a style or srcset), role, hint, value, descriptor and base (that of the page) of each reference; none for null."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        _text_or_binary(html, "page_references")
        schema = StructType().add("nth", IntegerType()).add("part", IntegerType())
        for name in ("role", "hint", "value", "descriptor", "base"):
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema)

    def eval(self, html) -> Iterator[tuple]:
        if html is not None:
            base, found = references(html.encode() if isinstance(html, str) else bytes(html))
            for nth, _, _, role, hint, part, _, _, value, descriptor in found:
                yield nth, part, role, hint, value, descriptor, base


@F.udtf(useArrow=True)
class RobotsRules:
    """pattern and allow of each rule that a robots.txt has for an agent; none for null."""

    @staticmethod
    def analyze(text: AnalyzeArgument, agent: AnalyzeArgument) -> AnalyzeResult:
        _text_or_binary(text, "robots_rules")
        if not agent.isConstantExpression:
            raise ValueError("the agent is a constant")
        return AnalyzeResult(StructType().add("pattern", StringType()).add("allow", BooleanType()))

    def eval(self, text, agent: str) -> Iterator[tuple]:
        if text is not None:
            yield from robots(text if isinstance(text, str) else bytes(text).decode("utf-8", "replace"), agent)[0]


def register(spark: SparkSession) -> None:
    """Makes page_references(html) and robots_rules(text, agent) known to the session's SQL."""
    spark.udtf.register("page_references", PageReferences)
    spark.udtf.register("robots_rules", RobotsRules)
