"""From documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the docs of the next.
All but the last return the columns of documents, whatever further ones those have; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.common import table, written
from linkloom.llm.decontaminate import drop_contaminated
from linkloom.llm.mixing import mix_documents
from linkloom.llm.neardup import keep_one
from linkloom.llm.pii import from_session, mask_documents
from linkloom.llm.quality import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules or their hosts' verdicts reject.

    Null and empty texts have no words and go; null sources are one host; repeated rows are each judged.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least doc_id (null last).

    Texts without words all stay; of repeated rows one stays; of rows with one id and the same shingles the one with the least text.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark.

    Null and empty texts and items match nothing; repeated rows all go or all stay; without items all stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms for personal data in the texts; the key is the session's (pii.KEY_SETTING), or a random one of the application.

    A null text stays null; texts without personal data stay as they are; equal values get equal pseudonyms in all rows.
    """
    return mask_documents(docs, from_session(spark, make=True))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes words of, with mix_size, mix_target and mix_taken, which replace columns of these names.

    Texts without words are never taken; null sources are one source; repeated rows each take part.
    """
    return mix_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
]

#: The stages hold keyed permutations and signatures, which SQL doesn't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
