"""Documents to packed training sequences: five stages, each one of the text operators over all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Labels
are those of sf_dir. `run` applies them to documents, each stage's result being a table in the shared folder.

In every stage a null text is read as an empty one, texts of any length are read whole, rows that are repeated are judged alike,
an empty table gives an empty one, and columns beyond those of documents stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visitlens.llm.common import stored, table
from visitlens.llm.lines import without_repeated_lines
from visitlens.llm.packing import packed_digests
from visitlens.llm.quality import good_documents
from visitlens.llm.rules import passing_documents
from visitlens.llm.simhash import one_of_each_group


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more stay; an empty text has the score of no n-grams. With labels of one class
    only, the score is that class's share throughout."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and the learned decision list stay; an empty text fails the check. Rules are learnt from
    labels outside the held-out fold; without two classes of them the list is empty."""
    return passing_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines leave the texts; every document stays, at worst with an empty text, and a null text
    stays null. The first copy is that of the lowest id (null is the lowest), then of the lowest text hash and line; rows equal in
    both are one document. n_chars follows the text."""
    return without_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the lowest id (null is the highest), then of the lowest text hash, then of
    the lowest hash of all columns. Texts without words are one group."""
    return one_of_each_group(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 ids; an empty text is its end id alone, and null ids stay null."""
    return packed_digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("packing", packing),
]

#: Learned models and components over all documents: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
