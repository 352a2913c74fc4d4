"""From documents to a training mix: five stages, each on all that the one before kept.

Every stage is an operator of ``newsloom.llm`` applied to a table of documents; all but the last return its
columns. ``run`` applies them in turn and saves the table between stages in the folder that the cluster names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.columns import saved, table
from newsloom.llm.decontaminate import decontaminated
from newsloom.llm.mixing import mixed
from newsloom.llm.near_copies import without_near_copies
from newsloom.llm.phrases import without_repeats
from newsloom.llm.quality import good

#: Words in a shingle of the near-copy stage.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component stays."""
    return without_near_copies(docs, SHINGLE)


def repeated_phrases(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_phrases", repeated_phrases),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: A classifier and signatures are not SQL; ``tests/llm`` compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = saved(docs)
    return docs
