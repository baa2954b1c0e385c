"""The corpus pipeline: from documents to packed sequences.

Each stage takes what its predecessor kept, as a stored table, and returns rows with the columns
of ``documents``; the last returns the pieces of the packed sequences. Extra columns stay until
then. Models are fitted on the rows of ``labels`` that the contracts of their operators allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm import jaccard_join, line_dedup, packing, quality, toxicity
from textrisk.llm.common import read_table, stored
from textrisk.llm.training import fold
from textrisk.session import ship_package

REJECTED_TOXICITY = 0.3  # toxicity scores from which on a document goes
ACCEPTED_QUALITY = 0.3  # quality scores from which on a document stays


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic; null and empty texts have a score as well."""
    ship_package(spark)
    score = toxicity.toxicity_score(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return docs.where(score < REJECTED_TOXICITY)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of acceptable quality, null and empty texts scored like any other; word vectors
    come from the documents given."""
    ship_package(spark)
    score = quality.quality_score(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return docs.where(score >= ACCEPTED_QUALITY)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that recur across sites; ``n_chars`` follows the text."""
    ship_package(spark)
    return line_dedup.remove_boilerplate(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; documents without
    words or id are in no group. Rows that repeat an id are one document and stay together."""
    ship_package(spark)
    found = jaccard_join.jaccard_components(docs)
    others = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    # A stored table, whose size the planner knows: it broadcasts the ids where they are few.
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens; null texts count as empty, and
    an empty one is its end mark."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

# Two stages apply fitted models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is stored for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
