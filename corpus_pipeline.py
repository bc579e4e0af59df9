"""A corpus from raw documents to packed sequences, stage by stage.

Every stage works on all that the one before kept, and its decisions take effect: documents
and lines and words that it drops are gone. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import line_dedup, packing, quality, simhash, substring, vocabularies
from stallwise.llm.common import ready, table
from stallwise.llm.queries import GOOD, SEQUENCE
from stallwise.session import scratch


def with_text(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the struct ``doc``, with the text of ``new_text``."""
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return df.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ready(spark)
    model = quality.learned(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.scored(docs, model).filter(F.col("score") >= GOOD).select("doc.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that three documents or more hold, but for the last of these."""
    ready(spark)
    cleaned = line_dedup.dedup_lines(docs, 3, 20)
    new = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("doc.text"))
    return with_text(cleaned.withColumn("new_text", new), docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints over three-word shingles are linked at two bits."""
    ready(spark)
    return simhash.one_of_each(docs, 3)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 13-word windows that a smaller document also has."""
    ready(spark)
    cleaned = substring.dedup_substrings(docs, 13)
    new = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("doc.text"))
    return with_text(cleaned.withColumn("new_text", new), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    ready(spark)
    return packing.pack_documents(docs, SEQUENCE, 0, vocabularies.byte_tokens)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("packing", packed),
]

# Models, components and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
