"""From raw documents to packed training sequences: quality, near duplicates, repeated passages, benchmark leaks, packing.

All stages keep the columns of their input, whatever their names, but for the last. Nulls: a null text is the empty text and
a null id is kept as such. Repeated rows are treated alike, and ties go to the smaller doc_id. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import index, near, packing, quality, windows
from tessella.llm.common import id_remainder, stored, table
from tessella.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns as op6 does. Each row is scored by its own text,
    so repeated rows go or stay together; an empty text has the prior's score."""
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 5) != 0)
    return quality.accepted(docs, labels.select("doc_id", F.col("quality").alias("label")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more, verified. The document
    of the smallest doc_id stays, with all rows of that id; texts without words are copies of each other."""
    return near.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that several documents share stay in one of them. Of documents of the same text of 50
    words or more one stays; a text that is cut away whole goes; shorter texts are not touched."""
    return windows.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without phrases of the benchmark; rows of one doc_id are judged by their own texts."""
    return index.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences for training; a null or empty text is one piece with the end id."""
    return packing.pack(docs.select("doc_id", "text", "source"), tokenizer_path(), with_ids=False).drop("ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: No stage but decontamination is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each reading what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
