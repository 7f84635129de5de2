"""A corpus made ready for training: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; between stages
the documents are written as Parquet to the shared folder. All but the last return COLUMNS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixture, near, quality, spans
from ledgerloom.llm.common import stage
from ledgerloom.llm.queries import word_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts (under 50 words) go. Repeated rows and doc_ids are judged each, a null
    doc_id like any other; texts of any length are judged whole. Other columns than COLUMNS are
    dropped. An empty table gives none.
    """
    verdicts = quality.judge(docs, carry=COLUMNS[1:])
    return verdicts.filter("kept").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or near-equal texts.

    The smallest doc_id of a class stays, null last; of repeated rows one stays. Rows with null texts all stay,
    of equal blank texts one does. Texts of any length are compared whole. Other columns than COLUMNS
    are dropped. An empty table gives none.
    """
    return near.representatives(docs, COLUMNS[2:]).select(COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus; those with nothing left go.

    Null and empty texts go too. Of repeated rows, and of rows with equal texts and null doc_ids, the first
    keeps its passages. Texts of any length are cut whole. Other columns than COLUMNS are dropped. An
    empty table gives none.
    """
    return spans.remove_repeated(docs, carry=["lang", "source"]).filter("text <> ''").select(
        "doc_id", "text", "lang", "source", F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    ).select(COLUMNS)


def to_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; the last one of a source is cut to fit.

    Documents without words, null texts too, are of size 0 and not taken. Null sources are a source of
    their own; repeated rows and null doc_ids are documents each. Other columns than COLUMNS are dropped.
    An empty table gives none.
    """
    return mixture.mixed_documents(docs).select(
        "doc_id", "text", "lang", "source", F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    ).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the text they decode to.

    Null texts count as empty; repeated rows and null doc_ids keep their rows; texts of any length are
    encoded whole. Other columns are dropped. An empty table gives none.
    """
    return bpe.encode_digests(docs, word_vocabulary())


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", one_of_each),
    ("substring_dedup", drop_passages),
    ("mixing", to_mixture),
    ("bpe", encode),
]

#: Hashing, clustering and encoding stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
