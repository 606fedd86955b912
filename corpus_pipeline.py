"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir). Its result is stored and read again as the next one's docs; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact, langid, ngram_join, packing, pii
from corpusloom.llm.common import stored, table, unused
from corpusloom.plans.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is unknown or ambiguous; lang becomes the predicted language.

    Every row is decided by its own text: null and repeated ids are rows like any other.
    """
    ship(spark)
    return langid.keep_clear(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id.

    Null text counts as empty, runs of white space as one space, and a null id comes last. Of rows with equal ids and
    texts, one stays. Columns beside id and text count for nothing, whatever their names.
    """
    ship(spark)
    return exact.drop_exact_copies(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked rows, the one with the smallest id.

    Null texts and those without words link with nothing and stay, and so do rows with a null id. Every row is decided
    by its own text: rows that repeat an id are documents of their own, of which those with equal texts are one; of
    linked rows with equal ids, the one with the smaller hash stays. Other columns count for nothing, whatever their
    names.
    """
    ship(spark)
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    again = stored(again)
    if again.isEmpty():
        gone = ngram_join.link_components(docs).filter("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    key, flag = unused(docs, "key"), unused(docs, "flag")
    rows = docs.join(again.withColumn(flag, F.lit(True)), "doc_id", "left")
    rows = rows.withColumn(key, F.when(F.col(flag), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))).drop(flag)
    rows = stored(rows.filter(F.col(key).isNull()).unionByName(rows.filter(F.col(key).isNotNull()).dropDuplicates([key])))
    found = ngram_join.link_components(rows, id_col=key).filter("component_id IS NOT NULL").select(F.col("doc_id").alias("k"), "component_id")
    found = stored(found.join(rows.select(F.col(key).alias("k"), F.col("doc_id").alias("i")), "k"))
    stays = found.groupBy("component_id").agg(F.min(F.struct("i", "k"))["k"].alias("stays"))
    gone = found.join(stays, "component_id").filter("k <> stays").select(F.col("k").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text.

    A null text stays null and has no characters; an empty one stays empty. Null and repeated ids are rows like any
    other; equal texts are redacted alike. Other columns stay as they are, whatever their names.
    """
    ship(spark)
    found = pii.redact_column(docs, pii.fit(docs))
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences.

    A null text is an empty one, whose only token is the end id. A null source is a queue of its own. Null and repeated
    ids are documents of their own, and a long document is cut where windows end. Other columns are left out.
    """
    ship(spark)
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("pii", redact_pii),
    ("packing", pack),
]

#: Language ID, the boosted spans and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
