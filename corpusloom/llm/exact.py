"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, maybe_among, table, text_or_empty, unused

SALTS = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space has become one space. Three combining steps,
    each of which groups by the whole normalised text and not only by its digest: Spark's map-side aggregation removes
    the copies within a task, `salts` groups per digest spread a group of copies that holds a large part of all rows,
    and the winners of the salts are combined last. Rows then look their group up by digest, a second hash and salt, so
    that the lookup of a large group is spread too; texts that share 256 bits of SHA-2 and 64 of xxHash count as equal.

    Null text counts as empty. A null id never wins against another; where a group has no id, keep_id is null and all
    its rows count as kept. Rows that repeat both id and text are reported one by one and share kept. Other columns of `docs`
    are ignored, whatever their names.
    """
    norm = F.regexp_replace(text_or_empty(text_col), SPACE_RUN, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("second"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    )
    local = rows.groupBy("digest", "second", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = local.groupBy("digest", "second", "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")
    )
    lookup = winners.select("digest", "second", F.explode("salts").alias("salt"), "keep_id", "group_size")
    return (
        rows.select("doc_id", "digest", "second", "salt")
        .join(lookup, ["digest", "second", "salt"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with all its columns, without the rows whose text another row that stays has.

    Of equal texts, the row with the smallest id stays; a null id comes last. Of rows with equal ids and texts, one
    stays: ids that occur twice, found by a bit map, have their rows combined by id and whole normalised text first.
    """
    norm, again = unused(docs, "norm"), unused(docs, "again")
    ids = docs.select(F.coalesce(F.col(id_col), F.lit(0)).alias(again)).groupBy(again).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(again)
    rows = docs.withColumn(again, F.coalesce(F.col(id_col), F.lit(0)))
    twice = maybe_among(rows, again, ids)
    once = maybe_among(rows, again, ids, keep=False)
    twice = twice.withColumn(norm, F.regexp_replace(text_or_empty(text_col), SPACE_RUN, " ")).dropDuplicates([id_col, norm])
    rows = once.select(docs.columns).unionByName(twice.select(docs.columns))
    kept = exact_groups(rows, id_col, text_col).filter("kept").select(F.col("doc_id").alias(again), F.col("text_sha256").alias(norm))
    digest = F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE_RUN, " "), 256)
    return rows.join(kept, F.col(id_col).eqNullSafe(F.col(again)) & (digest == F.col(norm)), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
