"""What is read around search hits: neighbours, whole documents for summaries, and evidence that comes later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scores of neighbours and of chunks that a summary adds, documents that it reads, and their characters.
NEIGHBOUR, WHOLE, DOCUMENTS, CHARS = 0.05, 0.95, 2, 9000

HIT = ["query_id", "doc_id", "ordinal", "score", "relevance"]


def with_neighbours(hits: DataFrame, chunks: DataFrame, span: int = 1) -> DataFrame:
    """query_id, doc_id, ordinal, score, relevance: the hits, and the chunks at most `span` places from them in the same
    document that are no hits of the query themselves, each once, with score 0.05 and relevance 0."""
    around = hits.select("query_id", "doc_id", F.explode(F.sequence(F.col("ordinal") - span, F.col("ordinal") + span)).alias("ordinal")).filter("ordinal >= 0").distinct()
    new = around.join(hits, ["query_id", "doc_id", "ordinal"], "left_anti").join(chunks.select("doc_id", "ordinal"), ["doc_id", "ordinal"])
    return hits.select(HIT).union(new.select("query_id", "doc_id", "ordinal", F.lit(NEIGHBOUR), F.lit(0.0)))


def for_summary(hits: DataFrame, chunks: DataFrame, documents: int = DOCUMENTS, chars: int = CHARS) -> DataFrame:
    """The hits and, of each query's first two different documents by rank (score), the chunks from the start within 9000
    characters (the first always) that are no hits, with score 0.95 and relevance 0."""
    first = hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("best"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "doc_id"))
    wanted = first.withColumn("r", place).filter(F.col("r") <= documents).select("query_id", "doc_id")
    total = F.sum("n_chars").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    head = chunks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "ordinal", total.alias("total"))
    head = head.filter((F.col("total") <= chars) | (F.col("ordinal") == 0))
    new = wanted.join(head, "doc_id").join(hits, ["query_id", "doc_id", "ordinal"], "left_anti")
    return hits.select(HIT).union(new.select("query_id", "doc_id", "ordinal", F.lit(WHOLE), F.lit(0.0)))


def with_later(hits: DataFrame, fresh: DataFrame) -> DataFrame:
    """The hits, and of later ones those that are no hits yet, with place: their order by relevance, earlier ones first of equals."""
    new = fresh.select(HIT).dropDuplicates(["query_id", "doc_id", "ordinal"]).join(hits, ["query_id", "doc_id", "ordinal"], "left_anti")
    rows = hits.select(*HIT, F.lit(0).alias("late")).union(new.select(*HIT, F.lit(1).alias("late")))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "late", F.desc("score"), "doc_id", "ordinal")
    return rows.withColumn("place", F.row_number().over(order)).drop("late")
