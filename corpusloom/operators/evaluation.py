"""How well searches do on cases whose answers are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_ranks(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, rank of the first hit (query_id, rank, name, content) that answers each case (query_id, document,
    keywords): the name contains `document`, if there is one, and the content any of the keywords, if there are any."""
    rows = hits.join(cases, "query_id")
    named = (F.coalesce("document", F.lit("")) == "") | F.coalesce(F.col("name"), F.lit("")).contains(F.col("document"))
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    said = (F.size(words) == 0) | F.exists(words, lambda w: F.coalesce(F.col("content"), F.lit("")).contains(w))
    found = rows.filter(named & said).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return cases.select("query_id").join(found, "query_id", "left")


def summary(ranks: DataFrame) -> DataFrame:
    """n_cases, hit_rate, top1, mrr of case_ranks."""
    share = lambda c: F.round(F.avg(c), 6)
    return ranks.agg(
        F.count(F.lit(1)).alias("n_cases"),
        share(F.col("rank").isNotNull().cast("int")).alias("hit_rate"),
        share((F.coalesce("rank", F.lit(0)) == 1).cast("int")).alias("top1"),
        share(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )
