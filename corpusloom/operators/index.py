"""Inverted index and hashed vectors as tables, and search over them for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import char_ngrams, tokens
from corpusloom.operators import hashed

K1, B = 1.5, 0.75


def postings(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, term, tf, dl: of every chunk the counts of its terms and its length, at least 1."""
    words = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    words = words.select("id", F.greatest(F.size("w"), F.lit(1)).alias("dl"), F.explode("w").alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_docs, avgdl."""
    return chunks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.greatest(F.size(tokens(F.col(text_col))), F.lit(1))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_table(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    n = chunks.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return postings(chunks, id_col, text_col).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", idf(n, F.col("df")).alias("idf"))


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, to be broadcast if a count says that it has at most `most` rows; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def query_weights(queries: DataFrame, chunks: DataFrame, query_id: str = "item_id") -> DataFrame:
    """term, idf of the query terms that occur in any chunk, without postings of the other terms."""
    n = chunks.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    terms = small(query_terms(queries, query_id).select("term").distinct())
    found = chunks.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(terms, "term", "left_semi")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf(n, F.col("df")).alias("idf"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int, scope: Column | None = None, id_col: str = "doc_id", query_id: str = "item_id") -> DataFrame:
    """query_id, doc_id, score, matched, rank. Statistics are those of all chunks, also when `scope` limits the results.

    Only postings of query terms are shuffled: the terms of the queries, if they are few, go to every task of the chunks
    and drop all other words before anything is summed or shuffled.
    """
    stats = corpus_stats(chunks).select(F.struct("n_docs", "avgdl").alias("s")).scalar()
    n, avgdl = stats["n_docs"], stats["avgdl"]
    terms = small(query_terms(queries, query_id))
    words = chunks.select(F.col(id_col).alias("id"), (F.lit(True) if scope is None else scope).alias("inside"), tokens(F.col("text")).alias("w"))
    words = words.select("id", "inside", F.greatest(F.size("w"), F.lit(1)).alias("dl"), F.explode("w").alias("term"))
    post = words.join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("id", "term", "inside", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = idf(n, F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    scored = post.join(df, "term").filter("inside").select("id", "term", weight.alias("s"))
    hits = scored.join(terms, "term").groupBy("query_id", F.col("id").alias("doc_id"))
    hits = hits.agg(F.round(F.sum("s"), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))
    return top(hits, k)


def top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hash_features(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = 512, digits: int | None = None) -> DataFrame:
    """id, slot, value: words (weight 1 each) and character pairs and triples (0.6 each), hashed with sign; of length 1, to `digits` places.

    Rows that repeat an id, or null, are one text's: their features are counted together. All others are counted row by
    row, without a shuffle.
    """
    chunks = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    again = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("id").alias("same"))
    if again.isEmpty():
        return _features_by_row(chunks, dim, digits)
    same = F.col("id").eqNullSafe(F.col("same"))
    merged = _features_by_id(chunks.join(again, same, "left_semi"), dim)
    merged = merged if digits is None else merged.withColumn("value", F.round("value", digits))
    return _features_by_row(chunks.join(again, same, "left_anti"), dim, digits).union(merged)


def _features_by_row(chunks: DataFrame, dim: int, digits: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, v, used in hashed.steps(batches, dim):
            row, slot = np.nonzero(used)
            value = v[row, slot] if digits is None else hashed.rounded(v[row, slot], digits)
            yield pa.RecordBatch.from_arrays([own.column("id").take(pa.array(row)), pa.array(slot.astype(np.int32)), pa.array(value)], ["id", "slot", "value"])

    rows = hashed.prepared(chunks, "id", "text")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, slot int, value double")


def _features_by_id(chunks: DataFrame, dim: int) -> DataFrame:
    text = F.col("text")
    words = chunks.select("id", F.explode(F.transform(tokens(text), lambda t: F.concat(F.lit("w:"), t))).alias("f"), F.lit(1.0).alias("w"))
    grams = F.filter(char_ngrams(text, 2, 3), lambda g: F.length(F.trim(g)) > 0)
    chars = chunks.select("id", F.explode(F.transform(grams, lambda t: F.concat(F.lit("c:"), t))).alias("f"), F.lit(0.6).alias("w"))
    sums = words.union(chars).groupBy("id", "f").agg(F.sum("w").alias("w"))
    digest = F.md5("f")
    slot = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(digest, 10, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    cells = sums.groupBy("id", slot.alias("slot")).agg(F.sum(sign * (1 + F.log("w"))).alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("id")))
    return cells.select("id", "slot", (F.col("value") / F.when(norm > 0, norm).otherwise(1.0)).alias("value"))


def fuse(semantic: DataFrame, keyword: DataFrame, semantic_weight: float = 0.6) -> DataFrame:
    """query_id, doc_id, sem, score: full outer union of two candidate lists (query_id, doc_id, score), each scaled by its query's best score."""
    both = semantic.select("query_id", "doc_id", F.greatest("score", F.lit(0.0)).alias("sem"), F.lit(0.0).alias("kw")).union(
        keyword.select("query_id", "doc_id", F.lit(0.0).alias("sem"), F.col("score").alias("kw"))
    )
    both = both.groupBy("query_id", "doc_id").agg(F.max("sem").alias("sem"), F.max("kw").alias("kw"))
    best = lambda c: F.max(c).over(Window.partitionBy("query_id"))
    part = lambda c: F.when(best(c) > 0, F.col(c) / best(c)).otherwise(0.0)
    return both.select("query_id", "doc_id", "sem", F.round(semantic_weight * part("sem") + (1 - semantic_weight) * part("kw"), 6).alias("score"))


def phrase_bonus(score: Column, query: Column, text: Column, bonus: float = 0.12) -> Column:
    """The score, raised up to 1 where the text contains the whole query of two characters or more."""
    phrase = F.trim(F.regexp_replace(query, r"\s+", " "))
    return F.when((F.length(phrase) >= 2) & text.contains(phrase), F.least(F.lit(1.0), score + bonus)).otherwise(score)


def coverage(hits: DataFrame, terms: DataFrame, weights: DataFrame, n: Column) -> DataFrame:
    """query_id, doc_id, coverage of hits (query_id, doc_id, matched): the weight of the matched terms among the query's.

    weights: term, idf. A term that no text has weighs the mean of the query's known ones, at most the greatest idf; a
    query without known terms has 0.
    """
    rows = terms.join(weights, "term", "left")
    known = rows.groupBy("query_id").agg(
        F.coalesce(F.sum("idf"), F.lit(0.0)).alias("known"), F.count_if(F.col("idf").isNull()).alias("unknown"), F.coalesce(F.avg("idf"), F.lit(0.0)).alias("mean")
    )
    whole = F.col("known") + F.col("unknown") * F.least(F.log(1 + (n + 0.5) / 0.5), F.col("mean"))
    got = hits.select("query_id", "doc_id", F.explode("matched").alias("term")).join(rows, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum("idf").alias("got"))
    return got.join(known, "query_id").select("query_id", "doc_id", F.when(whole > 0, F.col("got") / whole).otherwise(0.0).alias("coverage"))


def hybrid(semantic: DataFrame, keyword: DataFrame, covered: DataFrame, queries: DataFrame, texts: DataFrame, gate: float = 0.18, shortlist: int = 20) -> DataFrame:
    """query_id, doc_id, score, relevance, rank of the best `shortlist` candidates whose relevance reaches `gate`.

    semantic and keyword: query_id, doc_id, score; covered: query_id, doc_id, coverage; queries: query_id, q; texts:
    doc_id, text. score is that of `fuse` with the phrase bonus, relevance 0.6 of the cosine and 0.4 of the coverage, each
    0 where the candidate isn't in that list.
    """
    rows = fuse(semantic, keyword).join(covered, ["query_id", "doc_id"], "left").join(queries, "query_id").join(texts, "doc_id")
    relevance = F.round(0.6 * F.col("sem") + 0.4 * F.coalesce("coverage", F.lit(0.0)), 6)
    rows = rows.select("query_id", "doc_id", F.round(phrase_bonus(F.col("score"), F.col("q"), F.col("text")), 6).alias("score"), relevance.alias("relevance"))
    return top(rows.filter(F.col("relevance") >= gate), shortlist)
