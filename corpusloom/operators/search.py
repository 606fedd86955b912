"""The whole way of a search: candidates by vectors and by words, their fusion, the gate, the reranker, marginal relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators.index import B, K1, fuse, idf, phrase_bonus, query_terms, small, top
from corpusloom.operators.vectors import knn, mmr
from corpusloom.sources.snapshots import stored

# Candidates of either kind, least relevance, length of the shortlist, weights of the reranker.
CANDIDATES, GATE, SHORTLIST = 30, 0.18, 20
RERANK, PHRASE, HEADING = 0.4, 0.15, 0.2
SEMANTIC = 0.6


def word_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words, dl of every document, stored, so that a search tokenises each text once."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), tokens(F.col(text_col)).alias("words"))
    return stored(rows.select("id", "words", F.greatest(F.size("words"), F.lit(1)).alias("dl")))


def keyword_hits(words: DataFrame, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """BM25 over a word table: query_id, doc_id, score of the best k; term, idf of the query terms that occur; how many documents there are."""
    n, avgdl = words.agg(F.count(F.lit(1)), F.avg("dl")).first()
    asked = small(terms.select("term").distinct())
    post = words.select("id", "dl", F.explode("words").alias("term")).join(asked, "term", "left_semi").groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    post = stored(post)
    weights = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf(F.lit(n), F.col("df")).alias("idf"))
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    hits = post.join(small(weights), "term").select("id", "term", score.alias("s")).join(small(terms), "term")
    return top(hits.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.round(F.sum("s"), 6).alias("score")), k), weights, n


def weighed_terms(terms: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """query_id, known (term and idf of the terms that any document has), whole: the weight of all of a query's terms.

    A term that no document has weighs the mean of the query's known ones, at most the greatest idf.
    """
    rows = terms.join(small(weights), "term", "left").groupBy("query_id")
    own = rows.agg(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "idf"))).alias("known"), F.count_if(F.col("idf").isNull()).alias("missing"), F.avg("idf").alias("mean"), F.sum("idf").alias("got"))
    return own.select("query_id", "known", (F.col("got") + F.col("missing") * F.least(F.log(1 + (F.lit(n) + 0.5) / 0.5), F.col("mean"))).alias("whole"))


def covered(known: Column, whole: Column, words: Column) -> Column:
    """The weight of the query's terms that are among the words, as a share; 0 for a query without known terms."""
    got = F.aggregate(F.filter(known, lambda t: F.array_contains(words, t["term"])), F.lit(0.0), lambda s, t: s + t["idf"])
    return F.when(whole > 0, got / whole).otherwise(0.0)


def lexical(query: Column, text: Column, heading: Column, words: Column | None = None) -> Column:
    """The reranker's score: the query's words in the text by their lengths, the whole phrase, the words in the heading; at most 1."""
    own = F.array_distinct(tokens(query))
    size = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.greatest(F.lit(1), F.length(x)))
    share = lambda w: size(F.filter(own, lambda x: F.array_contains(w, x))) / F.greatest(F.lit(1), size(own))
    phrase = F.trim(F.regexp_replace(query, r"\s+", " "))
    bonus = F.when((F.length(phrase) >= 4) & text.contains(phrase), PHRASE).otherwise(0.0)
    named = F.coalesce(F.lit(HEADING) * share(tokens(heading)), F.lit(0.0))
    return F.least(F.lit(1.0), share(tokens(text) if words is None else words) + bonus + named)


def rerank(rows: DataFrame, weight: float = RERANK) -> DataFrame:
    """Rows (query_id, doc_id, score, q, text, heading, perhaps words) with the score mixed with `lexical`; a query without words keeps its scores."""
    mixed = (1 - weight) * F.col("score") + weight * lexical(F.col("q"), F.col("text"), F.col("heading"), F.col("words") if "words" in rows.columns else None)
    return rows.withColumn("score", F.round(F.when(F.size(tokens(F.col("q"))) > 0, mixed).otherwise(F.col("score")), 6))


def shortlist(queries: DataFrame, docs: DataFrame, semantic: DataFrame, candidates: int = CANDIDATES, gate: float = GATE, most: int = SHORTLIST) -> DataFrame:
    """query_id, doc_id, score, relevance, rank, q, text, heading, words: of every query's candidates that are relevant enough the best `most`.

    queries: query_id, q; docs: doc_id, text, heading; semantic: query_id, doc_id, score of the nearest documents. The
    candidates of both kinds, at most twice `candidates` a query, are joined with their texts and words: relevance takes
    the coverage of each from its own words, whether or not BM25 has listed it. Blank queries find nothing.
    """
    queries = queries.filter(F.trim("q") != "")
    terms = stored(query_terms(queries, "query_id", "q"))
    words = word_table(docs)
    keyword, weights, n = keyword_hits(words, terms, candidates)
    scored = fuse(semantic.join(queries.select("query_id"), "query_id", "left_semi"), keyword, SEMANTIC)
    rows = stored(scored.join(weighed_terms(terms, weights, n), "query_id", "left").join(queries, "query_id"))
    found = docs.select("doc_id", "text", "heading").join(small(rows), "doc_id").join(small(rows.select("doc_id").distinct()).join(words, F.col("doc_id") == F.col("id")).select("doc_id", "words"), "doc_id")
    share = F.coalesce(covered(F.col("known"), F.col("whole"), F.col("words")), F.lit(0.0))
    relevance = F.round(SEMANTIC * F.col("sem") + (1 - SEMANTIC) * share, 6)
    score = F.round(phrase_bonus(F.col("score"), F.col("q"), F.col("text")), 6)
    found = found.select("query_id", "doc_id", score.alias("score"), relevance.alias("relevance"), "q", "text", "heading", "words")
    return top(found.filter(F.col("relevance") >= gate), most)


def search(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, k: int = 6, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, doc_id, score, rank: shortlist, reranker, then `k` by marginal relevance.

    query_vectors, doc_vectors: id, v; documents without a vector are found by words only and are near nothing.
    """
    short = stored(rerank(shortlist(queries, docs, knn(query_vectors, doc_vectors, candidates, others=False), candidates)).select("query_id", "doc_id", "score"))
    own = doc_vectors.join(small(short.select(F.col("doc_id").alias("id")).distinct()), "id", "left_semi")
    rows = short.join(query_vectors.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id", "left").join(own.select(F.col("id").alias("doc_id"), "v"), "doc_id", "left")
    return mmr(rows.select("query_id", "doc_id", "score", "qv", "v"), k)


def search_many(hits: DataFrame, parts: DataFrame, k: int = 6) -> DataFrame:
    """question_id, doc_id, score, rank: of the searches of a question's parts (question_id, query_id) the best score of each document, the best k."""
    best = hits.join(small(parts), "query_id").groupBy("question_id", "doc_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
