"""Quality rules: base counts of every text and a hashed n-gram log-likelihood ratio, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, maybe_among, stored, table, text_or_empty

BUCKETS = 8192
#: A document is kept when its mean log-likelihood ratio is at least this.
MIN_RATIO = -0.1
_SPACES = r"' \t\n\u000b\u000c\r'"


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).withColumn(
        "w", F.array_remove(F.split("t", SPACE_RUN), "")
    )


def _grams(words: str, buckets: int) -> str:
    """The buckets of all words and of all pairs of neighbours."""
    return f"""concat(
        transform({words}, x -> cast(pmod(xxhash64(x), {buckets}) as int)),
        transform(slice({words}, 2, size({words})), (x, i) -> cast(pmod(xxhash64(get({words}, i), x), {buckets}) as int)))"""


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (the text, null as empty), w (its words) and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = _words(docs, id_col, text_col).select(
        "doc_id",
        "t",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.expr(f"cast(length(translate(t, {_SPACES}, '')) as long)").alias("word_chars"),
        F.expr("cast(length(t) - length(translate(t, '#*$%&|<>', '')) as long)").alias("n_symbols"),
        F.expr(rf"filter(split(t, '\n'), x -> length(translate(x, {_SPACES}, '')) > 0)").alias("lines"),
        F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))").alias("win"),
    )
    # Windows that occur twice stand side by side once sorted; most texts have none, and skip the sort.
    rows = rows.withColumn(
        "sorted",
        F.expr("if(size(array_distinct(win)) = size(win), null, sort_array(transform(win, (x, i) -> struct(x as h, i as p))))"),
    )
    return rows.select(
        "doc_id",
        "t",
        "w",
        "n_words",
        "word_chars",
        "n_symbols",
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr("""coalesce(aggregate(
            sort_array(transform(
              filter(sorted, (x, i) -> x.h <=> get(sorted, i - 1).h or x.h <=> get(sorted, i + 1).h), x -> x.p)),
            struct(-3 as p, 0L as n), (a, p) -> struct(p as p, a.n + least(3, p - a.p) as n), a -> a.n), 0L)""").alias("n_repeat_words"),
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """b, ratio: of each bucket the log of its share in the trusted texts over its share in all texts, both smoothed by one.

    `trusted` has the ids of the trusted target; only the texts that a bit map of these ids lets pass are shuffled. A bucket is counted before anything is shuffled; the result has
    `buckets` rows at any size of the corpus.
    """
    ids = trusted.select(F.col(id_col).alias("known_id")).distinct()
    good = maybe_among(docs.select(id_col, text_col), id_col, ids).join(ids, F.col(id_col) == F.col("known_id"), "left_semi")
    count = lambda rows, name: _words(rows, id_col, text_col).select(F.explode(F.expr(_grams("w", buckets))).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias(name))
    counts = count(docs, "n").join(count(good, "good"), "b", "left").na.fill(0)
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    every = stored(every)
    total = every.agg(F.sum("good").alias("sg"), F.sum("n").alias("sn"))
    share = lambda c, t: F.log((F.col(c) + 1) / (F.col(t) + buckets))
    return every.join(F.broadcast(total)).select("b", (share("good", "sg") - share("n", "sn")).alias("ratio"))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    min_ratio: float = MIN_RATIO,
) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, ratio and kept.

    ratio is the sum of the log-likelihood ratios of a text's words and word pairs, divided by their number; a text
    without words has 0. kept: the base rules hold and ratio >= min_ratio. The weights are `buckets` numbers, read as
    one array. Null text counts as empty, so it fails the base rules; without trusted rows every ratio is close to 0.
    Null or repeated ids give a row each. Other columns are ignored.
    """
    weights = log_ratios(docs, trusted, id_col, text_col, buckets).agg(
        F.expr("transform(sort_array(collect_list(struct(b, ratio))), x -> x.ratio)").alias("v")
    )
    # A driver round trip of `buckets` doubles: one literal array in the second pass.
    values = F.lit([float(x) for x in weights.first()["v"]])
    rows = base_counts(docs, id_col, text_col).withColumn("g", F.expr(_grams("w", buckets)))
    total = F.aggregate("g", F.lit(0.0), lambda a, b: a + F.get(values, b))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(total / (2 * F.col("n_words") - 1)).alias("ratio"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= min_ratio))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return quality_rules(table(spark, sf_dir, "documents"), labels)
