"""Answers drawn from evidence, checks of their citations, and what to look for next, as joins over sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import sentences, tokens
from corpusloom.operators.conversation import COMPARE, aspects

# A citation, what makes a sentence a mere tail of the one before, its ends, the reply without material, and patterns of compared things.
CITATION = r"\[(\d{1,2})\]"
TAIL = r"^[\s\-*+>|　]*\[\d{1,2}\]"
SENTENCE_ENDS = "。！？!?…；;"
NO_MATERIAL = "暂无相关资料"
REFERENCES = "**参考来源**"
FILLERS = "(之间的|的|有哪些|是什么|怎么样|如何|请|帮我|一下)"
BETWEEN = r"(?:和|与|跟|、|vs\.?|VS|VS\.)"
ASKING_END = "(之间|有什么区别|有什么不同|有什么|有哪些|是什么|怎么样|怎么|如何|哪些|哪个|什么|区别|差异)+$"
#: Patterns of what users say of themselves: pattern, category, importance, what stands before it.
MEMORY_RULES = (
    (r"(?:我|本人)(?:是|是一名|是一个|做|从事|就读于|就职于)([^。！？；\n]{2,30})", "fact", 0.7, "用户信息："),
    (r"我(?:喜欢|偏好|习惯用?|常用|更倾向|倾向于)([^。！？；\n]{2,40})", "preference", 0.75, "用户偏好："),
    (r"我(?:关注|重点研究|正在研究|正在学|想学|需要学)([^。！？；\n]{2,40})", "interest", 0.7, "用户关注："),
    (r"(?:以后|下次|今后|之后)([^。！？；\n]{2,40})", "scenario", 0.6, "常用场景："),
    (r"记住([^。！？；\n]{2,40})", "fact", 0.8, "用户信息："),
)


def _cited(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))


def _uncited(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def segments(answer: Column) -> Column:
    """The sentences of an answer; one that only cites, or has no words of its own, belongs to the sentence before it."""
    tail = lambda x: (x.rlike(TAIL) & ~F.lit(SENTENCE_ENDS).contains(F.substring(x, -1, 1))) | (F.size(tokens(_uncited(x))) == 0)
    step = lambda a, x: F.when((F.size(a) > 0) & tail(x), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.element_at(a, -1), x)))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(sentences(answer), F.array().cast("array<string>"), step)


def verify(answers: DataFrame, evidence: DataFrame, strict: bool = True, least: float = 0.25) -> DataFrame:
    """query_id, answer, used, invalid, unsupported, grounded_ratio, grounded of answers (query_id, answer).

    evidence: query_id, idx (from 1), content, document, heading. Citations of what isn't there are taken out if strict.
    A citing sentence is supported if at least `least` of its words occur in what it cites; grounded_ratio is the share of
    supported ones among all that cite, and 0.5 is enough. An answer without citations isn't grounded and gets the list
    of its first three pieces of evidence; an empty one, or one without evidence, isn't grounded either.
    """
    known = evidence.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("idx") <= 3, F.struct("idx", "document", "heading")))).alias("first")
    )
    rows = answers.select("query_id", F.trim(F.coalesce("answer", F.lit(""))).alias("answer")).join(known, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inside = lambda x: (x >= 1) & (x <= F.col("n"))
    all_ = F.array_sort(F.array_distinct(_cited(F.col("answer"))))
    rows = rows.withColumn("used", F.filter(all_, inside)).withColumn("invalid", F.filter(all_, lambda x: ~inside(x)))
    if strict:
        out = F.aggregate("invalid", F.col("answer"), lambda a, i: F.replace(a, F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.lit("")))
        rows = rows.withColumn("answer", out)
    parts = rows.select("query_id", "n", F.posexplode(segments(F.col("answer"))).alias("pos", "s")).filter(F.col("s").rlike(CITATION))
    parts = parts.select("query_id", "pos", "s", F.array_distinct(F.filter(_cited(F.col("s")), inside)).alias("cites"), F.array_distinct(tokens(_uncited(F.col("s")))).alias("w"))
    words = evidence.select("query_id", F.col("idx").alias("cite"), tokens(F.col("content")).alias("e"))
    found = parts.select("query_id", "pos", F.explode("cites").alias("cite")).join(words, ["query_id", "cite"]).groupBy("query_id", "pos").agg(F.flatten(F.collect_list("e")).alias("e"))
    judged = parts.join(found, ["query_id", "pos"], "left")
    open_ = (F.size("cites") > 0) & (F.size("w") > 0)
    share = F.size(F.array_intersect("w", F.coalesce("e", F.array().cast("array<string>")))) / F.size("w")
    sums = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("citing"), F.count_if(open_ & (share >= least)).alias("supported"),
        F.transform(F.array_sort(F.collect_list(F.when(open_ & (share < least), F.struct("pos", "s")))), lambda x: x["s"]).alias("unsupported"),
    )
    rows = rows.join(sums, "query_id", "left")
    none = (F.col("answer") != "") & (F.col("n") > 0) & F.col("citing").isNull()
    line = lambda x: F.concat(F.lit("- ["), x["idx"].cast("string"), F.lit("] 《"), x["document"], F.lit("》"), F.when(F.coalesce(x["heading"], F.lit("")) != "", F.concat(F.lit("（"), x["heading"], F.lit("）"))).otherwise(""))
    listed = F.concat_ws("\n", "answer", F.lit(""), F.lit(REFERENCES), F.array_join(F.transform("first", line), "\n"))
    ratio = F.when((F.col("n") > 0) & F.col("citing").isNotNull(), F.round(F.col("supported") / F.col("citing"), 4)).otherwise(0.0)
    return rows.select(
        "query_id",
        F.when(none & ~F.col("answer").contains(REFERENCES), listed).otherwise(F.col("answer")).alias("answer"),
        F.when(none, F.sequence(F.lit(1), F.least(F.lit(3), F.col("n").cast("int")))).otherwise(F.col("used")).alias("used"),
        "invalid",
        F.coalesce(F.when(F.col("n") > 0, F.col("unsupported")), F.array().cast("array<string>")).alias("unsupported"),
        ratio.alias("grounded_ratio"),
        (ratio >= 0.5).alias("grounded"),
    )


def citations(used: DataFrame, evidence: DataFrame, most: int = 800) -> DataFrame:
    """query_id, idx, document, content (up to `most` characters) of what an answer uses (query_id, used), or of the first three."""
    rows = evidence.join(used.select("query_id", "used"), "query_id")
    wanted = F.when(F.size("used") > 0, F.array_contains("used", F.col("idx"))).otherwise(F.col("idx") <= 3)
    return rows.filter(wanted).select("query_id", "idx", "document", F.substring("content", 1, most).alias("content"))


def _candidates(evidence: DataFrame) -> DataFrame:
    rows = evidence.select("query_id", "idx", "document", F.posexplode(sentences(F.col("content"))).alias("pos", "s"))
    rows = rows.withColumn("s", F.regexp_replace(F.regexp_replace("s", r"^[#\-*+>| \t]+", ""), r"^\s+|\s+$", ""))
    return rows.filter((F.length("s") >= 6) & (F.length(F.regexp_replace("s", r"[\s#>*\-|]", "")) >= 6))


def extract_answers(questions: DataFrame, evidence: DataFrame, most: int = 5) -> DataFrame:
    """query_id, idx, document, sentence, score of the sentences that answer: at most `most` different ones per question.

    questions: query_id, q. A word weighs ln((n + 1) / (sentences with it + 1)) + 0.1 among the question's n candidate
    sentences; a sentence's score is the weight of the question's words in it over that of all. Where no sentence shares
    a word, the first one of each of the first two pieces of evidence stands in with score 0, provided that any sentence
    of the evidence has words; else the question has no row.
    """
    rows = _candidates(evidence).withColumn("w", F.array_distinct(tokens(F.col("s"))))
    worded = rows.filter(F.size("w") > 0)
    n = worded.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("q")))).alias("t"))
    hits = worded.select("query_id", "idx", "pos", F.explode("w").alias("t")).join(asked, ["query_id", "t"])
    weight = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 0.1
    terms = asked.join(hits.groupBy("query_id", "t").agg(F.count(F.lit(1)).alias("df")), ["query_id", "t"], "left").join(n, "query_id").select("query_id", "t", weight.alias("x"))
    whole = terms.groupBy("query_id").agg(F.sum("x").alias("whole"))
    scores = hits.join(terms, ["query_id", "t"]).groupBy("query_id", "idx", "pos").agg(F.sum("x").alias("got")).join(whole, "query_id")
    scored = worded.join(scores, ["query_id", "idx", "pos"]).select("query_id", "idx", "pos", "document", "s", F.round(F.col("got") / F.when(F.col("whole") == 0, 1.0).otherwise(F.col("whole")), 6).alias("score"))
    # Of equal sentences the best, of equal scores the earlier place.
    one = Window.partitionBy("query_id", "s").orderBy(F.desc("score"), "idx", "pos")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "idx", "pos")
    picked = scored.withColumn("r", F.row_number().over(one)).filter("r = 1").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).drop("r")
    # Without any sentence that has words, there is no material, and nothing stands in.
    first = rows.filter("idx <= 2").join(n.select("query_id"), "query_id", "left_semi").join(picked.select("query_id").distinct(), "query_id", "left_anti").groupBy("query_id", "idx")
    first = first.agg(F.min_by(F.struct("pos", "document", "s"), "pos").alias("x")).select("query_id", "idx", "x.pos", "x.document", "x.s", F.lit(0.0).alias("score"))
    return picked.unionByName(first).select("query_id", "idx", "document", F.col("s").alias("sentence"), "score")


def compared_answers(evidence: DataFrame, most: int = 3) -> DataFrame:
    """query_id, document, idx, sentence: the longest sentence of each piece of evidence, the first `most` per document."""
    rows = evidence.select("query_id", "idx", "document", F.posexplode(sentences(F.col("content"))).alias("pos", "s"))
    best = rows.groupBy("query_id", "document", "idx").agg(F.max_by("s", F.struct(F.length("s"), -F.col("pos"))).alias("sentence"))
    order = Window.partitionBy("query_id", "document").orderBy("idx")
    return best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")


def evidence_block(idx: Column, document: Column, heading: Column) -> Column:
    return F.concat(F.lit("["), idx.cast("string"), F.lit("] 文档："), document, F.lit("｜章节："), F.coalesce(heading, F.lit("无章节")))


def parsed_block(block: Column) -> Column:
    """struct(idx, document, heading) of the head of a piece of evidence, as `evidence_block` makes it."""
    part = lambda i: F.regexp_extract(block, r"^\[(\d+)\] 文档：(.*?)｜章节：([^\n]*)", i)
    return F.struct(part(1).cast("int").alias("idx"), part(2).alias("document"), part(3).alias("heading"))


def has_material(best: Column, least: float = 0.2) -> Column:
    return F.coalesce(best >= least, F.lit(False))


def reflect(questions: DataFrame, checked: DataFrame, evidence: DataFrame, least_coverage: float = 0.6, least_grounded: float = 0.5, queries: int = 3) -> DataFrame:
    """query_id, coverage, missing, risk, sufficient, score, follow_up of answers checked by `verify`.

    coverage: the share of the question's aspects that occur in any evidence. An answer is a risk if it isn't grounded,
    has unsupported sentences, claims that there is no material, or falls below `least_grounded`; it is sufficient if it
    is none and the coverage is reached. follow_up: what is missing, or the first five words of unsupported sentences.
    """
    parts = evidence.select("query_id", F.lower("content").alias("low"), F.lit(1).alias("has"))
    own = questions.select("query_id", F.posexplode_outer(aspects(F.col("q"))).alias("pos", "a"))
    met = own.join(parts, "query_id", "left").groupBy("query_id", "pos", "a").agg(F.bool_or(F.col("low").contains(F.col("a"))).alias("met"), F.max("has").alias("has"))
    sums = met.groupBy("query_id").agg(
        F.count("a").alias("n"), F.count_if("met").alias("hit"), F.max("has").alias("has"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull() & ~F.coalesce("met", F.lit(False)), F.struct("pos", "a")))), lambda x: x["a"]).alias("missing"),
    )
    share = F.when(F.col("has").isNull(), 0.0).when(F.col("n") == 0, 1.0).otherwise(F.col("hit") / F.col("n"))
    rows = sums.withColumn("coverage", share).join(checked, "query_id")
    risk = F.col("has").isNull() | ~F.col("grounded") | F.col("answer").contains(NO_MATERIAL) | (F.size("unsupported") > 0) | (F.col("grounded_ratio") < least_grounded)
    keywords = F.transform(F.slice("unsupported", 1, queries), lambda s: F.array_join(F.slice(tokens(s), 1, 5), " "))
    follow = F.when(F.col("has").isNull(), F.array().cast("array<string>")).when(F.size("missing") > 0, F.slice("missing", 1, queries)).otherwise(F.array_distinct(F.filter(keywords, lambda x: x != "")))
    score = F.when(F.col("has").isNull(), 0.0).otherwise(F.round(F.least(F.when(F.col("grounded"), F.col("grounded_ratio")).otherwise(0.0), F.col("coverage")), 4))
    return rows.select("query_id", F.round("coverage", 4).alias("coverage"), "missing", risk.alias("risk"), (~risk & (F.col("coverage") >= least_coverage)).alias("sufficient"), score.alias("score"), follow.alias("follow_up"))


def merge_verdicts(rule: DataFrame, other: DataFrame) -> DataFrame:
    """Two verdicts (query_id, sufficient, risk, score, missing, follow_up) as one, which is sufficient only if both are."""
    a, b = rule.alias("a"), other.alias("b")
    either = lambda x, y, c: F.when(F.size(f"{x}.{c}") > 0, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(c)
    return a.join(b, F.col("a.query_id") == F.col("b.query_id")).select(
        "a.query_id", (F.col("a.sufficient") & F.col("b.sufficient")).alias("sufficient"), (F.col("a.risk") | F.col("b.risk")).alias("risk"), "a.score", either("a", "b", "missing"), either("b", "a", "follow_up")
    )


def within_chars(evidence: DataFrame, most: int = 12_000) -> DataFrame:
    """The evidence (query_id, idx, content) by rank while its characters stay within `most`; the first always."""
    total = F.sum(F.length("content")).over(Window.partitionBy("query_id").orderBy("idx"))
    return evidence.withColumn("total", total).filter((F.col("total") <= most) | (F.col("idx") == 1)).drop("total")


def supplement(seen: DataFrame, found: DataFrame, least: float = 0.2) -> DataFrame:
    """What a further search found (query_id, doc_id, relevance) that wasn't seen before and is relevant enough."""
    return found.join(seen, ["query_id", "doc_id"], "left_anti").filter(F.col("relevance") >= least)


def merged(hits: DataFrame, k: int) -> DataFrame:
    """Of several searches (query_id, doc_id, score) the best score of each document, and the best k."""
    best = hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def compare_targets(question: Column) -> Column:
    """Up to three things that a question compares, of 2 to 24 characters each."""
    core = F.regexp_replace(F.regexp_replace(question, COMPARE, " "), FILLERS, " ")
    edge = lambda x, chars: F.regexp_replace(x, f"^[{chars}]+|[{chars}]+$", "")
    clean = lambda x: F.trim(edge(F.regexp_replace(edge(F.trim(x), "?？。！!，,、 　"), ASKING_END, ""), "的了呢吗么?？。！!，,、 　"))
    return F.slice(F.filter(F.transform(F.split(core, BETWEEN), clean), lambda x: (F.length(x) > 1) & (F.length(x) <= 24)), 1, 3)


def extract_memories(question: Column) -> Column:
    """Up to three different statements that users make of themselves: struct(category, content, importance)."""

    def of(pattern: str, category: str, importance: float, before: str) -> Column:
        bodies = F.transform(F.regexp_extract_all(question, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, "^[ ，,。.、]+|[ ，,。.、]+$", ""))
        named = lambda x: F.struct(F.lit(category).alias("category"), F.concat(F.lit(before), x).alias("content"), F.lit(importance).alias("importance"))
        return F.transform(F.filter(bodies, lambda x: F.length(x) >= 2), named)

    every = F.concat(*[of(*rule) for rule in MEMORY_RULES])
    fresh = F.filter(every, lambda x: F.array_position(F.transform(every, lambda y: y["content"]), x["content"]) == F.array_position(every, x))
    return F.slice(F.array_distinct(fresh), 1, 3)


def normal_memory(category: Column, content: Column, importance: Column) -> Column:
    """A proposed memory within bounds: known category or fact, importance 0 to 1, at most 200 characters; null under two."""
    kind = F.lower(F.trim(F.coalesce(category, F.lit("fact"))))
    text = F.trim(F.coalesce(content, F.lit("")))
    cut = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 199), F.lit("…"))).otherwise(text)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(importance, F.lit(0.5))))
    return F.when(F.length(text) >= 2, F.struct(F.when(kind.isin("preference", "interest", "fact", "scenario"), kind).otherwise("fact").alias("category"), cut.alias("content"), value.alias("importance")))


def recall(asked: DataFrame, memories: DataFrame, k: int = 5) -> DataFrame:
    """query_id, memory_id, value, rank: a user's best k active memories by importance, likeness and use.

    asked: query_id, user_id, qv; memories: user_id, memory_id, importance, hits, active, v.
    """
    from corpusloom.functions.text import cosine

    near = F.when(F.size("qv") == F.size("v"), F.greatest(F.lit(0.0), cosine(F.col("qv"), F.col("v")))).otherwise(0.0)
    value = 0.55 * F.col("importance") + 0.45 * near + 0.01 * F.least("hits", F.lit(5))
    rows = asked.join(memories.filter("active"), "user_id").select("query_id", "memory_id", F.round(value, 6).alias("value"))
    order = Window.partitionBy("query_id").orderBy(F.desc("value"), "memory_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
