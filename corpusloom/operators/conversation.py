"""Conversation memory, query understanding and grounding checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens, truncate

# The rule planner's patterns, in order of precedence, and the words that refer back.
CHITCHAT = "^(你好|您好|hi|hello|hey|嗨|哈喽|在吗|在不在|早上好|晚上好|下午好|谢谢|多谢|感谢|再见|拜拜|你是谁|你叫什么)"
KB_STATS = "(知识库|库|文档|文件|资料).{0,6}(统计|数量|多少|几个|多大)|(统计|多少).{0,6}(文档|文件|片段|知识)"
COMPARE = r"(对比|比较|区别|差异|异同|优劣|优缺点|哪个更好|哪个好|相比|vs\.?|VS)"
SUMMARIZE = "(总结|摘要|概括|归纳|要点|大纲|思维导图|梳理|提炼|讲了什么|说了什么|主要讲)"
COMPLEX = "(并且|同时|还有|以及|另外|然后|分别|各自|既.{0,12}又)"
PRONOUNS = ("它", "他", "她", "这个", "那个", "该", "上述", "上面", "前面", "其", "此", "这些", "那些")
MEMORY_HINT = "我|咱|本人|记住|记一下|记下|以后|下次|今后|之后|偏好|习惯|常用|喜欢|研究|关注|正在学|需要学"


def intent(question: Column) -> Column:
    """Intent by rules: chitchat, kb_stats, compare, summarize, complex_qa or simple_qa."""
    text = F.trim(F.coalesce(question, F.lit("")))
    clauses = F.size(F.filter(F.split(text, "[？?]"), lambda x: F.trim(x) != ""))
    commas = F.length(text) - F.length(F.translate(text, "，,", ""))
    hard = (F.length(text) > 45) | (clauses >= 2) | text.rlike(COMPLEX) | (commas >= 3)
    return (
        F.when((text == "") | ((F.length(text) <= 20) & text.rlike(CHITCHAT)), "chitchat")
        .when(text.rlike(KB_STATS), "kb_stats")
        .when(text.rlike(COMPARE), "compare")
        .when(text.rlike(SUMMARIZE), "summarize")
        .when(hard, "complex_qa")
        .otherwise("simple_qa")
    )


def clauses(question: Column) -> Column:
    """Sub-questions of a complex question: clauses of four characters or more, if there are two; at most four."""
    parts = F.transform(F.split(question, "[？?；;]|并且|以及|同时|还有|另外|然后"), lambda x: F.regexp_replace(x, "^[，,。. 　]+|[，,。. 　]+$", ""))
    parts = F.filter(parts, lambda x: F.length(x) >= 4)
    return F.when(F.size(parts) >= 2, F.slice(parts, 1, 4)).otherwise(F.array().cast("array<string>"))


def aspects(question: Column) -> Column:
    return F.array_distinct(F.filter(tokens(question), lambda x: F.length(x) >= 2))


def coverage(question: Column, evidence: Column) -> Column:
    """The share of the aspects that occur in the evidence; 1 without aspects, 0 without evidence."""
    own = aspects(question)
    found = F.size(F.filter(own, lambda x: F.lower(evidence).contains(x)))
    return F.when(F.coalesce(evidence, F.lit("")) == "", 0.0).when(F.size(own) == 0, 1.0).otherwise(found / F.size(own))


def history(messages: DataFrame, turns: int = 6) -> DataFrame:
    """The last 2 * turns messages of each conversation, numbered from the newest."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= 2 * turns)


def rolling_summary(messages: DataFrame, trigger: int = 12, least: int = 4) -> DataFrame:
    """conv_id, summary of conversations of more than `trigger` messages: the older user and assistant messages, if at least
    `least`; the last six of them as "role：text" joined by "；", at most 300 characters."""
    ranked = messages.select("*", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("back"))
    old = ranked.filter((F.col("back") > trigger) & F.col("role").isin("user", "assistant"))
    old = old.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    last = old.filter((F.col("n") >= least) & (F.col("r") <= 6)).groupBy("conv_id")
    last = last.agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit("："), "text").alias("m")))).alias("ms"))
    return last.select("conv_id", F.substring(F.array_join(F.transform("ms", lambda x: x["m"]), "；"), 1, 300).alias("summary"))


def rewrite(messages: DataFrame, pronouns=PRONOUNS, most: int = 16) -> DataFrame:
    """conv_id, turn, question of every user message; one of at most `most` characters with a pronoun gets the user message before it in front."""
    users = messages.filter("role = 'user'")
    before = F.trim(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    refers = (F.length("text") <= most) & F.col("text").rlike("|".join(pronouns)) & (F.coalesce(before, F.lit("")) != "") & (before != F.col("text"))
    return users.select("conv_id", "turn", F.when(refers, F.concat_ws(" ", F.substring(before, 1, 80), "text")).otherwise(F.col("text")).alias("question"))


def memory_worthy(question: Column) -> Column:
    return F.coalesce(question.rlike(MEMORY_HINT), F.lit(False))


def evict(memories: DataFrame, most: int = 60) -> DataFrame:
    """user_id, memory_id, active: the best `most` of a user by importance + 0.02 * min(hits, 10), then by age."""
    value = F.col("importance") + 0.02 * F.least("hits", F.lit(10))
    order = Window.partitionBy("user_id").orderBy(F.desc(value), F.desc("updated_at"), "memory_id")
    return memories.select("user_id", "memory_id", (F.row_number().over(order) <= most).alias("active"))


def grounding(answers: DataFrame) -> DataFrame:
    """query_id, overlap, supported of rows query_id, answer, evidence: the share of the answer's terms found in the evidence, and whether it is 0.25 or more."""
    own = F.array_distinct(tokens(F.col("answer")))
    share = F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, tokens(F.col("evidence")))) / F.size(own))
    return answers.select("query_id", "doc_id", F.round(share, 6).alias("overlap")).withColumn("supported", F.col("overlap") >= 0.25)


def preview(text: Column, most: int = 120) -> Column:
    return truncate(F.translate(text, "\n", " "), most)
