"""Queries whose rows take every branch of the small operators, with the constants that these have by default, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers as A
from corpusloom.operators import contexts as X
from corpusloom.operators import conversation as C
from corpusloom.operators import corpus as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import index as I
from corpusloom.operators import search as S
from corpusloom.operators import tables as B
from corpusloom.plans.catalogue import _BM25, _CHUNKS, _EVIDENCE, _SEARCH, QUERIES, SQL, _evidence, query  # noqa: F401
from corpusloom.plans.catalogue import daily_counts, search_shortlist
from corpusloom.sources import load as L

_INTENTS = ("你好，", "知识库里有多少文档 ", "对比这两个 ", "总结一下 ", "其一，其二，其三，其四 ", "为什么？怎么办？", "并且 ", "问 ")


def _asked(t):
    """Every user message behind a phrase of one of the kinds of question, cut to 24 characters or whole."""
    n = F.col("conv_id") + F.col("turn")
    phrase = F.element_at(F.array(*map(F.lit, _INTENTS)), (n % len(_INTENTS) + 1).cast("int"))
    return t("conversations").select("conv_id", "turn", F.concat(phrase, F.when(n % 3 == 0, F.col("text")).otherwise(F.substring("text", 1, 12))).alias("text"))


_ASKED = "a AS (SELECT conv_id, turn, [" + ", ".join(f"'{x}'" for x in _INTENTS) + f"][(conv_id + turn) % {len(_INTENTS)} + 1] || CASE WHEN (conv_id + turn) % 3 = 0 THEN text ELSE left(text, 12) END AS text FROM conversations)"


@query(f"""WITH {_ASKED} SELECT conv_id, turn, CASE WHEN trim(text) = '' OR (len(text) <= 20 AND regexp_matches(text, '{C.CHITCHAT}')) THEN 'chitchat' WHEN regexp_matches(text, '{C.KB_STATS}') THEN 'kb_stats'
WHEN regexp_matches(text, '{C.COMPARE}') THEN 'compare' WHEN regexp_matches(text, '{C.SUMMARIZE}') THEN 'summarize'
WHEN len(trim(text)) > 45 OR regexp_matches(text, '{C.COMPLEX}') OR length(regexp_replace(text, '[^,，]', '', 'g')) >= 3 OR len(list_filter(string_split_regex(text, '[?？]'), lambda x: trim(x) <> '')) >= 2 THEN 'complex_qa' ELSE 'simple_qa' END AS intent FROM a""")
def question_intents(t):
    return _asked(t).select("conv_id", "turn", C.intent(F.col("text")).alias("intent"))


@query(f"""WITH {_ASKED}, p AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[？?；;]|并且|以及|同时|还有|另外|然后'), lambda x: regexp_replace(x, '^[，,。. 　]+|[，,。. 　]+$', '', 'g')), lambda x: len(x) >= 4) AS p FROM a)
SELECT conv_id, turn, CASE WHEN len(p) >= 2 THEN array_to_string(p[1:4], '|') ELSE '' END AS parts FROM p""")
def question_clauses(t):
    return _asked(t).select("conv_id", "turn", F.array_join(C.clauses(F.col("text")), "|").alias("parts"))


@query(f"""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN left(text, 10) || '它' WHEN turn % 3 = 1 THEN '前面' || left(text, 30) ELSE text END AS text FROM conversations WHERE role = 'user'),
u AS (SELECT *, trim(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS before FROM m)
SELECT conv_id, turn, CASE WHEN len(text) <= 16 AND regexp_matches(text, '{"|".join(C.PRONOUNS)}') AND coalesce(before, '') <> '' AND before <> text THEN left(before, 80) || ' ' || text ELSE text END AS question FROM u""")
def rewrite_questions(t):
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.substring("text", 1, 10), F.lit("它"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("前面"), F.substring("text", 1, 30))).otherwise(F.col("text"))
    return C.rewrite(t("conversations").withColumn("text", said))


@query("""WITH c AS (SELECT conv_id % 10 AS conv_id, conv_id * 1000 + turn AS turn, role, text FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM r WHERE back > 12 AND role IN ('user', 'assistant'))
SELECT conv_id, left(string_agg(role || '：' || text, '；' ORDER BY turn), 300) AS summary FROM o WHERE n >= 4 AND r <= 6 GROUP BY 1""")
def long_summaries(t):
    """Summaries with the default constants, of conversations long enough for them."""
    rows = t("conversations").select((F.col("conv_id") % 10).alias("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), "role", "text")
    return C.rolling_summary(rows)


@query(f"""SELECT conv_id, turn, coalesce(regexp_matches(text || CASE turn % 4 WHEN 0 THEN '记住' WHEN 1 THEN ' 以后 ' ELSE '' END, '{C.MEMORY_HINT}'), false) AS worthy FROM conversations""")
def memory_hints(t):
    said = F.concat("text", F.when(F.col("turn") % 4 == 0, "记住").when(F.col("turn") % 4 == 1, " 以后 ").otherwise(""))
    return t("conversations").select("conv_id", "turn", C.memory_worthy(said).alias("worthy"))


@query("""SELECT user_id, event_id AS memory_id, row_number() OVER (PARTITION BY user_id ORDER BY value / 97 + 0.02 * least(event_id % 17, 10) DESC, ts DESC, event_id) <= 60 AS active FROM events""")
def memory_eviction(t):
    rows = t("events").select("user_id", F.col("event_id").alias("memory_id"), (F.col("value") / 97).alias("importance"), (F.col("event_id") % 17).alias("hits"), F.col("ts").alias("updated_at"))
    return C.evict(rows)


_HITS = "hits AS (SELECT doc_id % 7 AS query_id, doc_id, ordinal, round(1 / (ordinal + 2 + doc_id % 3), 6) AS score, round(1 / (ordinal + 3), 6) AS relevance FROM c WHERE ordinal % 5 = 1)"


def _hits(t):
    """Every fifth chunk as a hit of one of seven queries."""
    chunks = D.packed_chunks(t("documents"))
    score, relevance = F.round(1 / (F.col("ordinal") + 2 + F.col("doc_id") % 3), 6), F.round(1 / (F.col("ordinal") + 3), 6)
    return chunks.filter("ordinal % 5 = 1").select((F.col("doc_id") % 7).alias("query_id"), "doc_id", "ordinal", score.alias("score"), relevance.alias("relevance")), chunks


@query(f"""WITH {_CHUNKS}, {_HITS}, n AS (SELECT DISTINCT query_id, doc_id, ordinal + d AS ordinal FROM hits, (VALUES (-1), (0), (1)) v(d))
SELECT * FROM hits UNION ALL SELECT query_id, doc_id, ordinal, 0.05, 0.0 FROM n JOIN c USING (doc_id, ordinal) WHERE (query_id, doc_id, ordinal) NOT IN (SELECT (query_id, doc_id, ordinal) FROM hits)""")
def hit_neighbours(t):
    return X.with_neighbours(*_hits(t))


@query(f"""WITH {_CHUNKS}, {_HITS}, f0 AS (SELECT query_id, doc_id, max(score) AS best FROM hits GROUP BY 1, 2), f AS (SELECT query_id, doc_id FROM f0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best DESC, doc_id) <= 2),
w AS (SELECT doc_id, ordinal, sum(n_chars) OVER (PARTITION BY doc_id ORDER BY ordinal) AS total FROM c)
SELECT * FROM hits UNION ALL SELECT query_id, doc_id, ordinal, 0.95, 0.0 FROM f JOIN w USING (doc_id) WHERE (total <= 9000 OR ordinal = 0) AND (query_id, doc_id, ordinal) NOT IN (SELECT (query_id, doc_id, ordinal) FROM hits)""")
def summary_evidence(t):
    return X.for_summary(*_hits(t))


@query(f"""WITH {_CHUNKS}, {_HITS}, lt AS (SELECT query_id, doc_id, ordinal + ordinal % 2 AS ordinal, score, round(relevance + 0.01, 6) AS relevance FROM hits),
a AS (SELECT *, 0 AS late FROM hits UNION ALL SELECT *, 1 FROM lt WHERE (query_id, doc_id, ordinal) NOT IN (SELECT (query_id, doc_id, ordinal) FROM hits))
SELECT query_id, doc_id, ordinal, score, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, late, score DESC, doc_id, ordinal) AS place FROM a""")
def later_evidence(t):
    hits, _ = _hits(t)
    later = hits.withColumn("ordinal", F.col("ordinal") + F.col("ordinal") % 2).withColumn("relevance", F.round(F.col("relevance") + 0.01, 6))
    return X.with_later(hits, later)


_CASES = "cs AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'src' ELSE 'no such' END AS document, CASE WHEN item_id % 4 = 0 THEN [] ELSE ['@@', substr(text, 6, 9)] END AS keywords FROM benchmark)"


@query(f"""WITH {_BM25}, {_CASES}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h),
f AS (SELECT r.query_id, min(rank) AS rank FROM r JOIN cs USING (query_id) JOIN documents d USING (doc_id) WHERE rank <= 6 AND (document IS NULL OR contains('src ' || d.source, document))
  AND (len(keywords) = 0 OR len(list_filter(keywords, lambda x: contains(d.text, x))) > 0) GROUP BY 1)
SELECT query_id, rank FROM cs LEFT JOIN f USING (query_id)""")
def golden_cases(t):
    """The rank of the first hit that each case's document and keywords fit."""
    words = F.when(F.col("item_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("@@"), F.substring("text", 6, 9)))
    document = F.when(F.col("item_id") % 3 == 1, "src").when(F.col("item_id") % 3 == 2, "no such")
    cases = t("benchmark").select(F.col("item_id").alias("query_id"), document.alias("document"), words.alias("keywords"))
    hits = I.bm25(t("benchmark"), t("documents"), 6).select("query_id", "doc_id", "rank")
    hits = hits.join(t("documents").select("doc_id", F.concat(F.lit("src "), "source").alias("name"), F.col("text").alias("content")), "doc_id")
    return E.case_ranks(hits, cases)


_PARTS = "(SELECT (item_id * 100 + i)::BIGINT AS item_id, p AS text FROM (SELECT item_id, unnest(string_split(text, ',')) AS p, unnest(range(len(string_split(text, ',')))) AS i FROM benchmark) WHERE trim(p) <> '') benchmark"


@query(f"""WITH {_BM25.replace("FROM benchmark", "FROM " + _PARTS)}, r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 6),
m AS (SELECT query_id // 100 AS question_id, doc_id, max(score) AS score FROM r GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM m QUALIFY rank <= 6""")
def sub_question_search(t):
    """Every part of a question between commas is searched by itself; a document counts with its best score."""
    parts = t("benchmark").select("item_id", F.posexplode(F.split("text", ",")).alias("i", "text")).filter("trim(text) <> ''")
    parts = parts.select((F.col("item_id") * 100 + F.col("i")).alias("item_id"), "text", F.col("item_id").alias("question_id"))
    hits = I.bm25(parts, t("documents"), 6).select("query_id", "doc_id", "score")
    return S.search_many(hits, parts.select("question_id", F.col("item_id").alias("query_id")))


_URLS = ("https://", "http://user@", "ftp://", "HTTPS://a.localhost/", "https://x.internal./", "https:///", "http://b.local:80/", "https://c.home.arpa?", "")


@query("WITH u AS (SELECT page_id, [" + ", ".join(f"'{x}'" for x in _URLS) + f"""][page_id % {len(_URLS)} + 1] || CASE WHEN page_id % {len(_URLS)} = 8 THEN '' ELSE regexp_replace(url, '^[a-z]+://', '') END AS url FROM pages)
SELECT page_id, CASE page_id % {len(_URLS)} WHEN 1 THEN 'userinfo' WHEN 2 THEN 'scheme' WHEN 3 THEN 'blocked host' WHEN 4 THEN 'blocked host' WHEN 5 THEN 'no host' WHEN 6 THEN 'blocked host' WHEN 7 THEN 'blocked host' WHEN 8 THEN 'empty' ELSE 'ok' END AS verdict FROM u""")
def url_guard_branches(t):
    """URLs that are refused for each of the reasons."""
    front = F.element_at(F.array(*map(F.lit, _URLS)), (F.col("page_id") % len(_URLS) + 1).cast("int"))
    url = F.concat(front, F.when(F.col("page_id") % len(_URLS) == 8, "").otherwise(F.regexp_replace("url", "^[a-z]+://", "")))
    return t("pages").select("page_id", L.url_verdict(url).alias("verdict"))


_HOSTS = {"10.0.0.1": False, "8.8.8.8": True, "[::1]": False, "::ffff:192.168.1.1": False, "2001:4860:4860::8888": True, "example.com": True, "169.254.1.1": False, "::ffff:8.8.4.4": True}


@query("SELECT page_id, [" + ", ".join(str(x).lower() for x in _HOSTS.values()) + f"][page_id % {len(_HOSTS)} + 1] AS allowed FROM pages")
def address_guard(t):
    host = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("page_id") % len(_HOSTS) + 1).cast("int"))
    return t("pages").select("page_id", L.address_allowed(host).alias("allowed"))


@query(r"""SELECT doc_id, sha1(text) AS sha1, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ') AS squashed, left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 200) AS preview, doc_id % 4 = 0 AS cjk,
round(1 / (1 + exp(-(n_chars % 11 - 5.0))), 6) AS sigmoid, CASE WHEN text = '' THEN 0.0 ELSE round(len(list_intersect(list_distinct(string_split(text, '')), string_split('the end of it', ''))) / len(list_distinct(string_split(text, ''))), 6) END AS overlap FROM documents WHERE n_chars > 0""")
def text_scalars(t):
    text = F.col("text")
    cjk = T.contains_cjk(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "字").otherwise("")))
    return t("documents").filter("n_chars > 0").select("doc_id", F.sha1("text").alias("sha1"), T.squash_spaces(text).alias("squashed"), F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 200).alias("preview"), cjk.alias("cjk"), F.round(T.sigmoid(F.col("n_chars") % 11 - F.lit(5.0)), 6).alias("sigmoid"), F.round(T.char_overlap(text, F.lit("the end of it")), 6).alias("overlap"))


@query(r"""WITH d AS (SELECT doc_id, text || chr(10) || CASE doc_id % 5 WHEN 0 THEN '- 12 -' WHEN 1 THEN '第 3 页' WHEN 2 THEN '7/20' WHEN 3 THEN 'page 4' ELSE '123456' END AS text FROM documents)
SELECT doc_id, len(string_split(text, chr(10)))::INT - 1 AS pos, list_last(string_split(text, chr(10))) AS line FROM d WHERE doc_id % 5 < 3""")
def page_number_lines(t):
    """Documents with a last line that is a page number, or nearly one."""
    last = F.element_at(F.array(*map(F.lit, ("- 12 -", "第 3 页", "7/20", "page 4", "123456"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return D.page_numbers(t("documents").select("doc_id", F.concat("text", F.lit("\n"), last).alias("text")))


@query("""WITH b AS (SELECT doc_id % 9 AS q, '[' || (doc_id % 4 + 1) || '] 文档：' || source || '｜章节：' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE '无章节' END AS block, (doc_id % 4 + 1)::INT AS idx, source AS document, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '无章节' END AS heading, doc_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
SELECT doc_id, block, idx, document, heading FROM b""")
def evidence_blocks(t):
    """Heads of pieces of evidence as they stand in a prompt, and what is read from them again."""
    rows = t("documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    block = A.evidence_block((F.col("doc_id") % 4 + 1).cast("int"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return rows.select("doc_id", block.alias("block")).select("doc_id", "block", A.parsed_block(F.col("block")).alias("p")).select("doc_id", "block", "p.*")


@query("""WITH m AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY 1), s AS (SELECT conv_id, 'sum ' || conv_id AS summary, last AS upto, n, conv_id % 4 = 1 AS cleared, conv_id % 4 = 2 AS touched FROM m)
SELECT conv_id, CASE WHEN cleared THEN NULL WHEN touched THEN 'new' ELSE summary END AS summary, CASE WHEN cleared THEN 0 WHEN touched THEN upto + 1 ELSE upto END AS summarized_upto, CASE WHEN cleared THEN 0 ELSE n END AS message_count,
CASE WHEN cleared OR touched THEN 9 ELSE 1 END AS updated_at, CASE WHEN touched THEN left('title ' || repeat('x', 300), 200) ELSE 't' END AS title FROM s""")
def session_updates(t):
    """Every fourth session is cleared, every fourth gets a title, a summary and how far it goes."""
    rows = t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"), F.max("turn").alias("summarized_upto"))
    sessions = rows.select("conv_id", F.lit("t").alias("title"), F.concat(F.lit("sum "), "conv_id").alias("summary"), "summarized_upto", "message_count", F.lit(1).alias("updated_at"))
    touched = sessions.filter("conv_id % 4 = 2").select("conv_id", F.concat(F.lit("title "), F.repeat(F.lit("x"), 300)).alias("title"), F.lit("new").alias("summary"), (F.col("summarized_upto") + 1).alias("summarized_upto"), F.lit(9).alias("updated_at"))
    return B.sessions_cleared(B.sessions_touched(sessions, touched), sessions.filter("conv_id % 4 = 1").select("conv_id", F.lit(9).alias("updated_at")))


@query(f"WITH {_CHUNKS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ordinal, a::BIGINT AS start, n::INT AS n_chars FROM e WHERE n > 0")
def sentence_offsets(t):
    return D.sentence_offsets(t("documents")).select("doc_id", "ordinal", "start", "n_chars")


@query(_SEARCH + " SELECT query_id, count(*) AS n, round(max(relevance), 4) AS relevance FROM sl GROUP BY 1")
def search_summary(t):
    """How many pieces of evidence every question finds, and how relevant the best is."""
    found = search_shortlist(t)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("relevance"), 4).alias("relevance"))


@query(f"""{_EVIDENCE}, t AS (SELECT *, sum(len(content)) OVER (PARTITION BY query_id ORDER BY idx) AS total FROM ev) SELECT query_id, idx, document, md5(content) AS content FROM t WHERE total <= 8000 OR idx = 1""")
def reflection_evidence(t):
    """What a check of an answer reads: evidence by rank within 8000 characters, the first always."""
    return A.within_chars(_evidence(t)[1], 8000).select("query_id", "idx", "document", F.md5("content").alias("content"))


@query("SELECT p.event_id AS asked, e.event_id, user_id, event_type FROM (SELECT DISTINCT event_id * 7 AS event_id FROM events WHERE event_id % 11 = 0) p LEFT JOIN events e USING (event_id)")
def point_lookups(t):
    """Rows by their key, for keys of which some aren't there."""
    keys = t("events").filter("event_id % 11 = 0").select((F.col("event_id") * 7).alias("asked")).distinct()
    rows = t("events").select("event_id", "user_id", "event_type")
    return keys.join(rows, keys["asked"] == rows["event_id"], "left").select("asked", "event_id", "user_id", "event_type")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 DAY GROUP BY 1)
SELECT 'latency' AS kind, '' AS name, round(avg(value), 1) AS value FROM events UNION ALL SELECT 'day', CAST(day AS VARCHAR), n FROM d UNION ALL SELECT 'intent', event_type, count(*) FROM events GROUP BY event_type
UNION ALL SELECT 'vectors', '', count(*) FROM embeddings UNION ALL SELECT 'documents', '', count(*) FROM documents UNION ALL SELECT 'messages', '', count(*) FROM conversations""")
def stats_overview(t):
    """Counters, mean latency, the last seven days and the mix of intents, as rows."""
    row = lambda kind, name, value, df: df.agg(value.alias("value")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col("value").cast("double").alias("value"))
    n = F.count(F.lit(1))
    days = daily_counts(t).select(F.lit("day"), F.col("day").cast("string"), F.col("n").cast("double"))
    mix = t("events").groupBy("event_type").agg(n.alias("n")).select(F.lit("intent"), "event_type", F.col("n").cast("double"))
    out = row("latency", "", F.coalesce(F.round(F.avg("value"), 1), F.lit(0.0)), t("events")).union(days).union(mix)
    return out.union(row("vectors", "", n, t("embeddings"))).union(row("documents", "", n, t("documents"))).union(row("messages", "", n, t("conversations")))
