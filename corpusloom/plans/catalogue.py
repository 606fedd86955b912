"""The queries of the corpus and retrieval operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers as A
from corpusloom.operators import conversation as C
from corpusloom.operators import corpus as D
from corpusloom.operators import index as I
from corpusloom.operators import search as S
from corpusloom.operators import structure as U
from corpusloom.operators import tables as B
from corpusloom.operators import vectors as V
from corpusloom.sources import load as L
from corpusloom.sources.snapshots import stored

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS if w.isascii())
_TOKENS = r"list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_\-'']*|[0-9]+(?:\.[0-9]+)?'), lambda x: x NOT IN (" + _STOP + "))"
_BM25 = f"""
d AS (SELECT doc_id, lang, greatest(len({_TOKENS}), 1) AS dl, {_TOKENS} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
p AS (SELECT doc_id, lang, dl, t, count(*) AS tf FROM (SELECT doc_id, lang, dl, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS})) AS t FROM benchmark),
h AS (SELECT query_id, doc_id, lang, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM q JOIN p USING (t) JOIN df USING (t), st GROUP BY ALL)
"""


def _ranked(where: str, k: int, head: str = "") -> str:
    return f"""WITH {_BM25}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h {where})
{head or 'SELECT * FROM r'} {'WHERE rank <= ' + str(k) if not head else ''}"""


@query(_ranked("", 5))
def bm25_top5(t):
    return I.bm25(t("benchmark"), t("documents"), 5).drop("matched")


@query(_ranked("WHERE lang = 'en'", 5))
def bm25_scoped_lang_en(t):
    return I.bm25(t("benchmark"), t("documents"), 5, F.col("lang") == "en").drop("matched")


@query(f"""WITH p AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents)
SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p GROUP BY term""")
def idf_table(t):
    return I.idf_table(t("documents")).withColumn("idf", F.round("idf", 6))


@query(f"SELECT count(*) AS n_docs, round(avg(greatest(len({_TOKENS}), 1)), 6) AS avgdl FROM documents")
def corpus_stats(t):
    return I.corpus_stats(t("documents")).withColumn("avgdl", F.round("avgdl", 6))


@query(f"""WITH {_BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h),
f AS (SELECT r.query_id, min(rank) AS rank FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d USING (doc_id) WHERE r.rank <= 6 AND contains(d.text, b.text) GROUP BY 1)
SELECT count(*) AS n_cases, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate, round(avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END), 6) AS top1, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr
FROM benchmark LEFT JOIN f ON f.query_id = item_id""")
def retrieval_eval(t):
    hits = I.bm25(t("benchmark"), t("documents"), 6).select("query_id", "doc_id", "rank")
    cases = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("want"))
    found = hits.join(cases, "query_id").join(t("documents").select("doc_id", "text"), "doc_id").filter(F.col("text").contains(F.col("want")))
    found = cases.join(found.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")
    share = lambda c: F.round(F.avg(c), 6)
    return found.agg(
        F.count(F.lit(1)).alias("n_cases"),
        share(F.col("rank").isNotNull().cast("int")).alias("hit_rate"),
        share((F.coalesce("rank", F.lit(0)) == 1).cast("int")).alias("top1"),
        share(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


@query(f"""WITH {_BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h),
s AS (SELECT n, ln(1 + (n + 0.5) / 0.5) AS most FROM st),
w AS (SELECT query_id, q.t, CASE WHEN df IS NULL THEN NULL ELSE ln(1 + (n - df + 0.5) / (df + 0.5)) END AS idf FROM q LEFT JOIN df USING (t), s),
a AS (SELECT query_id, coalesce(sum(idf), 0) AS known, count(*) FILTER (idf IS NULL) AS unknown, least(any_value(most), coalesce(avg(idf), 0)) AS pen FROM w, s GROUP BY 1),
m AS (SELECT r.query_id, r.doc_id, r.rank, sum(w.idf) AS got FROM r JOIN w USING (query_id) JOIN p ON p.doc_id = r.doc_id AND p.t = w.t WHERE r.rank <= 5 GROUP BY ALL)
SELECT query_id, doc_id, rank, round(got / (known + unknown * pen), 4) AS coverage FROM m JOIN a USING (query_id)""")
def idf_coverage(t):
    docs = t("documents")
    n = docs.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    hits = I.bm25(t("benchmark"), docs, 5)
    found = I.coverage(hits, I.query_terms(t("benchmark")), I.query_weights(t("benchmark"), docs), n)
    return hits.select("query_id", "doc_id", "rank").join(found, ["query_id", "doc_id"]).withColumn("coverage", F.round("coverage", 4))


@query(f"""WITH {_BM25}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h),
c AS (SELECT r.*, list_distinct(regexp_extract_all(lower(b.text), '[a-z][a-z0-9_\\-'']*|[0-9]+(?:\\.[0-9]+)?')) AS bw, b.text AS bt, d.text AS dt, dd.w AS dw, score / max(score) OVER (PARTITION BY query_id) AS s
      FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d USING (doc_id) JOIN d dd USING (doc_id) WHERE r.rank <= 20),
e AS (SELECT *, list_filter(bw, lambda x: x NOT IN ({_STOP})) AS qw FROM c),
g AS (SELECT query_id, doc_id, round(0.6 * s + 0.4 * least(1, list_sum(list_transform(qw, lambda x: CASE WHEN list_contains(dw, x) THEN len(x) ELSE 0 END)) / list_sum(list_transform(qw, lambda x: len(x)))
      + CASE WHEN contains(dt, bt) AND len(bt) >= 4 THEN 0.15 ELSE 0 END), 6) AS score FROM e)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 6""")
def lexical_rerank(t):
    hits = I.bm25(t("benchmark"), t("documents"), 20)
    scaled = hits.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    rows = scaled.join(t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id")
    rows = rows.join(t("documents").select("doc_id", "text", F.lit(None).cast("string").alias("heading")), "doc_id").withColumnRenamed("matched", "words")
    return I.top(S.rerank(rows).select("query_id", "doc_id", "score"), 6)


@query("""WITH g AS (SELECT md5(text) AS content_hash, min(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY 1)
SELECT content_hash, keep_id, n FROM g WHERE n > 1""")
def doc_exact_dups(t):
    return t("documents").groupBy(F.md5("text").alias("content_hash")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY md5(text)) THEN 'index' ELSE 'skip' END AS action FROM documents")
def doc_dup_policy(t):
    first = t("documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first"))
    rows = t("documents").select("doc_id", F.md5("text").alias("h")).join(first, "h")
    return rows.select("doc_id", F.when(F.col("doc_id") == F.col("first"), "index").otherwise("skip").alias("action"))


_SIMHASH = f"""
tk AS (SELECT doc_id, t, count(*) AS tf, ('0x' || md5(t)[1:16])::UBIGINT AS h FROM (SELECT doc_id, unnest(CASE WHEN len({_TOKENS}) = 0 AND text <> '' THEN string_split(lower(text), '') ELSE {_TOKENS} END) AS t FROM documents) GROUP BY ALL),
vt AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN tf ELSE -tf END) AS v FROM tk, range(64) AS r(b) GROUP BY ALL),
sv AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN (1::HUGEINT << b) ELSE 0 END) AS u FROM vt GROUP BY 1),
sh AS (SELECT d.doc_id, len(text) AS n_chars, (CASE WHEN coalesce(u, 0) >= (1::HUGEINT << 63) THEN u - (1::HUGEINT << 64) ELSE coalesce(u, 0) END)::BIGINT AS simhash FROM documents d LEFT JOIN sv USING (doc_id))
"""


@query(f"WITH {_SIMHASH} SELECT doc_id, simhash FROM sh")
def doc_simhash(t):
    return D.simhash(t("documents"), characters=True).select("doc_id", "simhash")


@query(f"""WITH {_SIMHASH}, p AS (SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.simhash, y.simhash)) AS distance FROM sh x JOIN sh y ON x.doc_id < y.doc_id
WHERE bit_count(xor(x.simhash, y.simhash)) <= 3 AND (x.n_chars = 0 OR y.n_chars = 0 OR abs(x.n_chars - y.n_chars) <= 0.02 * greatest(x.n_chars, y.n_chars))),
g AS (SELECT simhash, n_chars, min(doc_id) AS rep FROM sh GROUP BY ALL), r AS (SELECT doc_id, rep FROM sh JOIN g USING (simhash, n_chars))
SELECT a, b, distance::BIGINT AS distance FROM p JOIN r ra ON ra.doc_id = a JOIN r rb ON rb.doc_id = b WHERE (ra.rep = a AND rb.rep = b) OR (ra.rep = rb.rep AND ra.rep = a)""")
def doc_near_dups(t):
    return D.near_pairs(D.simhash(t("documents"), characters=True)).withColumn("distance", F.col("distance").cast("long"))


_KNN = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 50 = 0),
x AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings v ON v.vec_id <> query_id {on})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 10"""


@query(_KNN.format(on=""))
def knn_top10(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.knn(v.filter("id % 50 = 0"), v, 10)


@query(_KNN.format(on="AND v.label = 3"))
def knn_scoped_label(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return V.knn(v.filter("id % 50 = 0"), v.filter("label = 3"), 10)


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z][a-z0-9_\\-'']*|[0-9]+(?:\\.[0-9]+)?')) AS n_all, len({_TOKENS}) AS n_kept FROM documents")
def token_counts(t):
    return t("documents").select("doc_id", F.size(T.tokens(F.col("text"), True)).alias("n_all"), F.size(T.tokens(F.col("text"))).alias("n_kept"))


_PIECES = r"""regexp_extract_all(text, '[^。！？!?…；;\n]*[。！？!?…；;\n][”’」』）)\]"'']*|[^。！？!?…；;\n]+')"""
_HEAD, _TAIL = r"'^[ \t\n\x0b\f\r]+'", r"'[ \t\n\x0b\f\r]+$'"
_SENTENCES = f"list_filter(list_transform({_PIECES}, lambda x: regexp_replace(regexp_replace(x, {_HEAD}, ''), {_TAIL}, '')), lambda x: x <> '')"
_CHUNKS = f"""
r AS (SELECT doc_id, {_PIECES} AS r FROM documents),
m AS (SELECT doc_id, unnest(r) AS s, generate_subscripts(r, 1) AS i FROM r),
e AS (SELECT doc_id, i, (sum(len(s)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - len(regexp_replace(s, {_HEAD}, '')) AS a,
  len(regexp_replace(regexp_replace(s, {_HEAD}, ''), {_TAIL}, '')) AS n FROM m),
l AS (SELECT doc_id, list([{{'a': a, 'b': a + n}}] ORDER BY i) AS l FROM e WHERE n > 0 GROUP BY doc_id),
k AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN x[1].b - acc[-1].a > 600 THEN list_concat(acc, x)
  ELSE list_concat(acc[1:len(acc) - 1], [{{'a': acc[-1].a, 'b': x[1].b}}]) END) AS k FROM l),
c AS (SELECT doc_id, ordinal, x.a AS start, x.b - x.a AS n_chars FROM (SELECT doc_id, generate_subscripts(k, 1) - 1 AS ordinal, unnest(k) AS x FROM k))
"""


@query(f"SELECT doc_id, len({_SENTENCES}) AS n, md5(array_to_string({_SENTENCES}, chr(10))) AS md5 FROM documents")
def sentences(t):
    found = t("documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "\n")).alias("md5"))


_CHARS = "string_split(lower(regexp_replace(text, '[ \\t\u00a0\u3000]+', ' ', 'g')), '')"


@query(f"""WITH c AS (SELECT doc_id, {_CHARS} AS c FROM documents),
g AS (SELECT doc_id, list_concat(c, list_concat([c[i] || c[i + 1] for i in range(1, len(c))], [c[i] || c[i + 1] || c[i + 2] for i in range(1, len(c) - 1)])) AS g FROM c)
SELECT doc_id, len(g) AS n_grams, md5(array_to_string(g, chr(10))) AS md5 FROM g""")
def char_ngrams(t):
    found = t("documents").select("doc_id", T.char_ngrams(F.col("text")).alias("g"))
    return found.select("doc_id", F.size("g").cast("long").alias("n_grams"), F.md5(F.array_join("g", "\n")).alias("md5"))


@query("SELECT doc_id, CASE WHEN len(text) > 120 THEN left(replace(text, chr(10), ' '), 119) || '…' ELSE replace(text, chr(10), ' ') END AS preview FROM documents")
def truncate_preview(t):
    return t("documents").select("doc_id", C.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, CASE WHEN len(text) = 0 THEN 0 ELSE floor(0.3::DOUBLE * len(text)) + 1 END::INT AS n FROM documents")
def est_tokens(t):
    return t("documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("n"))


@query(r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents)
SELECT doc_id, line, count(*) AS n FROM l WHERE len(line) BETWEEN 1 AND 40 AND NOT regexp_matches(line, '^(#{1,6}\s|>\s|[-*+]\s|\d+[.)]\s|\||```)') GROUP BY ALL HAVING count(*) >= 3""")
def clean_repeated_lines(t):
    return D.repeated_lines(t("documents"))


@query(r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents),
c AS (SELECT *, count(*) FILTER (len(line) BETWEEN 1 AND 40 AND NOT regexp_matches(line, '^(#{1,6}\s|>\s|[-*+]\s|\d+[.)]\s|\||```)')) OVER (PARTITION BY doc_id, line) AS n FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n >= 3 OR (line <> '' AND len(line) <= 12 AND regexp_matches(line, '^\s*[-\[\(]*\s*\d{1,4}\s*(?:/\s*\d{1,4})?\s*[-\]\)]*\s*$'))) AS n_dropped FROM c GROUP BY 1""")
def clean_stats(t):
    return D.cleaned_lines(t("documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("dropped").alias("n_dropped"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<title\b[^>]*>.*?</title>', ' ', 'gis'), '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'),
 '<nav\b[^>]*>.*?</nav>', ' ', 'gis'), '<(?:footer\b[^>]*>.*?</footer|aside\b[^>]*>.*?</aside|form\b[^>]*>.*?</form)>|<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_title_text(t):
    title, text = L.html_columns(F.col("html"))
    return t("pages").select("page_id", title.alias("title"), text.alias("text"))


@query("""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^(?i)https?://') THEN 'scheme' WHEN regexp_matches(url, '^[^/]*//[^/?#]*@') THEN 'userinfo'
WHEN regexp_matches(url, '^(?i)https?://[^/?#:]*(localhost|[.]local|[.]internal)([/?#:]|$)') THEN 'blocked host' ELSE 'ok' END AS verdict FROM pages""")
def url_syntax_guard(t):
    return t("pages").select("page_id", L.url_verdict(F.col("url")).alias("verdict"))


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, sum(n_chars)::BIGINT AS n_chars FROM c GROUP BY doc_id")
def fixed_pack_chunks(t):
    chunks = D.packed_chunks(t("documents"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_chars").alias("n_chars"))


@query(f"WITH {_CHUNKS} SELECT doc_id, h.ordinal AS hit_ordinal, c.ordinal, c.n_chars FROM c JOIN c h USING (doc_id) WHERE h.ordinal = 1 AND abs(c.ordinal - h.ordinal) <= 1")
def chunk_window(t):
    chunks = D.packed_chunks(t("documents"))
    return D.chunk_window(chunks, chunks.filter("ordinal = 1").select("doc_id", "ordinal"), 1).select("doc_id", "hit_ordinal", "ordinal", "n_chars")


@query(f"WITH {_CHUNKS}, p AS (SELECT doc_id, ordinal, n_chars, (sum(n_chars) OVER (PARTITION BY doc_id ORDER BY ordinal))::BIGINT AS total FROM c) SELECT * FROM p WHERE total <= 12000 OR ordinal = 0")
def read_document_prefix(t):
    return D.read_prefix(D.packed_chunks(t("documents"))).select("doc_id", "ordinal", "n_chars", "total")


@query(f"""WITH {_SIMHASH}, l AS (SELECT list([{{'i': doc_id, 'h': simhash, 'n': n_chars}}] ORDER BY doc_id) AS l FROM sh),
k AS (SELECT list_transform(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: bit_count(xor(y.h, x[1].h)) <= 3
  AND (y.n = 0 OR x[1].n = 0 OR abs(y.n - x[1].n) <= 0.02 * greatest(y.n, x[1].n)))) > 0 THEN acc ELSE list_concat(acc, x) END), lambda x: x.i) AS k FROM l)
SELECT doc_id, list_contains(k, doc_id) AS kept FROM sh, k""")
def doc_greedy_dedup(t):
    return D.greedy_dedup(D.simhash(t("documents"), characters=True))


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 12""")
def history_last12(t):
    return C.history(t("conversations")).select("conv_id", "turn", "role", "back")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM r WHERE back > 2 AND role IN ('user', 'assistant'))
SELECT conv_id, left(string_agg(role || '：' || text, '；' ORDER BY turn), 300) AS summary FROM o WHERE n >= 2 AND r <= 6 GROUP BY 1""")
def rolling_summary(t):
    return C.rolling_summary(t("conversations"), trigger=2, least=2)


@query("""WITH u AS (SELECT *, trim(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS before FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN len(text) <= 40 AND regexp_matches(text, 'the|die|que') AND coalesce(before, '') <> '' AND before <> text THEN left(before, 80) || ' ' || text ELSE text END AS question FROM u""")
def rewrite_pronoun(t):
    return C.rewrite(t("conversations"), ("the", "die", "que"), 40)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 DAY GROUP BY 1")
def daily_counts(t):
    last = t("events").agg(F.max("ts").alias("m")).select("m").scalar()
    return t("events").filter(F.col("ts") >= last - F.expr("INTERVAL 6 DAYS")).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS intent, count(*) AS n FROM events GROUP BY 1")
def intent_mix(t):
    return t("events").groupBy(F.col("event_type").alias("intent")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "intent")


@query("SELECT coalesce(round(avg(value), 1), 0.0) AS latency FROM events")
def avg_latency(t):
    return t("events").agg(F.coalesce(F.round(F.avg("value"), 1), F.lit(0.0)).alias("latency"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_feedback(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""SELECT count(*) AS n_documents, count(*) FILTER (lang = 'en') AS n_en, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT source) AS n_sources, (SELECT count(*) FROM labels WHERE quality = 1) AS n_good FROM documents""")
def kb_stats(t):
    good = t("labels").agg(F.count_if(F.col("quality") == 1).alias("n")).select("n").scalar()
    docs = t("documents").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("lang") == "en").alias("n_en"), F.sum("n_chars").alias("n_chars"), F.countDistinct("source").alias("n_sources"))
    return docs.withColumn("n_good", good)


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(t):
    best = t("events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return best.select("user_id", "event_type", "value")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def tombstone_delete(t):
    return t("documents").join(t("labels").filter("quality = 0"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def page_of_documents(t):
    return t("documents").orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(20).select("doc_id", "source")


@query(f"""WITH {_BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h),
q2 AS (SELECT query_id, list(t) AS qw FROM q GROUP BY 1)
SELECT r.query_id, r.doc_id, round(len(list_intersect(qw, d.w)) / len(qw), 6) AS overlap, round(len(list_intersect(qw, d.w)) / len(qw), 6) >= 0.25 AS supported
FROM r JOIN q2 USING (query_id) JOIN d USING (doc_id) WHERE rank <= 3""")
def grounding_overlap(t):
    hits = I.bm25(t("benchmark"), t("documents"), 3).select("query_id", "doc_id")
    rows = hits.join(t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer")), "query_id")
    return C.grounding(rows.join(t("documents").select("doc_id", F.col("text").alias("evidence")), "doc_id"))


@query(f"""WITH {_BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h),
q2 AS (SELECT query_id, list(t) AS qw FROM q WHERE len(t) >= 2 GROUP BY 1)
SELECT query_id, doc_id, round(len(list_filter(qw, lambda x: contains(lower(text), x))) / len(qw), 6) AS coverage FROM r JOIN q2 USING (query_id) JOIN documents USING (doc_id) WHERE rank = 1""")
def aspect_coverage(t):
    hits = I.bm25(t("benchmark"), t("documents"), 1).select("query_id", "doc_id")
    rows = hits.join(t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id").join(t("documents").select("doc_id", "text"), "doc_id")
    return rows.select("query_id", "doc_id", F.round(C.coverage(F.col("q"), F.col("text")), 6).alias("coverage"))


@query("SELECT conv_id, turn, CASE WHEN len(text) > 45 OR length(regexp_replace(text, '[^,，]', '', 'g')) >= 3 OR len(list_filter(string_split_regex(text, '[?？]'), lambda x: trim(x) <> '')) >= 2 THEN 'complex_qa' ELSE 'simple_qa' END AS intent FROM conversations WHERE role = 'user'")
def question_intent(t):
    return t("conversations").filter("role = 'user'").select("conv_id", "turn", C.intent(F.col("text")).alias("intent"))


@query()
def hash_embed_sparse(t):
    return I.hash_features(t("documents"), digits=6)


@query(f"SELECT doc_id, len({_SENTENCES}) AS n FROM documents")
def doc_sentences(t):
    return t("documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query()
def clean_page_numbers(t):
    return D.page_numbers(t("documents"))


@query(f"WITH {_SIMHASH} SELECT doc_id, b::INT AS band, ((simhash >> (16 * b::INT)) & 65535)::BIGINT AS value FROM sh, range(4) AS r(b)")
def simhash_bands(t):
    return D.simhash_bands(D.simhash(t("documents"), characters=True))


def _questions(t) -> tuple[DataFrame, DataFrame]:
    """The questions, and all documents with the first 60 characters of their text as heading."""
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return asked, t("documents").select("doc_id", "text", F.substring("text", 1, 60).alias("heading"))


def _by_number(t) -> tuple[DataFrame, DataFrame]:
    """Vectors of questions and documents that SQL has, too: those of the same number; other documents have none."""
    v = lambda: t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v().join(t("benchmark").select(F.col("item_id").alias("id")), "id", "left_semi"), v()


@query()
def hybrid_fuse(t):
    asked, docs = _questions(t)
    near = V.knn(V.dense(t("benchmark"), "item_id"), stored(V.dense(docs)), S.CANDIDATES, others=False)
    return S.shortlist(asked, docs, near).filter("rank <= 6").select("query_id", "doc_id", "score", "relevance", "rank")


@query()
def mmr_select(t):
    asked, docs = _questions(t)
    return S.search(asked, docs, V.dense(t("benchmark"), "item_id"), stored(V.dense(docs)))


_WORDS_OF = lambda x: _TOKENS.replace("lower(text)", f"lower({x})")
_SIZE = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: greatest(1, len(y)))), 0)"
_SEARCH = f"""WITH {_BM25},
v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
b AS MATERIALIZED (SELECT item_id AS query_id, text AS q FROM benchmark WHERE trim(text) <> ''),
k AS (SELECT query_id, doc_id, score AS kw FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 30),
s AS (SELECT query_id, x.vec_id AS doc_id, round(list_cosine_similarity(y.e, x.e), 6) AS sem FROM b JOIN v y ON y.vec_id = query_id, v x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sem DESC, doc_id) <= 30),
u AS (SELECT query_id, doc_id, greatest(coalesce(sem, 0), 0) AS sem, coalesce(kw, 0) AS kw FROM s FULL JOIN k USING (query_id, doc_id)),
f AS MATERIALIZED (SELECT *, round(0.6 * CASE WHEN max(sem) OVER w > 0 THEN sem / max(sem) OVER w ELSE 0 END + 0.4 * CASE WHEN max(kw) OVER w > 0 THEN kw / max(kw) OVER w ELSE 0 END, 6) AS fused FROM u WINDOW w AS (PARTITION BY query_id)),
w AS (SELECT query_id, q.t, CASE WHEN df IS NULL THEN NULL ELSE ln(1 + (n - df + 0.5) / (df + 0.5)) END AS idf, ln(1 + (n + 0.5) / 0.5) AS most FROM q LEFT JOIN df USING (t), st),
a AS (SELECT query_id, sum(idf) + count(*) FILTER (idf IS NULL) * least(any_value(most), avg(idf)) AS whole, list({{'t': t, 'i': idf}}) FILTER (idf IS NOT NULL) AS known FROM w GROUP BY 1),
g AS MATERIALIZED (SELECT f.query_id, f.doc_id, b.q, dd.text, dd.text[1:60] AS heading, d.w AS words,
  round(fused + CASE WHEN len(b.q) >= 2 AND contains(dd.text, trim(regexp_replace(b.q, '\\s+', ' ', 'g'))) THEN least(0.12, 1 - fused) ELSE 0 END, 6) AS score,
  round(0.6 * sem + 0.4 * CASE WHEN whole > 0 THEN coalesce(list_sum(list_transform(known, lambda z: CASE WHEN list_contains(d.w, z.t) THEN z.i ELSE 0 END)), 0) / whole ELSE 0 END, 6) AS relevance
  FROM f JOIN b USING (query_id) JOIN d USING (doc_id) JOIN documents dd USING (doc_id) LEFT JOIN a USING (query_id)),
sl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE relevance >= 0.18 QUALIFY rank <= 20)"""


@query(_SEARCH + " SELECT query_id, doc_id, score, relevance, rank FROM sl")
def search_shortlist(t):
    """Every question's gated shortlist, over vectors that SQL has, too."""
    asked, docs = _questions(t)
    return S.shortlist(asked, docs, V.knn(*_by_number(t), S.CANDIDATES, others=False)).select("query_id", "doc_id", "score", "relevance", "rank")


def _search_sql(k: int) -> str:
    """The reranked shortlist, then k steps of marginal relevance."""
    own, text, head = _WORDS_OF("q"), "words", _WORDS_OF("heading")
    share = lambda w: _SIZE(f"list_intersect(ow, {w})") + " / greatest(1, " + _SIZE("ow") + ")"
    sql = f"""{_SEARCH},
o AS (SELECT *, list_distinct({own}) AS ow, {head} AS hw FROM sl),
rr AS MATERIALIZED (SELECT o.query_id, o.doc_id, round(CASE WHEN len(ow) = 0 THEN score ELSE 0.6 * score + 0.4 * least(1, {share(text)}
  + CASE WHEN len(q) >= 4 AND contains(text, q) THEN 0.15 ELSE 0 END + 0.2 * ({share("hw")})) END, 6) AS score, v.e, coalesce(list_cosine_similarity(v.e, y.e), 0) AS near
  FROM o LEFT JOIN v ON v.vec_id = o.doc_id LEFT JOIN v y ON y.vec_id = o.query_id),
s0 AS (SELECT *, -1.0::DOUBLE AS red FROM rr),
c0 AS (SELECT query_id, doc_id, score, e, 0 AS rank FROM s0 WHERE false)"""
    for i in range(1, k + 1):
        value = "round(0.7 * score + 0.3 * near" + (" - 0.3 * greatest(red, 0)" if i > 1 else "") + ", 9)"
        sql += f""",
c{i} AS MATERIALIZED (SELECT query_id, doc_id, score, e, {i} AS rank FROM s{i - 1} WHERE red < 0.96 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {value} DESC, score DESC, doc_id) = 1),
s{i} AS MATERIALIZED (SELECT s.query_id, s.doc_id, s.score, s.e, s.near, greatest(s.red, coalesce(list_cosine_similarity(s.e, c.e), 0)) AS red FROM s{i - 1} s JOIN c{i} c USING (query_id) WHERE s.doc_id <> c.doc_id)"""
    return sql + " SELECT query_id, doc_id, score, rank FROM (" + " UNION ALL ".join(f"SELECT query_id, doc_id, score, rank FROM c{i}" for i in range(1, k + 1)) + ")"


@query(_search_sql(6))
def search_whole(t):
    """Candidates, gate, reranker with headings, marginal relevance."""
    return S.search(*_questions(t), *_by_number(t))


@query(r"""WITH l AS (SELECT doc_id, len(text) AS n0, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
c AS (SELECT doc_id, n0, pos, trim(raw, ' ') AS line, count(*) FILTER (len(trim(raw, ' ')) BETWEEN 1 AND 40 AND NOT regexp_matches(trim(raw, ' '), '^(#{1,6}\s|>\s|[-*+]\s|\d+[.)]\s|\||```)')) OVER (PARTITION BY doc_id, trim(raw, ' ')) AS n FROM l),
k AS (SELECT *, n >= 3 OR (line <> '' AND len(line) <= 12 AND regexp_matches(line, '^\s*[-\[\(]*\s*\d{1,4}\s*(?:/\s*\d{1,4})?\s*[-\]\)]*\s*$')) AS dropped FROM c),
a AS (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM k WHERE NOT dropped),
m AS (SELECT *, coalesce(prev, '') <> '' AND line <> '' AND NOT regexp_matches(right(prev, 1), '[!?;:.)\]-]') AND NOT regexp_matches(line, '^(#|>\s|[-*+]\s|\d+[.)]\s|\||```)') AS may FROM a),
r AS (SELECT *, sum(CASE WHEN may THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m),
j AS (SELECT *, may AND coalesce(bool_or(len(line) >= 12 AND NOT starts_with(line, '|')) OVER (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS joins FROM r),
t AS (SELECT doc_id, string_agg(CASE WHEN joins THEN line ELSE chr(10) || line END, '' ORDER BY pos) AS t, count(*) FILTER (joins) AS merged FROM j GROUP BY 1),
p AS (SELECT doc_id, merged, """ + "regexp_replace(" * 7 + r"""t, ',{4,}', ',', 'g'), '[.]{4,}', '.', 'g'), '!{4,}', '!', 'g'), '[?]{4,}', '?', 'g'), ';{4,}', ';', 'g'), ':{4,}', ':', 'g'), ' {2,}', ' ', 'g') AS t FROM t),
q AS (SELECT doc_id, merged, regexp_replace(regexp_replace(t, '
{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM p)
SELECT d.doc_id, md5(coalesce(t, '')) AS cleaned, len(d.text)::INT AS original_chars, len(coalesce(t, ''))::INT AS cleaned_chars, (SELECT count(*) FROM k WHERE k.doc_id = d.doc_id AND dropped) AS dropped_lines, coalesce(merged, 0) AS merged_lines
FROM documents d LEFT JOIN q USING (doc_id)""")
def clean_text(t):
    return U.clean_text(t("documents")).withColumn("cleaned", F.md5("cleaned")).drop("removed_ratio")


@query()
def split_chunks(t):
    return U.split_chunks(t("documents")).select("doc_id", "ordinal", "start", "n_chars", "kind", F.md5("content").alias("content_md5"))


def _evidence(t, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """The questions, and the best k documents of each as evidence."""
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    hits = I.bm25(t("benchmark"), t("documents"), k).select("query_id", "doc_id", F.col("rank").alias("idx"))
    docs = t("documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("document"), F.lit(None).cast("string").alias("heading"))
    return asked, hits.join(docs, "doc_id")


_SPLIT = r"list_filter(list_transform(regexp_extract_all({}, '[^!?;\n]*(?:[!?;\n][)\]\"'']*|$)'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')"
_EVIDENCE = f"""WITH {_BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS idx FROM h),
ev AS (SELECT query_id, idx, text AS content, source AS document FROM r JOIN documents USING (doc_id) WHERE idx <= 3)"""
_OF = lambda x: _TOKENS.replace("lower(text)", f"lower({x})")


@query(rf"""{_EVIDENCE}, s0 AS (SELECT query_id, idx, document, unnest({_SPLIT.format("content")}) AS s, unnest(range(len({_SPLIT.format("content")}))) AS pos FROM ev),
s1 AS (SELECT query_id, idx, document, pos, trim(regexp_replace(s, '^[#*+>| \t-]+', '')) AS s FROM s0),
s2 AS (SELECT *, list_distinct({_OF("s")}) AS w FROM s1 WHERE len(s) >= 6 AND len(regexp_replace(s, '[\s#>*|-]', '', 'g')) >= 6),
cand AS (SELECT * FROM s2 WHERE len(w) > 0),
nn AS (SELECT query_id, count(*) AS n FROM cand GROUP BY 1),
hit AS (SELECT cand.query_id, idx, pos, u.t FROM cand, unnest(w) AS u(t) JOIN q ON q.query_id = cand.query_id AND q.t = u.t),
wt AS (SELECT q.query_id, q.t, ln((n + 1) / (coalesce(c, 0) + 1)) + 0.1 AS x FROM q JOIN nn USING (query_id) LEFT JOIN (SELECT query_id, t, count(*) AS c FROM hit GROUP BY ALL) d ON d.query_id = q.query_id AND d.t = q.t),
sc AS (SELECT hit.query_id, hit.idx, hit.pos, sum(x) AS got FROM hit JOIN wt ON wt.query_id = hit.query_id AND wt.t = hit.t GROUP BY ALL),
sd AS (SELECT cand.query_id, cand.idx, cand.pos, document, s, round(got / whole, 6) AS score FROM sc JOIN cand USING (query_id, idx, pos) JOIN (SELECT query_id, sum(x) AS whole FROM wt GROUP BY 1) USING (query_id)),
p1 AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY query_id, s ORDER BY score DESC, idx, pos) = 1),
p2 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx, pos) <= 5)
SELECT query_id, idx, document, md5(s) AS sentence, score FROM p2
UNION ALL SELECT query_id, idx, document, md5(arg_min(s, pos)), 0.0 FROM s2 WHERE idx <= 2 AND query_id IN (SELECT query_id FROM cand) AND query_id NOT IN (SELECT query_id FROM p2) GROUP BY ALL""")
def extractive_answer(t):
    return A.extract_answers(*_evidence(t)).withColumn("sentence", F.md5("sentence"))


def _checked(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each question as its own answer, which cites its first evidence, and one that doesn't exist in every second."""
    asked, evidence = _evidence(t)
    cite = F.when(F.col("query_id") % 2 == 0, " [1][9]").otherwise(" [1]")
    return asked, evidence, A.verify(asked.select("query_id", F.concat("q", cite).alias("answer")), evidence)


@query(f"""{_EVIDENCE}, a AS (SELECT item_id AS query_id, text, list_last(list_filter({_SPLIT.format("text")}, lambda x: len({_OF("x").replace("lambda x", "lambda y").replace("x NOT IN", "y NOT IN")}) > 0)) AS s FROM benchmark),
o AS (SELECT a.query_id, a.text, list_distinct({_OF("s")}) AS w, {_OF("content")} AS e FROM a JOIN ev ON ev.query_id = a.query_id AND idx = 1)
SELECT query_id, md5(text || ' [1]') AS answer, [1] AS used, CASE WHEN query_id % 2 = 0 THEN [9] ELSE [] END AS invalid, CASE WHEN len(list_intersect(w, e)) / len(w) >= 0.25 THEN 1.0 ELSE 0.0 END AS grounded_ratio, len(list_intersect(w, e)) / len(w) >= 0.25 AS grounded FROM o""")
def citation_check(t):
    return _checked(t)[2].drop("unsupported").withColumn("answer", F.md5("answer"))


@query()
def reflection(t):
    asked, evidence, checked = _checked(t)
    return A.reflect(asked, checked, evidence)


@query(f"""{_EVIDENCE}, t AS (SELECT *, sum(len(content)) OVER (PARTITION BY query_id ORDER BY idx) AS total FROM ev) SELECT query_id, idx, document, left(content, 800) AS content FROM t WHERE total <= 12000 OR idx = 1""")
def evidence_within_chars(t):
    asked, evidence = _evidence(t)
    kept = A.within_chars(evidence)
    return A.citations(asked.select("query_id", F.array().cast("array<int>").alias("used")), kept)


@query("""SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY 1""")
def message_counts(t):
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"))


@query("""SELECT doc_id, CASE WHEN d.lang IN ('en', 'de') AND l.quality IS NULL THEN 'open' WHEN l.quality IS NULL THEN 'other' ELSE 'labelled' END AS state, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_state(t):
    rows = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    state = F.when(F.col("lang").isin("en", "de") & F.col("quality").isNull(), "open").when(F.col("quality").isNull(), "other").otherwise("labelled")
    return rows.select("doc_id", state.alias("state"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("""WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id AS task_id, CASE WHEN event_type IN ('view', 'click') THEN 'failed' ELSE event_type END AS status, round(value / 100, 4) AS progress, ts AS updated_at, CASE WHEN event_type <> 'signup' THEN ts END AS finished_at FROM e""")
def task_states(t):
    """Every user's events as those of a task: a purchase or an error ends it, views and clicks are interrupted by a restart."""
    events = t("events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("status"), (F.col("value") / 100).alias("progress"))
    return B.task_states(events, ("purchase", "error"), ("view", "click"), restarted=True)


@query("""SELECT conv_id, coalesce(nullif(CASE WHEN len(q) > 30 THEN left(q, 29) || '…' ELSE q END, ''), '新会话') AS title
FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q FROM conversations GROUP BY 1)""")
def session_titles(t):
    return B.session_titles(t("conversations"))


_CLEARED = "c AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING arg_max(role, turn) = 'user')"


def _unanswered(t) -> DataFrame:
    last = t("conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"))
    return last.filter("role = 'user'").select("conv_id")


@query(f"WITH {_CLEARED} SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (FROM c)")
def clear_sessions(t):
    return B.clear_sessions(t("conversations"), _unanswered(t))[0].select("conv_id", "turn", "role")


@query(f"WITH {_CLEARED} SELECT conv_id, count(*) AS removed FROM conversations JOIN c USING (conv_id) GROUP BY 1")
def cleared_counts(t):
    return B.clear_sessions(t("conversations"), _unanswered(t))[1]


@query("SELECT user_id, max(ts) AS updated_at, count(*) AS n FROM events GROUP BY 1 ORDER BY updated_at DESC, user_id")
def session_listing(t):
    return t("events").groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("updated_at"), "user_id")


@query("SELECT DISTINCT source FROM documents ORDER BY source LIMIT 50")
def distinct_sources(t):
    return t("documents").select("source").distinct().orderBy("source").limit(50)


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || n_chars || '}' AS row FROM documents""")
def rows_as_json(t):
    return t("documents").select("doc_id", B.as_json("doc_id", "lang", "n_chars").alias("row"))


@query("""WITH n AS (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels WHERE quality = 1) AS good, (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic,
(SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM conversations) AS messages,
(SELECT count(*) FROM events) AS events, (SELECT coalesce(round(avg(value), 1), 0.0) FROM events) AS latency)
SELECT n.*, doc_id, n_chars, rank FROM n, (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE n_chars > 0 QUALIFY rank <= 5)""")
def overview(t):
    """All counters in one row, repeated for each of the five longest documents."""
    number = lambda df, c: df.agg(c.alias("x")).select("x").scalar()
    rows = F.count(F.lit(1))
    most = t("documents").filter("n_chars > 0").orderBy(F.desc("n_chars"), "doc_id").limit(5)
    ranked = most.select("doc_id", "n_chars", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))  # five rows
    return ranked.select(
        number(t("documents"), rows).alias("documents"),
        number(t("labels"), F.count_if(F.col("quality") == 1)).alias("good"),
        number(t("labels"), F.count_if(F.col("toxic") == 1)).alias("toxic"),
        number(t("embeddings"), rows).alias("vectors"),
        number(t("conversations"), F.countDistinct("conv_id")).alias("sessions"),
        number(t("conversations"), rows).alias("messages"),
        number(t("events"), rows).alias("events"),
        number(t("events"), F.coalesce(F.round(F.avg("value"), 1), F.lit(0.0))).alias("latency"),
        "doc_id",
        "n_chars",
        "rank",
    )
