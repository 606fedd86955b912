"""The catalogue's queries against DuckDB, and functions and sources on hand-made cases."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.functions import text as T
from corpusloom.operators import answers as A
from corpusloom.operators import conversation as C
from corpusloom.operators import corpus as D
from corpusloom.operators import index as I
from corpusloom.operators import structure as U
from corpusloom.operators import vectors as V
from corpusloom.plans.branches import QUERIES, SQL
from corpusloom.plans.session import ship
from corpusloom.operators import tables as B
from corpusloom.sources import load as L
from corpusloom.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return sorted(str(tuple(show(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf_dir, name):
    df = QUERIES[name](ship(spark), sf_dir)
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, T.tokens(F.lit("It's 3.14 of 知识库 Data-set"))) == ["3.14", "知", "识", "库", "知识", "识库", "data-set"]
    assert one(spark, T.sentences(F.lit("他说。” 好！a.b\n c"))) == ["他说。”", "好！", "a.b", "c"]
    assert one(spark, T.truncate(F.lit("abcdef"), 4)) == "abc…" and one(spark, T.char_overlap(F.lit("abc"), F.lit("bcd"))) == pytest.approx(2 / 3)
    assert one(spark, T.hamming(F.lit(7), F.lit(0))) == 3 and one(spark, T.hamming(F.lit(None).cast("int"), F.lit(0))) == 64
    assert one(spark, T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == 1.0


def test_clean(spark):
    docs = spark.createDataFrame([(1, "foot\nx\nfoot\n- 3 -\nfoot\n```\nfoot\n```")], "doc_id long, text string")
    got = [r.line for r in D.cleaned_lines(docs).orderBy("pos").filter("NOT dropped").collect()]
    assert got == ["x", "```", "foot", "```"]


def test_greedy_chain(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    nodes, pairs = spark.range(1, 4).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r.doc_id: r.kept for r in D.greedy_keep(nodes, pairs).collect()} == {1: True, 2: False, 3: True}


def test_greedy_brute_force(spark, sf_dir, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    hand = [(1, 0b0, 100), (2, 0b111, 100), (3, 0b111, 100), (4, 0b111111, 100), (5, 0b1111111, 99), (6, 0b111, 100), (7, 5, None), (8, 5, None)]
    tables = [spark.createDataFrame(hand, "doc_id long, simhash long, n_chars int")]
    tables.append(D.simhash(spark.read.parquet(f"{sf_dir}/documents.parquet"), characters=True))
    for hashes in tables:
        kept, want = [], {}
        for i, h, n in sorted((r.doc_id, r.simhash, r.n_chars) for r in hashes.collect()):
            near = lambda g, m: n is not None and m is not None and ((g ^ h) % (1 << 64)).bit_count() <= 3 and (n == 0 or m == 0 or abs(n - m) <= 0.02 * max(n, m))  # noqa: B023, E731
            want[i] = not any(near(g, m) for g, m in kept)
            if want[i]:
                kept.append((h, n))
        assert {r.doc_id: r.kept for r in D.greedy_dedup(hashes).collect()} == want
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "a long, b long")
    assert {r.doc_id: r.kept for r in D.greedy_keep(spark.range(1, 61).toDF("doc_id"), pairs).collect()} == {i: i % 2 == 1 for i in range(1, 61)}


def test_near_pairs_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for base in (rng.getrandbits(64) for _ in range(40)):
        for _ in range(6):
            h = base
            for b in rng.sample(range(64), rng.randrange(5)):
                h ^= 1 << b
            n = rng.choice([0, 1, 50, 98, 99, 100, 101, 102, 1000, 1020, 1021, None])
            rows.append((len(rows), h - (1 << 64) if h >> 63 else h, n))
    rows += [(len(rows) + i, *rows[i][1:]) for i in range(0, 40, 3)]
    first = {}
    for i, h, n in rows:
        first.setdefault((h, n), i)
    for distance in (0, 3, 5):
        want = {(first[h, n], i, 0) for i, h, n in rows if n is not None and first[h, n] != i}
        for (h, n), i in first.items():
            for (g, m), j in first.items():
                d = ((g ^ h) % (1 << 64)).bit_count()
                sized = 0 in (n, m) or (None not in (n, m) and abs(n - m) <= 0.02 * max(n, m))
                want |= {(i, j, d)} if i < j and d <= distance and sized else set()
        hashes = spark.createDataFrame(rows, "doc_id long, simhash long, n_chars int")
        got = [tuple(r) for r in D.near_pairs(hashes, distance).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_simhash_of_characters(spark):
    docs = spark.createDataFrame([(1, "!?!"), (2, ""), (3, None), (4, "The")], "doc_id long, text string")
    votes = lambda t: sum(1 << b for b in range(64) if sum(1 if int(hashlib.md5(c.encode()).hexdigest()[:16], 16) >> b & 1 else -1 for c in t) > 0)
    got = {r.doc_id: r.simhash % (1 << 64) for r in D.simhash(docs, characters=True).collect()}
    assert got == {1: votes("!?!"), 2: 0, 3: 0, 4: votes("the")}


def test_documents_by_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ends = re.compile("[^。！？!?…；;\n]*(?:[。！？!?…；;\n][”’」』）)\\]\"']*|$)")
    got = {r.doc_id: r.n for r in QUERIES["doc_sentences"](spark, sf_dir).collect()}
    assert got == {i: sum(1 for m in ends.finditer(t) if m[0].strip()) for i, t in docs.items()}
    assert any(re.search("[!?;]", t) for t in docs.values())
    hashes = {r.doc_id: r.simhash % (1 << 64) for r in QUERIES["doc_simhash"](spark, sf_dir).collect()}
    got = {(r.doc_id, r.band): r.value for r in QUERIES["simhash_bands"](spark, sf_dir).collect()}
    assert got == {(i, b): h >> 16 * b & 65535 for i, h in hashes.items() for b in range(4)}
    hand = spark.createDataFrame([(1, "a\n 3/9 \n- 12 -\n```\n4\n```\n12345"), (2, None)], "doc_id long, text string")
    assert [(r.pos, r.line) for r in D.page_numbers(hand).orderBy("pos").collect()] == [(1, "3/9"), (2, "- 12 -")]
    assert QUERIES["hash_embed_sparse"](spark, sf_dir).select("id").distinct().count() > 100


def test_chunks_are_slices(spark):
    text = "一句。" * 300 + "\n\n" + "x" * 700 + "\nend"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = D.packed_chunks(docs).orderBy("ordinal").collect()
    assert all(text[r.start : r.start + r.n_chars] == r.content for r in got) and [r.ordinal for r in got] == list(range(len(got)))
    assert all(r.n_chars <= 600 for r in got if "x" not in r.content)


def test_intents(spark):
    cases = {"你好": "chitchat", "知识库有多少文档": "kb_stats", "对比A和B": "compare", "总结一下": "summarize", "为什么？怎么办？": "complex_qa", "是什么": "simple_qa", "": "chitchat"}
    df = spark.createDataFrame(list(cases.items()), "q string, want string").withColumn("got", C.intent(F.col("q")))
    assert df.filter("got <> want").count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.25)], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(1, 11, 4.0), (1, 12, 2.0)], "query_id long, doc_id long, score double")
    assert [(r.doc_id, r.score) for r in I.top(I.fuse(a, b), 3).orderBy("rank").collect()] == [(11, 0.7), (10, 0.6), (12, 0.2)]


def test_sources(spark, tmp_path):
    ship(spark)
    (tmp_path / "a.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "b.html").write_text("<title>T</title><nav>no</nav><h2>H</h2><ul><li>x</li></ul><table><tr><td>1</td><td>2</td></tr></table>")
    (tmp_path / "c.doc").write_bytes(b"x")
    got = {r.name: r for r in L.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "中文" and got["c.doc"].error and got["T"].text == "## H\n\n- x\n| 1 | 2 |"
    urls = ["ftp://a", "http://u:p@a.b/", "http://", "http://x.local/", "https://ok.org/x", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(L.url_verdict(F.col("u")).alias("v"))
    assert [r.v for r in df.collect()] == ["scheme", "userinfo", "no host", "blocked host", "ok", "empty", "empty"]


def test_stream(spark, sf_dir, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "in/x"))
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(str(tmp_path / "in/x"))
    ingest.append_to(ingest.windowed_stats(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] > 900


def test_dense_is_hash_features(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.length("text")).limit(40).union(spark.createDataFrame([(-1, "知识库 A  b", "", "", 1), (-2, "", "", "", 0), (-3, None, "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r.id: r.v for r in V.dense(docs).collect()}
    want = {i: [0.0] * 512 for i in got}
    for r in I.hash_features(docs).collect():
        want[r.id][r.slot] = r.value
    assert len(got) == 43 and all(v == pytest.approx(want[i], abs=1e-6) for i, v in got.items())


def test_hybrid_by_hand(spark, sf_dir):
    got = QUERIES["hybrid_fuse"](ship(spark), sf_dir).toPandas()
    assert (got.relevance >= 0.18).all() and (got.groupby("query_id")["rank"].max() <= 6).all() and got.score.max() <= 1 and len(got) > 50
    docs, asked = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    import numpy as np

    d, q = V.dense(docs).toPandas().sort_values("id"), V.dense(asked, "item_id").toPandas()
    score = np.round(np.stack(q.v).astype(float) @ np.stack(d.v).astype(float).T, 6)
    near = V.knn(V.dense(asked, "item_id"), V.dense(docs), 30, others=False).toPandas()
    for i, query in enumerate(q.id):
        order = sorted(range(len(d)), key=lambda j: (-score[i][j], d.id.iloc[j]))[:30]
        own = near[near.query_id == query].sort_values("rank")
        assert own.score.tolist() == pytest.approx([score[i][j] for j in order], abs=2e-6)


def test_mmr(spark):
    e = lambda *x: [float(y) for y in x]
    rows = [(1, 1, 1.0, e(1, 0), e(1, 0)), (1, 2, 0.99, e(1, 0), e(1, 0.01)), (1, 3, 0.5, e(1, 0), e(0, 1)), (1, 4, 0.4, e(1, 0), None), (2, 1, 0.1, e(0, 1), e(1, 1))]
    got = V.mmr(spark.createDataFrame(rows, "query_id long, doc_id long, score double, qv array<double>, v array<double>"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_knn_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0]), (6, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    assert [(r.doc_id, r.score) for r in V.knn(v.filter("id = 1"), v, 2).orderBy("rank").collect()] == [(5, 1.0), (2, 0.0)]
    assert V.knn(v.filter("false"), v, 2).count() == 0 and V.knn(v, v.filter("false"), 2).count() == 0


def test_clean_whole(spark):
    ship(spark)
    cases = {
        "ＡＢ\u200bc\ufeff\ue000": "ABc",
        "exam-\nple\r\nnext\rline": "example\nnext\nline",
        "foot\nx\nfoot\n- 3 -\nfoot\n2024": "x",
        "a line that goes\non here.\nNext": "a line that goeson here.\nNext",
        "# Head of the text\nbody": "# Head of the textbody",
        "| a table row here |\nnext": "| a table row here |\nnext",
        "short\nline that is longer\nthan that\nand ends.\nNo": "short\nline that is longerthan thatand ends.\nNo",
        "why？？？？？ ok!!!\n\n\n\n  b    c  ": "why? ok!!!\n\nb c",
        "": "", None: "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in U.clean_text(docs).collect()}
    assert [got[i].cleaned for i in range(len(cases))] == list(cases.values())
    assert got[2].dropped_lines == 5 and got[6].merged_lines == 2 and got[2].removed_ratio == round(1 - 1 / 27, 4)


def test_split_by_structure(spark):
    ship(spark)
    text = "# T\nintro line\n\n## A\n1. one\n2. two\n  more\n\n| x | y |\n| 1 | 2 |\n```\ncode\n\n| no table but a line of code |\n```\ntail text\n### B\nx\n# C\n第三章 总结\n3.1 部分\nbody 4.2 no head\n5.1 still body\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "  \n "), (5, "s" * 50)], "doc_id long, text string")
    got = [(r.kind, text[r.start : r.stop], r.heading) for r in U.units(docs).filter("doc_id = 1").orderBy("start").collect()]
    assert got == [
        ("heading", "# T", "T"), ("prose", "intro line", "T"), ("heading", "## A", "T > A"), ("list", "1. one\n2. two\n  more", "T > A"), ("table", "| x | y |\n| 1 | 2 |", "T > A"),
        ("code", "```\ncode\n\n| no table but a line of code |\n```", "T > A"), ("prose", "tail text", "T > A"), ("heading", "### B", "T > A > B"), ("prose", "x", "T > A > B"), ("heading", "# C", "C"),
        ("heading", "第三章 总结", "C > 第三章 总结"), ("heading", "3.1 部分", "C > 第三章 总结 > 3.1 部分"), ("prose", "body 4.2 no head\n5.1 still body", "C > 第三章 总结 > 3.1 部分"),
    ]
    rows = U.split_chunks(docs).orderBy("doc_id", "ordinal").collect()
    assert [r.content for r in rows if r.doc_id == 5] == ["s" * 50] and {r.doc_id for r in rows} == {1, 5}
    own = [r for r in rows if r.doc_id == 1]
    assert all(text[r.start : r.start + r.n_chars] == r.content for r in own) and [r.ordinal for r in own] == list(range(len(own)))
    assert [r.kind for r in own].count("code") == 1 and own[0].heading == "T" and own[-1].heading == "C > 第三章 总结 > 3.1 部分"


def test_split_long_units(spark, sf_dir):
    ship(spark)
    prose, table = "".join(f"Sentence number {i} ends here! " for i in range(120)), "\n".join(f"| row {i} | of a long table |" for i in range(100))
    texts = {1: prose, 2: table, 3: prose + "\n\nshort tail", 4: "a" * 1700, 5: "x" * 30 + "\n\n" + "y" * 30}
    rows = U.split_chunks(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for i, t in texts.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.ordinal)
        assert own and all(t[r.start : r.start + r.n_chars] == r.content for r in own)
        ends, last = [r.start + r.n_chars for r in own], 0
        for r, e in zip(own, ends):
            assert r.start <= last + 3
            last = e
        assert own[0].start == 0 and ends[-1] == len(t.rstrip())
    # An overlap is a whole atom of up to 600 characters.
    assert all(r.n_chars <= 1240 for r in rows if r.doc_id in (1, 2)) and len([r for r in rows if r.doc_id == 1]) > 5
    assert [r.n_chars for r in rows if r.doc_id == 4] == [1700] and [r.n_chars for r in rows if r.doc_id == 5] == [62]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = U.split_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert all(docs[r.doc_id][r.start : r.start + r.n_chars] == r.content for r in got) and {r.doc_id for r in got} == {i for i, t in docs.items() if t.strip()}


EVIDENCE = [(1, 1, "知识库 系统 支持 检索 documents quickly", "docA", "H"), (1, 2, "other material about trees", "docB", None), (2, 1, "alpha beta gamma", "docA", None)]
EVIDENCE_TYPE = "query_id long, idx int, content string, document string, heading string"


def test_verify(spark):
    evidence = spark.createDataFrame(EVIDENCE, EVIDENCE_TYPE)
    answers = [(1, "The documents quickly found. [1] Trees grow。[2] Nonsense words entirely! zzz yyy xxx [2][7]"), (2, "no citation here"), (3, "nothing [1]"), (4, "")]
    got = {r.query_id: r for r in A.verify(spark.createDataFrame(answers, "query_id long, answer string"), evidence).collect()}
    a = got[1]
    assert a.used == [1, 2] and a.invalid == [7] and "[7]" not in a.answer and a.grounded_ratio == 0.3333 and not a.grounded
    assert a.unsupported == ["[2] Nonsense words entirely!", "zzz yyy xxx [2]"]
    assert not got[2].grounded and got[2].used == [1] and got[2].answer.endswith("- [1] 《docA》") and got[2].grounded_ratio == 0
    assert not got[3].grounded and not got[4].grounded and got[4].answer == ""
    shown = A.citations(spark.createDataFrame([(1, [2]), (2, [])], "query_id long, used array<int>"), evidence).orderBy("query_id").collect()
    assert [(r.query_id, r.idx) for r in shown] == [(1, 2), (2, 1)]
    loose = A.verify(spark.createDataFrame([(1, "documents [1][8]")], "query_id long, answer string"), evidence, strict=False).first()
    assert loose.answer == "documents [1][8]" and loose.invalid == [8] and loose.grounded_ratio == 1


def test_reflection_rules(spark):
    evidence = spark.createDataFrame(EVIDENCE, EVIDENCE_TYPE)
    asked = spark.createDataFrame([(1, "documents trees rockets"), (2, "alpha beta"), (3, "anything else")], "query_id long, q string")
    answers = spark.createDataFrame([(1, "documents quickly [1]"), (2, "alpha beta [1]"), (3, "x")], "query_id long, answer string")
    got = {r.query_id: r for r in A.reflect(asked, A.verify(answers, evidence), evidence, 0.7).collect()}
    assert got[1].coverage == 0.6667 and got[1].missing == got[1].follow_up == ["rockets"] and not got[1].sufficient and not got[1].risk
    assert got[2].sufficient and got[2].score == 1 and got[2].follow_up == []
    assert got[3].risk and not got[3].sufficient and got[3].coverage == 0
    both = A.merge_verdicts(A.reflect(asked, A.verify(answers, evidence), evidence), spark.createDataFrame([(2, False, True, 0.1, ["m"], ["f"])], "query_id long, sufficient boolean, risk boolean, score double, missing array<string>, follow_up array<string>")).first()
    assert not both.sufficient and both.risk and both.score == 1 and both.missing == ["m"] and both.follow_up == ["f"]


def test_answer_pieces(spark):
    evidence = spark.createDataFrame(EVIDENCE + [(1, 3, "- short; The trees of the documents grow quickly!", "docC", None)], EVIDENCE_TYPE)
    asked = spark.createDataFrame([(1, "documents trees"), (2, "nothing shared")], "query_id long, q string")
    got = A.extract_answers(asked, evidence).orderBy("query_id", F.desc("score")).collect()
    assert got[0].sentence == "The trees of the documents grow quickly!" and got[0].score == 1 and [(r.query_id, r.score) for r in got][-1] == (2, 0.0)
    assert {(r.document, r.idx) for r in A.compared_answers(evidence).collect()} == {("docA", 1), ("docB", 2), ("docC", 3)}
    assert one(spark, A.compare_targets(F.lit("对比一下Redis和MySQL有什么区别？"))) == ["Redis", "MySQL"]
    said = one(spark, A.extract_memories(F.lit("我是一名工程师。我喜欢简短回答，记住我喜欢简短回答。")))
    assert [(x.category, x.content) for x in said] == [("fact", "用户信息：一名工程师"), ("preference", "用户偏好：简短回答，记住我喜欢简短回答"), ("fact", "用户信息：我喜欢简短回答")]
    assert one(spark, A.normal_memory(F.lit("Odd"), F.lit(" xy "), F.lit(7.0))).asDict() == {"category": "fact", "content": "xy", "importance": 1.0} and one(spark, A.normal_memory(F.lit("fact"), F.lit("x"), F.lit(0.5))) is None
    memories = spark.createDataFrame([(1, 1, 0.5, 0, True, [1.0, 0.0]), (1, 2, 0.5, 9, True, [0.0, 1.0]), (1, 3, 0.9, 0, False, None), (1, 4, 0.4, 0, True, None)], "user_id long, memory_id long, importance double, hits int, active boolean, v array<double>")
    asked = spark.createDataFrame([(7, 1, [1.0, 0.0])], "query_id long, user_id long, qv array<double>")
    assert [(r.memory_id, r.value) for r in A.recall(asked, memories, 2).orderBy("rank").collect()] == [(1, 0.725), (2, 0.325)]
    hits = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.7), (1, 2, 0.6)], "query_id long, doc_id long, score double")
    assert [(r.doc_id, r.score) for r in A.merged(hits, 5).orderBy("rank").collect()] == [(1, 0.7), (2, 0.6)]
    assert A.supplement(hits.filter("doc_id = 1"), hits.withColumn("relevance", F.col("score"))).count() == 1
    assert A.within_chars(evidence.filter("query_id = 1"), 50).count() == 1 and one(spark, A.has_material(F.lit(None).cast("double"))) is False


def test_tables(spark):
    at = "cast('2024-01-0' || x || ' 00:00:00' as timestamp)"
    rows = spark.createDataFrame([(1, 1, "queued", 0.0), (1, 2, "succeeded", 1.0), (2, 1, "running", 0.33336), (None, 1, "failed", 0.5)], "task_id long, x int, status string, progress double")
    events = rows.select("task_id", F.col("x").alias("seq"), F.expr(at).alias("at"), "status", "progress")
    got = {r.task_id: r for r in B.task_states(events).collect()}
    assert {i: (r.status, r.progress, r.finished_at is None) for i, r in got.items()} == {1: ("succeeded", 1.0, False), 2: ("running", 0.3334, True), None: ("failed", 0.5, False)}
    again = {r.task_id: r for r in B.task_states(events, restarted=True).collect()}
    assert (again[2].status, again[2].finished_at) == ("failed", again[2].updated_at)
    given = events.withColumn("finished_at", F.expr("timestamp'2020-01-01 00:00:00'"))
    assert {r.finished_at.year for r in B.task_states(given).collect() if r.finished_at} == {2020}
    messages = spark.createDataFrame([(1, 0, "user", "q" * 40), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (3, 0, "user", ""), (4, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.title for r in B.session_titles(messages).collect()} == {1: "q" * 29 + "…", 2: B.UNTITLED, 3: B.UNTITLED, 4: "hi"}
    titles = spark.createDataFrame([(1, B.UNTITLED), (4, "named"), (3, None)], "conv_id long, title string")
    assert {r.conv_id: r.title for r in B.session_titles(messages, titles).collect()} == {1: "q" * 29 + "…", 2: B.UNTITLED, 3: B.UNTITLED, 4: "named"}
    left, removed = B.clear_sessions(messages, spark.createDataFrame([(1,), (1,), (9,)], "conv_id long"))
    assert sorted(r.conv_id for r in left.collect()) == [2, 3, 4] and {r.conv_id: r.removed for r in removed.collect()} == {1: 2, 9: 0}
    wide = B.with_missing_columns(B.with_missing_columns(titles, messages.schema), messages.schema)
    assert wide.columns == ["conv_id", "title", "turn", "role", "text"] and wide.filter("turn IS NULL").count() == 3
    assert messages.filter("conv_id = 4").select(B.as_json("conv_id", "text").alias("x")).first().x == '{"conv_id":4,"text":"hi"}'
