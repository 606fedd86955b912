"""Indexes and tables that are kept on disk, and the fold of memories: growth, deletion, failures and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.json import extract_json
from corpusloom.operators import answers as A
from corpusloom.operators import corpus as D
from corpusloom.operators import index as I
from corpusloom.operators import memory as M
from corpusloom.operators import structure as U
from corpusloom.operators import vectors as V
from corpusloom.operators.chunk_store import ChunkStore
from corpusloom.operators.fingerprints import FingerprintIndex
from corpusloom.operators.ingest import ingest
from corpusloom.operators.stored_index import InvertedIndex
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.plans.session import ship
from corpusloom.plans.settings import of_file, settings
from corpusloom.sources import load as L
from corpusloom.sources import snapshots
from corpusloom.sources.docx import docx_text
from corpusloom.streaming import turns as TN


def test_inverted_index(spark, sf_dir, tmp_path):
    docs, asked = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    index = InvertedIndex.create(docs.filter("doc_id % 10 > 1"), f"{tmp_path}/i", buckets=16)
    index.append(docs.filter("doc_id % 10 <= 1"))
    assert index.delete(docs.filter("doc_id % 10 = 2").select("doc_id")) == docs.filter("doc_id % 10 = 2").count()
    assert index.delete(docs.filter("doc_id % 10 = 2").select("doc_id")) == 0
    index.append(docs.filter("doc_id % 10 = 3").select("doc_id", F.lit("replaced by this one").alias("text")))
    rest = docs.filter("doc_id % 10 <> 2").withColumn("text", F.when(F.col("doc_id") % 10 == 3, "replaced by this one").otherwise(F.col("text")))
    show = lambda df: sorted((r.query_id, r.doc_id, r.score, tuple(r.matched)) for r in df.collect())
    want = show(I.bm25(asked, rest, 5))
    again = InvertedIndex(spark, f"{tmp_path}/i")
    assert again.state == index.state and show(again.search(asked, 5)) == want
    # Only the buckets of a query's terms are read.
    one = asked.limit(1).select("item_id", F.substring("text", 1, 40).alias("text"))
    hits = again.search(one, 5)
    scan = next(x for x in hits._jdf.queryExecution().toString().split("\n") if "FileScan parquet" in x and "postings" in x)
    assert "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0] and "term" in scan.split("PushedFilters: [")[1]
    terms = I.query_terms(one).select("term").distinct()
    files = again._asked(terms)(again.read("postings")).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert 0 < len({r.f.split("bucket=")[1].split("/")[0] for r in files}) <= terms.count() < 16
    some = docs.filter("doc_id < 40").select("doc_id")
    assert {r.doc_id for r in again.search(asked, 3, scope=some).collect()} <= set(range(40))
    again.compact()
    assert again.state["gone"] == [] and show(again.search(asked, 5)) == want
    assert len(again.vacuum()) > 5 and show(InvertedIndex(spark, f"{tmp_path}/i").search(asked, 5)) == want
    # Another writer's version is not overwritten.
    stale = InvertedIndex(spark, f"{tmp_path}/i")
    again.append(docs.limit(1).select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    with pytest.raises(RuntimeError):
        stale.delete(docs.select("doc_id").limit(2))


def test_inverted_index_odd_rows(spark, tmp_path):
    rows = ship(spark).createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (None, "alpha"), (4, "alpha alpha gamma")], "doc_id long, text string")
    index = InvertedIndex.create(rows.filter("false"), f"{tmp_path}/i", buckets=4)
    asked = spark.createDataFrame([(1, "alpha delta"), (2, ""), (3, None)], "item_id long, text string")
    assert index.search(asked, 3).count() == 0
    index.append(rows)
    got = index.search(asked, 3)
    assert [(r.query_id, r.doc_id) for r in got.orderBy("rank").collect()] == [(r.query_id, r.doc_id) for r in I.bm25(asked, rows.filter("doc_id IS NOT NULL"), 3).orderBy("rank").collect()]
    assert index.state["n_docs"] == 4 and index.weights(spark.createDataFrame([("alpha",), ("zeta",)], "term string")).collect()[0].df == 2
    assert index.delete(spark.createDataFrame([(9,), (None,), (1,), (1,)], "i long")) == 1 and index.state["n_docs"] == 3


def test_vector_index(spark, sf_dir, tmp_path):
    v = ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    odd = spark.createDataFrame([(None, [1.0] * 64), (7000, None), (7001, [1.0]), (7002, [None] * 64), (7003, [0.0] * 64)], "id long, v array<float>")
    index = VectorIndex.create(v.union(odd), f"{tmp_path}/v", cells=9)
    index.delete(v.filter("id % 7 = 0").select("id"))
    index.add(v.filter("id % 9 = 0"))
    now = v.filter("id % 7 <> 0 OR id % 9 = 0").union(odd.filter("id = 7003"))
    show = lambda df: sorted(map(tuple, df.collect()))
    want = show(V.knn(v.filter("id % 20 = 0"), now, 4))
    assert show(index.search(v.filter("id % 20 = 0"), 4, exact=True)) == want
    index.compact()
    again = VectorIndex(spark, f"{tmp_path}/v")
    assert show(again.search(v.filter("id % 20 = 0"), 4, exact=True)) == want
    few = show(again.search(v.filter("id % 20 = 0"), 4, probes=2))
    assert {x[0] for x in few} == {x[0] for x in want} and all(any(x[:3] == y[:3] for y in want) or x[2] <= max(y[2] for y in want if y[0] == x[0]) for x in few)
    empty = VectorIndex.create(v.filter("false"), f"{tmp_path}/e")
    assert empty.search(v, 3).count() == 0


def fold_by_hand(rows, most):
    """A user's rows (turn, pos, content, category, importance, v) one after the other, as plain lists."""
    every, active = [], []
    for turn in sorted({r[0] for r in rows}):
        listed = sorted(active, key=lambda m: (-m["importance"], -m["at"], m["n"]))[:most]
        new = False
        for _, pos, content, _, importance, v in sorted((r for r in rows if r[0] == turn), key=lambda r: (r[1], r[2])):
            hit = None
            for m in listed:
                if m["content"] == content:
                    hit = m
                elif v is not None and m["v"] is not None and len(v) == len(m["v"]):
                    if np.dot(v, m["v"]) / (np.linalg.norm(v) * np.linalg.norm(m["v"])) >= 0.9:
                        hit = m
                elif content and m["content"] and len(set(content) & set(m["content"])) / len(set(content)) >= 0.85:
                    hit = m
                if hit:
                    break
            if hit:
                hit["importance"], hit["at"] = max(hit["importance"], importance), turn
            else:
                m = {"n": len(every), "id": f"{turn}-{pos}", "content": content, "importance": importance, "at": turn, "v": v, "active": True}
                every.append(m)
                active.append(m)
                listed.append(m)
                new = True
        if new and len(active) > most:
            active.sort(key=lambda m: (-m["importance"], -m["at"], m["n"]))
            for m in active[most:]:
                m["active"] = False
            active = active[:most]
    return sorted((m["id"], m["content"], round(m["importance"], 6), m["at"], m["active"]) for m in every)


def some_candidates(n, seed):
    rng = random.Random(seed)
    vectors = [[1.0, 0.0, 0.1], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.9, 0.5], [1.0, 0.0]]
    return [
        (rng.choice([None, 1, 2, 3]), turn, pos, "".join(rng.choices("abcdef", k=rng.randrange(1, 7))), "fact", round(rng.random(), 2), rng.choice([None, *vectors]))
        for turn in range(n)
        for pos in range(rng.randrange(1, 4))
    ]


@pytest.mark.parametrize("most", [4, 60])
def test_memory_by_brute_force(spark, most):
    rows = some_candidates(150, most)
    table = ship(spark).createDataFrame(rows, M.CANDIDATES).repartition(5)
    got = M.merged(table, most).collect()
    for user in (None, 1, 2, 3):
        own = sorted((r.memory_id, r.content, round(r.importance, 6), r.updated_at, r.active) for r in got if r.user_id == user)
        assert own == fold_by_hand([r[1:] for r in rows if r[0] == user], most)
    assert M.merged(table.filter("false")).count() == 0
    odd = spark.createDataFrame([(1, 1, None, "x", None, None, None), (1, None, 0, "y", None, 1.0, None), (1, 2, 0, None, None, 1.0, None)], M.CANDIDATES)
    assert [(r.content, r.importance) for r in M.merged(odd).collect()] == [("x", 0.5)]


def test_no_fall_through_with_vectors():
    m = M.Memory("1-0", 0, "abcdef", None, 0.5, 0, 1, [1.0, 0.0])
    assert M.alike("abcdef", [0.0, 1.0], m) and not M.alike("fedcba", [0.0, 1.0], m) and M.alike("fedcba", None, m) and M.alike("fedcba", [1.0], m)
    assert M.alike("zzz", [1.0, 0.4], m) and not M.alike("zzz", [1.0, 0.5], m) and not M.alike("", None, m)


def test_memory_stream_is_batch(spark, tmp_path):
    rows = [r for r in some_candidates(60, 9) if r[0] is not None]
    want = sorted(map(tuple, M.merged(ship(spark).createDataFrame(rows, M.CANDIDATES), 5).collect()))
    cuts = [[r for r in rows if a <= r[1] < b] for a, b in ((0, 20), (20, 45), (45, 60))]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(M.CANDIDATES).parquet(f"{tmp_path}/in")
    for own in cuts:
        spark.createDataFrame(own, M.CANDIDATES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        keep = lambda df, batch: df.write.mode("append").parquet(f"{tmp_path}/out")
        M.merged_stream(stream, 5).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    got = M.current(spark.read.parquet(f"{tmp_path}/out")).select([x.split()[0] for x in M.MEMORIES.split(", ")])
    assert sorted(map(tuple, got.collect())) == want


def test_versions(spark, tmp_path):
    folder = str(tmp_path)
    assert snapshots.current(spark, folder) == (-1, {})
    assert snapshots.commit(spark, folder, -1, {"a": 1}) == 0 and snapshots.commit(spark, folder, 0, {"a": 2}) == 1
    assert snapshots.current(spark, folder) == (1, {"a": 2})
    with pytest.raises(RuntimeError):
        snapshots.commit(spark, folder, 0, {"a": 3})
    assert snapshots.current(spark, folder) == (1, {"a": 2})


def test_fingerprints(spark, sf_dir, tmp_path):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = FingerprintIndex.create(docs.filter("doc_id >= 20"), f"{tmp_path}/f")
    again = FingerprintIndex(spark, f"{tmp_path}/f")
    long_text = next(r.text for r in docs.filter("doc_id >= 20 AND length(text) > 2000").orderBy("doc_id").collect())
    original = docs.filter(F.col("text") == long_text).agg(F.max("doc_id"), F.min("doc_id")).first()
    new = [(1, long_text), (2, long_text + " x"), (3, "nothing like it " * 9), (4, None), (5, ""), (6, long_text[: len(long_text) // 2])]
    asked = spark.createDataFrame(new, "doc_id long, text string")
    found = again.nearest(asked)
    got = {r.doc_id: r for r in found.collect()}
    assert (got[1].original, got[1].similarity, got[1].action) == (original[0], 1.0, "skip")
    assert got[2].original == original[1] and got[2].action == "skip" and 1 - 3 / 64 <= got[2].similarity <= 1
    assert [got[i].action for i in (3, 4, 6)] == ["index"] * 3 and got[4].original is None and len(got) == 6
    # The stored texts aren't read again.
    assert "documents.parquet" not in found._jdf.queryExecution().toString()
    again.add(asked.filter("doc_id IN (3, 4)"))
    assert {r.doc_id: r.original for r in again.nearest(asked.filter("doc_id = 3").union(asked.filter("doc_id = 4"))).collect()} == {3: 3, 4: None}


def files_under(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_chunk_store(spark, sf_dir, tmp_path, monkeypatch):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    store = ChunkStore.create(spark, f"{tmp_path}/s", parts=16, buckets=4, embed=lambda rows: V.dense(rows, "id", "text", 16), embedder="a")
    store.put(docs.union(spark.createDataFrame([(None, "x"), (500, None)], docs.schema)))
    state = lambda s: sorted((r.doc_id, r.ordinal, r.content) for r in s.read("chunks").collect())
    vectors = lambda s: sorted((r.chunk_id, r.content_hash) for r in s.read("vectors").collect())
    before, files = state(store), files_under(tmp_path / "s" / "chunks")
    assert {x[0] for x in before} == {r.doc_id for r in docs.filter("trim(text) <> ''").collect()} and len(vectors(store)) == len(before)
    store.put(spark.createDataFrame([(7, "A new text. It is short!")], docs.schema))
    listed = {f"seg={s}/part={p}/" for p, s in store.state["chunks"].items()}
    kept = {f for f in files if any(f.startswith(x) for x in listed)}
    assert len({f.split("/")[1] for f in kept}) == len({f.split("/")[1] for f in files}) - 1  # one partition was written anew
    after = state(store)
    assert after == sorted([x for x in before if x[0] != 7] + [(7, 0, "A new text. It is short!")])
    n = sum(x[0] in (3, 4) for x in after)
    assert store.delete(spark.createDataFrame([(3,), (4,), (4,), (999,), (None,)], "i long")) == n and store.delete(spark.createDataFrame([(3,)], "i long")) == 0
    left = [x for x in after if x[0] not in (3, 4)]
    assert state(store) == left and len(vectors(store)) == len(left) and store.state["postings"]["n_docs"] == len(left)
    # A change that fails half-way is not seen.
    again = ChunkStore(spark, f"{tmp_path}/s", embed=lambda rows: V.dense(rows, "id", "text", 16), embedder="a")
    with monkeypatch.context() as m:
        m.setattr(InvertedIndex, "append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            again.put(spark.createDataFrame([(8, "never seen")], docs.schema))
    again = ChunkStore(spark, f"{tmp_path}/s", embed=lambda rows: V.dense(rows, "id", "text", 16), embedder="a")
    assert state(again) == left
    again.put(spark.createDataFrame([(8, "seen now")], docs.schema))
    assert (8, 0, "seen now") in state(again)
    hit = again.search(spark.createDataFrame([(1, "seen now")], "item_id long, text string"), 1).first()
    assert hit.doc_id == 8 << 20
    # Only stale vectors are made again.
    assert again.reembed() == 0
    other = ChunkStore(spark, f"{tmp_path}/s", embed=lambda rows: V.dense(rows, "id", "text", 8), embedder="b")
    assert other.reembed() == len(state(other)) and {len(r.v) for r in other.read("vectors").collect()} == {8} and other.reembed() == 0


def docx(body, styles="", name="word/document.xml"):
    import io
    import zipfile

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>")
    return out.getvalue()


def test_docx():
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda text, extra="": f"<w:tc><w:tcPr>{extra}</w:tcPr>{p(text)}</w:tc>"
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H2", "heading 2"), ("H9", "heading 9"), ("T", "Title"), ("H", "Heading")))
    link = '<w:p><w:r><w:t>see</w:t><w:br/><w:t>it</w:t></w:r><w:hyperlink><w:r><w:tab/><w:t>there</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>no</w:delText></w:r></w:del></w:p>'
    table = f'<w:tbl><w:tr>{cell("a", "<w:vMerge w:val=" + chr(34) + "restart" + chr(34) + "/>")}{cell(" b ")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("c")}</w:tr><w:tr>{cell("")}{cell("")}</w:tr><w:tr>{cell("wide", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}</w:tr></w:tbl>'
    text = docx_text(docx(p("Top", "H2") + p("one &amp; two") + table + p("") + p("Deep", "H9") + p("Named", "T") + p("Any", "H") + link, styles))
    assert text.split("\n") == ["## Top", "", "one & two", "", "| a | b |", "| a | c |", "| wide | wide |", "", "", "", "# Deep", "", "Named", "", "# Any", "", "see", "it\tthere", ""]
    big = docx(p("x" * 5000) * 200)
    assert len(big) < 50_000 and len(docx_text(big)) > 900_000
    doctype = docx("").replace(b"word/document.xml", b"word/document.xml")
    for bad in (b"", b"PK\x03\x04junk", big[:-100], docx("", name="other.xml"), docx("<w:p><open>"), doctype[:40]):
        with pytest.raises(ValueError):
            docx_text(bad)
    with pytest.raises(ValueError, match="too many"):
        docx_text(big, most=100_000)
    with pytest.raises(ValueError, match="document type"):
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')
        docx_text(out.getvalue())
    assert docx_text(docx("")) == ""


def test_ingest(spark, tmp_path):
    long = "\n".join(f"Line {i} tells of something that no other line does, {i * 7919 % 104729}." for i in range(60))
    p = "<w:p><w:r><w:t>A paragraph of a Word file, long enough to be a chunk.</w:t></w:r></w:p>"
    rows = [(1, "a.txt", long.encode()), (2, "b.txt", long.encode()), (3, "c.md", (long + " ").encode("utf-16")), (4, "d.docx", docx(p)), (5, "e.docx", b"PK"), (6, "f.exe", b"x"), (7, "g.html", b"<script>x</script>"), (8, "h.txt", None), (None, "i.txt", b"x"), (9, None, b"x"), (10, "k.txt", b"boom")]

    def parse(name, data):
        if data == b"boom":
            raise ZeroDivisionError("what a parser may do")
        return L.file_text(name, data)

    files = ship(spark).createDataFrame(rows, "doc_id long, name string, content binary").repartition(3)
    store = ChunkStore.create(spark, f"{tmp_path}/s", parts=2, buckets=2)
    got = {(r.doc_id, r.name): r for r in ingest(files, store=store, parse=parse).collect()}
    show = {k[0]: (r.status, r.stage) for k, r in got.items()}
    assert len(got) == len(rows) and show[1] == ("succeeded", "finished") and show[2] == ("skipped", "finished") and show[4] == ("succeeded", "finished")
    assert all(show[i] == ("failed", "parsing") for i in (5, 6, 7, 8, None, 9, 10)) and got[10, "k.txt"].error == "ZeroDivisionError: what a parser may do"
    assert {r.doc_id for r in store.read("chunks").collect()} == {i for i, x in show.items() if x[0] == "succeeded"}
    assert got[1, "a.txt"].n_chunks == store.read("chunks").filter("doc_id = 1").count() > 1
    assert ingest(files.filter("doc_id IN (1, 2)"), policy="keep").filter("status = 'succeeded'").count() == 2
    assert ingest(files.filter("false")).count() == 0


def test_read_files_in_order(spark, tmp_path):
    for name, data in (("b.txt", b"two"), ("a.html", b"<h1>Head <b>line</b></h1><p>x</p>"), ("sub/c.bin", b"?"), ("d.docx", docx("<w:p><w:r><w:t>w</w:t></w:r></w:p>"))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = L.read_files(ship(spark), str(tmp_path)).collect()
    assert [(r.name, r.text and r.text.strip(), r.error) for r in got] == [("Head line", "# Head line\n\nx", None), ("b.txt", "two", None), ("d.docx", "w", None), ("c.bin", None, "unsupported format: bin")]


def test_extract_json(spark):
    import json

    cases = {
        None: None, "": None, '{"a": 1}': {"a": 1}, " [1, 2] ": [1, 2], 'so: {"a": {"b": "}"}} done': {"a": {"b": "}"}}, '```json\n{"x": 1}\n``` {"no": 1}': {"x": 1}, "```\n[1]\n```": [1],
        'text [1, {"a": 2}] end': {"a": 2}, '{"a": 1} and {"b": 2}': None, "[1] {": [1], '} {"a"': None, '"s"': "s", "12": 12, '{"a": tru}': None, 'pre {"q": "a\\"b"} post [': {"q": 'a"b'}, "[] {}": {},
        "x {bad} [3]": [3], '日本 {"k": "値🎉"} 語': {"k": "値🎉"}, '{"a": 1,}': None, '1], [2': None, '1, 2': None, '```json\nnope {"y": 1}\n```': {"y": 1},
    }
    table = ship(spark).createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r for r in table.select("i", extract_json(F.col("t")).isNull().alias("none"), F.to_json(extract_json(F.col("t"))).alias("j")).collect()}
    for i, (case, want) in enumerate(cases.items()):
        assert (None if got[i].none else json.loads(got[i].j)) == want, case
    assert spark.range(1).select(extract_json(F.lit("null")).isNull()).first()[0] is False


def test_turns_stream(spark, tmp_path):
    import datetime

    ship(spark)
    row = lambda i: (i % 3, 1, datetime.datetime(2024, 1, 1, 0, 0, i), f"question {i}", f"answer {i}", "simple_qa")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(TN.TURNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.createDataFrame([row(i) for i in range(10)], TN.TURNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda save: stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    run(TN.saver(spark, f"{tmp_path}/t"))
    spark.createDataFrame([row(i) for i in range(10, 17)], TN.TURNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="failed after qa_logs"):
        run(TN.saver(spark, f"{tmp_path}/t", fail_after="qa_logs"))
    assert TN.read(spark, f"{tmp_path}/t", "messages").count() == 20 and TN.read(spark, f"{tmp_path}/t", "qa_logs").count() == 10
    run(TN.saver(spark, f"{tmp_path}/t"))
    run(TN.saver(spark, f"{tmp_path}/t"))
    assert TN.read(spark, f"{tmp_path}/t", "messages").count() == 34 and TN.read(spark, f"{tmp_path}/t", "qa_logs").distinct().count() == 17
    assert sorted((r.session_id, r.title) for r in TN.sessions(spark, f"{tmp_path}/t").collect()) == [(0, "question 0"), (1, "question 1"), (2, "question 2")]


def test_clean_rows_of_any_id(spark):
    rows = [(None, "one\n\n\n\ntwo"), (1, "first of two"), (1, "second of two\n- 3 -"), (None, None), (2, "")]
    got = U.clean_text(ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((r.doc_id or 0, r.cleaned, r.original_chars, r.dropped_lines) for r in got) == [(0, "", 0, 0), (0, "one\n\ntwo", 10, 0), (1, "first of two", 12, 0), (1, "second of two", 19, 1), (2, "", 0, 0)]


def test_no_material(spark):
    asked = ship(spark).createDataFrame([(1, "what is it"), (2, "alpha")], "query_id long, q string")
    evidence = spark.createDataFrame([(1, 1, "...... ?!?!?!", "d"), (2, 1, "beta gamma delta", "d")], "query_id long, idx int, content string, document string")
    assert [(r.query_id, r.sentence, r.score) for r in A.extract_answers(asked, evidence).collect()] == [(2, "beta gamma delta", 0.0)]


def test_long_chains_settle_in_few_rounds(spark, tmp_path, monkeypatch):
    ship(spark).sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(3)
    pairs = {(i, i + 1) for i in range(1, 2000)} | {(3000 + i, 3000 + i + 1 + rng.randrange(3)) for i in range(40)} | {(5000, 5000 + i) for i in range(1, 9)}
    kept = {}
    for i in range(1, 5100):
        kept[i] = not any(kept[a] for a in range(max(1, i - 2000), i) if (a, i) in pairs)
    nodes, table = spark.range(1, 5100).toDF("doc_id"), spark.createDataFrame(sorted(pairs), "a long, b long").repartition(4)
    made = []
    whole = D.cut
    monkeypatch.setattr(D, "cut", lambda df: made.append(1) or whole(df))
    assert {r.doc_id: r.kept for r in D.greedy_keep(nodes, table).collect()} == kept and len(made) < 50
    assert {r.doc_id: r.kept for r in D.greedy_keep(nodes, table.filter("a > 2500"), rounds=1, settled_pairs=5).collect()} == kept | {i: True for i in range(1, 2500)}
    with pytest.raises(RuntimeError):
        D.greedy_keep(nodes, spark.createDataFrame([(2, 1), (1, 2)], "a long, b long")).collect()


def test_settings():
    text = "\ufeff# a comment\nCHUNK_SIZE=99999\nMMR_LAMBDA = '0.5' \nRERANK_TOP_N=7 # seven\nno line\nRERANK_TOP_N=9\nCHUNK_OVERLAP=1.5\nMIN_RELEVANCE_SCORE=-1\n"
    found = of_file(text)
    got = settings({"RERANK_WEIGHT": "0.25", "MMR_LAMBDA": " "}, found)
    assert found["RERANK_TOP_N"] == "7" and got["CHUNK_SIZE"] == 4000 and got["MMR_LAMBDA"] == 0.5 and got["RERANK_TOP_N"] == 7 and got["RERANK_WEIGHT"] == 0.25
    assert got["CHUNK_OVERLAP"] == 80 and got["MIN_RELEVANCE_SCORE"] == 0 and settings()["LONG_TERM_MAX_ITEMS"] == 60


def test_sentence_offsets_are_slices(spark, sf_dir):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, " 一。二！」 x;\n\n y "), (-2, None), (-3, "")], docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = D.sentence_offsets(docs).collect()
    assert all(texts[r.doc_id][r.start : r.start + r.n_chars] == r.content for r in rows)
    assert [r.content for r in sorted((r for r in rows if r.doc_id == -1), key=lambda r: r.ordinal)] == ["一。", "二！」", "x;", "y"]
