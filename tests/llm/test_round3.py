"""Token files, vector codes and centroid clusters: awkward rows, brute force and round trips."""

import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import clusters, langid, packing, pii, quality_model, quality_rules, queries, token_files, vector_codes
from corpusloom.llm.common import shared_dir
from corpusloom.plans.session import ship

LONG = " ".join(f"word{i % 611} and{i % 7}\n" for i in range(9000))
TEXTS = [None, "", " ", "\n\n \t", "a", "a b  c  d \n\ne", "don't stop\r\n\r\n  now", "日本語 テキスト\u3000 🎉", "x" * 3000, LONG, "a<|endoftext|> b <|endoftext|>", "same", "same"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.tokenizer_path())


def test_piece_ids(library):
    rng = random.Random(5)
    signs = ["the", "Word", "'s", "12", " ", "  ", "\n", "\t", " ", " ", "　", "\u0085", " ", "é", "日", "​", ".", "<", "<|endoftext|>", "\x1c", "🎉"]
    texts = TEXTS + ["".join(rng.choices(signs, k=rng.randrange(1, 30))) for _ in range(3000)]
    ids_of = token_files.PieceIds(token_files.tokenizer_path())
    for at in range(0, len(texts), 700):
        flat, n = ids_of(pa.array(texts[at : at + 700], pa.string()))
        ends = np.cumsum(n)
        for text, a, b in zip(texts[at : at + 700], ends - n, ends, strict=True):
            assert flat[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_file_format():
    import zstandard

    docs = [(7, [1, 2, 50256]), (None, [0]), (7, list(range(5000))), (-3, []), (9, [5] * 70000)]
    out = io.BytesIO()
    out.close, closed = (lambda: None), out.close
    writer = token_files.Writer(out, 2)
    for i, ids in docs:
        writer.add(i, np.array(ids, "<u4"))
    writer.close()
    data = out.getvalue()
    closed()
    assert writer.size == len(data)
    # Any zstandard decoder skips the index and the seek table.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(np.array(ids, "<u2").tobytes() for _, ids in docs)
    reader = token_files.Reader(io.BytesIO(data), len(data))
    assert reader.doc_ids.to_pylist() == [i for i, _ in docs]
    assert [(i, x.tolist()) for i, x in reader.read([2, 4])] == [(2, docs[2][1]), (4, docs[4][1])] and reader.decompressed == 2
    assert [x.tolist() for _, x in reader.read(range(5))] == [ids for _, ids in docs]
    for at in (reader.offsets[2] + 20, reader.offsets[5] + 30, len(data) - 12):
        broken = bytearray(data)
        broken[at] ^= 255
        with pytest.raises(Exception):
            list(token_files.Reader(io.BytesIO(bytes(broken)), len(data)).read(range(5)))


def test_token_files(spark, library):
    ship(spark)
    rows = [(i, t, 0, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 0, "x"), (4, "again", 0, "x"), (-5, "first", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, file string").repartition(3)
    folder = shared_dir(spark)
    manifest = token_files.write(docs, folder, token_files.tokenizer_path(), file_bytes=200)
    assert manifest.count() >= 3
    got = token_files.contents(manifest, folder).orderBy("start").collect()
    ids_of = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want = sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in (ids_of(r[1]) for r in rows))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    found = token_files.fetch(manifest, folder, spark.createDataFrame([(9,), (4,), (4,), (None,), (77,)], "i long")).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in found) == sorted([(9, ids_of(LONG)), (4, ids_of("a")), (4, ids_of("again"))])
    none = token_files.write(docs.filter("false"), shared_dir(spark), token_files.tokenizer_path())
    assert token_files.contents(none, folder).count() == 0 and token_files.fetch(none, folder, docs.select("doc_id")).count() == 0


def test_token_files_of_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    at = 0
    rows = token_files.query(ship(spark), sf_dir).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = np.array([*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_centroid_clusters"])
def test_vectors_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](ship(spark), sf_dir).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 100


def vectors(spark, rows, kind="int"):
    return ship(spark).createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<float>, label {kind}, v string, cluster int").repartition(3)


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(("n", "k", "spread"), [(1500, 64, 40), (300, 5, 2), (40, 64, 400), (200, 7, 0), (1, 1, 9)])
def test_forest_by_brute_force(n, k, spread):
    rng = np.random.default_rng(n)
    v = rng.integers(-spread, spread + 1, (n, 32))
    v[::3] = v[0]
    points, books = vector_codes._points(v, 16), vector_codes._points(v[:k], 16).reshape(16, min(n, k), 2)
    forest = vector_codes.plant(points, 16)
    inside = np.repeat(np.arange(len(forest.start)), forest.stop - forest.start)
    mine = np.concatenate([forest.order[a:b] for a, b in zip(forest.start, forest.stop, strict=True)])
    assert (np.sqrt(((points[mine] - points[forest.centre[inside]]) ** 2).sum(1)) <= forest.radius[inside] + 1e-9).all()
    total = np.zeros_like(forest.sums)
    np.add.at(total, inside, points[mine])
    assert (total == forest.sums).all()
    sums, counts, code, error = vector_codes.assign(points, forest, books, codes=True)
    far = ((points.reshape(16, n, 1, 2) - books[:, None]) ** 2).sum(-1)
    assert (code == far.argmin(2).reshape(-1)).all() and (error == far.min(2).reshape(-1)).all()
    want = np.zeros_like(sums)
    np.add.at(want, (np.repeat(np.arange(16), n), code), points)
    assert (want == sums).all() and (counts.sum(1) == n).all()


def codes_by_hand(v, ids, k=64, rounds=2):
    parts = v.reshape(len(v), 16, -1)
    books = parts[np.argsort(ids, kind="stable")[:k]].copy()
    for r in range(rounds + 1):
        far = ((parts[:, None] - books[None]) ** 2).sum(-1)
        code = far.argmin(1)
        if r < rounds:
            for p in range(16):
                for e in range(len(books)):
                    own = parts[code[:, p] == e, p]
                    if len(own):
                        books[e, p] = own.sum(0) // len(own)
    return ["".join(f"{c:02x}" for c in row) for row in code], far.min(1).sum(1), books


def test_vector_codes(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(300, 32)) / 8).astype(np.float32)
    v[50:150] = v[50]
    rows = [(i, x.tolist(), None if i % 3 else i % 2) for i, x in enumerate(v)]
    odd = [(900, None, 1), (901, [None] * 32, 1), (902, [NAN] * 32, 1), (903, [INF] * 32, 1), (904, [1.0] * 8, 1), (905, [], 1)]
    got = {r.vec_id: r for r in vector_codes.compress(vectors(spark, rows + odd), block=64).collect()}
    code, error, books = codes_by_hand(np.floor(256 * v.astype(float)).astype(int), np.arange(300))
    assert len(got) == 300 and all((got[i].code, got[i].error) == (code[i], error[i]) for i in range(300))
    digest = hashlib.sha256(",".join(map(str, books.transpose(1, 0, 2).reshape(-1).tolist())).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got.values()} == {digest}
    for label in (None, 0, 1):
        assert {r.label_error for i, r in got.items() if r.label == label} == {sum(error[i] for i in range(300) if got[i].label == label)}
    # Null and repeated ids, lengths that don't come out even, huge components, nothing at all.
    few = vector_codes.compress(vectors(spark, [(1, [1e30] * 20, 1), (None, [-1e30] * 20, None), (1, [0.5] * 20, 1), (1, [0.5] * 20, 1)])).collect()
    assert len(few) == 4 and all(len(r.code) == 32 for r in few)
    assert vector_codes.compress(vectors(spark, odd[:4])).count() == 0
    assert vector_codes.compress(vectors(spark, []).withColumn("label", F.lit("a"))).count() == 0


@pytest.mark.parametrize(("k", "spread"), [(1, 3), (2, 1), (8, 30), (20, 2), (60, 300)])
def test_search_by_brute_force(k, spread):
    rng = np.random.default_rng(k)
    x = rng.integers(-spread, spread + 1, (400, 6))
    c = x[:k].copy()
    b, full = clusters.first_scan(x, c), 0
    for turn in range(12):
        far = ((x[:, None] - c[None]) ** 2).sum(-1)
        assert (b.nearest == far.argmin(1)).all()
        others = far.astype(float)
        others[np.arange(400), b.nearest] = np.inf
        assert (b.upper >= np.sqrt(far.min(1)) - 1e-6).all() and (b.lower <= np.sqrt(others.min(1)) + 1e-6).all()
        new = c.copy()
        for i in range(k):
            if (b.nearest == i).any():
                new[i] = x[b.nearest == i].sum(0) // (b.nearest == i).sum()
        if turn % 4 == 3:
            new[rng.integers(k)] += rng.integers(-3, 4, 6)
        full += clusters.search(x, new, np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-9), b)
        c = new
    assert full < 12 * k * 400 or k <= 2


def test_clusters(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(500, 64)) / 8).astype(np.float32)
    v[100:300] = v[100]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(500, v[0].tolist(), 0), (500, v[0].tolist(), 0)]
    odd = [(900, None, 1), (901, [1.0] * 63, 1), (902, [NAN] * 64, 1), (903, [INF] * 64, 1), (904, [None] * 64, 1)]
    got = clusters.cluster(vectors(spark, rows + odd), block=50).collect()
    x = np.floor(1024 * np.array([r[1] for r in rows], float)).astype(int)
    ids = [r[0] for r in rows]
    c = x[np.argsort([hashlib.sha256(f"3:{i}".encode()).hexdigest() for i in ids], kind="stable")[:8]].copy()
    for turn in range(11):
        far = ((x[:, None] - c[None]) ** 2).sum(-1)
        own = far.argmin(1)
        if turn < 10:
            c = np.array([x[own == i].sum(0) // (own == i).sum() if (own == i).any() else c[i] for i in range(8)])
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    least = far.min(1)
    want = [(i, o, d, least[own == o].sum(), least.sum(), digests[o]) for i, o, d in zip(ids, own, least, strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)
    few = clusters.cluster(vectors(spark, [(None, [1e30] * 64, 1), (1, [-1e30] * 64, 1), (1, [-1e30] * 64, 1)])).collect()
    assert sorted(r.cluster for r in few) in ([0, 0, 2], [0, 1, 1], [0, 0, 1]) and all(r.distance == 0 for r in few)
    assert clusters.cluster(vectors(spark, odd)).count() == 0 and clusters.cluster(vectors(spark, [])).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loom_")]


def test_pii_long_runs_of_digits(spark):
    import time

    model = pii.Trees([], 20.0, 0.5)
    cases = ["0" * 5000 + "1.2.3.4", "1." * 2000 + "1", "7" * 2_000_000, "a@b.cc " * 20_000, "key-1234567890abc " * 20_000, "x" * 1000 + " 00300.1.1.1"]
    for text in cases:
        begin = time.perf_counter()
        good, added = pii.all_spans(text, model)
        assert time.perf_counter() - begin < 20
    assert ("ip", 0, 5007) in pii.base_spans(cases[0])[0] and not pii.base_spans(cases[-1])[0]
    got = pii.find_pii(ship(spark).createDataFrame(list(enumerate(cases)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert got[0].n_ip == 1 and got[3].n_email == 20_000


def test_pii_threshold():
    p, t = np.array([0.9] * 4 + [0.8] * 6 + [0.7] * 90 + [0.4] * 10), np.array([1] * 4 + [1] * 6 + [1] * 80 + [0] * 10 + [1] * 10)
    for seed in range(5):
        order = np.random.default_rng(seed).permutation(len(p))
        assert pii.lowest_score(p[order], t[order], 0.95) == 0.8
    assert pii.lowest_score(p, t, 0.85) == 0.7 and pii.lowest_score(p, 0 * t, 0.5) == 2.0


def test_pii_precision_and_secrets(spark):
    import re

    docs = ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    good = bad = 0
    for text in set(texts.values()):
        base, failed = pii.base_spans(text)
        for span in pii.candidates(text) if pii.worth(text) else []:
            label = pii.weak_label(text, span, pii.Held(base), pii.Held(failed))
            own = not any(a < span[2] and span[1] < b for _, a, b in base)
            if own and label is not None and model.of(text).score(np.array([pii.features(text, span)]))[0] >= model.threshold:
                good, bad = good + label, bad + 1 - label
    assert good >= 0.99 * (good + bad) > 10
    for r in pii.find_pii(docs, model).collect():
        found = set(r.spans.split(","))
        for m in re.finditer(r'token = "([^"]+)"', texts[r.doc_id]):
            assert f"secret:{m.start(1)}:{m.end(1)}" in found
    mixed = pii.fit(docs.orderBy(F.desc("doc_id")).repartition(5))
    assert mixed == model


def test_decided_by_own_text(spark, sf_dir):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(90000 + i, t) for i, t in enumerate(["²³½", "①②", "Ⅷ", "  the end ", " 12 the", "... le "] * 20)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd)
    model = langid.fit(docs)
    by = [{r.doc_id: (r.lang_pred, r.score) for r in langid.predict(rows.repartition(n), model).collect()} for n in (1, 3, 7)]
    assert by[0] == by[1] == by[2]
    assert all(by[0][90000 + i] == ("und", 0.0) for i in range(120) if i % 6 < 3)
    scores = [{r.doc_id: round(r.score, 9) for r in quality_model.quality_scores(rows.repartition(n)).collect()} for n in (1, 7)]
    assert scores[0] == scores[1]


def test_codewords_by_brute_force():
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 9):
        code = langid.codewords(k)
        trust = rng.random(code.shape)
        model = langid.Model([f"l{i}" for i in range(k)], code, rng.normal(size=(50, code.shape[1])), trust / np.maximum(trust.sum(1, keepdims=True), 1e-9))
        counts = rng.integers(0, 4, (30, 50)).astype(float)
        best, score = model.decode(counts)
        for row, b, s in zip(counts, best, score, strict=True):
            if k == 1:
                assert (b, s) == (0, 1.0)
                continue
            margin = [sum(c * w for c, w in zip(row, model.weights[:, j], strict=True)) * min(row.sum(), langid.FULL_EVIDENCE) / row.sum() for j in range(code.shape[1])]
            loss = [sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(model.trust[i], code[i], margin, strict=True)) for i in range(k)]
            assert b == int(np.argmin(loss)) and s == pytest.approx(np.exp(-min(loss)) / sum(np.exp(-x) for x in loss))


def test_near_dedup_by_row(spark, sf_dir):
    import corpus_pipeline as P

    a = " ".join(f"w{i}" for i in range(100))
    rows = [(1, a), (7, a + " more"), (7, "a text of its own that nothing else is like"), (7, None), (7, None), (9, a + " still more"), (None, a), (3, "same words here"), (3, "same words here")]
    docs = ship(spark).createDataFrame([(*r, "en", "s", 1, "x", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, flag boolean")
    got = P.near_dedup(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(1, a), (7, rows[2][1]), (7, ""), (0, a), (3, "same words here")])


def spark_hash(*words):
    """Spark's xxhash64 of several strings: each is hashed with the hash before it as seed."""
    import xxhash

    h = 42
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def test_quality_ratio_by_brute_force(spark, sf_dir):
    import collections
    import math
    import re

    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0")
    good = {r.doc_id for r in trusted.collect()}
    grams = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams[r.doc_id] = [spark_hash(x) % quality_rules.BUCKETS for x in w] + [spark_hash(x, y) % quality_rules.BUCKETS for x, y in zip(w, w[1:])]
    every, own = (collections.Counter(g for i in ids for g in grams[i]) for ids in (grams, good & set(grams)))
    n, m = sum(every.values()), sum(own.values())
    weight = [math.log((own[b] + 1) / (m + quality_rules.BUCKETS)) - math.log((every[b] + 1) / (n + quality_rules.BUCKETS)) for b in range(quality_rules.BUCKETS)]
    rows = quality_rules.quality_rules(docs, trusted).collect()
    for r in rows:
        ratio = sum(weight[g] for g in grams[r.doc_id]) / len(grams[r.doc_id]) if grams[r.doc_id] else 0.0
        assert r.ratio == pytest.approx(ratio, abs=1e-9) and r.kept == (not r.base_failed and r.ratio >= quality_rules.MIN_RATIO)
    assert any(r.kept for r in rows) and any(not r.kept and not r.base_failed for r in rows)


def test_label_model_by_brute_force():
    rng = np.random.default_rng(8)
    votes = rng.integers(-1, 2, (400, 4))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    few, every = quality_model.fit_labels(patterns, counts), quality_model.fit_labels(votes, np.ones(len(votes)))
    assert few.prior == pytest.approx(every.prior) and np.allclose(few.rates, every.rates)
    for row in patterns[:20]:
        likely = [p * np.prod([few.rates[j, kind, v + 1] for j, v in enumerate(row)]) for kind, p in ((0, 1 - few.prior), (1, few.prior))]
        assert few.posterior(row[None])[0] == pytest.approx(likely[1] / sum(likely))


def test_deficits_over_lanes(spark, sf_dir):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, packing.tokenizer_path(), lane_tokens=12_000).toPandas()
    rows["at"] = rows.sequence_id * packing.WINDOW + rows.offset
    rows = rows.sort_values("at").reset_index(drop=True)
    total = rows.length.sum()
    assert total > 8 * 12_000 and (rows["at"] == rows.length.cumsum() - rows.length).all()
    end = rows["at"] + rows.length
    for source, own in rows.groupby("source"):
        share = own.length.sum() / total
        behind = np.abs(share * end - rows.length.where(rows.source == source, 0).cumsum()).max()
        assert behind < 12_000, (source, behind)  # what a lane holds too much of one source, the next ones make good
